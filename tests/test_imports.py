import io
import json
import sqlite3
import zipfile

import pytest
from pyspark.sql import functions as F

from notemill.plans import upsert
from notemill.plans.views import Base, View, in_view, is_blank_record, ordered_columns
from notemill.sources import files, registry, tables
from notemill.streaming import imports

NOTE = "folder string, title string, source_id string, mtime long, content string, ordinal int"
STATE = "path string, source_id string, mtime long, content string"


def planned(spark, notes, state, mode="update"):
    df = upsert.plan(spark.createDataFrame(notes, NOTE), spark.createDataFrame(state, STATE), mode)
    return [(r.path, r.disposition) for r in df.orderBy("ordinal").collect()]


def test_plan(spark):
    state = [("F/moved.md", "s1", 10, "a"), ("F/b.md", None, 10, "b"), ("F/c.md", "other", 10, "c"), ("F/D.md", "s4", 10, "d"), ("F/e.md", "s5", 10, "e"), ("F/f.md", "s6", 10, "same")]
    notes = [
        ("F", "a", "s1", 10, "a", 0), ("F", "b", "s2", 11, "b2", 1), ("F", "c", "s3", 10, "x", 2), ("F", "d", "s4", 9, "d2", 3), ("F", "e", "s5", 20, "e2", 4), ("F", "f", "s6", None, "same", 5),
        ("F", "new", "s7", 1, "n", 6), ("F", "NEW", "s8", 1, "n", 7), ("", "root", None, 1, "r", 8), ("F", "again", "s1", 99, "q", 9),
    ]
    assert planned(spark, notes, state) == [
        ("F/moved.md", "unchanged"), ("F/b.md", "update"), ("F/c 1.md", "create"), ("F/D.md", "preserve"), ("F/e.md", "update"), ("F/f.md", "unchanged"),
        ("F/new.md", "create"), ("F/NEW 1.md", "create"), ("root.md", "create"), ("F/again.md", "create"),
    ]
    assert planned(spark, notes[:2], state, "skip") == [("F/moved.md", "skip"), ("F/b.md", "skip")]
    assert planned(spark, notes[1:2] + notes[6:7], state, "copy") == [("F/b 1.md", "copy"), ("F/new.md", "create")]
    with pytest.raises(ValueError):
        planned(spark, notes, state, "overwrite")


def test_a_second_run_changes_nothing(spark):
    notes = spark.createDataFrame([("F", f"n{i % 4}", f"s{i}", 5, f"c{i}", i) for i in range(10)], NOTE)
    empty = spark.createDataFrame([], STATE)
    first = upsert.applied(upsert.plan(notes, empty), notes, empty)
    assert first.count() == 10 and first.select("path").distinct().count() == 10
    again = upsert.plan(notes, first)
    assert [tuple(r) for r in upsert.report(again).collect()] == [("unchanged", 10)]
    assert sorted(map(tuple, upsert.applied(again, notes, first).collect())) == sorted(map(tuple, first.collect()))


def test_new_notes_are_dealt_out(spark):
    """Notes that match none of a held state have one and the same key in a join on the match: it would give them all to one task."""
    notes = spark.range(2_000).selectExpr("'F' AS folder", "concat('n', id % 1500) AS title", "concat('s', id) AS source_id", "5L AS mtime", "'c' AS content", "id AS ordinal")
    state = spark.range(1_900, 2_100).selectExpr("concat('Old/n ', id, '.md') AS path", "concat('s', id) AS source_id", "5L AS mtime", "'c' AS content")
    state = state.unionByName(spark.createDataFrame([("F/N3.md", "else", 5, "x"), ("F/n3 1.md", None, 5, "x"), ("F/n4 2.MD", None, 5, "x")], STATE))
    settings_ = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    before = {k: spark.conf.get(k) for k in settings_}
    try:
        for k, v in settings_.items():
            spark.conf.set(k, v)
        planned = upsert.plan(notes, state)
        spread = [r["count"] for r in planned.groupBy(F.spark_partition_id()).count().collect()]
        got = {r.ordinal: (r.path, r.disposition) for r in planned.collect()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert sum(spread) == 2_000 and max(spread) < 1_000
    want = {k: (f"F/n{k % 1500}{' 1' if k >= 1500 else ''}.md", "create") for k in range(1_900)} | {k: (f"Old/n {k}.md", "unchanged") for k in range(1_900, 2_000)}
    want |= {3: ("F/n3 2.md", "create"), 1503: ("F/n3 3.md", "create")}
    assert got == want


def test_attachments_and_types(spark):
    found = spark.createDataFrame([("a", 1, "x"), ("b", 2, "y"), ("c", 3, "z")], "path string, size int, digest string")
    there = spark.createDataFrame([("a", 1, "x"), ("b", 9, "y")], "path string, size int, digest string")
    assert {r.path: r.verdict for r in upsert.attachment_verdict(found, there).collect()} == {"a": "same", "b": "stale", "c": "new"}
    folder = spark.range(1).select(*[upsert.attachment_folder(m, "att", F.lit("n/f")).alias(m) for m in ("vault", "folder", "note", "subfolder")])
    assert tuple(folder.first()) == ("", "att", "n/f", "n/f/attachments")
    types = lambda *r: spark.createDataFrame(r, "name string, kind string")
    assert [tuple(r) for r in upsert.new_types(types(("a", "text")), types(("a", "number"), ("b", "date"))).collect()] == [("b", "date")]


def test_views(spark):
    df = spark.createDataFrame([("a", ["v"], 2, ""), ("b", [], 1, "t")], "name string, views array<string>, n int, t string")
    base = Base([View("v", in_view("v"), ["name", "double"]), View("all", sort=[F.desc("n")], limit=1)], {"double": F.col("n") * 2})
    assert [tuple(r) for r in base.apply(df, "v").collect()] == [("a", 4)]
    assert base.apply(df, "all").first().name == "a"
    assert [v.name for v in base.merged(Base([View("all", columns=["n"]), View("w")])).views] == ["v", "all", "w"]
    assert ordered_columns(["b", "zz"], ["a", "b"]) == ["name", "b"] and ordered_columns([], ["a", "b"]) == ["name", "a", "b"]
    assert [r.name for r in df.where(is_blank_record({"t": "text", "views": "multitext"})).collect()] == []


def test_files(spark, tmp_path):
    inner, outer = io.BytesIO(), io.BytesIO()
    with zipfile.ZipFile(inner, "w") as z:
        z.writestr("deep.md", "deep")
    with zipfile.ZipFile(outer, "w") as z:
        z.writestr("a/note.md", "hi")
        z.writestr("__MACOSX/a/note.md", "no")
        z.writestr(".hidden", "no")
        z.writestr("part.zip", inner.getvalue())
        z.writestr("n.textbundle/text.md", "t")
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "x.zip").write_bytes(outer.getvalue())
    (tmp_path / "in" / "bad.zip").write_bytes(b"not a zip")
    found = files.scan(spark, str(tmp_path / "in"), "*.zip")
    assert {(r.basename, r.extension) for r in found.collect()} == {("x", "zip"), ("bad", "zip")}
    entries = files.zip_entries(found, nested=True)
    got = {r.entry: bytes(r.content).decode() for r in entries.where("error IS NULL").collect()}
    assert got == {"a/note.md": "hi", "deep.md": "deep", "n.textbundle/text.md": "t"}
    assert entries.where("error IS NOT NULL").count() == 1
    assert [(r.bundle, r.inner) for r in files.bundles(entries.where("error IS NULL")).collect()] == [("n.textbundle", "text.md")]


def test_text_and_urls(spark):
    raw = [b"\xef\xbb\xbfa", "é".encode("utf-16"), b'<?xml encoding="ISO-8859-1"?>\xe9', b"\xc3\xa9", b"charset=nonsense x", None]
    df = spark.createDataFrame([(bytearray(b) if b else None,) for b in raw], "c binary")
    assert [r.x for r in df.select(files.decoded(F.col("c")).alias("x")).collect()] == ["a", "é", '<?xml encoding="ISO-8859-1"?>é', "é", "charset=nonsense x", None]
    urls = spark.createDataFrame([("data:text/plain;base64,aGk=",), ("data:,a%20+b",), ("http://x",)], "u string")
    assert [None if r.x is None else bytes(r.x) for r in urls.select(files.data_url(F.col("u")).alias("x")).collect()] == [b"hi", b"a +b", None]


def test_csv(spark, tmp_path):
    (tmp_path / "t.csv").write_text('Title , Tags,Note\n"a, b"," x ","say ""hi""\nthere"\n\nshort\n')
    got = [tuple(r) for r in tables.read_csv(spark, str(tmp_path / "t.csv")).collect()]
    assert got == [("a, b", "x", 'say "hi"\nthere'), ("short", "", "")]
    assert tables.read_csv(spark, str(tmp_path / "t.csv"), header=False).columns == ["Column 1", "Column 2", "Column 3"]


def test_keep(spark):
    note = {"title": "T", "textContent": "see #a! #b", "color": "RED", "isPinned": True, "isArchived": False, "isTrashed": False, "createdTimestampUsec": 1, "userEditedTimestampUsec": 2, "listContent": [{"text": "x", "isChecked": True}, {"text": "", "isChecked": False}], "attachments": [{"filePath": "p.png"}], "labels": [{"name": "My label"}]}
    df = spark.createDataFrame([(json.dumps(note),), ("{broken",), (json.dumps({"title": "no times"}),), (json.dumps(note | {"isTrashed": True}),)], "text string")
    notes = tables.keep_notes(df)
    assert [r.valid for r in notes.collect()] == [True, False, False, True]
    kept = tables.keep_selected(notes)
    row = kept.select(tables.keep_tags().alias("tags"), tables.keep_body().alias("body")).collect()
    assert len(row) == 1 and row[0].tags == ["Keep/Color/Red", "Keep/Pinned", "Keep/Attachment", "Keep/Label/My-label"]
    assert row[0].body == "\nsee #a #b\n\n- [X] x\n\n![[p.png]]"


def test_outline_and_xml(spark, tmp_path):
    graph = [{"title": "P", "uid": "p", "children": [{"string": "a", "uid": "a", "children": [{"string": "b", "uid": "b", "heading": 2}]}, {"string": "c", "uid": "c"}]}]
    (tmp_path / "g.json").write_text(json.dumps(graph))
    got = {r.uid: (r.parent_uid, r.path, r.heading) for r in tables.outline_blocks(spark, str(tmp_path / "g.json")).collect()}
    assert got == {"a": ("p", [0], None), "b": ("a", [0, 0], 2), "c": ("p", [1], None)}
    (tmp_path / "n.enex").write_text("<en-export><note><title>A</title><content>x</content><created>20240102T030405Z</created><tag>one</tag></note><note><title>B</title><tag>one</tag><tag>two</tag><note-attributes><source>web.clip7</source></note-attributes></note></en-export>")
    notes = tables.xml_notes(spark, str(tmp_path / "n.enex"))
    assert {r.title: r.tag for r in notes.collect()} == {"A": ["one"], "B": ["one", "two"]}
    assert [(r.title, str(r.created)) for r in tables.without_clips(notes).collect()] == [("A", "2024-01-02 03:04:05")]


def test_sqlite(spark, tmp_path):
    path = str(tmp_path / "t.sqlite")
    with sqlite3.connect(path) as db:
        db.execute("CREATE TABLE n (Z_PK INTEGER PRIMARY KEY, ZTITLE VARCHAR, ZDATE TIMESTAMP, ZDATA BLOB)")
        db.executemany("INSERT INTO n VALUES (?, ?, ?, ?)", [(i, f"t{i}", i / 2, b"x") for i in range(1, 101)])
        db.execute("CREATE TABLE empty (a INTEGER)")
    tables.register(spark)
    df = spark.read.format("sqlite").option("path", path).option("table", "n").option("partitions", "4").load()
    assert df.rdd.getNumPartitions() == 4 and df.count() == 100
    assert tuple(df.where("z_pk = 7").select("ztitle", "zdate").first()) == ("t7", 3.5)
    assert spark.read.format("sqlite").option("path", path).option("table", "empty").load().count() == 0


def test_registry(spark):
    assert {s.key for s in registry.SOURCES} >= {"csv", "keep", "xml-notes", "sqlite"}
    assert registry.claims(spark).where("extension = 'zip'").count() == 4


def test_stream_goes_on_and_repeats_nothing(spark, tmp_path):
    source, state, marks = (str(tmp_path / n) for n in ("in", "state", "marks"))
    schema = "folder string, title string, source_id string, mtime long, content string"

    def arrive(*notes):
        spark.createDataFrame(notes, schema).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).parquet(source)
        imports.start_import(stream, state, marks).awaitTermination()
        version, rows = imports.current_state(spark, state)
        return version, {r.source_id: (r.path, r.mtime, r.content) for r in rows.collect()}

    first = arrive(("F", "a", "1", 5, "x"), ("F", "a", "2", 5, "y"))[1]
    assert {p for p, *_ in first.values()} == {"F/a.md", "F/a 1.md"} and first["1"][1:] == (5, "x")
    version, held = arrive(("F", "a", "1", 9, "x2"), ("F", "a", "1", 7, "old"), ("G", "b", "3", 1, "z"))
    assert held["1"] == (first["1"][0], 9, "x2") and held["3"] == ("G/b.md", 1, "z") and len(held) == 3
    batch = spark.createDataFrame([("F", "q", "9", 1, "once")], schema)
    imports.apply_batch(batch, 0, state, run="other")
    imports.apply_batch(batch.withColumn("source_id", F.lit("10")), 0, state, run="other")
    assert {r.source_id for r in imports.current_state(spark, state)[1].collect()} == {"1", "2", "3", "9"}
    marks = str(tmp_path / "new marks")  # a new checkpoint counts its batches from 0
    held = arrive(("G", "c", "4", 1, "late"))[1]
    assert set(held) == {"1", "2", "3", "4", "9"} and held["1"][1] == 9
    (tmp_path / "state" / "v=99").mkdir()  # a version without its mark does not count
    assert len(imports.current_state(spark, state)[1].collect()) == 5


def test_a_batch_writes_the_buckets_it_changes(spark, tmp_path):
    schema = "folder string, title string, source_id string, mtime long, content string"
    state = tmp_path / "state"
    want = {f"F/t{k}.md": f"text {k}" for k in range(60)}
    imports.apply_batch(spark.createDataFrame([("F", f"t{k}", str(k), 1, f"text {k}") for k in range(60)], schema), 0, str(state), buckets=8)
    assert len(list((state / "v=0").glob("bucket=*"))) == 8
    for k in range(1, 6):  # one note each: its bucket alone is written
        imports.apply_batch(spark.createDataFrame([("F", "t7", "7", 1 + k, f"new {k}"), ("F", "t9", "9", 1, "text 9")], schema), k, str(state))
        want["F/t7.md"] = f"new {k}"
        assert len(list((state / f"v={k}").glob("bucket=*"))) == 1
        rows = imports.current_state(spark, str(state))[1].collect()
        assert len(rows) == 60 and {r.path: r.content for r in rows} == want
    assert len(list((state / "v=0").glob("bucket=*"))) == 7 and not (state / "v=0" / imports.MARK).exists()
    assert sorted(p.name for p in state.iterdir()) == ["v=0", "v=4", "v=5"]
    imports.apply_batch(spark.createDataFrame([], schema), 6, str(state))  # nothing to write
    assert imports.current_state(spark, str(state))[0] == 6 and imports.current_state(spark, str(state))[1].count() == 60


def test_equal_times_are_settled_by_content(spark, tmp_path):
    schema = "folder string, title string, source_id string, mtime long, content string"
    rows = [("F", "a", "1", 5, f"text {k}") for k in range(20)]
    held = set()
    for k in range(3):
        imports.apply_batch(spark.createDataFrame(rows[k * 5 :] + rows[: k * 5], schema).repartition(k + 1), 0, str(tmp_path / f"s{k}"))
        held.add(imports.current_state(spark, str(tmp_path / f"s{k}"))[1].first().content)
    assert len(held) == 1


def test_deep_outlines_are_read_whole(spark, tmp_path):
    block = {"string": "leaf", "uid": "u14"}
    for k in range(13, -1, -1):
        block = {"string": f"level {k}", "uid": f"u{k}", "children": [block]}
    (tmp_path / "deep.json").write_text(json.dumps([{"title": "P", "uid": "p", "children": [block, {"string": "second", "uid": "v"}]}]))
    got = tables.outline_blocks(spark, str(tmp_path / "deep.json")).collect()
    assert len(got) == 16 and {len(r.path) for r in got if r.uid == "u14"} == {15} and next(r for r in got if r.uid == "v").path == [1]


def test_shared_folder_is_asked_for_off_one_machine(spark, monkeypatch):
    from types import SimpleNamespace

    from notemill import staging

    context = SimpleNamespace(master="spark://host:7077", applicationId="a", getConf=lambda: SimpleNamespace(get=lambda k, d: d))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        staging.shared_dir(SimpleNamespace(sparkContext=context))
    scratch = staging.Scratch()
    df = scratch(spark.range(5), "x")
    assert df.count() == 5 and df.inputFiles()
    scratch.clear()
    assert scratch.frames == []


def test_late_events_do_not_reopen_windows(spark):
    events = spark.createDataFrame([("2024-01-01 10:05", "a", 1.0), ("2024-01-01 10:55", "a", 2.0), ("2024-01-01 11:00", "a", 4.0)], "t string, event_type string, value double").withColumn("ts", F.to_timestamp_ntz("t"))
    got = {str(r.start): (r.n, r.total) for r in imports.window_counts(events).collect()}
    assert got == {"2024-01-01 10:00:00": (2, 3.0), "2024-01-01 11:00:00": (1, 4.0)}


def test_small_entries_go_many_at_a_time(spark, tmp_path):
    """An archive of many files is handed on in large parts: one part a file took over 20 s."""
    import time
    import zipfile

    with zipfile.ZipFile(tmp_path / "many.zip", "w") as archive:
        for k in range(10_000):
            archive.writestr(f"f{k}.txt", f"text {k}")
    began = time.perf_counter()
    rows = files.zip_entries(files.scan(spark, str(tmp_path), "*.zip")).selectExpr("count(*) AS n", "sum(size) AS size", "count(DISTINCT entry, content, mtime) AS different", "count(error) AS failed").first()
    assert tuple(rows) == (10_000, sum(len(f"text {k}") for k in range(10_000)), 10_000, 0) and time.perf_counter() - began < 10


def test_outline_files_are_read_once(spark, tmp_path):
    """One object or a list, with a byte order mark or in UTF-16, a broken file; reading takes no file's bytes again for each block."""
    import json

    page = lambda t, n: {"title": t, "uid": t, "children": [{"string": f"é {k}", "uid": f"{t}{k}", "children": [{"string": "x", "uid": f"{t}{k}x"}]} for k in range(n)]}
    (tmp_path / "a.json").write_text(json.dumps([page("A", 2), page("B", 1)], ensure_ascii=False), "utf-8")
    (tmp_path / "b.json").write_text(json.dumps(page("C", 1), ensure_ascii=False, indent=1), "utf-8-sig")
    (tmp_path / "c.json").write_text(json.dumps([page("D", 1)], ensure_ascii=False), "utf-16")
    (tmp_path / "d.json").write_text('[{"title": "E", "chil')
    rows = tables.outline_blocks(spark, str(tmp_path)).select("page", "uid", "parent_uid", "path", "text").collect()
    want = [(t, f"{t}{k}", t, [k], f"é {k}") for t, n in zip("ABCD", (2, 1, 1, 1)) for k in range(n)]
    want += [(t, f"{u}x", u, [*at, 0], "x") for t, u, _, at, _ in want]
    assert sorted(map(tuple, rows)) == sorted(want)


def test_pages_of_an_outline_are_dealt_to_files(spark, tmp_path):
    """Each page in a file of its own would be one task's, however large it is."""
    import pathlib

    from notemill.reader_queries import outliner_round_trip
    from notemill.staging import shared_dir

    spark.range(30_000).selectExpr("id AS c_custkey", "concat('C', id) AS c_name", "id % 2 AS c_nationkey", "'M' AS c_mktsegment").write.parquet(f"{tmp_path}/customer.parquet")
    spark.sql("SELECT n AS n_nationkey, concat('N', n) AS n_name FROM VALUES (0L), (1L) AS t(n)").write.parquet(f"{tmp_path}/nation.parquet")
    assert outliner_round_trip(spark, str(tmp_path)).count() == 60_000
    made = max(pathlib.Path(shared_dir(spark).removeprefix("file://")).glob("outliner-*"), key=lambda p: p.stat().st_mtime)
    assert len(list(made.glob("file=*/part-*"))) == 3
