import json

from pyspark.sql import functions as F

from notemill.operators import notes
from notemill.sources import exports


def test_table_export(spark, tmp_path):
    base = {
        "tables": [
            {"id": "t1", "name": "Books", "primaryFieldId": "f1", "fields": [{"id": "f1", "name": "Name", "type": "singleLineText"}, {"id": "f2", "name": "Tags", "type": "multipleSelects", "options": {"choices": []}}, {"id": "f3", "name": "N", "type": "number"}],
             "views": [{"id": "v1", "name": "All", "type": "grid"}, {"id": "v2", "name": "X", "type": "block"}], "records": [{"id": "r1", "createdTime": "2024-01-02T03:04:05Z", "fields": {"Name": "A", "Tags": ["x", "y"], "N": 2.5}}, {"id": "r2", "fields": {}}]},
            {"id": "t2", "name": "People", "primaryFieldId": "g1", "fields": [{"id": "g1", "name": "Name", "type": "email"}], "views": [], "records": []},
        ],
        "viewRecords": {"v1": ["r1", "r2"]},
    }
    (tmp_path / "b.json").write_text(json.dumps(base))
    e = exports.table_export(spark, str(tmp_path / "b.json"))
    assert [r.view_id for r in e.views.collect()] == ["v1"] and e.record_view.count() == 2
    got = {r.record_id: (r.Name, r.Tags, r.N) for r in e.typed("t1", {"Name": "singleLineText", "Tags": "multipleSelects", "N": "number"}).collect()}
    assert got == {"r1": ("A", ["x", "y"], 2.5), "r2": (None, None, None)}
    assert {r.record_id: r.is_empty for r in e.empty_records().collect()} == {"r1": False, "r2": True}
    assert {r["name"]: r.type for r in exports.first_fields(e.fields).collect()} == {"Name": "singleLineText", "Tags": "multipleSelects", "N": "number"}


def test_page_export(spark, tmp_path):
    rows = [
        {"id": "p1", "object": "page", "parent": {"type": "workspace", "workspace": True}, "last_edited_time": "2024-01-01T00:00:00Z", "properties": {"Rel": {"relation": [{"id": "p2"}, {"id": "p9"}]}}},
        {"id": "p2", "object": "page", "parent": {"type": "page_id", "page_id": "p1"}, "properties": {}},
    ]
    (tmp_path / "p.json").write_text("\n".join(map(json.dumps, rows)))
    pages = exports.page_export(spark, str(tmp_path / "p.json"))
    assert {(r.id, r.parent_type, r.parent_id) for r in pages.collect()} == {("p1", "workspace", "true"), ("p2", "page_id", "p1")}
    assert [(r.pos, r.target) for r in exports.page_relations(pages, "Rel").orderBy("pos").collect()] == [(0, "p2"), (1, "p9")]


def test_html_export(spark):
    a, b = "a" * 32, "b" * 32
    df = spark.createDataFrame([(f"Top {a}.html",), (f"Top {a}/Sub page {b}.html",), ("index.html",), (f"Top {a}/pic.png",)], "entry string")
    index = exports.html_export_index(df)
    assert {r.id: (r.title, r.parent_ids) for r in index.collect()} == {a: ("Top", []), b: ("Sub page", [a])}
    assert {r.id: r.path for r in exports.chain_paths(index).collect()} == {a: "Top", b: "Top/Sub page"}
    assert {r.id: r.has_children for r in exports.into_own_folder(index).collect()} == {a: True, b: False}


def test_bundles_and_times(spark, tmp_path):
    info = json.dumps({"net.shinyfrog.bear": {"uniqueIdentifier": "U", "creationDate": "2024-01-02T00:00:00Z", "archived": 1}})
    rows = [("n.textbundle/text.md", b"body"), ("n.textbundle/info.json", info.encode()), ("n.textbundle/assets/a.png", b"x"), ("loose.md", b"y")]
    got = exports.bundle_times(exports.bundle_notes(spark.createDataFrame([(e, bytearray(c)) for e, c in rows], "entry string, content binary"))).first()
    assert (got.text, got.assets, got.unique_id, got.archived, str(got.created)) == ("body", ["assets/a.png"], "U", True, "2024-01-02 00:00:00")
    (tmp_path / "t.note").write_text("<note><title>T</title><text>plain &amp;</text><tags><tag>a</tag></tags><create-date>2024-01-02T03:04:05.1234567+00:00</create-date><last-change-date>2024-01-02T03:04:05,5Z</last-change-date></note>")
    note = exports.desktop_notes(spark, str(tmp_path / "t.note")).first()
    assert (note.title, note.text, note.tags, note.created.microsecond, note.changed.microsecond) == ("T", "plain &", ["a"], 123456, 500000)
    pages = spark.createDataFrame([("index.html", "x"), ("e.html", "<h1>Monday, 4 March 2024</h1>")], "name string, html string")
    assert [str(r.day) for r in exports.journal_entries(pages).collect()] == ["2024-03-04"]
    assert str(spark.range(1).select(exports.apple_seconds(F.lit(0)).alias("x")).first().x) == "2001-01-01 00:00:00"


def test_notes(spark):
    df = spark.createDataFrame([("r1", " A ", ["x", "true"], 2.0), ("r2", None, [], None)], "id string, name string, tags array<string>, n double")
    made = {r.id: (r.note_title, r.content) for r in notes.render(df, "name", {"tags": "multitext", "n": "number"}, "T: {{tags}}", "id", "source").collect()}
    assert made["r1"] == ("A", '---\nsource: "r1"\ntags:\n  - "x"\n  - true\nn: 2.0\n---\nT: x, true') and made["r2"] == ("Untitled Record", '---\nsource: "r2"\n---\nT: ')
    kept, log = notes.kept_and_skipped(df, "id", {"no name": F.col("name").isNull(), "large": F.col("n") > 9})
    assert [r.id for r in kept.collect()] == ["r1"] and [tuple(r) for r in log.collect()] == [("skipped", "r2", "no name")]
    assert tuple(notes.log_report(log).first()) == ("skipped", "no name", 1, "r2")
    blocks = spark.createDataFrame([("b1", "x"), ("b2", "y")], "block_id string, text string")
    assert {r.text for r in notes.with_anchors(blocks, blocks.where("block_id = 'b2'")).collect()} == {"x", "y ^b2"}
    links = spark.createDataFrame([("d", "h1"), ("d", "none")], "doc string, fragment string")
    heads = spark.createDataFrame([("d", "h1", "Heading", 0), ("d", "h1", "Later", 1)], "doc string, anchor string, text string, pos int")
    assert {r.fragment: r.heading for r in notes.resolve_fragments(links, heads).collect()} == {"h1": "Heading", "none": None}
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    assert one(notes.standard_links(F.lit("[a](b/c.md) ![i](x.md) [u](http://x.md)"))) == "[[b/c|a]] ![i](x.md) [u](http://x.md)"
    assert one(notes.standard_links(F.lit("[[a]] [[b|c]]"), wiki=False)) == "[a](a.md) [c](b.md)"
    assert one(notes.tidy_markdown(F.lit("* a  \n\n\n\n\t+ b"))) == "- a\n\n    - b"
    png = bytearray(b"\x89PNG\r\n\x1a\n\0\0\0\rIHDR\0\0\0\x20\0\0\0\x10")
    size = spark.createDataFrame([(png,), (bytearray(b"GIF89a\x05\x00\x06\x00"),), (bytearray(b"??"),)], "c binary").select(*[c.alias(n) for c, n in zip(notes.image_size(F.col("c")), "wh")])
    assert [tuple(r) for r in size.collect()] == [(32, 16), (5, 6), (None, None)]
