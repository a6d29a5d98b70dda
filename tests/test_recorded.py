import json
import random

import pytest

from notemill.sources.recorded import export_records, index_of, view_records

ODD = ['a"b', "\\", '\\"', "[", "]}", '{"id":"x","records":[1]}', ",", "é", "\\\\", '"records": [', "\n"]


def document(seed):
    rng = random.Random(seed)
    value = lambda i: rng.choice([rng.choice(ODD), "".join(rng.choices(ODD, k=rng.randint(0, 6))), i, None, [1, {"a": ["]"]}], True])
    record = lambda t, i: {"id": f"{t}r{i}", "createdTime": f"2024-01-{1 + i % 28:02d}T00:00:00.000Z", "fields": {rng.choice(ODD) + str(k): value(i) for k in range(rng.randint(0, 4))}}
    made = [
        {"id": f"t{t}", "name": rng.choice(ODD), "fields": [{"id": "f", "name": "records", "options": {"choices": [1, 2]}}], "views": [{"id": "v", "visibleFieldIds": ["f"]}], "records": [record(f"t{t}", i) for i in range(n)]}
        for t, n in enumerate([0, 1, 57, 200])
    ]
    made[2] = {k: made[2][k] for k in ("name", "records", "fields", "id", "views")}  # the id behind the records
    return {"tables": made, "viewRecords": {"v1": [f"t3r{i}" for i in range(150)], "v2": [], 'odd"[': ["t1r0"]}}


@pytest.mark.parametrize(("indent", "block"), [(None, 97), (None, 1000), (2, 331), (2, 10**7)])
def test_ranges_give_all_records(spark, tmp_path, indent, block):
    doc = document(indent or 1)
    path = tmp_path / "base.json"
    path.write_text(json.dumps(doc, indent=indent, ensure_ascii=bool(indent)))
    got = sorted((r.table_id, r["at"], r.record_id, r.created_time, dict(r.fields)) for r in export_records(spark, str(path), block=block).collect())
    text = lambda v: v if isinstance(v, str) or v is None else json.dumps(v, ensure_ascii=False, separators=(",", ":"))
    want = [(t["id"], r["id"], r["createdTime"], {k: text(v) for k, v in r["fields"].items()}) for t in doc["tables"] for r in t["records"]]
    assert [(t, i, c, f) for t, _, i, c, f in got] == want
    shown = sorted((r.view_id, r.record_id) for r in view_records(spark, f"file://{path}", block=block).collect())
    assert shown == sorted((v, i) for v, ids in doc["viewRecords"].items() for i in ids)


def test_filters_are_pushed(spark, tmp_path, capsys):
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    doc = document(3)
    path = tmp_path / "base.json"
    path.write_text(json.dumps(doc))
    whole = export_records(spark, str(path), block=1000)
    own = export_records(spark, str(path), only=["x"], block=1000).where("table_id = 't1' AND created_time >= '2024-01-01' AND record_id IN ('t1r0', 'q')")
    assert [(r.record_id, dict(r.fields)) for r in own.collect()] == [("t1r0", {})]
    own.explain("formatted")
    assert "PushedFilters: [IsNotNull(table_id), IsNotNull(created_time), EqualTo(table_id,t1)" in capsys.readouterr().out
    assert own.rdd.getNumPartitions() < 3 < 8 < whole.rdd.getNumPartitions()


def test_other_documents(spark, tmp_path):
    for k, text in enumerate(["", "{}", '{"tables": []}', '{"tables": [{"id": "t", "records": []}], "viewRecords": {}}', '[{"records": [{"id": 1}]}]']):
        path = tmp_path / f"{k}.json"
        path.write_text(text)
        assert export_records(spark, str(path), block=5).collect() == view_records(spark, str(path), block=5).collect() == []
    assert index_of(spark, str(tmp_path / "1.json"))["arrays"] == []


def test_a_document_in_parts(spark, tmp_path, monkeypatch):
    """Files of a folder, cut anywhere, are one document in the order of their names; its blocks are no more than allowed."""
    from notemill.sources import recorded

    text = json.dumps(document(4), ensure_ascii=False).encode()
    (tmp_path / "whole.json").write_bytes(text)
    (tmp_path / "parts").mkdir()
    for k, at in enumerate(range(0, len(text), 1013)):
        (tmp_path / "parts" / f"part-{k:05d}").write_bytes(text[at : at + 1013])
    (tmp_path / "parts" / "_SUCCESS").write_bytes(b"")
    monkeypatch.setattr(recorded, "MOST_BLOCKS", 7)
    index = index_of(spark, str(tmp_path / "parts"), 97)
    assert len(index["states"]) <= 7 and len(index["files"]) > 7
    rows = lambda df: sorted((r[0], *map(str, r[1:])) for r in df.collect())
    assert rows(export_records(spark, str(tmp_path / "parts"), index=index)) == rows(export_records(spark, str(tmp_path / "whole.json"))) != []
    assert rows(view_records(spark, str(tmp_path / "parts"), index=index)) == rows(view_records(spark, str(tmp_path / "whole.json"))) != []


def test_views_are_joined_by_their_own_size(spark, tmp_path):
    """The few ranges that hold a view's records do not make it small: its records are not broadcast beyond the limit."""
    path = tmp_path / "base.json"
    path.write_text(json.dumps({"tables": [{"id": "t", "records": [{"id": f"r{k}", "createdTime": "2024"} for k in range(3000)]}], "viewRecords": {"v": [f"r{k}" for k in range(0, 3000, 2)]}}))
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "20000")
    try:
        index = index_of(spark, str(path), 10_000)
        joined = export_records(spark, str(path), index=index).join(view_records(spark, str(path), index=index), "record_id", "left")
        assert sorted((r.record_id, r.view_id) for r in joined.collect()) == sorted((f"r{k}", None if k % 2 else "v") for k in range(3000))
        plan = joined._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
        assert "SortMergeJoin" in plan and "Broadcast" not in plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
