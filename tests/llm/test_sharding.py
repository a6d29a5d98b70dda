import itertools
import zlib

import numpy as np

from notemill.llm.sharding import contiguous_cuts, shard_documents, smallest_capacity, write_shards


def brute_capacity(sizes, shards):
    n = len(sizes)
    best = None
    for cuts in itertools.combinations_with_replacement(range(n + 1), shards - 1):
        edges = [0, *cuts, n]
        worst = max(sum(sizes[a:b]) for a, b in zip(edges, edges[1:]))
        best = worst if best is None else min(best, worst)
    return best


def test_capacity_is_the_least():
    rng = np.random.default_rng(0)
    for _ in range(60):
        sizes = rng.integers(1, 30, rng.integers(1, 9))
        for shards in (1, 2, 3, 4):
            capacity = smallest_capacity(sizes, shards)
            assert capacity == brute_capacity(sizes.tolist(), shards)
            cuts = contiguous_cuts(sizes, shards)
            assert len(cuts) == shards + 1 and (np.diff(cuts) >= 0).all()
            assert max(sizes[a:b].sum() for a, b in zip(cuts, cuts[1:])) == capacity


def test_shards_are_even():
    sizes = np.random.default_rng(1).integers(1, 100, 4000)
    cuts = contiguous_cuts(sizes, 40)
    load = [sizes[a:b].sum() for a, b in zip(cuts, cuts[1:])]
    assert max(load) - min(load) < 200


def test_documents(spark, tmp_path):
    rows = [(i, f"text {i % 97} " * (i % 7), 3, "x") for i in range(600)] + [(1000, None, 0, ""), (1001, "", 0, ""), (1002, None, 0, ""), (5, "again", 0, ""), (5, "again", 0, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, shard int, size string")
    got = shard_documents(docs, 8).collect()
    assert len(got) == len(rows)
    text = {}
    for d, t, *_ in rows:
        text.setdefault(d, []).append(t)
    shard_of = {}
    load = [0] * 8
    for r in got:
        t = text[r.doc_id][-1]
        assert r.size == 16 + len((t or "").encode()) or len(text[r.doc_id]) > 1
        assert r.text_crc32 == zlib.crc32((t or "").encode()) or len(text[r.doc_id]) > 1
        if len(text[r.doc_id]) == 1:
            assert shard_of.setdefault(t, r.shard) == r.shard
        load[r.shard] += r.size
    for s in range(8):
        slots = sorted(r.slot for r in got if r.shard == s)
        assert slots == list(range(len(slots)))
    assert max(load) <= 1.5 * sum(load) / 8
    assert shard_documents(docs.limit(0), 8).collect() == []
    unique = docs.where("doc_id > 5")
    write_shards(unique, shard_documents(unique, 4), str(tmp_path / "s"))
    assert spark.read.parquet(str(tmp_path / "s")).count() == unique.count()


def test_one_text_holds_everything(spark):
    docs = spark.createDataFrame([(i, "same") for i in range(50)], "doc_id long, text string")
    assert len({r.shard for r in shard_documents(docs, 4).collect()}) == 1
