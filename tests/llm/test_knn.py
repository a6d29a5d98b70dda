import math

import numpy as np
import pytest

from notemill.llm.knn import _Cells, top_k


def brute(rows, asked, k):
    ok = [(i, [math.floor(1024 * float(x)) for x in v]) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, v in ok:
        if q in asked:
            hits = sorted((-sum(a * b for a, b in zip(v, w)), i is None, i or 0) for i, w in ok if i != q and len(w) == len(v))[:k]
            out += [(q, r + 1, None if n else i, -s) for r, (s, n, i) in enumerate(hits)]
    return sorted(out, key=lambda r: r[:2])


@pytest.mark.parametrize("block", [20_000, 40])
def test_equals_brute_force(spark, block):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(6, 8))
    rows = [(i, (centres[i % 6] + 0.2 * rng.normal(size=8)).astype(np.float32).tolist()) for i in range(400)]
    rows += [(i, rows[7][1]) for i in range(400, 500)]  # a hot vector
    rows += [(500, None), (600, [None] * 8), (601, [float("nan")] * 8), (602, [float("inf")] * 8), (700, [1.0, 2.0]), (701, [3.0, -1.0]), (800, []), (801, [])]
    rows += [(None, rows[7][1]), (None, rows[3][1]), (None, None), (2**53 + 1, rows[3][1]), (2**53 + 3, rows[3][1]), (-(2**62) - 1, rows[5][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("vec_id", "embedding", "1 AS cell", "2 AS rank")
    asked = {i for i, _ in rows if i is not None and (i % 20 == 0 or i >= 690)}
    got = top_k(df.where((df.vec_id % 20 == 0) | (df.vec_id >= 690) | df.vec_id.isNull()), df, 10, block_rows=block)
    assert sorted(((r.query_id, r["rank"], r.id, r.score) for r in got.collect()), key=lambda r: r[:2]) == brute(rows, asked, 10)


def test_groups_meet_only_what_their_bounds_allow():
    rng = np.random.default_rng(7)
    pivots = [(1000 * v).astype(int).tolist() for v in rng.normal(size=(20, 4))]
    data = [(np.array(p) + rng.integers(-40, 40, 4)) for p in pivots for _ in range(30)]
    far = lambda x: np.sqrt(((np.array(pivots) - x) ** 2).sum(1))
    cell = [int(far(x).argmin()) for x in data]
    radius = [(c, cell.count(c), max(far(x)[c] for x, k in zip(data, cell) if k == c)) for c in set(cell)]
    cells = _Cells(pivots, radius, [(c, r) for c, _, r in radius], 5)
    held = cells.held(4)[0].tolist()
    assert sum(m.sum() for _, m in cells.groups.values()) < 0.5 * len(held) ** 2
    for q, c in zip(data, cell):
        score = [int(q @ x) for x in data]
        floor, meets = cells.groups[c]
        top = sorted(score)[-5]
        assert floor <= top and all(meets[held.index(k)] for s, k in zip(score, cell) if s >= top)


def test_few_and_no_rows(spark):
    df = spark.createDataFrame([(0, [1.0, 0.5]), (1, [0.5, 0.5])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in top_k(df.where("vec_id = 0"), df, 10).collect()] == [(0, 1, 1, 1024 * 512 + 512 * 512)]
    assert top_k(df.limit(0), df, 10).collect() == []
    assert top_k(df, df.limit(0), 10).collect() == []


def test_repeated_queries_are_answered_once(spark):
    df = spark.createDataFrame([(0, [1.0]), (0, [1.0]), (1, [2.0]), (1, [2.0])], "vec_id long, embedding array<float>")
    assert sorted(tuple(r) for r in top_k(df.where("vec_id = 0"), df, 10).collect()) == [(0, 1, 1, 2 * 1024 * 1024), (0, 2, 1, 2 * 1024 * 1024)]
