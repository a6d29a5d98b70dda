import random

import numpy as np
import pytest

from notemill.llm import bayes_dedup as B
from notemill.llm import queries as q


def brute(rows, shingle):
    """id, n_shingles, component_id, kept of (id, text) rows."""
    sets = []
    for _, text in rows:
        ws = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
        sets.append({tuple(ws[k : k + shingle]) for k in range(max(1, len(ws) - shingle + 1))} if ws else set())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 80 * len(a | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return sorted(((d, len(s), least.get(find(i)), d == least.get(find(i))) for i, ((d, _), s) in enumerate(zip(rows, sets))), key=str)


def edited(rng):
    rows = []
    for _ in range(50):
        base = [f"w{rng.randrange(3000)}" for _ in range(rng.choice([5, 20, 60, 150]))]
        for _ in range(rng.choice([1, 2, 8])):
            ws = list(base)
            for _ in range(int(len(ws) * rng.choice([0, 0.01, 0.02, 0.03, 0.05]))):
                ws[rng.randrange(len(ws))] = f"x{rng.randrange(9999)}"
            rows.append((len(rows) * 3 + 1, " ".join(ws)))
    ws = [f"c{k}" for k in range(100)]
    for k in range(40):  # a chain: only neighbours are similar
        rows.append((10_000 - k, " ".join(ws)))
        ws[2 * k] = f"d{k}"
    return rows


def test_bounds():
    for n in range(16, 129, 16):
        m = B.least_matches(0.8, n, 1e-6)
        x = np.linspace(0, 1, 200_001)
        tail = lambda m: (lambda y: y[x >= 0.8].sum() / y.sum())(x**m * (1 - x) ** (n - m))
        assert tail(m) >= 1e-6 * 0.9 and (m == 0 or tail(m - 1) < 1e-6 * 1.1)
    same = np.zeros((2, 128), "<u4")
    other = np.ones((2, 128), "<u4")
    pruner = B.Pruner(B.Fraction(4, 5), 1e-6)
    each = np.arange(2)
    assert pruner.survivors(same, same, each, each, np.array([10, 8]), np.array([8, 20])).tolist() == [0]
    assert pruner.survivors(same, same, each, each[::-1], np.array([10, 8]), np.array([8, 20])).tolist() == [1]
    assert pruner.survivors(same, other, each, each, np.array([9, 9]), np.array([9, 9])).tolist() == []


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(3)
    x = rng.integers(0, 2**63, 4500, np.uint64)
    a, b = B.signature(x[:4000]), B.signature(x[500:])
    assert abs((a == b).mean() - 3500 / 4500) < 0.12
    assert (B.signature(x[:0]) == 2**32 - 1).all()


@pytest.mark.parametrize("group", [2000, 6])
def test_components_match_brute_force(spark, group):
    rows = edited(random.Random(5)) + [(7000, None), (7001, ""), (7002, " \t"), (7003, "A b"), (7004, "a  B"), (7005, "a b c d"), (7006, "a b c d"), (7006, "a b c d"), (None, "a b c d"), (None, "lone"), (None, None)]
    docs = spark.createDataFrame([(i, t, "n", "s") for i, t in rows], "doc_id long, text string, node string, sig string").repartition(3)
    got = B.near_duplicate_sets(docs, shingle=4, group=group)
    want = brute([r for r in rows if r[0] is not None], 4)
    assert sorted((tuple(r) for r in got.where("doc_id IS NOT NULL").collect()), key=str) == want
    assert sorted((tuple(r) for r in got.where("doc_id IS NULL").collect()), key=str) == sorted([(None, 1, 7005, False), (None, 1, None, True), (None, 0, None, True)], key=str)


def test_empty_table(spark):
    assert B.near_duplicate_sets(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_query(spark, tmp_path):
    rng = random.Random(8)
    rows = edited(rng) + [(20_000, " ".join(f"l{rng.randrange(999)}" for _ in range(20_000)))]
    rows += [(20_001, rows[-1][1].replace("l7 ", "L7 ").replace("l9 ", "", 3)), (20_002, None)]
    spark.createDataFrame([(i, t, "en") for i, t in rows], "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    got = [(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in q.op13_minhash_near_dedup(spark, str(tmp_path)).collect()]
    assert sorted(got, key=str) == brute(rows, 4)
