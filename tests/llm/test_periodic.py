import hashlib
import random
import zlib
from fractions import Fraction

import pytest

from notemill.llm import periodic as P
from notemill.llm import queries as q


def brute(ws, least, exponent):
    """Runs by comparing words at each distance."""
    found = set()
    for p in range(1, len(ws) // 2 + 1):
        s = 0
        while s < len(ws):
            t = s
            while t + p < len(ws) and ws[t] == ws[t + p]:
                t += 1
            n = t - s + p
            w = ws[s : s + n]
            if t > s and n >= max(least, exponent * p) and not any(w[r:] == w[:-r] for r in range(1, p)):
                found.add((s, n, p))
            s = t + 1
    return sorted(found, key=lambda r: (r[0], r[2]))


def periodic_words(rng, kinds, most=40):
    ws = [b"w%d" % rng.randrange(kinds) for _ in range(rng.randint(0, most))]
    for _ in range(rng.randint(0, 3)):
        unit = [b"w%d" % rng.randrange(kinds) for _ in range(rng.randint(1, 5))]
        at = rng.randint(0, len(ws))
        ws[at:at] = unit * rng.randint(2, 7)
    return ws


def test_squares():
    for seed in range(300):
        ws = periodic_words(random.Random(seed), 1 + seed % 4)
        want = {(e, p) for p in range(1, len(ws) // 2 + 1) for e in range(2 * p - 1, len(ws)) if ws[e - 2 * p + 1 : e - p + 1] == ws[e - p + 1 : e + 1]}
        root = lambda e, p: any(p % d == 0 and ws[e - p + 1 : e - p + 1 + d] * (p // d) == ws[e - p + 1 : e + 1] for d in range(1, p))
        assert set(P.squares(ws)) == {(e, p) for e, p in want if not root(e, p)}


@pytest.mark.parametrize(("least", "exponent"), [(6, 4), (2, 2), (3, Fraction(5, 2)), (9, 3)])
def test_runs_match_brute_force(least, exponent):
    for seed in range(400):
        rng = random.Random(seed)
        texts = [periodic_words(rng, rng.choice([1, 2, 3, 5])) for _ in range(4)] + [[]]
        assert P.runs_of(texts, least, Fraction(exponent)) == [brute(ws, least, exponent) for ws in texts]


def test_long_text():
    rng = random.Random(9)
    plain = [b"v%d" % rng.randrange(5000) for _ in range(30_000)]
    ws = plain[:12_345] + plain[500:900] * 9 + [b"x"] * 70 + plain[12_345:]
    assert [r for r in P.runs_of([ws], 6, Fraction(4))[0] if r[2] in (1, 400)] == [(12_345, 3600, 400), (15_945, 70, 1)]


def test_table(spark):
    rows = [(1, "a a a a a a b", "x"), (None, None, "y"), (None, " \n\t ", "y"), (2, "", "z"), (1, "a a a a a a b", "x"), (3, "one", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs string")
    got = sorted(((r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in P.periodic_runs(docs).collect()), key=str)
    assert got == sorted([(1, 7, [(0, 6, 1)], "a b")] * 2 + [(None, 0, [], "")] * 2 + [(2, 0, [], ""), (3, 1, [], "one")], key=str)
    assert P.periodic_runs(docs.limit(0)).collect() == []
    with pytest.raises(ValueError):
        P.periodic_runs(docs, min_exponent=1.5)


def test_query(spark, tmp_path):
    rng = random.Random(6)
    texts = [b" ".join(periodic_words(rng, rng.choice([2, 5, 900]), 120)).decode().replace(" ", "\n", 2) for _ in range(300)] + [None, "", "  é é é é é é", "z " * 4000]
    rows = [(i, t, 5) for i, t in enumerate(texts)] + [(None, "b b b b b b", 1), (4, texts[4], 1)]
    spark.createDataFrame(rows, "doc_id long, text string, words int").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    want = []
    for i, t, _ in rows:
        ws = (t or "").encode().split()
        n, h = len(ws), zlib.crc32(str(i).encode())
        g = h // 10
        if i is not None and h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            ws = [ws[k] if k < a else ws[a + (k - a) % p] for k in range(n)]
        runs = brute(ws, 6, 4)
        gone = {k for s, m, p in runs for k in range(s + p, s + m)}
        best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=(None, None, None))
        sha = lambda x: hashlib.sha256(x).hexdigest()
        want.append((i, len(runs), *best, best[1] and 1000 * best[1] // best[2], sha("".join("%d,%d,%d\n" % r for r in runs).encode()), sha(b" ".join(w for k, w in enumerate(ws) if k not in gone))))
    got = [tuple(r[c] for c in ("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")) for r in q.op12_periodic_runs(spark, str(tmp_path)).collect()]
    assert sorted(got, key=str) == sorted(want, key=str) and sum(r[1] > 0 for r in got) > 30
