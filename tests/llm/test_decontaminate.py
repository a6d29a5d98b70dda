import random

import numpy as np
import pytest

from notemill.llm.decontaminate import GAP, MATCH, MISMATCH, Seeds, align, contaminated, least_score, words, without_copies


def plain_sw(a, b):
    h = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            s = MATCH if a[i - 1] == b[j - 1] else MISMATCH
            h[i][j] = max(0, h[i - 1][j - 1] + s, h[i - 1][j] + GAP, h[i][j - 1] + GAP)
    return max(map(max, h))


def test_alignment_equals_plain_table():
    rng = random.Random(1)
    for _ in range(60):
        a, b = ([rng.randint(1, 4) for _ in range(rng.randint(1, 14))] for _ in range(2))
        score, start, end = align(np.array(a), np.array(b))
        assert round(score * MATCH * len(b)) == plain_sw(a, b)
        assert round(score * MATCH * len(b)) == plain_sw(a[start:end], b)


def prose(rng, n):
    return [f"w{rng.randint(0, 400)}" for _ in range(n)]


def test_copies_are_found(spark):
    rng = random.Random(2)
    items = [(i, " ".join(prose(rng, 30))) for i in range(12)] + [(20, None), (21, ""), (22, "too short"), (24, "One."), (23, "Exact, Copy! of a-b c")]
    docs, want = [], set()
    for d in range(80):
        body = prose(rng, 200)
        if d % 2 == 0:
            i = 0 if d % 4 == 0 else rng.randrange(12)  # one item is in a quarter of all documents
            copy = items[i][1].upper().split() if d % 8 == 0 else items[i][1].split()
            for _ in range(rng.randint(0, 4)):
                copy[rng.randrange(len(copy))] = "changed"
            if d % 3 == 0:
                copy.insert(10, "inserted,")
            body[50:50] = copy
            want.add((d, i))
        docs.append((d, " ".join(body)))
    docs += [(100, None), (101, ""), (102, "EXACT copy of A B c."), (103, "filler " * 200_000 + items[3][1]), (104, "it is too short here"), (105, "a line\n- Too short!\none"), (None, items[4][1]), (None, None)]
    want |= {(102, 23), (103, 3), (105, 22), (105, 24), (None, 4)}
    df = spark.createDataFrame([(*r, "clash", 1) for r in docs], "doc_id long, text string, item_id string, score int")
    bench = spark.createDataFrame([(*r, 5) for r in items], "item_id long, text string, doc_id int")
    for block in (8_000_000, 300):
        got = contaminated(df, bench, block_bytes=block).collect()
        assert {(r.doc_id, r.item_id) for r in got} == want
        assert all(0.4 <= r.score <= 1 and r.end_word > r.start_word for r in got)
    span = next(r for r in got if r.doc_id == 103)
    assert (span.start_word, span.end_word, span.score) == (200_000, 200_030, 1.0)
    kept = without_copies(df, bench, block_bytes=300)
    assert kept.columns == df.columns
    leaks = {d for d, _ in want}
    assert sorted((r.doc_id or -1, r.text) for r in kept.collect()) == sorted([(d, t) for d, t in docs if d not in leaks and d] + [(-1, None)])
    assert without_copies(df.limit(0), bench).collect() == [] and without_copies(df, bench.limit(0)).count() == len(docs)
    assert contaminated(df.limit(0), bench).collect() == [] and contaminated(df, bench.limit(0)).collect() == []


def test_seeds_that_occur():
    seeds = Seeds([(0, "a b c d e f"), (1, "a b c"), (2, "x y")])
    assert words("A, b-C") == [b"a", b"b", b"c"] and [item for item, _ in seeds.items] == [0, 1] and len(seeds.keys) == 5
    rare = seeds.rare(np.array([900, 5, 5, 0, 5]))
    assert rare.tolist() == [False, True, True, False, True]
    # What no document has is no seed, and doesn't hide the rest.
    assert seeds.rare(np.array([0, 0, 0, 0, 7])).tolist() == [False] * 4 + [True]
    assert [least_score(n, 0.4) for n in (3, 5, 6, 8, 20)] == [1.0, 0.7, 0.75, 0.5, 0.4]


def edit(rng, ws, kind, share):
    out = []
    for w in ws:
        if rng.random() >= share:
            out.append(w)
        elif kind == "substitute":
            out.append(rng.choice(ws) if rng.random() < 0.5 else f"new{rng.randrange(999)}")
        elif kind == "insert":
            out += [w, f"new{rng.randrange(999)}"]
    return out


@pytest.mark.parametrize(("share", "least"), [(0.1, 0.99), (0.2, 0.95), (0.3, 0.85)])
def test_recall_of_edited_copies(spark, share, least):
    """Words follow a Zipf law, as in prose, and most n-grams of an edited item are nowhere else."""
    rng = random.Random(7)
    known = [f"w{k}" for k in range(2000)]
    weight = [1 / (k + 1) for k in range(2000)]
    prose_ = lambda n: rng.choices(known, weight, k=n)
    items = [(i, prose_(rng.randint(25, 50))) for i in range(60)]
    docs, want = [], set()
    for kind in ("substitute", "insert", "delete"):
        for i, ws in items:
            body = prose_(150)
            docs.append((len(docs), " ".join(body[:60] + edit(rng, ws, kind, share) + body[60:])))
            want.add((len(docs) - 1, i))
    docs += [(1000 + k, " ".join(prose_(300))) for k in range(150)]
    got = contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(i, " ".join(ws)) for i, ws in items], "item_id long, text string"))
    found = {(r.doc_id, r.item_id) for r in got.collect()}
    assert found <= want and len(found) >= least * len(want)


def test_query_against_plain_alignment(spark):
    """Every document with every item, by the plain table. (A copy with a new word at every other place has no seed left.)"""
    rng = random.Random(3)
    items = [(i, [f"w{rng.randrange(300)}" for _ in range(rng.choice([12, 25, 40]))]) for i in range(6)]
    docs = []
    for d in range(40):
        body = [f"w{rng.randrange(300)}" for _ in range(60)]
        copy = edit(rng, items[d % 6][1], rng.choice(["substitute", "insert", "delete"]), rng.choice([0, 0.1, 0.2, 1]))
        docs.append((d, body[:30] + copy + body[30:]))
    score = {(d, i): plain_sw(ws, item) / (MATCH * len(item)) for d, ws in docs for i, item in items}
    want = {k: s for k, s in score.items() if s >= least_score(len(items[k[1]][1]), 0.4)}
    frames = spark.createDataFrame([(d, " ".join(ws)) for d, ws in docs], "doc_id long, text string"), spark.createDataFrame([(i, " ".join(ws)) for i, ws in items], "item_id long, text string")
    assert {(r.doc_id, r.item_id): r.score for r in contaminated(*frames).collect()} == want and len(want) > 20
