import random

import numpy as np
import pytest
import xxhash

from notemill.llm.near_dup import close_pairs, gray_rank, link_fingerprints, near_duplicates, one_of_each_group, simhash64


def plain_simhash(text):
    if not text:
        return 0
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text).encode().split()
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(ids, codes, most):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, x in zip(ids, codes):
        for b, y in zip(ids, codes):
            if a < b and (x ^ y).bit_count() <= most:
                ra, rb = find(a), find(b)
                root[max(ra, rb)] = min(ra, rb)
    return {i: find(i) for i in ids}


def test_gray_rank():
    n = np.arange(1000, dtype=np.uint64)
    assert (gray_rank(n ^ (n >> np.uint64(1))) == n).all()


def test_close_pairs_match_all_pairs():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**64, 30, np.uint64)
    codes = np.concatenate([base, base ^ (np.uint64(1) << rng.integers(0, 64, 30).astype(np.uint64)), base[:5]])
    group = rng.integers(0, 2, len(codes))
    order = np.lexsort((gray_rank(codes), group))
    group, codes = group[order], codes[order]
    got = {(int(a), int(b)) for i, j in close_pairs(group, codes, 4) for a, b in zip(i, j)}
    want = {(i, j) for j in range(len(codes)) for i in range(j) if group[i] == group[j] and int(codes[i] ^ codes[j]).bit_count() <= 4}
    assert got == want


@pytest.mark.parametrize("limit", [4096, 3])
def test_links_give_brute_force_components(spark, limit):
    rng = random.Random(2)
    codes = {rng.getrandbits(64) for _ in range(60)}
    for c in list(codes)[:30]:
        for _ in range(6):
            for _ in range(rng.randint(1, 5)):
                c ^= 1 << rng.randrange(64)
            codes.add(c)
    codes = sorted(codes)
    signed = [c - (1 << 64) if c >> 63 else c for c in codes]
    at = {c: i for i, c in enumerate(signed)}
    df = spark.createDataFrame([(c,) for c in signed], "fp long")
    links = [(at[r.src], at[r.dst]) for r in link_fingerprints(df, 4, limit).collect()]
    root = {i: i for i in range(len(codes))}
    for _ in range(len(codes)):
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    assert all((codes[a] ^ codes[b]).bit_count() <= 4 or root[a] == root[b] for a, b in links)
    assert root == components(range(len(codes)), codes, 4)


def test_documents_edge_cases(spark):
    words = [f"w{i}" for i in range(300)]
    long = " ".join(words)
    texts = [long, long.replace("w7 ", "x "), long.upper(), None, "", " \t\n", "one two", "One  Two", "tiny", " ".join(words * 80), long]
    rows = [(i, t, "x", 5) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string, component_id int")
    got = {r.doc_id: r for r in near_duplicates(docs).collect()}
    assert len(got) == len(rows)
    codes = [plain_simhash(t) for t in texts]
    assert [got[i].fp % 2**64 for i in range(len(texts))] == codes
    assert {i: got[i].component_id for i in got} == components(range(len(texts)), codes, 4)
    assert got[5].component_id == got[3].component_id == 3
    assert simhash64(None) == 0


def test_empty_and_repeated_rows(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert near_duplicates(docs).collect() == []
    twice = spark.createDataFrame([(4, "a b"), (4, "a b"), (9, "a b")], "doc_id long, text string")
    assert sorted((r.doc_id, r.component_id) for r in near_duplicates(twice).collect()) == [(4, 4), (4, 4), (9, 4)]


def test_null_ids_link_others(spark):
    words = [f"w{i}" for i in range(40)]
    texts = [" ".join(words[:k] + words[k + 1 :]) for k in range(40)]
    codes = [plain_simhash(t) for t in texts]
    close = lambda a, b: (codes[a] ^ codes[b]).bit_count() <= 4
    a, m, b = next((a, m, b) for m in range(40) for a in range(40) for b in range(a) if close(a, m) and close(m, b) and not close(a, b))
    rows = [(3, texts[a], "x"), (None, texts[m], "y"), (8, texts[b], "z"), (None, texts[m], "y"), (8, texts[b], "z"), (None, "alone here", "x"), (None, "alone  here", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, id string")
    assert {r.component_id for r in near_duplicates(docs.limit(5)).collect()} == {3}
    kept = [tuple(r) for r in one_of_each_group(docs).collect()]
    assert len(kept) == 2 and rows[0] in kept and (rows[5] in kept or rows[6] in kept)
    assert one_of_each_group(docs.limit(0)).collect() == []
