import random
import time

import numpy as np
import pyarrow as pa
import pytest

from notemill.llm.substring_dedup import Paragraphs, _large_links, block_pairs, cut_spans, duplicate_spans, remove_duplicate_spans, similar_pairs, tune_bands
from notemill.staging import Scratch


def prose(rng, n, vocab=5000):
    return [f"w{rng.randrange(vocab)}" for _ in range(n)]


def test_bands():
    assert tune_bands(0.8, 0.99) == (5, 2)
    assert tune_bands(0.8, 0.99, 4) == (9, 4) and tune_bands(0.8, 0.99, 1) == (3, 1)
    for s, r in ((0.8, 0.99), (0.9, 0.999), (0.5, 0.9)):
        b, k = tune_bands(s, r)
        assert 1 - (1 - s**k) ** b >= r


def test_parts_cover_long_lines_and_depend_on_near_words_only():
    rng = random.Random(1)
    passage = prose(rng, 60)
    texts = [" ".join(prose(rng, 40) + passage + prose(rng, 40)) + "\nshort line", " ".join(passage), "", "\n\n", None]
    p = Paragraphs(pa.array(texts))
    for doc in (0, 1):
        parts = [(b, e) for b, e, d, k in zip(p.begin, p.stop, p.doc[p.begin], p.is_part) if d == doc and k]
        assert parts[0][0] == p.first_word[doc] and all(a[1] == b[0] for a, b in zip(parts, parts[1:]))
    contents = p.contents()
    sets = [{int(c): int(e - b) for c, b, e, d in zip(contents, p.begin, p.stop, p.doc[p.begin]) if d == doc} for doc in (0, 1)]
    assert sum(n for c, n in sets[1].items() if c in sets[0]) >= 20
    assert set(p.doc[p.begin].tolist()) == {0, 1}


def test_similar_pairs_connect_as_all_pairs_do():
    rng = random.Random(2)
    sets = []
    for _ in range(12):
        base = rng.sample(range(400), 20)
        for _ in range(5):
            base = [x if rng.random() > 0.06 else rng.randrange(400) for x in base]
            sets.append(np.unique(base))

    def groups(pairs):
        root = list(range(len(sets)))
        for _ in sets:
            for i, j in pairs:
                root[i] = root[j] = min(root[i], root[j])
        return root

    jac = lambda a, b: len(set(a) & set(b)) / len(set(a) | set(b))
    found = list(similar_pairs(sets, 0.8))
    assert all(jac(sets[i], sets[j]) >= 0.8 for i, j in found)
    assert groups(found) == groups([(i, j) for j in range(len(sets)) for i in range(j) if jac(sets[i], sets[j]) >= 0.8])


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(3)
    passage, line = prose(rng, 60), " ".join(prose(rng, 30))
    near = line.split()
    near[0] = "edited"
    rows, planted = [], set()
    for d in range(60):
        body = prose(rng, rng.randint(100, 300))
        for k in range(30, len(body), 47):
            body[k] += "\n"
        if d % 3 == 0:
            body[41:41] = passage
            planted.add(d)
        rows.append((d, " ".join(body)))
    rows += [(100, "intro\n" + line), (101, " ".join(near) + "\nother words"), (102, None), (103, ""), (104, "\n \n"), (105, "tiny"), (106, "tiny")]
    rows += [(107, " ".join(prose(rng, 40_000)) + "\n" + line)]
    rows += [(110, "repeated row of " + " ".join(prose(rng, 20)))] * 2
    return rows, planted, passage


def test_planted_passages_and_clean_documents(spark, corpus):
    rows, planted, passage = corpus
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, removed string, c int")
    got = duplicate_spans(df).collect()
    assert {r.doc_id for r in got if r.doc_id < 100} == planted
    assert {r.doc_id for r in got if r.doc_id >= 100} == {100, 101, 107}
    assert {r.doc_id for r in got if not r.removed} == {0, 100}
    assert len({r.cluster for r in got if r.doc_id >= 100}) == 1
    text = dict(rows)
    for r in got:
        own = text[r.doc_id].encode()[r.start_byte : r.end_byte].decode().split()
        assert own == text[r.doc_id].split()[r.start_word : r.end_word] and len(own) == r.n_words >= 15
        if r.doc_id < 100:
            assert set(own) <= set(w for w in passage)
    assert duplicate_spans(df.limit(0)).collect() == []


def test_removal(spark, corpus):
    rows, planted, passage = corpus
    df = spark.createDataFrame(rows + [(200, rows[60][1].split("\n")[1])], "doc_id long, text string")
    out = {r.doc_id: r.text for r in remove_duplicate_spans(df).collect()}
    text = dict(rows)
    assert 200 not in out and 102 in out and 103 in out
    for d in set(text) - {101, 107} - planted:
        assert out[d] == text[d]
    assert out[0] == text[0] and out[101] == "other words"
    for d in planted - {0}:
        assert len(out[d].split()) <= len(text[d].split()) - 15 and " ".join(passage) not in out[d]


def test_cutting():
    assert cut_spans(b"aa bb\ncc dd\nee", [(6, 11)]) == b"aa bb\nee"
    assert cut_spans(b"aa bb cc", [(0, 5)]) == b"cc"
    assert cut_spans(b"aa bb cc", [(3, 8), (3, 5)]) == b"aa"


@pytest.mark.parametrize("group_rows", [2, 7, 1000])
def test_large_keys_are_dealt_again_and_lose_no_pair(spark, group_rows):
    rng = random.Random(4)
    sets = []
    for d in range(12):  # families of near copies, linked in a chain; all hold the frequent shingle 0
        own = rng.sample(range(1, 400), 40)
        for k in range(5):
            sets.append(sorted({0, *own}))
            own[5 * k : 5 * k + 3] = rng.sample(range(1, 400), 3)
    df = spark.createDataFrame([(i, s) for i, s in enumerate(sets)], "c long, shingles array<long>")
    none = spark.createDataFrame([], "src long, dst long")
    found = [(r.src, r.dst) for r in _large_links(df, none, 0.8, group_rows, Scratch()).collect()]
    jac = lambda i, j: len(set(sets[i]) & set(sets[j])) / len(set(sets[i]) | set(sets[j]))
    want = [(i, j) for i in range(60) for j in range(i) if jac(i, j) >= 0.8]
    assert want and all(jac(i, j) >= 0.8 for i, j in found)

    def groups(pairs):
        root = list(range(60))
        for _ in root:
            for i, j in pairs:
                root[i] = root[j] = min(root[i], root[j])
        return root

    assert groups(found) == groups(want)


def test_block_pairs_bound_groups_and_meet_all(spark):
    rows = [(1, c, 0 if c < 30 else c) for c in range(50)] + [(2, c, c) for c in range(9)]
    got = block_pairs(spark.createDataFrame(rows, "key long, c long, label long"), 4, Scratch()).collect()
    groups, label = {}, {(k, c): x for k, c, x in rows}
    for r in got:
        groups.setdefault(r.key, []).append(r.c)
    assert max(map(len, groups.values())) <= 8
    met = {(a, b) for g in groups.values() for a in g for b in g}
    assert all((a, b) in met for a in range(50) for b in range(50) if label[1, a] != label[1, b])


def test_near_copies_are_compared_all_at_once():
    rng = np.random.default_rng(5)
    base = np.arange(56)
    sets = []
    for k in range(2000):
        own = base.copy()
        own[rng.integers(0, 52) :][:5] = 1000 + 5 * k + np.arange(5)
        sets.append(np.unique(own))
    begin = time.process_time()
    assert len(list(similar_pairs([base, *sets], 0.8))) == 2000
    assert time.process_time() - begin < 20


def test_near_lines_are_linked(spark):
    """Recall of the banding over whole lines that differ in a few words (Jaccard 0.8 to 1)."""
    rng = random.Random(6)
    rows, want = [], set()
    for d in range(300):
        line = prose(rng, 60, 100_000)
        rows.append((2 * d, " ".join(line)))
        line[rng.randrange(60)] = "changed"
        rows.append((2 * d + 1, " ".join(line)))
        want.add(2 * d + 1)
    got = duplicate_spans(spark.createDataFrame(rows, "doc_id long, text string")).where("removed AND n_words = 60").collect()
    found = {r.doc_id for r in got}
    assert found <= want and len(found) >= 0.97 * len(want)


@pytest.mark.parametrize("length,least", [(50, 0.9), (70, 0.95), (100, 0.95)])
def test_recall_of_passages_inside_lines(spark, length, least):
    """Share of passages, pasted into the middle of two lines each, that are found."""
    rng = random.Random(length)
    rows = []
    for d in range(150):
        passage = prose(rng, length, 100_000)
        rows += [(2 * d + k, " ".join(prose(rng, 80, 100_000) + passage + prose(rng, 80, 100_000))) for k in (0, 1)]
    got = duplicate_spans(spark.createDataFrame(rows, "doc_id long, text string")).where("removed").collect()
    assert {r.doc_id % 2 for r in got} == {1} and len({r.doc_id for r in got}) >= least * 150


@pytest.mark.parametrize(("share", "least"), [(0.05, 0.9), (0.1, 0.45)])
def test_recall_of_edited_passages_inside_lines(spark, share, least):
    """Share of passages of 100 words, pasted into the middle of two lines each and edited in one, which are found; nothing else is."""
    rng = random.Random(3)
    rows = []
    for d in range(150):
        passage = prose(rng, 100, 100_000)
        edited = [f"new{rng.randrange(10**6)}" if rng.random() < share else w for w in passage]
        rows += [(2 * d + k, " ".join(prose(rng, 80, 100_000) + own + prose(rng, 80, 100_000))) for k, own in enumerate((passage, edited))]
    got = duplicate_spans(spark.createDataFrame(rows, "doc_id long, text string")).where("removed").collect()
    assert {r.doc_id % 2 for r in got} == {1} and len({r.doc_id for r in got}) >= least * 150
    assert all(80 <= r.start_word and r.end_word <= 180 for r in got)


def test_parts_of_other_passages_are_not_bridged(spark):
    """Two passages from two sources, and two that stand elsewhere far apart, stay two spans with other words between."""
    rng = random.Random(12)
    one, other, between = prose(rng, 60, 100_000), prose(rng, 60, 100_000), prose(rng, 20, 100_000)
    far = one + prose(rng, 200, 100_000) + other
    rows = [(1, " ".join(one)), (2, " ".join(other)), (3, " ".join(prose(rng, 40, 100_000) + one + between + other + prose(rng, 40, 100_000)))]
    text = lambda rows: sorted((r.start_word, r.end_word) for r in duplicate_spans(spark.createDataFrame(rows, "doc_id long, text string")).where("removed AND doc_id = 3").collect())
    for own in (rows, [(1, " ".join(prose(rng, 50, 100_000) + far + prose(rng, 50, 100_000))), rows[2]]):
        spans = text(own)
        assert len(spans) == 2 and spans[0][1] <= 101 and spans[1][0] >= 119


def test_columns_of_any_name_stay(spark):
    line = " ".join(prose(random.Random(8), 30))
    rows = [(1, line, "a", "b", "c", "d", 5), (2, line + "\nmore words", "e", "f", "g", "h", 6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, _h string, _id string, _cut string, id string, th int")
    out = sorted(tuple(r) for r in remove_duplicate_spans(df).collect())
    assert out == [rows[0], (2, "more words", *rows[1][2:])] and remove_duplicate_spans(df).columns == df.columns
