import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from notemill.llm import queries as q
from notemill.llm import spelling as S


def near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def varied(rng, n, letters="abcéz"):
    words = {"".join(rng.choice(letters) for _ in range(rng.randint(7, 10))) for _ in range(n)}
    for w in sorted(words):
        for _ in range(3):
            k, c = rng.randrange(len(w)), rng.choice(letters + "ÿ")
            words.add(rng.choice([w[:k] + c + w[k + 1 :], w[:k] + c + w[k:], w[:k] + w[k + 1 :]]))
    return sorted(words)


def brute(counts, times=10):
    """word, form, root, n, n_near, form_n of words with their numbers."""
    form, rows = {}, {}
    for w, n in counts.items():
        own = [v for v in counts if near(w, v)]
        best = min(own, key=lambda v: (-counts[v], v), default=None)
        form[w] = best if own and counts[best] >= times * n else None
        rows[w] = n, len(own)
    root = {}
    for w in counts:
        r = w
        while form[r]:
            r = form[r]
        root[w] = r
    return {(w, form[w], root[w], n, k, counts[form[w]] if form[w] else None) for w, (n, k) in rows.items()}


def test_letter_counts_and_tree():
    words = varied(random.Random(1), 60)
    counts = S.letter_counts(words)
    assert counts[:, S.LENGTH].tolist() == [len(w) for w in words] and counts[:, : S.LENGTH].sum(1).tolist() == [len(w) for w in words]
    tree = S.KdTree(counts, 8, lengths=True)
    home = tree.home(counts)
    assert all(k in tree.members[leaf] for k, leaf in enumerate(home))
    # A pruned search reaches the leaf of every word one edit away.
    for mode, longer in ((S.SUBSTITUTED, 0), (S.INSERTED, 1)):
        reached = set(zip(*map(np.ndarray.tolist, tree.search(counts, mode))))
        assert all((i, home[j]) in reached for i, a in enumerate(words) for j, b in enumerate(words) if len(b) == len(a) + longer and near(a, b))
    assert len(S.KdTree(S.letter_counts(["abc", "bca", "cab"] * 30), 8, lengths=True).members) == 1


@pytest.mark.parametrize("limits", [(20, 10_000, 60_000), (2_000, 7, 9), (100_000, 10_000, 60_000)])
def test_near_words_match_all_pairs(spark, monkeypatch, limits):
    cell, held, searched = limits
    monkeypatch.setattr(S, "CELL", cell)
    monkeypatch.setattr(S, "HELD", held)
    monkeypatch.setattr(S, "SEARCHED", searched)
    words = varied(random.Random(2), 150) + ["q" * 3000, "q" * 2999 + "r", "q" * 3001, "q" * 400, "q" * 401]
    table = spark.createDataFrame([(w, k + 2) for k, w in enumerate(words)], "word string, n long").repartition(3)
    got = [(r.word, r.near, r.n) for r in S.near_words(table, partitions=5).collect()]
    number = {w: k + 2 for k, w in enumerate(words)}
    assert len(got) == len(set(got)) and set(got) == {(a, b, number[b]) for a in words for b in words if near(a, b)}


def test_forms(spark):
    counts = {"abcdefg": 2000, "abcdefgh": 200, "abcdefghi": 20, "abcdefghj": 2, "abcdefx": 2000, "abcdef": 150, "zzzzzzz": 5, "zzzzzzy": 49, "zzzzzyy": 50, "zzzyzzz": 50}
    table = spark.createDataFrame(list(counts.items()), "word string, n long")
    got = S.spelling_forms(table)
    assert {tuple(r) for r in got.select("word", "form", "root", "n", "n_near", "form_n").collect()} == brute(counts)
    assert {r.word: r.root for r in got.collect()}["abcdefghj"] == "abcdefg"
    assert S.spelling_forms(table.limit(0)).collect() == []


def test_query(spark, tmp_path):
    rng = random.Random(4)
    words = varied(rng, 40, "abéÀ×")
    texts = [" ".join(rng.choice(words[: rng.randint(1, len(words))]) + rng.choice(["", ",", "1", "-x"]) for _ in range(rng.randint(0, 300))) for _ in range(60)]
    texts += [None, "", "12 34", "ABCDEFG abcdefg Äbcdefg äbcdefg", texts[5], texts[5], "w" * 5000 + " " + " ".join(words * 20)]
    rows = [(i, t, "en", i, i) for i, t in enumerate(texts)] + [(None, texts[7], "en", 1, 1), (3, texts[3], "x", 0, 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, word int, n int").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    found = Counter()
    for i, t, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            if i is not None and (h := zlib.crc32(f"{i}:{run}".encode())) % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            found[run] += 1
    want = brute({w: n for w, n in found.items() if len(w) >= 7 and n >= 2})
    got = [(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in q.op11_spelling_variants(spark, str(tmp_path)).collect()]
    assert len(got) == len(want) and set(got) == want and any(r[1] for r in got)
