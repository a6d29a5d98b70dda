import math
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from notemill.llm import ngram_lm as lm


def plain_tokens(text):
    raw = (text or "").encode()
    return [*bytes(b + 32 if 65 <= b <= 90 else b for b in raw).split(), None]


class PlainKneserNey:
    def __init__(self, texts):
        self.c2, self.c1 = Counter(), Counter()
        for t in texts:
            tokens = plain_tokens(t)
            for u, w in zip(["<s>", *tokens], tokens):
                self.c2[u, w] += 1
                self.c1[w] += 1
        self.n, self.v = sum(self.c1.values()), len(self.c1)
        self.left = Counter(w for _, w in self.c2)
        of = Counter(self.c2.values())
        self.d2 = [0, *lm.discounts(*(of[k] for k in (1, 2, 3, 4)))]
        of = Counter(self.left.values())
        self.d1 = [0, *lm.discounts(*(of[k] for k in (1, 2, 3, 4)))]
        self.after = defaultdict(list)
        for (u, _), n in self.c2.items():
            self.after[u].append(n)

    def p1(self, w):
        kinds = sum(self.left.values())
        if not kinds:
            return 1.0 / (self.v + 1)
        spread = sum(self.d1[min(n, 3)] for n in self.left.values()) / kinds
        n = self.left[w]
        return max(n - self.d1[min(n, 3)], 0) / kinds + spread / (self.v + 1)

    def p(self, u, w):
        counts = self.after.get(u)
        if not counts:
            return self.p1(w)
        n = self.c2[u, w]
        return max(n - self.d2[min(n, 3)], 0) / sum(counts) + sum(self.d2[min(x, 3)] for x in counts) / sum(counts) * self.p1(w)

    def score(self, text):
        tokens = plain_tokens(text)
        base = sum(math.log10((self.c1[w] + 1) / (self.n + self.v + 1)) for w in tokens)
        return len(tokens), sum(self.c1[w] > 0 for w in tokens), self.n, base, sum(math.log10(self.p(u, w)) for u, w in zip(["<s>", *tokens], tokens))


def test_tokens_are_those_of_split():
    texts = ["A b\tb\x0bC\x0c d\n", "", None, " \r\n ", "é\xa0É\x1cz", "x" * 3000 + " y", "last"]
    tokens, counts = lm.tokenise(pa.array(texts + ["pad"]).slice(0, len(texts)))
    want = [w for t in texts for w in plain_tokens(t)]
    assert counts.tolist() == [len(plain_tokens(t)) for t in texts]
    names = {}
    for h, w in zip(tokens.tolist(), want):
        assert names.setdefault(w, h) == h
    assert len(set(names.values())) == len(names)
    assert lm.tokenise(pa.array([], pa.string()))[0].tolist() == []


@pytest.mark.parametrize("shard_bytes", [1 << 24, 700])
def test_scores_equal_plain_model(spark, shard_bytes, monkeypatch):
    rng = random.Random(3)
    vocab = [f"W{i}" for i in range(60)]
    texts = [" ".join(rng.choices(vocab, [1 / (i + 1) for i in range(60)], k=rng.randint(0, 30))) for _ in range(60)] + [None, "", "the the the " * 500]
    held = ["w1 w2 zz w0", "", None, "zz zz", "W0 W1\nw0", "w0 " * 40_000]
    df = spark.createDataFrame([(i, t, 7, "x") for i, t in enumerate(texts)], "doc_id long, text string, score int, n_tokens string").repartition(3)
    info = lm.train(df, shard_bytes=shard_bytes)
    plain = PlainKneserNey(texts)
    assert (info.tokens, info.words) == (plain.n, plain.v)
    rows = [(i, t, 1.0) for i, t in enumerate(texts + held)]
    got = {r.doc_id: r for r in lm.score(spark.createDataFrame(rows, "doc_id long, text string, base_score double"), info).collect()}
    for i, t, _ in rows:
        want = plain.score(t)
        r = got[i]
        assert (r.n_tokens, r.n_known, r.train_tokens) == want[:3]
        assert r.base_score == pytest.approx(want[3]) and r.score == pytest.approx(want[4])
    total = sum(plain.p("<s>", w) for w in [*plain.c1, "unknown"])
    assert total == pytest.approx(1)


def test_empty_training_text(spark):
    df = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    info = lm.train(df.limit(0))
    assert (info.tokens, info.words) == (0, 0)
    assert [r.score for r in lm.score(df, info).collect()] == [0.0, 0.0]
    assert lm.score(df.limit(0), info).collect() == []
