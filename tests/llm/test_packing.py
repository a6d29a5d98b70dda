import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from notemill.llm.packing import pack_documents, pack_lengths, sum_of_squares
from notemill.llm.tokens import byte_bpe, default_tokenizer

TEXTS = [
    "plain words here", " lead", "trail ", "two  spaces   three", "tab\t x\n y \n\n z", "é  ü  x", "a<|endoftext|>b c",
    "don't we'll 12 345,6 ...", "", "x" * 5000, "　 日本 語", "q\x1c w \x85 e", "  ", "\r\n \r\n a", "😀 😀  ok",
]


@pytest.fixture(scope="module")
def hf():
    return Tokenizer.from_file(default_tokenizer())


def test_encoding_equals_tokenizers(hf):
    bpe = byte_bpe(default_tokenizer())
    for text in TEXTS:
        assert np.frombuffer(bpe.encode(text), "<u4").tolist() == hf.encode(text, add_special_tokens=False).ids, text


def test_ordinary_encoding_round_trips():
    bpe = byte_bpe(default_tokenizer())
    for text in TEXTS:
        ids = np.frombuffer(bpe.encode_ordinary(text), "<u4")
        assert 50256 not in ids and bpe.decode(ids) == text


def plain_sum_of_squares(lengths, capacity):
    bins, out = [], []
    for s in lengths:
        def cost(state):
            gaps = [capacity - b for b in state if b < capacity]
            return sum(gaps.count(g) ** 2 for g in set(gaps))
        options = []
        for i, b in enumerate(bins):
            if b + s <= capacity:
                options.append((cost(bins[:i] + [b + s] + bins[i + 1 :]), 0, capacity - b))
        options.append((cost(bins + [s]), 1, 0))
        out.append(min(options))
        if min(options)[1]:
            bins.append(s)
        else:
            i = next(i for i in reversed(range(len(bins))) if capacity - bins[i] == min(options)[2])
            bins[i] += s
    return sorted(bins)


def test_rule_matches_direct_search():
    rng = np.random.default_rng(3)
    for _ in range(5):
        lengths = rng.integers(1, 21, 60)
        bins, _ = sum_of_squares(lengths, 20)
        assert sorted(np.bincount(bins, lengths).astype(int).tolist()) == plain_sum_of_squares(lengths.tolist(), 20)


def test_packing_is_dense():
    rng = np.random.default_rng(4)
    lengths = np.clip(rng.lognormal(6, 1, 5000).astype(np.int64), 1, 2048)
    bins, offsets = pack_lengths(lengths)
    fill = np.bincount(bins, lengths)
    assert fill.max() <= 2048
    assert (fill > 0).sum() <= 1.01 * -(-lengths.sum() // 2048)


def test_documents(spark, hf):
    texts = [*TEXTS, None, "long words " * 3000, "dup", "dup"]
    docs = spark.createDataFrame([(i, t, 1, 2) for i, t in enumerate(texts)] + [(17, "dup", 1, 2)], "doc_id long, text string, piece int, length int")
    rows = pack_documents(docs, with_ids=True).collect()
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
    for i, t in enumerate(texts):
        ids = hf.encode(t or "", add_special_tokens=False).ids + [0]
        if i == 17:
            assert len(by[i]) == 2
            continue
        got = sorted(by[i], key=lambda r: r.piece)
        assert [r.piece for r in got] == list(range(len(got))) and [r.start for r in got] == [sum(x.length for x in got[:k]) for k in range(len(got))]
        assert np.concatenate([np.frombuffer(r.token_ids, "<u4") for r in got]).tolist() == ids
        assert all(zlib.crc32(r.token_ids) == r.ids_crc32 for r in got)
        assert len(got) == 1 if len(ids) <= 2048 else all(r.length == 2048 for r in got[1:])
    bins = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for held in bins.values():
        held.sort()
        assert [o for o, _ in held] == [sum(n for _, n in held[:k]) for k in range(len(held))] and sum(n for _, n in held) <= 2048
    assert pack_documents(docs.limit(0)).collect() == []
