"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from notemill.llm.workers import small_batches, tidy

#: Words of a seed. An alignment of half a perfect score leaves pairs of words of any item as they are.
SEED_WORDS = 2
#: Documents up to which an n-gram is rare for any item: so few may all be copies, and tell nothing about how common it is.
ALWAYS_RARE = 50
#: Items of fewer words count only where a whole line is equal to them.
LINE_WORDS = 3
#: Items of so many words need two seeds at different places near each other; shorter ones need one.
TWO_SEEDS = 9
#: Items of fewer words than this count from one substituted word, those under ``EXACT_WORDS`` without any.
ONE_EDIT_WORDS, EXACT_WORDS = 8, 5
#: Share of the score of a perfect copy from which an alignment counts; of items under ``FEW_WORDS`` words half counts.
MIN_SCORE, FEW_WORDS = 0.4, 20
#: Text of the benchmark, in bytes, that is sent to tasks at once; a larger one is handled in so many blocks.
BLOCK_BYTES = 8_000_000
MATCH, MISMATCH, GAP = 2, -1, -1
_WORD = np.array([b if b >= 128 or chr(b).isalnum() else 32 for b in range(256)], np.uint8).tobytes()


def words(text: str | None) -> list[bytes]:
    """Lower-cased words; ASCII punctuation and white space part them."""
    return (text or "").lower().encode("utf-8", "replace").translate(_WORD).split()


class Seeds:
    """The n-grams of a block of test items, over the block's own vocabulary."""

    def __init__(self, items: list[tuple], n: int = SEED_WORDS):
        self.n = n
        split = [(item, words(text)) for item, text in items]
        least = max(n, LINE_WORDS)
        self.items = [(item, ws) for item, ws in split if len(ws) >= least]
        #: Shorter items by their words.
        self.short: dict[tuple, list] = {}
        for item, ws in split:
            if 0 < len(ws) < least:
                self.short.setdefault(tuple(ws), []).append(item)
        vocabulary = {w: i + 1 for i, w in enumerate(sorted({w for _, ws in self.items for w in ws}))}
        self.code = vocabulary.get
        self.base = np.int64(len(vocabulary) + 1)
        self.coded = [np.array([vocabulary[w] for w in ws], np.int64) for _, ws in self.items]
        keys = [self.grams(c)[1] for c in self.coded]
        self.keys = np.unique(np.concatenate([np.empty(0, np.int64), *keys]))
        at = [np.searchsorted(self.keys, k) for k in keys]
        gram = np.concatenate([np.empty(0, np.int64), *at])
        item = np.repeat(np.arange(len(keys)), [len(k) for k in keys])
        place = np.concatenate([np.empty(0, np.int64), *[np.arange(len(k)) for k in keys]])
        order = np.argsort(gram, kind="stable")
        self.owners = item[order], place[order]
        self.first = np.searchsorted(gram[order], np.arange(len(self.keys) + 1))
        self.by_item = at

    def grams(self, coded: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places and keys of the n-grams without a word from outside the vocabulary."""
        m = len(coded) - self.n + 1
        if m <= 0:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        key, whole = np.zeros(m, np.int64), np.ones(m, bool)
        for k in range(self.n):
            key = key * self.base + coded[k : k + m]
            whole &= coded[k : k + m] > 0
        at = np.flatnonzero(whole)
        return at, key[at]

    def encode(self, ws: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.code, ws, repeat(0)), np.int64, len(ws))

    def hits(self, coded: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in a text and numbers of the benchmark's n-grams found there."""
        at, key = self.grams(coded)
        if not len(at) or not len(self.keys):
            return at[:0], at[:0]
        k = np.searchsorted(self.keys, key)
        found = self.keys[np.minimum(k, len(self.keys) - 1)] == key
        return at[found], k[found]

    def rare(self, frequency: np.ndarray) -> np.ndarray:
        """Which n-grams seed: of those that the corpus has, the ones no more frequent than the median of an item, or than ALWAYS_RARE; at least half of every item's."""
        out = np.zeros(len(self.keys), bool)
        for at in self.by_item:
            there = at[frequency[at] > 0]
            if len(there):
                out[there[frequency[there] <= max(ALWAYS_RARE, np.median(frequency[there]))]] = True
        return out


def _table(a: np.ndarray, b: np.ndarray) -> tuple[int, int]:
    """Best local score of a against b, and the place in a after which it is first reached."""
    slope = -GAP * np.arange(len(b) + 1)
    row = np.zeros(len(b) + 1, np.int64)
    best, end = 0, 0
    for i, x in enumerate(a):
        step = np.where(b == x, MATCH, MISMATCH)
        new = np.zeros(len(b) + 1, np.int64)
        np.maximum(row[:-1] + step, row[1:] + GAP, out=new[1:])
        new = np.maximum(np.maximum.accumulate(new + slope) - slope, 0)
        top = int(new.max())
        if top > best:
            best, end = top, i + 1
        row = new
    return best, end


def align(text: np.ndarray, item: np.ndarray) -> tuple[float, int, int]:
    """Smith-Waterman of a passage and a test item: share of a perfect copy's score, and the span in the passage."""
    best, end = _table(text, item)
    if not best:
        return 0.0, 0, 0
    _, length = _table(text[:end][::-1], item[::-1])
    return best / (MATCH * len(item)), end - length, end


def least_score(size: int, min_score: float) -> float:
    """The score that a copy of an item of ``size`` words needs."""
    if size < EXACT_WORDS:
        return 1.0
    if size < ONE_EDIT_WORDS:
        return max(min_score, 1 - (MATCH - MISMATCH) / (MATCH * size))
    return max(min_score, 0.5) if size < FEW_WORDS else min_score


def _clusters(begin: np.ndarray, place: np.ndarray, reach: int, need: int) -> Iterator[tuple[int, int]]:
    """Ranges of places where an item seems to begin, no further apart than ``reach``, told by seeds at ``need`` places of the item or more."""
    order = np.argsort(begin, kind="stable")
    begin, place = begin[order], place[order]
    for part in np.split(np.arange(len(begin)), np.flatnonzero(np.diff(begin) > reach) + 1):
        if need < 2 or place[part].min() != place[part].max():
            yield int(begin[part[0]]), int(begin[part[-1]])


def _frequencies(seeds: Seeds, text_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(seeds.keys), np.int64)
        for batch in batches:
            for text in batch[text_col]:
                _, gram = seeds.hits(seeds.encode(words(text.as_py())))
                total[np.unique(gram)] += 1
        there = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(there), pa.array(total[there])], names=["gram", "n"])

    return run


def _matcher(seeds: Seeds, rare: np.ndarray, min_score: float):
    """A function from a text to the copies in it: item, first and last word, score."""
    owner_item, owner_place = seeds.owners

    @lru_cache(20_000)
    def scored(passage: bytes, item: int) -> tuple[float, int, int]:
        return align(np.frombuffer(passage, np.int64), seeds.coded[item])

    def short(text: str) -> Iterator[tuple]:
        at = 0
        for line in text.split("\n"):
            ws = words(line)
            if ws:
                for item in seeds.short.get(tuple(ws), ()):
                    yield item, at, at + len(ws), 1.0
            at += len(ws)

    def found(text: str | None) -> Iterator[tuple]:
        if seeds.short and text:
            yield from short(text)
        coded = seeds.encode(words(text))
        at, gram = seeds.hits(coded)
        seed = rare[gram]
        at, gram = at[seed], gram[seed]
        if not len(at):
            return
        n = seeds.first[gram + 1] - seeds.first[gram]
        pick = np.repeat(seeds.first[gram] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        item, place = owner_item[pick], owner_place[pick]
        order = np.argsort(item, kind="stable")
        item, place, begin = item[order], place[order], (np.repeat(at, n) - place)[order]
        for part in np.split(np.arange(len(item)), np.flatnonzero(np.diff(item)) + 1):
            k = int(item[part[0]])
            size = len(seeds.coded[k])
            slack = size // 2 + seeds.n
            for low, high in _clusters(begin[part], place[part], size, 2 if size >= TWO_SEEDS else 1):
                a, b = max(0, low - slack), min(len(coded), high + size + slack)
                score, start, end = scored(coded[a:b].tobytes(), k)
                if score >= least_score(size, min_score):
                    yield seeds.items[k][0], a + start, a + end, score

    return found


def _aligned(seeds: Seeds, rare: np.ndarray, id_col: str, text_col: str, min_score: float, names: list[str], item_type: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = _matcher(seeds, rare, min_score)
        for batch in batches:
            out = [(i, *hit) for i, text in enumerate(batch[text_col]) for hit in found(text.as_py())]
            if out:
                rows, item, start, end, score = zip(*out)
                cols = [batch[id_col].take(pa.array(rows, pa.int64())), pa.array(item, item_type), pa.array(start, pa.int64()), pa.array(end, pa.int64()), pa.array(score, pa.float64())]
                yield pa.RecordBatch.from_arrays(cols, names=names)

    return run


def _without(seeds: Seeds, rare: np.ndarray, text_col: str, min_score: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = _matcher(seeds, rare, min_score)
        for batch in batches:
            yield batch.filter(pa.array([next(found(text.as_py()), None) is None for text in batch[text_col]], pa.bool_()))

    return run


def _seeded(docs: DataFrame, benchmark: DataFrame, text_col: str, item_col: str, item_text: str, seed_words: int, block_bytes: int) -> Iterator[tuple[Seeds, np.ndarray]]:
    """The seeds of each block of the benchmark, and which of them are rare in ``docs``."""
    items = benchmark.select(F.col(item_col).alias("item"), F.col(item_text).alias("text")).where("text IS NOT NULL")
    size = items.agg(F.sum(F.octet_length("text")).alias("n")).first().n or 0
    blocks = max(1, -(-size // block_bytes))
    for block in range(blocks):
        own = items.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == block).orderBy("item", "text").collect()
        seeds = Seeds([(r["item"], r["text"]) for r in own], seed_words)
        frequency = np.zeros(len(seeds.keys), np.int64)
        if len(frequency):
            counts = docs.select(text_col).mapInArrow(tidy(_frequencies(seeds, text_col)), "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))
            for r in counts.toLocalIterator():
                frequency[r.gram] = r.n
        yield seeds, seeds.rare(frequency)


def contaminated(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text",
    seed_words: int = SEED_WORDS, min_score: float = MIN_SCORE, block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """Copies of test items in documents, edited ones included.

    The benchmark's n-grams are counted over all documents. Of those that occur,
    the rare ones of an item seed it: a passage around places where a document has
    two of them (one, of items under ``TWO_SEEDS`` words) is aligned with the item by Smith-Waterman, and counts from
    ``min_score`` of a perfect copy's score. The seeds join to the documents
    inside the scans (two of them: counts, then alignments), so no text is
    shuffled and a passage that very many documents share makes no hot key. A
    benchmark over ``block_bytes`` is handled in blocks, so what a task holds
    stays bounded.

    Returns a row per copy: ``id_col, item_col, start_word, end_word, score``
    (words of ``words()``; copies of one item nearer than its length count once).
    Items under ``LINE_WORDS`` words have a copy where a whole line is equal to
    them, those under ``EXACT_WORDS`` where all their words stand, those under
    ``ONE_EDIT_WORDS`` where at most one is another. Null and empty texts and items have no copies. Repeated rows give
    repeated results; an empty table gives an empty one; other columns are ignored.
    """
    names = [id_col, item_col, "start_word", "end_word", "score"]
    fields = [T.StructField(id_col, docs.schema[id_col].dataType), T.StructField(item_col, benchmark.schema[item_col].dataType)]
    fields += [T.StructField("start_word", T.LongType()), T.StructField("end_word", T.LongType()), T.StructField("score", T.DoubleType())]
    schema = T.StructType(fields)
    texts = small_batches(docs).select(id_col, text_col)
    found = docs.sparkSession.createDataFrame([], schema)
    for seeds, rare in _seeded(docs, benchmark, text_col, item_col, item_text, seed_words, block_bytes):
        run = _aligned(seeds, rare, id_col, text_col, min_score, names, to_arrow_type(schema[item_col].dataType))
        found = found.unionByName(texts.mapInArrow(tidy(run), schema))
    return found


def without_copies(
    docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text",
    seed_words: int = SEED_WORDS, min_score: float = MIN_SCORE, block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """The rows of ``docs`` without a copy of a test item, as ``contaminated`` finds them, all columns as they are.

    Rows are dropped inside the scan, so null ids and repeated rows are treated
    as any others; null and empty texts stay.
    """
    kept = small_batches(docs)
    for seeds, rare in _seeded(docs, benchmark, text_col, item_col, item_text, seed_words, block_bytes):
        kept = kept.mapInArrow(tidy(_without(seeds, rare, text_col, min_score)), docs.schema)
    return kept
