"""Interpolated modified Kneser-Ney bigram model over sorted hash arrays."""

from __future__ import annotations

import json
import os
import uuid
from collections import OrderedDict
from collections.abc import Iterator
from dataclasses import asdict, dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from notemill.llm.workers import kept, small_batches, tidy
from notemill.staging import new_path

U64 = np.uint64
#: Text bytes tokenised at once, and distinct bigrams that a task holds before it merges them.
SLICE_BYTES = 2 << 20
MERGE_AT = 3_000_000
#: Stands in the array of counts for this count and all higher ones.
MANY = 255
#: Training text, in bytes, behind one shard of the model.
SHARD_BYTES = 24 << 20
#: Arrays that a worker has mapped at once; the one used longest ago is closed.
OPEN_MAPS = 8192
BEGIN, END = U64(0x9E3779B97F4A7C15), U64(0xD1B54A32D192ED03)
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_RANDOM = np.random.default_rng(20_240_601).integers(0, 2**64, 256, U64) | U64(1)
_STEP = U64(0xF1357AEA2E62A9C5)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads them evenly (the finaliser of SplitMix64)."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


@lru_cache(4)
def _powers(n: int) -> np.ndarray:
    out = np.ones(n, U64)
    out[1:] = _STEP
    return np.multiply.accumulate(out)


def _hash_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    out = np.empty(len(starts), U64)
    begin = 0
    while begin < len(starts):  # a slice of words at a time
        stop = max(begin + 1, int(np.searchsorted(ends, starts[begin] + SLICE_BYTES)))
        s, sizes = starts[begin:stop], (ends - starts)[begin:stop]
        first = np.cumsum(sizes) - sizes
        place = np.arange(int(sizes.sum())) - np.repeat(first, sizes)
        chars = _LOWER[data[np.repeat(s, sizes) + place]]
        power = _powers(1 << max(8, int(sizes.max()).bit_length()))
        out[begin:stop] = mix(np.add.reduceat(_RANDOM[chars] * power[place], first) + sizes.astype(U64))
        begin = stop
    return out


def _bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts, and where each begins (and the last ends); null counts as empty."""
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if texts.buffers()[2] is None:
        return np.empty(0, np.uint8), offsets - offsets[0]
    return np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def word_spans(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes and offsets of all texts, and begin, end and hash of every word in them.

    Words are runs of bytes other than space and 0x09-0x0D, with A-Z lower-cased.
    """
    data, offsets = _bytes_of(texts)
    inside = ~_SPACE[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[offsets] = True
    starts = np.flatnonzero(inside & (np.r_[True, ~inside[:-1]][: len(data)] | cut[:-1]))
    ends = np.flatnonzero(inside & (np.r_[~inside[1:], True] | cut[1:])) + 1 if len(data) else starts
    return data, offsets, starts, ends, _hash_words(data, starts, ends)


def tokenise(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes of all texts, and how many each has: its words, then one end token."""
    _, offsets, starts, _, words = word_spans(texts)
    counts = np.searchsorted(starts, offsets[1:]) - np.searchsorted(starts, offsets[:-1]) + 1
    tokens = np.empty(int(counts.sum()), U64)
    last = np.cumsum(counts) - 1
    word = np.ones(len(tokens), bool)
    word[last] = False
    tokens[word] = words
    tokens[last] = END
    return tokens, counts


def slices(texts: pa.Array) -> Iterator[pa.Array]:
    """Runs of texts of about SLICE_BYTES together, a longer text by itself."""
    group = np.cumsum(np.diff(_bytes_of(texts)[1])) // SLICE_BYTES
    for part in np.split(np.arange(len(texts)), np.flatnonzero(np.diff(group)) + 1):
        if len(part):
            yield texts.slice(int(part[0]), len(part))


def contexts(tokens: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The token before each, BEGIN at the start of a text."""
    before = np.empty_like(tokens)
    before[1:] = tokens[:-1]
    before[np.cumsum(counts) - counts] = BEGIN
    return before


def bigram(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    return mix(before * U64(0xA24BAED4963EE407) + word)


def _merge(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct keys in order, and the sums of each value per key."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.empty(0, np.int64)
    return keys[first], *(np.add.reduceat(v[order], first) if len(first) else v[:0] for v in values)


def _shard(hashes: np.ndarray, shards: int) -> np.ndarray:
    """Which of ``shards`` equal ranges of 64 bits a hash falls in."""
    return ((hashes >> U64(32)) * U64(shards) >> U64(32)).astype(np.int64)


class _Bigrams:
    """Distinct (before, word) pairs with counts, merged now and then."""

    def __init__(self):
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.held = self.settled = 0

    def add(self, before: np.ndarray, word: np.ndarray, n: np.ndarray) -> None:
        self.parts.append((before, word, n))
        self.held += len(n)
        if self.held > MERGE_AT + 2 * self.settled:
            self.merged()

    def merged(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        before, word, n = (np.concatenate(c) for c in zip(*self.parts)) if self.parts else (np.empty(0, U64), np.empty(0, U64), np.empty(0, np.int64))
        self.parts = []
        order = np.lexsort((word, before))
        before, word, n = before[order], word[order], n[order]
        first = np.flatnonzero(np.r_[True, (before[1:] != before[:-1]) | (word[1:] != word[:-1])]) if len(n) else np.empty(0, np.int64)
        before, word, n = before[first], word[first], np.add.reduceat(n, first) if len(first) else n
        self.parts, self.held, self.settled = [(before, word, n)], len(n), len(n)
        return before, word, n


#: kind, shard and named arrays, packed; what the two shuffles of the count carry.
_BLOB = "shard int, kind string, blob binary"
_NAMES = ["shard", "kind", "blob"]


def _pack(*arrays: np.ndarray) -> bytes:
    table = pa.table({str(i): a for i, a in enumerate(arrays)})
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="lz4")) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def _unpack(blob: pa.Scalar) -> list[np.ndarray]:
    table = pa.ipc.open_stream(blob.as_buffer()).read_all()
    return [c.to_numpy() for c in table.columns]


def _rows(rows: list[tuple[int, str, bytes]]) -> pa.RecordBatch:
    shard, kind, blob = zip(*rows)
    return pa.RecordBatch.from_arrays([pa.array(shard, pa.int32()), pa.array(kind, pa.string()), pa.array(blob, pa.binary())], names=_NAMES)


def _dealt(kind: str, shards: int, by: np.ndarray, *arrays: np.ndarray) -> Iterator[pa.RecordBatch]:
    """One blob of the arrays' rows per shard of ``by``."""
    shard = _shard(by, shards)
    order = np.argsort(shard, kind="stable")
    edges = np.searchsorted(shard[order], np.arange(shards + 1))
    for s in range(shards):
        at = order[edges[s] : edges[s + 1]]
        if len(at):
            yield _rows([(s, kind, _pack(*(a[at] for a in arrays)))])


def _count(text_col: str, shards: int):
    """Bigram and word counts of a task's texts, dealt by hash range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bigrams = _Bigrams()
        total = 0
        for batch in batches:
            for texts in slices(batch[text_col]):
                tokens, counts = tokenise(texts)
                before = contexts(tokens, counts)
                total += len(tokens)
                order = np.lexsort((tokens, before))
                u, w = before[order], tokens[order]
                first = np.flatnonzero(np.r_[True, (u[1:] != u[:-1]) | (w[1:] != w[:-1])])
                bigrams.add(u[first], w[first], np.diff(np.r_[first, len(u)]))
        before, word, n = bigrams.merged()
        if not total:
            return
        yield from _dealt("bigram", shards, bigram(before, word), before, word, n.astype(np.uint32))
        words, sums = _merge(word, n)
        yield from _dealt("word", shards, words, words, sums)

    return run


def _save(path: str, array: np.ndarray) -> None:
    """Write whole, then rename: a task that runs twice leaves the same file."""
    part = f"{path}.{uuid.uuid4().hex}.part"
    with open(part, "wb") as f:
        np.save(f, array)
    os.replace(part, path)


def _gathered(batches: Iterator[pa.RecordBatch]) -> tuple[int, dict[str, list[list[np.ndarray]]]]:
    shard, held = -1, {}
    for batch in batches:
        for s, kind, blob in zip(batch["shard"].to_pylist(), batch["kind"].to_pylist(), batch["blob"]):
            shard = s
            held.setdefault(kind, []).append(_unpack(blob))
    return shard, held


def _joined(parts: list[list[np.ndarray]]) -> list[np.ndarray]:
    return [np.concatenate(c) for c in zip(*parts)]


def _write_bigrams(folder: str, shards: int):
    """A shard's bigrams become sorted arrays; what they add to their words' statistics goes on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, held = _gathered(batches)
        if "word" in held:
            words, n = _merge(*_joined(held["word"]))
            zero = np.zeros(len(n), np.int64)
            yield from _dealt("word", shards, words, words, n, zero, zero, zero, zero, zero)
        if "bigram" not in held:
            return
        before, word, n = _joined(held.pop("bigram"))
        key = bigram(before, word)
        order = np.argsort(key, kind="stable")
        key, before, word, n = key[order], before[order], word[order], n[order].astype(np.int64)
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        key, before, word, n = key[first], before[first], word[first], np.add.reduceat(n, first)
        _save(f"{folder}/bigram-key-{shard}.npy", key)
        # Counts take a byte; the few over 254 stand in a table of their own.
        _save(f"{folder}/bigram-n-{shard}.npy", np.minimum(n, MANY).astype(np.uint8))
        _save(f"{folder}/bigram-many-{shard}.npy", np.stack([np.flatnonzero(n >= MANY), n[n >= MANY]]))
        grams = np.array([(n == 1).sum(), (n == 2).sum(), (n == 3).sum(), (n == 4).sum()])
        yield _rows([(0, "of", _pack(grams))])
        one = np.ones(len(n), np.int64)
        words, contexts_of = _merge(word, one)
        zero = np.zeros(len(words), np.int64)
        yield from _dealt("word", shards, words, words, zero, contexts_of, zero, zero, zero, zero)
        heads, total, n1, n2, n3 = _merge(before, n, (n == 1).astype(np.int64), (n == 2).astype(np.int64), (n > 2).astype(np.int64))
        zero = np.zeros(len(heads), np.int64)
        yield from _dealt("word", shards, heads, heads, zero, zero, total, n1, n2, n3)

    return run


_STATS = "words long, tokens long, c1 long, c2 long, c3 long, c4 long, contexts long, k1 long, k2 long, k3 long, k4 long, k3plus long"


def _write_words(folder: str):
    """A shard's words become sorted arrays; returns what the model needs of all words together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, held = _gathered(batches)
        out = np.zeros(12, np.int64)
        for (of,) in held.get("of", ()):
            out[2:6] += of
        if "word" in held:
            words, n, contexts_of, total, n1, n2, n3 = _merge(*_joined(held.pop("word")))
            _save(f"{folder}/word-key-{shard}.npy", words)
            _save(f"{folder}/word-stats-{shard}.npy", np.stack([n, contexts_of, total, n1, n2, n3]))
            out[:2] = (n > 0).sum(), n.sum()
            out[6:] = contexts_of.sum(), *((contexts_of == k).sum() for k in (1, 2, 3, 4)), (contexts_of > 2).sum()
        if shard >= 0:
            yield pa.RecordBatch.from_arrays([pa.array([int(x)]) for x in out], names=[x.split()[0] for x in _STATS.split(", ")])

    return run


def discounts(n1: int, n2: int, n3: int, n4: int) -> list[float]:
    """Of modified Kneser-Ney (Chen and Goodman 1998), for counts of one, two, and three or more; kept within 0 and the count."""
    if not n1 or not n2:
        return [0.5, 0.75, 0.75]
    y = n1 / (n1 + 2 * n2)
    raw = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 1.5]
    return [min(max(d, 0.0), k) for k, d in enumerate(raw, 1)]


@dataclass(frozen=True)
class ModelInfo:
    """Where the arrays lie, and the numbers that hold for all of them."""

    folder: str
    shards: int
    words: int
    tokens: int
    contexts: int
    upper: tuple[float, float, float]
    lower: tuple[float, float, float]
    spread: float  # probability that the unigram level leaves to the uniform one

    def to_json(self) -> str:
        return json.dumps(asdict(self))


def mounted(path: str) -> str:
    """A shared folder as workers see it: memory maps need a mounted file system."""
    if path.startswith("file:"):
        return "/" + path[len("file:") :].lstrip("/")
    if "://" in path:
        raise ValueError(f"the model is memory-mapped, so it needs a mounted shared folder, not {path}")
    return path


def train(docs: DataFrame, text_col: str = "text", folder: str | None = None, shard_bytes: int = SHARD_BYTES) -> ModelInfo:
    """Count all whole texts and write the model under ``folder`` (default: in the shared folder).

    Tasks count bigrams of their texts and send each distinct one, with its
    count, to the shard of its hash's range; shards add up, write sorted arrays
    of keys and counts, and send on what each bigram adds to the statistics of
    its two words; a second set of shards does the same for words. Frequent
    words and bigrams arrive at most once per task, so no key is hot. Only
    twelve sums per shard reach the driver.
    """
    spark = docs.sparkSession
    folder = mounted(folder or new_path(spark, "lm"))
    texts = small_batches(docs).select(text_col)
    size = texts.agg(F.sum(F.octet_length(text_col)).alias("n")).first().n or 0
    shards = max(1, -(-size // shard_bytes))
    _mkdir(spark, folder)
    counted = texts.mapInArrow(tidy(_count(text_col, shards)), _BLOB).repartitionById(shards, F.col("shard"))
    passed = counted.mapInArrow(tidy(_write_bigrams(folder, shards)), _BLOB).repartitionById(shards, F.col("shard"))
    s = passed.mapInArrow(tidy(_write_words(folder)), _STATS).groupBy().sum().first()
    words, tokens, c1, c2, c3, c4, contexts_all, k1, k2, k3, k4, k3plus = (x or 0 for x in s)
    lower = discounts(k1, k2, k3, k4)
    spread = (lower[0] * k1 + lower[1] * k2 + lower[2] * k3plus) / contexts_all if contexts_all else 1.0
    return ModelInfo(folder, shards, words, tokens, contexts_all, tuple(discounts(c1, c2, c3, c4)), tuple(lower), spread)


def _mkdir(spark, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"file://{folder}")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(path)


class Model:
    """The arrays, memory-mapped, and probabilities from them."""

    def __init__(self, info: ModelInfo):
        self.info = info
        self.maps: OrderedDict[str, np.ndarray | None] = OrderedDict()

    def _map(self, name: str, shard: int) -> np.ndarray | None:
        key = f"{name}-{shard}"
        if key not in self.maps:
            path = f"{self.info.folder}/{key}.npy"
            self.maps[key] = np.load(path, mmap_mode="r") if os.path.exists(path) else None
            if len(self.maps) > OPEN_MAPS:
                self.maps.popitem(last=False)
        self.maps.move_to_end(key)
        return self.maps[key]

    def _look_up(self, kind: str, keys: np.ndarray, value: str) -> np.ndarray:
        """Values of sorted distinct keys, 0 where absent; rows of a table for words."""
        rows = 6 if kind == "word" else 1
        out = np.zeros((rows, len(keys)), np.int64)
        edges = np.searchsorted(_shard(keys, self.info.shards), np.arange(self.info.shards + 1))
        for s in range(self.info.shards):
            a, b = edges[s], edges[s + 1]
            held = self._map(f"{kind}-key", s) if a < b else None
            if held is None or not len(held):
                continue
            at = np.minimum(np.searchsorted(held, keys[a:b]), len(held) - 1)
            hit = np.flatnonzero(held[at] == keys[a:b])
            found = np.atleast_2d(self._map(f"{kind}-{value}", s))[:, at[hit]].astype(np.int64)
            if kind == "bigram" and (many := np.flatnonzero(found[0] == MANY)).size:
                place, n = self._map("bigram-many", s)
                found[0, many] = n[np.searchsorted(place, at[hit[many]])]
            out[:, a + hit] = found
        return out

    def log10(self, tokens: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """log10 of each token's probability, and its count in the training text."""
        i = self.info
        words, at = np.unique(np.concatenate([tokens, before]), return_inverse=True)
        stats = self._look_up("word", words, "stats")
        w, u = at[: len(tokens)], at[len(tokens) :]
        heard = stats[1]
        cut = np.array([0.0, *i.lower])
        share = (heard - cut[np.minimum(heard, 3)]).clip(0) / max(1, i.contexts) + i.spread / (i.words + 1)
        keys, place = np.unique(bigram(before, tokens), return_inverse=True)
        n = self._look_up("bigram", keys, "n")[0][place]
        cut = np.array([0.0, *i.upper])
        _, _, total, n1, n2, n3 = stats[:, u]
        known = total > 0
        total = np.maximum(total, 1)
        left = np.where(known, (i.upper[0] * n1 + i.upper[1] * n2 + i.upper[2] * n3) / total, 1.0)
        p = (n - cut[np.minimum(n, 3)]).clip(0) / total + left * share[w]
        return np.log10(p), stats[0][w]


def _opened(info: ModelInfo) -> Model:
    return kept(info, lambda: Model(info))


def score(docs: DataFrame, info: ModelInfo, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Score every whole text.

    Returns ``id_col, n_tokens, n_known`` (tokens that the training text has),
    ``train_tokens, base_score`` (log10 under add-one unigrams) and ``score``
    (log10 under the model); perplexity is ``10 ** (-score / n_tokens)``. Null
    and empty texts are one end token. Repeated rows stay; other columns are
    ignored; a model of no text gives the uniform probability of one unknown word.
    """
    fields = [T.StructField(id_col, docs.schema[id_col].dataType)] + [T.StructField(n, T.LongType()) for n in ("n_tokens", "n_known", "train_tokens")]
    schema = T.StructType(fields + [T.StructField(n, T.DoubleType()) for n in ("base_score", "score")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _opened(info)
        for batch in batches:
            at = 0
            for texts in slices(batch[text_col]):
                tokens, counts = tokenise(texts)
                logs, seen = known.log10(tokens, contexts(tokens, counts))
                first = np.cumsum(counts) - counts
                base = np.log10((seen + 1) / (info.tokens + info.words + 1))
                cols = [batch[id_col].slice(at, len(texts)), pa.array(counts.astype(np.int64)), pa.array(np.add.reduceat((seen > 0).astype(np.int64), first))]
                cols += [pa.array(np.full(len(texts), info.tokens)), pa.array(np.add.reduceat(base, first)), pa.array(np.add.reduceat(logs, first))]
                yield pa.RecordBatch.from_arrays(cols, names=schema.names)
                at += len(texts)

    return small_batches(docs).select(id_col, text_col).mapInArrow(tidy(run), schema)
