"""SimHash near-duplicates through a Gray-order hierarchical index."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from notemill.llm.components import connected_components
from notemill.llm.workers import small_batches, tidy
from notemill.staging import Scratch, stage, unstage

#: Bits of the five blocks that a fingerprint is cut into. Fingerprints that
#: differ in four bits or fewer agree in at least one whole block.
BLOCKS = ((51, 13), (38, 13), (25, 13), (12, 13), (0, 12))
#: Children of a node of the local index.
FANOUT = 8
#: Node pairs expanded at once.
STEP = 1 << 16


def simhash64(text: bytes | None, shingle: int = 4, seed: int = 42) -> int:
    """The fingerprint of one text: bit i is set if over half the shingles' XXH64 have it.

    Words are maximal runs of bytes other than space and 0x09-0x0D, with A-Z
    lower-cased. Fewer words than ``shingle`` make one shingle; no words, or
    null, give 0.
    """
    words = (text or b"").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1).tolist()
    digest = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        hashes = [digest(joined, seed)]
    else:
        starts = [0, *ends]
        hashes = [digest(joined[a : b - 1], seed) for a, b in zip(starts, ends[shingle - 1 :])]
    bits = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 8192):
        part = np.array(hashes[at : at + 8192], ">u8").view(np.uint8).reshape(-1, 8)
        bits += np.unpackbits(part, axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(bits * 2 > len(hashes)).tobytes(), "big")


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """Place of each 64-bit code in the reflected Gray sequence."""
    rank = codes.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


def _parents(group: np.ndarray, low: np.ndarray, high: np.ndarray):
    """Pack up to FANOUT neighbouring nodes of one group under one node."""
    first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    place = np.arange(len(group)) - np.repeat(first, np.diff(np.r_[first, len(group)]))
    starts = np.flatnonzero(place % FANOUT == 0)
    return starts, group[starts], np.bitwise_and.reduceat(low, starts), np.bitwise_or.reduceat(high, starts)


def close_pairs(group: np.ndarray, codes: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs i < j of the same group whose codes differ in at most ``most`` bits.

    ``group`` and ``codes`` must be sorted by group, then Gray rank. A node keeps
    the bits that all codes below it share, as their AND and OR; the bits shared
    within both nodes of a pair but different between them bound the distance of
    every pair below, and pairs of nodes beyond ``most`` are dropped whole.
    """
    if not len(codes):
        return
    levels = [(np.arange(len(codes) + 1), group, codes, codes)]
    while len(levels[-1][1]) > 1 and (levels[-1][1][1:] == levels[-1][1][:-1]).any():
        _, g, low, high = levels[-1]
        starts, g2, low2, high2 = _parents(g, low, high)
        levels.append((np.r_[starts, len(g)], g2, low2, high2))
    top = np.arange(len(levels[-1][1]))
    work = [(len(levels) - 1, top[at : at + STEP], top[at : at + STEP]) for at in range(0, len(top), STEP)]
    while work:
        level, a, b = work.pop()
        if level == 0:
            yield a, b
            continue
        starts = levels[level][0]
        na, nb = starts[a + 1] - starts[a], starts[b + 1] - starts[b]
        n = na * nb
        pair = np.repeat(np.arange(len(a)), n)
        inner = np.arange(len(pair)) - np.repeat(np.cumsum(n) - n, n)
        ca, cb = starts[a][pair] + inner // nb[pair], starts[b][pair] + inner % nb[pair]
        keep = (ca < cb) if level == 1 else (ca <= cb)
        ca, cb = ca[keep], cb[keep]
        _, _, low, high = levels[level - 1]
        shared = ~(low[ca] ^ high[ca]) & ~(low[cb] ^ high[cb])
        keep = np.bitwise_count((low[ca] ^ low[cb]) & shared) <= most
        ca, cb = ca[keep], cb[keep]
        size = STEP if level == 1 else STEP // 16
        work += [(level - 1, ca[at : at + size], cb[at : at + size]) for at in range(0, len(ca), size)]


def _settle(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Merge the labels of linked items; each label is the smallest index of its set."""
    while True:
        a, b = label[i], label[j]
        differ = a != b
        if not differ.any():
            return
        i, j, a, b = i[differ], j[differ], a[differ], b[differ]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while (label[label] != label).any():
            label[:] = label[label]


_LINK = T.StructType([T.StructField("src", T.LongType()), T.StructField("dst", T.LongType())])


def _link_partition(most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cols = [(b["part"].to_numpy(), b["fp"].to_numpy()) for b in batches]
        if not cols:
            return
        part, fp = (np.concatenate(c) for c in zip(*cols))
        codes = fp.view(np.uint64)
        order = np.lexsort((gray_rank(codes), part))
        part, codes = part[order], codes[order]
        label = np.arange(len(codes))
        for i, j in close_pairs(part, codes, most):
            _settle(label, i, j)
        # The same node comes back once per block; a tree of links to one member of each set is enough.
        far = np.flatnonzero(label != np.arange(len(label)))
        src, dst = codes[far].view(np.int64), codes[label[far]].view(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(src), pa.array(dst)], names=["src", "dst"])

    return run


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4) -> DataFrame:
    """``id_col``, ``th`` (xxhash64 of the text) and ``fp``, the signed 64-bit SimHash of every whole text."""
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("th", T.LongType()), T.StructField("fp", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch[text_col]
            out = np.fromiter((simhash64(x.as_buffer().to_pybytes() if x.is_valid else None, shingle) for x in texts), np.uint64, len(texts))
            yield pa.RecordBatch.from_arrays([batch[id_col], batch["th"], pa.array(out.view(np.int64))], names=schema.names)

    return small_batches(docs).select(id_col, text_col, F.xxhash64(text_col).alias("th")).mapInArrow(tidy(run), schema)


def link_fingerprints(codes: DataFrame, max_bits: int = 4, group_limit: int = 4096) -> DataFrame:
    """Links (``src``, ``dst``) that connect all ``fp`` within ``max_bits`` of each other.

    ``codes`` holds distinct ``fp``. Every fingerprint goes
    to one group per block, by the block's value (the groups number at most
    36,864 at any input size), so each close pair meets in at least one group.
    A group over ``group_limit`` is dealt again by the five parts of its other
    bits, which again every close pair shares one of: nothing is dropped.
    Within a task the index finds close pairs and reports a tree of links.
    """
    if max_bits > 4:
        raise ValueError("five blocks find pairs of up to four differing bits")
    cut = lambda c, at, n: F.shiftrightunsigned(c, at).bitwiseAND(F.lit((1 << n) - 1)).cast("int")
    keyed = codes.select(
        "fp", F.explode(F.array(*[(F.lit(i << 13) + cut(F.col("fp"), *b)).alias("k") for i, b in enumerate(BLOCKS)])).alias("k")
    )
    large = F.broadcast(keyed.groupBy("k").count().where(F.col("count") > group_limit).select("k", F.lit(True).alias("large")))
    keyed = keyed.join(large, "k", "left")
    # The other 51 or 52 bits, closed up around the group's own block.
    def around(at: int, n: int):
        below = F.shiftrightunsigned(F.shiftleft("fp", 64 - at), n) if at else F.lit(0)
        return below.bitwiseOR(F.shiftrightunsigned("fp", at + n)) if at + n < 64 else below

    rest = F.coalesce(*[F.when(F.shiftright("k", 13) == i, around(*b)) for i, b in enumerate(BLOCKS)])
    parts = F.array(*[(F.lit(1 + (i << 11)) + cut(rest, 10 * i, 10 if i < 4 else 11)).cast("int") for i in range(5)])
    keyed = keyed.select("fp", "k", F.explode(F.when(F.col("large"), parts).otherwise(F.array(F.lit(0)))).alias("p"))
    keyed = keyed.select((F.col("k").cast("long") * 65536 + F.col("p")).alias("part"), "fp")
    return keyed.repartition("part").mapInArrow(tidy(_link_partition(max_bits)), _LINK)


def _best_by_print(prints: DataFrame, best: Column, max_bits: int) -> DataFrame:
    """``fp, best``, staged: the least ``best`` of all rows whose fingerprints are linked to ``fp``."""
    keep = Scratch()
    codes = keep(prints.groupBy("fp").agg(best.alias("best")), "codes")
    groups = connected_components(link_fingerprints(codes.select("fp"), max_bits))
    linked = keep(groups.select(F.col("node").alias("fp"), "component").join(codes, "fp"), "linked")
    unstage(groups)
    least = keep(linked.groupBy("component").agg(F.min("best").alias("least")), "least")
    of = linked.select("fp", "component").join(least, "component").select("fp", "least")
    named = stage(codes.join(of, "fp", "left").select("fp", F.coalesce("least", "best").alias("best")), "named")
    keep.clear()
    return named


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_bits: int = 4, shingle: int = 4) -> DataFrame:
    """One row per document: id, ``fp`` and ``component_id``, the smallest id linked to it.

    Documents link when their fingerprints differ in ``max_bits`` or fewer.
    Null, empty and white-space texts have fingerprint 0 and link like any
    other. Repeated rows give repeated rows; an empty table an empty one; other
    columns are ignored. A null id takes part and links others, but never names
    a component unless its whole component is null.
    """
    if id_col != "doc_id" or text_col != "text":
        docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    prints = stage(fingerprints(docs, shingle=shingle).drop("th"), "fp")
    named = _best_by_print(prints, F.min("doc_id").cast("long"), max_bits)
    return prints.join(named, "fp").select(F.col("doc_id").alias(id_col), "fp", F.col("best").alias("component_id"))


def representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_bits: int = 4, shingle: int = 4) -> DataFrame:
    """``id, th``: one document of each group of ``near_duplicates``, by id and xxhash64 of its text.

    The one with the smallest id, null ids last; of equal ids the smallest hash.
    """
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    prints = stage(fingerprints(docs, "id", shingle=shingle), "fp")
    best = F.min(F.struct(F.col("id").isNull(), "id", "th"))
    return _best_by_print(prints, best, max_bits).select("best.id", "best.th").distinct()


def one_of_each_group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` whose document represents its near-duplicate group; of equal ids and texts one row."""
    keep = stage(representatives(docs, id_col, text_col, **options), "keep")
    # Null ids compare as such, and the window's groups are the join's: one shuffle of the texts serves both.
    known = lambda c, th: [c.isNull().alias("n"), F.coalesce(c.cast("string"), F.lit("")).alias("i"), F.col(th).alias("h")]
    rows = docs.select(F.struct("*").alias("row"), F.xxhash64(text_col).alias("th"), F.col(id_col).alias("id"))
    rows = rows.select("row", *known(F.col("id"), "th"))
    first = F.row_number().over(Window.partitionBy("n", "i", "h").orderBy("h"))
    kept = rows.join(keep.select(*known(F.col("id"), "th")), ["n", "i", "h"], "left_semi").withColumn("place", first).where("place = 1")
    return kept.select("row.*")
