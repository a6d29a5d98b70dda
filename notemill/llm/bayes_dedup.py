"""Near duplicates by shingle sets: MinHash bands, sequential Bayesian pruning, exact verification."""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from notemill.llm.components import connected_components
from notemill.llm.workers import small_batches, tidy
from notemill.staging import Scratch, stage, unstage

#: Bands of so many hashes each. Sets that share 0.8 miss each other in all bands with probability 5e-8.
BANDS, ROWS = 32, 4
#: Hashes compared before each look at the posterior, and the probability below which a pair is given up.
BATCH, MISS = 16, 1e-6
#: Sets that one task compares with each other, and shingles in them all; larger groups are dealt again.
GROUP, GROUP_SHINGLES = 2_000, 4_000_000
#: Pairs whose signatures are compared at once.
PAIRS = 1 << 17
#: Sets checked against one set in one go; those of a set with more partners are dealt out.
PARTNERS = 256
#: Links that make a task of the components.
TASK_LINKS = 50_000
#: Bits at most of the map that tells scans which rows are wanted.
MAP_BITS = 1 << 27
_rng = np.random.default_rng(20_24)
_FACTOR = _rng.integers(0, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
_SHIFT = _rng.integers(0, 1 << 63, BANDS * ROWS, np.uint64)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def shingle_set(text: bytes | None, shingle: int) -> np.ndarray:
    """Sorted distinct XXH64 of the text's word shingles, A-Z lower-cased; fewer words make one shingle, none make none."""
    words = (text or b"").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return np.array([digest(joined)], np.uint64)
    ends = (np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1).tolist()
    starts = [0, *[e + 1 for e in ends]]
    return np.unique(np.fromiter((digest(joined[a:b]) for a, b in zip(starts, ends[shingle - 1 :])), np.uint64, len(words) - shingle + 1))


def signature(hashes: np.ndarray) -> np.ndarray:
    """The upper halves of the least values of BANDS * ROWS hash functions."""
    least = np.full(len(_FACTOR), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), 2048):
        values = np.multiply.outer(_FACTOR, hashes[at : at + 2048])
        values += _SHIFT[:, None]
        np.minimum(least, values.min(1), out=least)
    return (least >> np.uint64(32)).astype("<u4")


def least_matches(similarity: float, hashes: int, miss: float) -> int:
    """Fewest matches of so many hashes at which the posterior (uniform prior) of a similarity of at least ``similarity`` is ``miss`` or more."""
    # The tail of Beta(m + 1, n - m + 1) above s is that of a binomial of n + 1 trials up to m.
    tail, m = 0.0, -1
    while tail < miss and m < hashes:
        m += 1
        tail += comb(hashes + 1, m) * similarity**m * (1 - similarity) ** (hashes + 1 - m)
    return m


class Pruner:
    """Tells which pairs of signatures can still be similar, batch of hashes by batch."""

    def __init__(self, similarity: Fraction, miss: float):
        steps = range(BATCH, BANDS * ROWS + 1, BATCH)
        self.bounds = [(n - BATCH, n, least_matches(float(similarity), n, miss)) for n in steps]
        self.similarity = similarity

    def survivors(self, left: np.ndarray, right: np.ndarray, i: np.ndarray, j: np.ndarray, left_n: np.ndarray, right_n: np.ndarray) -> np.ndarray:
        """Which of the pairs of rows ``i`` of the one matrix and ``j`` of the other survive; sizes too far apart go first."""
        low, high = np.minimum(left_n[i], right_n[j]), np.maximum(left_n[i], right_n[j])
        alive = np.flatnonzero(low * self.similarity.denominator >= high * self.similarity.numerator)
        same = np.zeros(len(alive), np.int64)
        for begin, end, least in self.bounds:
            same += (left[i[alive], begin:end] == right[j[alive], begin:end]).sum(1)
            stay = same >= least
            alive, same = alive[stay], same[stay]
        return alive


def _signatures(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u4").reshape(len(column), BANDS * ROWS)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(29))) * _MIX
    return x ^ (x >> np.uint64(32))


def band_keys(signatures: np.ndarray) -> np.ndarray:
    """A key per signature (row) and band (column)."""
    values = signatures.astype(np.uint64).reshape(-1, BANDS, ROWS)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64) * _MIX, values.shape[:2])
    for k in range(ROWS):
        key = _mixed(key + values[:, :, k])
    return key


def _sketch(shingle: int, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(t.as_py(), shingle) for t in batch["_text"]]
            node = [xxhash.xxh128_digest(s.tobytes()) if len(s) else None for s in sets]
            sig = [signature(s).tobytes() if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays([batch["_id"], batch["_row"], pa.array(list(map(len, sets)), pa.int64()), pa.array(node, pa.binary()), pa.array(sig, pa.binary())], names=names)

    return run


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            keys = band_keys(_signatures(batch["sig"]))
            who = pa.array(np.repeat(np.arange(batch.num_rows), BANDS))
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), batch["node"].take(who), batch["n"].take(who)], names=["key", "node", "n"])


def _rekeyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each row of a large group once more for each of its other bands."""
    for batch in batches:
        if batch.num_rows:
            own = batch["key"].to_numpy().view(np.uint64)[:, None]
            keys = band_keys(_signatures(batch["sig"]))
            row, band = np.nonzero(keys != own)
            key = _mixed(keys[row, band] + _mixed(own[row, 0]))
            yield batch.take(pa.array(row)).set_column(0, "key", pa.array(key.view(np.int64)))


def _pruned(pruner: Pruner):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                each = np.arange(batch.num_rows)
                stay = pruner.survivors(_signatures(batch["sig_a"]), _signatures(batch["sig_b"]), each, each, batch["n_a"].to_numpy(), batch["n_b"].to_numpy())
                yield batch.select(["a", "b"]).take(pa.array(stay))

    return run


def _survivors(rows: pa.Table, group: np.ndarray, part: np.ndarray, pruner: Pruner) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows of one group, but of different parts (and blocks), whose signatures survive, where this is the first band that they share.

    ``group`` ascends. Pairs are made for some rows at a time.
    """
    sig, n, block = _signatures(rows["sig"].combine_chunks()), rows["n"].to_numpy(), rows["block"].to_numpy()
    apart = rows["x"].to_numpy() != rows["y"].to_numpy()
    hit = band_keys(sig).view(np.int64) == rows["key"].to_numpy()[:, None]
    band = np.where(hit.any(1), hit.argmax(1), -1)  # none: the group is of two bands, and may repeat a pair
    later = np.searchsorted(group, group, "right") - np.arange(len(group)) - 1
    upto, begin = np.cumsum(later), 0
    while begin < len(group):
        end = max(begin + 1, int(np.searchsorted(upto, (upto[begin - 1] if begin else 0) + PAIRS, "right")))
        i = np.repeat(np.arange(begin, end), later[begin:end])
        j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(later[begin:end]) - later[begin:end], later[begin:end])
        keep = (part[i] != part[j]) & (~apart[i] | (block[i] != block[j]))
        i, j = i[keep], j[keep]
        keep = pruner.survivors(sig, sig, i, j, n, n)
        i, j = i[keep], j[keep]
        shared = (sig[i] == sig[j]).reshape(-1, BANDS, ROWS).all(2)
        keep = (band[i] < 0) | (shared.argmax(1) == band[i])
        yield i[keep], j[keep]
        begin = end


def _parts(rows: pa.Table) -> np.ndarray:
    return rows["component"].combine_chunks().dictionary_encode().indices.to_numpy().copy()


def _meeting(pruner: Pruner):
    """The rows that have a surviving partner in their group."""

    def of(rows: pa.Table, group: np.ndarray) -> Iterator[pa.RecordBatch]:
        there = np.zeros(len(rows), bool)
        for i, j in _survivors(rows, group, _parts(rows), pruner):
            there[i] = there[j] = True
        if there.any():
            yield from rows.filter(pa.array(there)).combine_chunks().to_batches()

    return _by_groups(of)


def _linking(pruner: Pruner, similarity: Fraction):
    """``a, b``: similar sets of a group that connect its components; what is connected already is not compared."""

    def of(rows: pa.Table, group: np.ndarray) -> Iterator[pa.RecordBatch]:
        sets = [np.frombuffer(x.as_py(), np.uint64) for x in rows["set"]]
        size = np.fromiter(map(len, sets), np.int64, len(sets))
        ids = np.unique(np.concatenate(sets), return_inverse=True)[1]
        begin = np.concatenate([[0], np.cumsum(size)]).tolist()
        mark, last = np.zeros(int(ids.max()) + 1, bool), -1
        part, one, other = _parts(rows), [], []
        first = np.searchsorted(group, group)
        behind = np.searchsorted(group, group, "right")
        for left, right in _survivors(rows, group, part.copy(), pruner):
            for i, j in zip(left.tolist(), right.tolist()):
                if part[i] == part[j]:
                    continue
                if i != last:
                    if last >= 0:
                        mark[ids[begin[last] : begin[last + 1]]] = False
                    mark[ids[begin[i] : begin[i + 1]]], last = True, i
                both = int(np.count_nonzero(mark[ids[begin[j] : begin[j + 1]]]))
                if both * similarity.denominator >= (size[i] + size[j] - both) * similarity.numerator:
                    one.append(i)
                    other.append(j)
                    own = part[first[i] : behind[i]]
                    own[own == part[j]] = part[i]
        if one:
            nodes = rows["node"].combine_chunks()
            yield pa.RecordBatch.from_arrays([nodes.take(pa.array(one)), nodes.take(pa.array(other))], names=["a", "b"])

    return _by_groups(of)


def _by_groups(of):
    """``of`` some whole groups of rows at a time, sorted by ``key``, ``x``, ``y``, with the group of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size < GROUP // 2:
                continue
            rows = pa.Table.from_batches(held)
            group = _group_numbers(rows)
            done = int(np.searchsorted(group, group[-1]))  # the last group may go on in the next batch
            if done:
                yield from of(rows.slice(0, done), group[:done])
            held = rows.slice(done).combine_chunks().to_batches()
            size = len(rows) - done
        if size:
            rows = pa.Table.from_batches(held)
            yield from of(rows, _group_numbers(rows))

    return run


def _group_numbers(rows: pa.Table) -> np.ndarray:
    key, x, y = (rows[c].to_numpy() for c in ("key", "x", "y"))
    return np.concatenate([[0], np.cumsum((np.diff(key) != 0) | (np.diff(x) != 0) | (np.diff(y) != 0))])


def _wanted(shingle: int, bits: np.ndarray):
    """The sets of the rows whose bit is set, each once in a task."""
    mask = np.uint64(len(bits) * 8 - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent = set()
        for batch in batches:
            at = batch["_row"].to_numpy().view(np.uint64) & mask
            for k in np.flatnonzero(bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1).tolist():
                own = shingle_set(batch["_text"][k].as_py(), shingle).tobytes()
                node = xxhash.xxh128_digest(own)
                if own and node not in sent:
                    sent.add(node)
                    yield pa.RecordBatch.from_arrays([pa.array([node], pa.binary()), pa.array([own], pa.binary())], names=["node", "set"])

    return run


def _verify(similarity: Fraction):
    """Pairs that are similar, from rows sorted by ``a``, ``part``: first the set of ``a``, then those of its partners."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, own = None, None
        for batch in batches:
            hit = []
            for k, (a, b, packed) in enumerate(zip(batch["a"].to_pylist(), batch["b"].to_pylist(), batch["set"])):
                other = np.frombuffer(packed.as_py(), np.uint64)
                if b is None:
                    name, own = a, other
                elif a == name:
                    at = np.minimum(np.searchsorted(own, other), len(own) - 1)
                    both = int((own[at] == other).sum())
                    if both * similarity.denominator >= (len(own) + len(other) - both) * similarity.numerator:
                        hit.append(k)
            yield batch.select(["a", "b"]).take(pa.array(hit, pa.int64()))

    return run


class _Links:
    """The steps of ``linked_sets`` over one table of documents."""

    def __init__(self, rows: DataFrame, nodes: DataFrame, shingle: int, similarity: Fraction, miss: float, group: int):
        self.rows, self.nodes, self.shingle, self.similarity = rows, nodes, shingle, similarity
        self.pruner, self.group, self.keep = Pruner(similarity, miss), group, Scratch()

    def candidates(self) -> DataFrame:
        """``key, node, n, met``: the bands that several sets share; ``met`` tells how often a set meets others."""
        keys = small_batches(self.nodes.select("node", "sig", F.col("n_shingles").alias("n"))).mapInArrow(tidy(_keyed), "key long, node binary, n long")
        shared = keys.groupBy("key").agg(F.count("*").alias("together")).where("together > 1")
        # A set has BANDS keys at most: gathered and spread again, they need one shuffle less than a join.
        own = keys.join(shared, "key").groupBy("node", "n").agg(F.collect_list("key").alias("keys"), F.sum("together").alias("met"))
        return self.keep(own.select(F.explode("keys").alias("key"), "node", "n", "met"), "bands")

    def stars(self, bands: DataFrame) -> DataFrame:
        """``a, b``: in each band the set that meets most others (``a``), with each of the rest."""
        first = bands.groupBy("key").agg(F.max(F.struct("met", "node")).alias("first"))
        return bands.join(first.select("key", F.col("first.node").alias("a")), "key").where("a <> node").select("a", F.col("node").alias("b")).distinct()

    def prune(self, pairs: DataFrame) -> DataFrame:
        side = lambda x: self.nodes.select(F.col("node").alias(x), F.col("sig").alias(f"sig_{x}"), F.col("n_shingles").alias(f"n_{x}"))
        return pairs.join(side("a"), "a").join(side("b"), "b").mapInArrow(tidy(_pruned(self.pruner)), "a binary, b binary")

    def across(self, bands: DataFrame, links: DataFrame) -> DataFrame:
        """``a, b``, staged: similar sets that share a band, but no set that both are known to be linked with, as many as connect these.

        Signatures alone tell first which sets of a band have a partner there; only the sets of
        those are sent to it, and compared.
        """
        both = links.select("b", "a").union(links.select("a", F.col("a")))
        known = both.toDF("node", "to").groupBy("node").agg(F.min("to").alias("to"))
        labelled = self.keep(bands.join(known, "node", "left").select("key", "node", "n", F.coalesce("to", "node").alias("component")), "labelled")
        span = lambda rows: rows.groupBy("key").agg(F.count("*").alias("size"), F.sum("n").alias("words"), F.min("component").alias("low"), F.max("component").alias("high"))
        mixed = lambda rows: span(rows).where("low <> high").select("key", "size", "words")
        sized = labelled.join(mixed(labelled), "key").join(self.nodes.select("node", "sig"), "node")
        sized = self.keep(sized.select("key", "node", "component", "sig", "n", "size", "words"), "open")
        fits = (F.col("size") <= self.group) & (F.col("words") <= GROUP_SHINGLES)
        whole = "array(struct(0 AS x, 0 AS y, 0 AS block)) AS places"
        columns = ["key", "node", "component", "sig", "n", "places"]
        dealt, large = sized.where(fits).selectExpr("*", whole).select(columns), sized.where(~fits).drop("size", "words")
        if not large.isEmpty():
            again = self.keep(small_batches(large).mapInArrow(tidy(_rekeyed), large.schema), "again")
            again = again.join(mixed(again), "key")
            # What is still large is cut into blocks by hash; each pair of blocks is a group.
            blocks = F.ceil(F.greatest(F.col("size") / (self.group // 2), F.col("words") / (GROUP_SHINGLES // 2))).cast("int")
            block = F.pmod(F.xxhash64("node"), blocks).cast("int")
            meets = F.transform(F.sequence(F.lit(0), blocks - 1), lambda o: F.struct(F.least(o, block).alias("x"), F.greatest(o, block).alias("y"), block.alias("block")))
            dealt = dealt.unionByName(again.where(fits).selectExpr("*", whole).select(columns)).unionByName(again.where(~fits).withColumn("places", meets).select(columns))
        dealt = dealt.select("key", "node", "component", "sig", "n", F.explode("places").alias("p")).select("key", "p.x", "p.y", "p.block", "node", "component", "sig", "n")
        grouped = lambda df: small_batches(df.repartition("key", "x", "y").sortWithinPartitions("key", "x", "y"))
        meeting = self.keep(grouped(dealt).mapInArrow(tidy(_meeting(self.pruner)), dealt.schema), "meeting")
        if meeting.isEmpty():
            return meeting.select(F.col("node").alias("a"), F.col("node").alias("b"))
        sets = self.sets(meeting.select("node"))
        return self.keep(grouped(meeting.join(sets, "node")).mapInArrow(tidy(_linking(self.pruner, self.similarity)), "a binary, b binary"), "links")

    def sets(self, ends: DataFrame) -> DataFrame:
        """``node, set``, staged, of the nodes in ``ends``, from another scan.

        A map of bits, of bounded size, tells the scan which rows are wanted;
        others that share a bit are among the result.
        """
        wanted = self.keep(ends.distinct().join(self.nodes.select("node", "row"), "node").select("row"), "wanted")
        n, bits = wanted.count(), 1 << 15
        while bits < MAP_BITS and bits < 16 * n:
            bits *= 2
        # Spark's bitmaps number from 1, in buckets of 32,768 bits.
        place = wanted.select((F.col("row").bitwiseAND(F.lit(bits - 1)) + 1).alias("p"))
        parts = place.groupBy(F.bitmap_bucket_number("p").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("bits"))
        there = np.zeros(bits // 8, np.uint8)
        for r in parts.collect():  # MAP_BITS at most
            there[(r.bucket - 1) * 4096 : r.bucket * 4096] = np.frombuffer(bytes(r.bits), np.uint8)
        sets = small_batches(self.rows.select("_row", "_text")).mapInArrow(tidy(_wanted(self.shingle, there)), "node binary, set binary")
        return self.keep(sets.groupBy("node").agg(F.first("set").alias("set")), "sets")

    def verify(self, pairs: DataFrame) -> DataFrame:
        """The pairs whose whole sets are similar, staged.

        A set with many partners is sent to each part of them, so every task holds one set.
        """
        sets = self.sets(pairs.select(F.col("a").alias("node")).union(pairs.select("b")))
        count = pairs.groupBy("a").agg(F.ceil(F.count("*") / PARTNERS).cast("int").alias("parts"))
        partners = pairs.join(count, "a").select("a", F.pmod(F.xxhash64("b"), "parts").cast("int").alias("part"), "b")
        partners = partners.join(sets.withColumnRenamed("node", "b"), "b").select("a", "part", "b", "set")
        firsts = count.select("a", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(None).cast("binary").alias("b"))
        firsts = firsts.join(sets.withColumnRenamed("node", "a"), "a").select("a", "part", "b", "set")
        rows = firsts.unionByName(partners).repartition("a", "part").sortWithinPartitions("a", "part", F.col("b").asc_nulls_first())
        return self.keep(small_batches(rows).mapInArrow(tidy(_verify(self.similarity)), "a binary, b binary"), "links")


def _components(rows: DataFrame, nodes: DataFrame, shingle: int, similarity: Fraction, miss: float, group: int) -> DataFrame:
    """``node, component``, staged, of the sets that are linked with others."""
    steps = _Links(rows, nodes, shingle, similarity, miss, group)
    bands = steps.candidates()
    links = steps.verify(steps.keep(steps.prune(steps.keep(steps.stars(bands), "stars")), "pairs"))
    groups = stage(connected_components(links.unionByName(steps.across(bands, links)), "a", "b", task_rows=TASK_LINKS), "groups")
    steps.keep.clear()
    return groups


def near_duplicate_sets(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8, miss: float = MISS, group: int = GROUP,
) -> DataFrame:
    """Near-duplicate groups by the Jaccard similarity of word shingle sets.

    Words are runs of bytes other than space and 0x09-0x0D, A-Z lower-cased; a text of fewer words
    than ``shingle`` is one shingle, one without words has none and is linked with nothing. Equal
    sets are one class. MinHash bands bring classes together: first each with the class of its
    band that meets most others; then, where a band holds classes not linked with one such class,
    these with each other, large bands after they are dealt again by their other
    bands and, what stays large, by pairs of blocks. A pair's signatures are compared batch by
    batch until its posterior probability of reaching ``similarity`` falls below ``miss``;
    survivors are verified on their whole sets of 64-bit shingle hashes.

    Returns a row per document: ``id_col``, ``n_shingles``, ``component_id`` (the smallest id
    reachable, its own included), ``kept`` (whether it is that id). A null id takes part and links
    others, but names a component only if all its ids are null. Repeated rows stay; other columns
    are ignored; an empty table gives an empty one.
    """
    exact = Fraction(similarity).limit_denominator(10_000)
    keep = Scratch()
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("binary").alias("_text"), F.xxhash64(F.col(id_col), F.col(text_col)).alias("_row"))
    names = ["id", "row", "n_shingles", "node", "sig"]
    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), *T._parse_datatype_string("row long, n_shingles long, node binary, sig binary").fields])
    sketched = keep(small_batches(rows).mapInArrow(tidy(_sketch(shingle, names)), schema), "sketched")
    classes = sketched.where("node IS NOT NULL").groupBy("node").agg(F.min("row").alias("row"), F.min("id").alias("id"), F.first("n_shingles").alias("n_shingles"), F.first("sig").alias("sig"))
    nodes = keep(classes, "nodes")
    groups = _components(rows, nodes, shingle, exact, miss, group)
    keep.frames.append(groups)
    labelled = keep(nodes.select("node", "id").join(groups, "node", "left").select("node", "id", F.coalesce("component", "node").alias("component")), "labelled")
    least = labelled.groupBy("component").agg(F.min("id").alias("component_id"))
    named = labelled.join(least, "component").select("node", "component_id")
    out = sketched.select("id", "n_shingles", "node").join(named, "node", "left")
    out = stage(out.select(F.col("id").alias(id_col), "n_shingles", F.coalesce("component_id", "id").alias("component_id")), "near")
    keep.clear()
    return out.withColumn("kept", F.col(id_col).eqNullSafe(F.col("component_id")))
