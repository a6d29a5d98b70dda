"""Substring dedup: paragraph MinHash banding, exact verification, components."""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from notemill.llm.components import connected_components
from notemill.llm.ngram_lm import U64, mix, slices, word_spans
from notemill.llm.workers import small_batches, tidy
from notemill.staging import Scratch, sized_broadcast, unstage

SHINGLE = 5
SIMILARITY = 0.8
#: Rows of a band: one alone would let any two paragraphs with one frequent shingle collide.
LEAST_ROWS = 2
#: Words to each side over which a cut of a long paragraph must have the smallest hash.
CUT_REACH = 5
#: Paragraphs of more words are cut.
LONG_PARAGRAPH = 16
#: Neighbouring duplicate parts count from so many words together.
MIN_WORDS = 15
#: Words between two duplicate parts that both first stand in one document, about as far apart there (within the second number): an edited stretch of one passage.
BRIDGE_WORDS, BRIDGE_SHIFT = 30, 8
#: Contents of one key that are compared in one task; larger keys are dealt again.
GROUP_ROWS = 2000
#: Elements of sets compared at once.
COMPARED = 1 << 20
_MOST = U64(2**64 - 1)


def tune_bands(similarity: float, recall: float, least_rows: int = LEAST_ROWS) -> tuple[int, int]:
    """Fewest bands of at least ``least_rows`` rows, then most rows a band, by which pairs of ``similarity`` collide with probability ``recall``."""
    bands = max(1, math.ceil(math.log1p(-recall) / math.log1p(-(similarity**least_rows)) - 1e-9))
    rows = least_rows
    while 1 - (1 - similarity ** (rows + 1)) ** bands >= recall:
        rows += 1
    return bands, rows


def _first_of(groups: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.r_[True, groups[1:] != groups[:-1]]) if len(groups) else np.empty(0, np.int64)


def _cuts(hashes: np.ndarray, line: np.ndarray) -> np.ndarray:
    """Words at which a long paragraph is cut: where the hash of two words is the least within CUT_REACH words of the paragraph."""
    n = len(hashes)
    pair = np.full(n, _MOST)
    if n > 1:
        pair[:-1] = np.where(line[1:] == line[:-1], mix(hashes[:-1] * U64(0x9FB21C651E98DF25) + hashes[1:]), _MOST)
    least = pair < _MOST
    for d in range(1, min(CUT_REACH, n - 1) + 1):
        same = line[d:] == line[:-d]
        least[d:] &= ~same | (pair[d:] < pair[:-d])
        least[:-d] &= ~same | (pair[:-d] < pair[d:])
    size = np.bincount(line, minlength=int(line[-1]) + 1)[line] if n else np.empty(0, np.int64)
    return least & (size > LONG_PARAGRAPH)


class Paragraphs:
    """The paragraphs and their parts in some texts, with content hashes and shingles.

    A paragraph is a line. A line of over LONG_PARAGRAPH words also has parts, cut
    at places that depend on a few words around them only, so that a passage
    pasted into the middle of a line has most of its parts in common with its source.
    """

    def __init__(self, texts: pa.Array):
        data, offsets, self.starts, self.ends, self.hashes = word_spans(texts)
        n = len(self.starts)
        self.doc = np.searchsorted(offsets, self.starts, "right") - 1
        self.base = offsets
        self.first_word = np.searchsorted(self.starts, offsets[:-1])
        breaks = np.cumsum(data == 10)[self.starts] if n else np.empty(0, np.int64)
        new_line = np.r_[True, (breaks[1:] != breaks[:-1]) | (self.doc[1:] != self.doc[:-1])][:n]
        line = np.cumsum(new_line) - 1
        cuts = _cuts(self.hashes, line)
        whole = np.flatnonzero(new_line)
        has_cut = np.zeros(len(whole), bool)
        has_cut[line[cuts]] = True
        part = np.flatnonzero((cuts | new_line) & has_cut[line]) if n else whole
        ends = np.flatnonzero(np.r_[new_line[1:], True][:n]) + 1
        stop_whole = ends
        edges = np.flatnonzero(cuts | new_line)
        stop_part = np.r_[edges[1:], n][np.searchsorted(edges, part)]
        self.begin = np.r_[whole, part]
        self.stop = np.r_[stop_whole, stop_part]
        self.is_part = np.r_[np.zeros(len(whole), bool), np.ones(len(part), bool)]

    def shingles(self, unit: int) -> np.ndarray:
        """Distinct shingle hashes of one paragraph; fewer words than a shingle make one."""
        h = self.hashes[self.begin[unit] : self.stop[unit]]
        return np.unique(_shingles(h)) if len(h) >= SHINGLE else _shingles(h)

    def contents(self) -> np.ndarray:
        """A hash of each unit's words in order."""
        h = self.hashes
        size = self.stop - self.begin
        first = np.cumsum(size) - size
        place = np.arange(int(size.sum())) - np.repeat(first, size)
        words = h[np.repeat(self.begin, size) + place]
        spread = mix(words + mix(place.astype(U64)))
        return mix(np.add.reduceat(spread, first) + size.astype(U64)) if len(size) else np.empty(0, U64)

    def minhashes(self, count: int) -> np.ndarray:
        """``count`` minima of the shingles of each whole paragraph (columns), over as many permutations."""
        whole = np.flatnonzero(~self.is_part)
        begin, stop = self.begin[whole], self.stop[whole]
        n = len(self.hashes)
        s = np.full(n, _MOST)
        if n >= SHINGLE:
            s[: n - SHINGLE + 1] = _shingles(self.hashes)
        room = np.repeat(stop, stop - begin) - np.arange(n) >= SHINGLE
        short = np.flatnonzero(stop - begin < SHINGLE)
        own = np.array([_shingles(self.hashes[begin[k] : stop[k]])[0] for k in short], U64)
        out = np.empty((count, len(whole)), U64)
        for k in range(count):
            seed = mix(np.array([k + 1], U64))
            out[k] = np.minimum.reduceat(np.where(room, mix(s ^ seed), _MOST), begin) if n else out[k]
            out[k, short] = mix(own ^ seed)
        return out


def _shingles(h: np.ndarray) -> np.ndarray:
    m = max(1, len(h) - SHINGLE + 1)
    total = np.zeros(m, U64)
    for k in range(min(SHINGLE, len(h))):
        total = mix(total * U64(0x9E3779B97F4A7C15) + h[k : k + m])
    return mix(total + U64(min(len(h), SHINGLE)))


def _units(id_col: str, text_col: str, bands: int, rows: int, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for texts in slices(batch[text_col]):
                p = Paragraphs(texts)
                if len(p.begin):
                    doc = p.doc[p.begin]
                    owner = pa.array(at + doc)
                    base = p.base[doc]
                    low = p.minhashes(bands * rows)
                    whole = len(low[0])
                    keys = []
                    for b in range(bands):
                        key = mix(np.full(whole, b + 1, U64))
                        for r in range(rows):
                            key = mix(key * U64(0xC2B2AE3D27D4EB4F) + low[b * rows + r])
                        full = np.zeros(len(p.begin), np.int64)
                        full[:whole] = key.view(np.int64)
                        keys.append(pa.array(full, mask=p.is_part))
                    cols = [batch[id_col].take(owner), batch["th"].take(owner)]
                    cols += [pa.array(x.astype(np.int32)) for x in (p.begin - p.first_word[doc], p.stop - p.first_word[doc], p.starts[p.begin] - base, p.ends[p.stop - 1] - base)]
                    cols += [pa.array(p.contents().view(np.int64)), *keys]
                    yield pa.RecordBatch.from_arrays(cols, names=names)
                at += len(texts)

    return run


def _wanted_shingles(text_col: str):
    """Shingles of the paragraphs listed in ``wanted`` (first words and contents)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for texts in slices(batch[text_col]):
                p = Paragraphs(texts)
                want = batch["wanted"].slice(at, len(texts))
                doc = np.repeat(np.arange(len(texts)), want.value_lengths().to_numpy())
                at += len(texts)
                first, content = (want.flatten().field(k).to_numpy() for k in ("w0", "c"))
                whole = p.begin[: len(p.begin) - int(p.is_part.sum())]
                sets = [p.shingles(u).view(np.int64) for u in np.searchsorted(whole, p.first_word[doc] + first)]
                yield pa.RecordBatch.from_arrays([pa.array(content), pa.array(sets, pa.list_(pa.int64()))], names=["c", "shingles"])

    return run


def similar_pairs(sets: list[np.ndarray], threshold: float, labels: np.ndarray | None = None) -> Iterator[tuple[int, int]]:
    """Index pairs, enough to connect all pairs of Jaccard similarity ``threshold`` or more.

    Two such sets share one of their first ``n - ceil(threshold * n) + 1``
    elements in an order, here by rarity, so only sets that meet there are
    compared, all earlier ones at once. Those already connected (of equal
    ``labels`` at first) are passed over.
    """
    n = len(sets)
    label = np.arange(n) if labels is None else np.unique(labels, return_inverse=True)[1]
    size = np.array([len(s) for s in sets], np.int64)
    first = np.cumsum(size) - size
    _, element, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True) if n else (None, np.empty(0, np.int64), np.empty(0, np.int64))
    owner = np.repeat(np.arange(n), size)
    element = element[np.lexsort((element, count[element], owner))]
    prefix = np.arange(len(element)) - first[owner] <= size[owner] - np.ceil(threshold * size[owner] - 1e-9)
    met = np.flatnonzero(prefix)
    met = met[np.argsort(element[met], kind="stable")]
    # Places in ``met`` of each prefix element, and where its run begins.
    place, run = np.empty(len(element), np.int64), np.empty(len(element), np.int64)
    place[met] = np.arange(len(met))
    heads = _first_of(element[met])
    run[met] = np.repeat(heads, np.diff(np.r_[heads, len(met)]))
    holders, mine = owner[met], np.zeros(len(count), bool)
    for i in range(n):
        own = np.arange(first[i], first[i] + size[i])
        own = own[prefix[own]]
        if (place[own] == run[own]).all():
            continue
        near = np.unique(np.concatenate([holders[run[k] : place[k]] for k in own]))
        near = near[(label[near] != label[i]) & (np.minimum(size[near], size[i]) >= threshold * np.maximum(size[near], size[i]) - 1e-9)]
        mine[element[first[i] : first[i] + size[i]]] = True
        step = max(1, COMPARED // int(size[near].max())) if len(near) else 1
        for at in range(0, len(near), step):
            some = near[at : at + step]
            some = some[label[some] != label[i]]
            if not len(some):
                continue
            begin = np.cumsum(size[some]) - size[some]
            flat = np.repeat(first[some] - begin, size[some]) + np.arange(int(size[some].sum()))
            both = np.add.reduceat(mine[element[flat]].astype(np.int64), begin)
            for j in some[both >= threshold * (size[i] + size[some] - both) - 1e-9]:
                if label[i] != label[j]:
                    label[label == label[j]] = label[i]
                    yield i, int(j)
        mine[element[first[i] : first[i] + size[i]]] = False


def _linked(similarity: float):
    """Links within runs of equal ``key``, between contents of different ``label``; a partition holds every key whole, sorted."""

    def of(key: np.ndarray, c: np.ndarray, label: np.ndarray, sets: list[np.ndarray], out: list[tuple[int, int]]) -> None:
        edges = np.flatnonzero(np.r_[True, key[1:] != key[:-1], True])
        for a, b in zip(edges, edges[1:]):
            if b - a == 2:
                both = len(np.intersect1d(sets[a], sets[a + 1], assume_unique=True))
                if both >= similarity * (len(sets[a]) + len(sets[a + 1]) - both) - 1e-9:
                    out.append((c[a], c[a + 1]))
            elif b - a > 2:
                out += [(c[a + i], c[a + j]) for i, j in similar_pairs(sets[a:b], similarity, label[a:b])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, c, label, sets = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64), []
        for batch in chain(batches, [None]):
            out: list[tuple[int, int]] = []
            if batch is None:
                of(key, c, label, sets, out)
            elif batch.num_rows:
                flat, ends = batch["shingles"].flatten().to_numpy(), np.cumsum(batch["shingles"].value_lengths().to_numpy())
                key, c, label = (np.r_[x, batch[n].to_numpy()] for x, n in ((key, "key"), (c, "c"), (label, "label")))
                sets += np.split(flat, ends[:-1])
                done = int(np.searchsorted(key, key[-1]))  # the last key may go on in the next batch
                of(key[:done], c[:done], label[:done], sets[:done], out)
                key, c, label, sets = key[done:], c[done:], label[done:], sets[done:]
            if out:
                src, dst = zip(*out)
                yield pa.RecordBatch.from_arrays([pa.array(src, pa.int64()), pa.array(dst, pa.int64())], names=["src", "dst"])

    return run


def _solved(members: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Links between the ``members`` (``key, c, label``) of each key."""
    return members.join(sets, "c").repartition("key").sortWithinPartitions("key").mapInArrow(tidy(_linked(similarity)), "src long, dst long")


def prefix_rows(sets: DataFrame, similarity: float) -> DataFrame:
    """``key, c``: the rarest shingles of each set of which any two similar sets share one; without those that only one set has."""
    each = sets.select("c", F.size("shingles").alias("m"), F.explode("shingles").alias("x"))
    common = each.groupBy("x").agg(F.count("*").alias("n")).where("n > 1")
    held = each.join(common, "x").groupBy("c", "m").agg(F.array_sort(F.collect_list(F.struct("n", "x"))).alias("e"))
    take = (F.size("e") - F.ceil(F.lit(similarity) * F.col("m") - 1e-9) + 1).cast("int")
    return held.where(take > 0).select(F.explode(F.slice("e", F.lit(1), take)).alias("e"), "c").select(F.col("e.x").alias("key"), "c")


def block_pairs(members: DataFrame, group_rows: int, stage: Scratch) -> DataFrame:
    """``members`` (``key, c, label``) dealt anew by pairs of blocks of their key, at most ``2 * group_rows`` to a new key.

    Any two of one key and different labels meet; blocks of one label alone don't.
    """
    order = Window.partitionBy("key").orderBy("label", "c")
    placed = stage(members.withColumn("block", F.floor((F.row_number().over(order) - 1) / group_rows).cast("int")), "sd-blocks")
    blocks = placed.groupBy("key", "block").agg(F.min("label").alias("lo"), F.max("label").alias("hi"))
    one, other = blocks.alias("a"), blocks.select(F.col("key").alias("k"), F.col("block").alias("b"), F.col("lo").alias("l"), F.col("hi").alias("h")).alias("b")
    pairs = one.join(other, F.expr("key = k AND block < b")).where(F.least("lo", "l") < F.greatest("hi", "h"))
    pairs = pairs.select("key", F.xxhash64("key", "block", "b").alias("pair"), F.explode(F.array("block", "b")).alias("block"))
    return placed.join(pairs, ["key", "block"]).select(F.col("pair").alias("key"), "c", "label")


def _large_links(sets: DataFrame, links: DataFrame, similarity: float, group_rows: int, stage: Scratch) -> DataFrame:
    """Links that connect all similar ``sets``, given some ``links``, with a bounded number of sets in a group."""
    rows = prefix_rows(sets, similarity)
    rows = stage(rows, "sd-prefix")
    shared = stage(rows.join(rows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "key"), "sd-meeting")
    # First within blocks, which connects most of what is similar; then only what is not connected yet.
    block = F.pmod(F.xxhash64("c", "key"), F.ceil(F.col("n") / group_rows))
    once = shared.select(F.when(F.col("n") <= group_rows, F.col("key")).otherwise(F.xxhash64("key", block)).alias("key"), "c", F.col("c").alias("label"))
    links = stage(links.unionByName(_solved(once, sets, similarity)).distinct(), "sd-links")
    over = shared.where(F.col("n") > group_rows).select("key", "c")
    if over.isEmpty():
        return links
    known = stage(connected_components(links).select(F.col("node").alias("c"), "component"), "sd-known")
    over = over.join(known, "c", "left").select("key", "c", F.coalesce("component", "c").alias("label"))
    return links.unionByName(_solved(block_pairs(over, group_rows, stage), sets, similarity))


def _near_links(contents: DataFrame, docs: DataFrame, id_col: str, text_col: str, keys: list[str], similarity: float, group_rows: int, stage: Scratch) -> DataFrame:
    """Links between the contents of paragraphs that collide in a band and are similar."""
    banded = contents.select(F.explode(F.array(*keys)).alias("key"), "c")
    shared = stage(banded.groupBy("key").agg(F.count("*").cast("int").alias("n")).where("n > 1"), "sd-keys")
    colliding = stage(banded.join(shared, "key"), "sd-colliding")
    wanted = contents.join(colliding.select("c").distinct(), "c").groupBy(F.col(f"first.{id_col}").alias("id"), F.col("first.th").alias("th"))
    wanted = stage(wanted.agg(F.collect_list(F.struct(F.col("first.w0").alias("w0"), "c")).alias("wanted")), "sd-wanted")
    source = docs.select(F.col(id_col).alias("_id"), text_col, F.col("th").alias("_th"))
    source = source.join(sized_broadcast(wanted), F.col("_id").eqNullSafe(F.col("id")) & (F.col("_th") == F.col("th"))).select(text_col, "wanted")
    sets = stage(source.mapInArrow(tidy(_wanted_shingles(text_col)), "c long, shingles array<long>").dropDuplicates(["c"]), "sd-sets")
    links = _solved(colliding.where(F.col("n") <= group_rows).select("key", "c", F.col("c").alias("label")), sets, similarity)
    large = stage(colliding.where(F.col("n") > group_rows).select("c").distinct(), "sd-large")
    return links if large.isEmpty() else _large_links(sets.join(large, "c", "left_semi"), links, similarity, group_rows, stage)


def duplicate_spans(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY, recall: float = 0.99, min_words: int = MIN_WORDS,
    group_rows: int = GROUP_ROWS,
) -> DataFrame:
    """Spans of text that stand in more than one place.

    Whole paragraphs collide in MinHash bands over five-word shingles, tuned for
    ``recall`` at ``similarity``; colliding ones are verified by exact Jaccard
    similarity and joined to components. Keys of more than ``group_rows``
    contents are dealt again by rare shingles and blocks, by which every similar
    pair in them meets. Parts of long paragraphs are matched
    where their words are equal, so that passages pasted into a line are seen.
    Of each component the first place (by id) is kept, the others are removable;
    neighbouring parts count from ``min_words`` words together. Parts with up to
    ``BRIDGE_WORDS`` other words between belong together, and these words with
    them, where they first stand in one document about as far apart: edits cut a
    passage into such parts.

    Returns ``id_col, th`` (xxhash64 of the text), ``removed`` (False for the
    place that is kept), ``start_word, end_word, start_byte, end_byte, n_words,
    cluster`` and ``copies`` (places of the span's most frequent part). Rows with
    equal id and text are one document, so repeated rows are not copies of each
    other. Null and empty texts have no spans; an empty table gives an empty
    one; other columns are ignored.
    """
    stage, result = Scratch(), Scratch()
    bands, rows = tune_bands(similarity, recall)
    keys = [f"k{b}" for b in range(bands)]
    docs = small_batches(docs).select(id_col, text_col, F.xxhash64(text_col).alias("th"))
    fields = [T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("th", T.LongType())]
    fields += [T.StructField(n, T.IntegerType()) for n in ("w0", "w1", "b0", "b1")] + [T.StructField(n, T.LongType()) for n in ("c", *keys)]
    schema = T.StructType(fields)
    units = stage(docs.mapInArrow(tidy(_units(id_col, text_col, bands, rows, schema.names)), schema), "sd-units")
    place = F.struct(id_col, "th", "w0", "w1")
    # Most contents stand once, so what finds the others is kept narrow; their places follow.
    spot = F.xxhash64(id_col, "th", "w0", "w1")
    twice = units.groupBy("c").agg(F.count("*").alias("n"), F.min(spot).alias("lo"), F.max(spot).alias("hi")).where("lo <> hi").select("c", "n")
    repeated = stage(twice, "sd-exact")
    # Paragraphs by content: what is common counts once from here on.
    lines = units.where(F.col(keys[0]).isNotNull())
    contents = stage(lines.groupBy("c").agg(F.count("*").alias("n"), F.min(place).alias("first"), *[F.min(k).alias(k) for k in keys]), "sd-contents")
    links = stage(_near_links(contents, docs, id_col, text_col, keys, similarity, group_rows, stage).distinct(), "sd-links")
    groups = connected_components(links)
    near = stage(groups.select(F.col("node").alias("c"), "component"), "sd-near")
    unstage(groups)
    # First place and copies of every component: exact ones by content, near ones over all their contents.
    near_places = contents.join(near, "c").groupBy("component").agg(F.sum("n").alias("n"))
    of_near = near.join(stage(near_places, "sd-firsts"), "component").select("c", "component", "n")
    of_exact = repeated.join(near.select("c"), "c", "left_anti").select("c", F.col("c").alias("component"), "n")
    marked = stage(of_exact.unionByName(of_near), "sd-marked")
    found = result(units.drop(*keys).join(marked, "c").drop("c"), "sd-found")
    stage.clear()
    firsts = result(found.groupBy("component").agg(F.min(place).alias("first")), "sd-first")
    hits = found.join(firsts, "component").withColumn("removed", place != F.col("first"))
    source = F.xxhash64(f"first.{id_col}", "first.th").alias("source")
    hits = hits.select(id_col, "th", "w0", "w1", "b0", "b1", "component", "n", "removed", source, F.col("first.w0").alias("f0"), F.col("first.w1").alias("f1")).distinct()
    order = Window.partitionBy(id_col, "th", "removed").orderBy("w0", "w1", "component")
    before = F.max("w1").over(order.rowsBetween(Window.unboundedPreceding, -1))
    last = F.lag(F.struct("source", "w1", "f1")).over(order)
    apart = F.col("w0") - F.col("last.w1")
    shift = F.abs(F.col("f0") - F.col("last.f1") - apart)
    bridged = (F.col("source") == F.col("last.source")) & (apart <= BRIDGE_WORDS) & (shift <= BRIDGE_SHIFT)
    run = F.sum(F.when((F.col("w0") <= F.col("before")) | F.coalesce(bridged, F.lit(False)), 0).otherwise(1)).over(order.rowsBetween(Window.unboundedPreceding, 0))
    runs = hits.withColumn("before", before).withColumn("last", last).withColumn("run", run)
    spans = runs.groupBy(id_col, "th", "removed", "run").agg(
        F.min("w0").alias("start_word"), F.max("w1").alias("end_word"), F.min("b0").alias("start_byte"), F.max("b1").alias("end_byte"),
        F.min("component").alias("cluster"), F.max("n").alias("copies"),
    )
    spans = spans.withColumn("n_words", F.col("end_word") - F.col("start_word")).where(F.col("n_words") >= min_words)
    return spans.select(id_col, "th", "removed", "start_word", "end_word", "start_byte", "end_byte", "n_words", "cluster", "copies")


def cut_spans(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """The text without some spans; a span that begins a line goes with the white space after it."""
    out, at = [], 0
    for start, end in sorted(spans):
        start = max(start, at)
        out.append(text[at:start])
        at = max(at, end)
        if not out[-1] or out[-1].endswith(b"\n"):
            while at < len(text) and text[at] in b" \t\r\n":
                at += 1
    return b"".join([*out, text[at:]]).rstrip()


def remove_duplicate_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with the removable spans cut from their texts, without documents that have no word left by it.

    All other columns, whatever their names, and rows whose text has no removable span, stay as they are.
    """
    spans = duplicate_spans(docs, id_col, text_col, **options).where("removed")
    cut = spans.groupBy(F.col(id_col).alias("id"), "th").agg(F.collect_list(F.struct("start_byte", "end_byte")).alias("cut"))
    cut = Scratch()(cut, "sd-cut")
    rows = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("own"), F.xxhash64(text_col).alias("h"))
    there = rows.join(sized_broadcast(cut), F.col("h").eqNullSafe(F.col("th")) & F.col("own").eqNullSafe(F.col("id")), "left")

    @F.pandas_udf("string")
    def without(text: pd.Series, spans: pd.Series) -> pd.Series:
        return pd.Series([cut_spans(t.encode(), [(s["start_byte"], s["end_byte"]) for s in x]).decode() for t, x in zip(text, spans)])

    changed = there.where(F.col("cut").isNotNull()).withColumn("text", without(F.col("row")[text_col], "cut")).where(F.trim("text") != "")
    changed = changed.select(*[(F.col("text") if c == text_col else F.col("row")[c]).alias(c) for c in docs.columns])
    return there.where(F.col("cut").isNull()).select("row.*").unionByName(changed)
