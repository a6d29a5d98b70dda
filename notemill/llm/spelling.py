"""Spelling variants: words within one edit, by k-d trees over their letter counts."""

from __future__ import annotations

from collections.abc import Iterator
from heapq import heapify, heapreplace
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notemill.llm.workers import small_batches, tidy
from notemill.staging import Scratch, stage, unstage

#: Letters: A-Z lower-cased, a-z and U+00C0-U+00FF. One coordinate counts each, the last holds the length.
LETTERS = [*range(ord("a"), ord("z") + 1), *range(0xC0, 0x100)]
LENGTH = len(LETTERS)
_PLACE = np.zeros(256, np.int64)
_PLACE[LETTERS] = np.arange(LENGTH)
#: Words, of at most so many letters, that the cells are fitted to; every word is then put into its cell.
SAMPLE, SAMPLE_LETTERS = 50_000, 64
#: Words that a cell should hold, and cells at most.
CELL, CELLS = 2_000, 4096
#: Words of a cell, and words that search it, in one group; more are dealt to several groups.
HELD, SEARCHED = 10_000, 60_000
#: Words of a leaf within a group.
LEAF = 48
#: Pairs looked at at once.
STEP = 1 << 19
#: Roles of a row in a group: the word is held; it searches for substitutions in another cell, for insertions, for substitutions in its own cell.
HELD_HERE, SUBSTITUTED, INSERTED, AT_HOME = 0, 1, 2, 3


def _codes(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All letters one after the other, and where each word begins (and the last ends)."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    return np.frombuffer("".join(words).encode("latin-1"), np.uint8), np.concatenate([[0], np.cumsum(sizes)])


def letter_counts(words: list[str]) -> np.ndarray:
    """A row per word: how often it has each letter, and its length. One edit changes the counts by two in all at most."""
    letters, begin = _codes(words)
    row = np.repeat(np.arange(len(words)), np.diff(begin))
    counts = np.bincount(row * (LENGTH + 1) + _PLACE[letters], minlength=len(words) * (LENGTH + 1)).reshape(len(words), LENGTH + 1)
    counts[:, LENGTH] = np.diff(begin)
    return counts.astype(np.int32)


class KdTree:
    """A k-d tree over letter counts: at each node one coordinate is compared with a threshold, greater ones go right."""

    def __init__(self, counts: np.ndarray, leaf: int, lengths: bool):
        """``leaf``: points at most, but equal points stay together. ``lengths``: whether the length is split too."""
        dim, at, child, self.members = [], [], [], []
        stack = [(np.arange(len(counts)), -1)]
        while stack:
            points, hang = stack.pop()
            if hang >= 0:
                child[hang >> 1][hang & 1] = len(dim)
            split = self._split(counts[points] if lengths else counts[points, :LENGTH]) if len(points) > leaf else None
            if split is None:
                dim.append(-1)
                at.append(len(self.members))
                self.members.append(points)
                child.append([0, 0])
                continue
            dim.append(split[0])
            at.append(split[1])
            child.append([0, 0])
            less = counts[points, split[0]] <= split[1]
            here = len(dim) - 1
            stack.append((points[~less], 2 * here + 1))
            stack.append((points[less], 2 * here))
        self.dim, self.at, self.child = np.array(dim), np.array(at), np.array(child)

    @staticmethod
    def _split(x: np.ndarray) -> tuple[int, int] | None:
        """The coordinate and threshold that part the points most evenly."""
        best = None
        low = x.min(0)
        for step in range(4):
            less = (x <= low + step).sum(0)
            even = np.minimum(less, len(x) - less)
            d = int(even.argmax())
            if even[d] and (best is None or even[d] > best[0]):
                best = int(even[d]), d, int(low[d]) + step
        return best and best[1:]

    def home(self, counts: np.ndarray) -> np.ndarray:
        """The leaf of each point."""
        node = np.zeros(len(counts), np.int64)
        while True:
            inner = np.flatnonzero(self.dim[node] >= 0)
            if not len(inner):
                return self.at[node]
            n = node[inner]
            node[inner] = self.child[n, (counts[inner, self.dim[n]] > self.at[n]).astype(np.int64)]

    def search(self, counts: np.ndarray, mode: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of points and leaves: all leaves that can hold a word made from the point's by one edit.

        That word has one letter more; if the edit is a substitution, also one
        letter less of another kind. A path that needs more of either is pruned.
        """
        point, node = np.arange(len(counts)), np.zeros(len(counts), np.int64)
        more, less = np.full(len(counts), -1), np.full(len(counts), -1)
        found = []
        while len(point):
            d = self.dim[node]
            done = d < 0
            found.append((point[done], self.at[node[done]]))
            point, node, more, less, d = (a[~done] for a in (point, node, more, less, d))
            t = self.at[node]
            x = counts[point, d] + (more == d) - (less == d)
            fixed = d == LENGTH
            if mode == INSERTED:
                x += fixed
            down = (x == t + 1) & (less < 0) & (more != d) & ~fixed if mode == SUBSTITUTED else np.zeros(len(d), bool)
            up = (x == t) & (more < 0) & (less != d) & ~fixed
            to_left, to_right = (x <= t) | down, (x > t) | up
            point, node, more, less = (
                np.concatenate([point[to_left], point[to_right]]),
                np.concatenate([self.child[node[to_left], 0], self.child[node[to_right], 1]]),
                np.concatenate([more[to_left], np.where(up, d, more)[to_right]]),
                np.concatenate([np.where(down, d, less)[to_left], less[to_right]]),
            )
        return tuple(np.concatenate(x) for x in zip(*found)) if found else (point, node)


def _halves(letters: np.ndarray, begin: np.ndarray, size: int, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the first half of ``length`` letters, and of as many as its second half has at the end, of words of ``size`` letters."""
    first, last = np.zeros(len(begin), np.uint64), np.zeros(len(begin), np.uint64)
    for k in range(length // 2):
        first = first * np.uint64(0x100000001B3) + letters[begin + k]
    for k in range(size - length + length // 2, size):
        last = last * np.uint64(0x100000001B3) + letters[begin + k]
    return first, last


class _Length:
    """The words of a group that have one length, in a k-d tree."""

    def __init__(self, counts: np.ndarray, own: np.ndarray):
        self.tree = KdTree(counts[own], LEAF, lengths=False)
        self.sizes = np.fromiter(map(len, self.tree.members), np.int64, len(self.tree.members))
        self.first = np.cumsum(self.sizes) - self.sizes
        self.flat = own[np.concatenate(self.tree.members)]
        self.halves: dict[int, tuple] = {}


class Group:
    """Some words, searched by length pair."""

    def __init__(self, words: list[str]):
        self.letters, self.begin = _codes(words)
        counts = letter_counts(words)
        self.lengths = {n: _Length(counts, np.flatnonzero(counts[:, LENGTH] == n)) for n in np.unique(counts[:, LENGTH]).tolist()}

    def near(self, words: list[str], mode: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of places in ``words`` and in the group: the second word is made from the first by one edit."""
        letters, begin = _codes(words)
        counts = letter_counts(words)
        for length in np.unique(counts[:, LENGTH]).tolist():
            size = length + (mode == INSERTED)
            held = self.lengths.get(size)
            if held is None:
                continue
            if mode not in held.halves:
                held.halves[mode] = _halves(self.letters, self.begin[held.flat], size, length)
            asked = np.flatnonzero(counts[:, LENGTH] == length)
            first, last = _halves(letters, begin[asked], length, length)
            point, leaf = held.tree.search(counts[asked], mode)
            step = max(1, STEP // max(LEAF, int(held.sizes.max())))
            for low in range(0, len(point), step):
                own, size_of = point[low : low + step], held.sizes[leaf[low : low + step]]
                shift = held.first[leaf[low : low + step]] - (np.cumsum(size_of) - size_of)
                a, at = np.repeat(own, size_of), np.repeat(shift, size_of) + np.arange(int(size_of.sum()))
                # One edit leaves one half as it is; what agrees in one is compared letter by letter.
                half = np.flatnonzero((first[a] == held.halves[mode][0][at]) | (last[a] == held.halves[mode][1][at]))
                a, b = asked[a[half]], held.flat[at[half]]
                hit = self._one_edit(letters, begin[a], b, length, mode)
                yield a[hit], b[hit]

    def _one_edit(self, letters: np.ndarray, begin: np.ndarray, b: np.ndarray, length: int, mode: int) -> np.ndarray:
        """Which words of ``length`` letters that begin there become the group's words ``b`` by one edit."""
        other = self.begin[b]
        if mode == SUBSTITUTED:
            differ = np.zeros(len(b), np.int64)
            for k in range(length):
                differ += letters[begin + k] != self.letters[other + k]
            return differ == 1
        behind, hit = np.zeros(len(b), bool), np.ones(len(b), bool)  # behind: the added letter is passed
        for k in range(length):
            behind |= letters[begin + k] != self.letters[other + k]
            hit &= ~behind | (letters[begin + k] == self.letters[other + k + 1])
        return hit


def letter_runs(text_col: str = "text", min_letters: int = 1) -> Column:
    """Maximal runs of at least ``min_letters`` letters of a text, A-Z lower-cased."""
    lower = F.translate(text_col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.regexp_extract_all(lower, F.lit(f"([A-Za-zÀ-ÿ]{{{min_letters},}})"), F.lit(1))


def count_words(words: DataFrame, min_letters: int = 7, min_count: int = 2) -> DataFrame:
    """``word, n`` of the words (column ``word``) that are long and frequent enough."""
    counted = words.where(F.char_length("word") >= min_letters).groupBy("word").agg(F.count("*").alias("n"))
    return counted.where(F.col("n") >= min_count)


def _cells(words: DataFrame, n_words: int) -> KdTree:
    """A tree over a bounded sample; its leaves are the cells."""
    share = F.pmod(F.xxhash64("word"), F.lit(1 << 30)) < int(min(1.0, SAMPLE / max(1, n_words)) * (1 << 30))
    sample = [r.word for r in words.select("word").where(share & (F.char_length("word") <= SAMPLE_LETTERS)).limit(2 * SAMPLE).collect()]
    cells = min(CELLS, max(1, n_words // CELL))
    return KdTree(letter_counts(sorted(sample)), max(1, len(sample) // cells), lengths=True)


def _placed(tree: KdTree, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The home cell of each word; and the cells that it searches: word, cell and kind of edit.

    Words of one length find each other in the cell of higher number, so one of them searches.
    """
    counts = letter_counts(words)
    home = tree.home(counts)
    at, cell = tree.search(counts, SUBSTITUTED)
    ahead = cell >= home[at]
    longer, its = tree.search(counts, INSERTED)
    mode = np.concatenate([np.where(cell == home[at], AT_HOME, SUBSTITUTED)[ahead], np.full(len(longer), INSERTED)])
    return home, np.concatenate([at[ahead], longer]), np.concatenate([cell[ahead], its]), mode


def _sizes(tree: KdTree):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, searched = np.zeros(len(tree.members), np.int64), np.zeros(len(tree.members), np.int64)
        for batch in batches:
            if batch.num_rows:
                home, _, cell, _ = _placed(tree, batch["word"].to_pylist())
                held += np.bincount(home, minlength=len(held))
                searched += np.bincount(cell, minlength=len(held))
        there = np.flatnonzero(held + searched)
        yield pa.RecordBatch.from_arrays([pa.array(there), pa.array(held[there]), pa.array(searched[there])], names=["cell", "held", "searched"])

    return run


class Dealt:
    """How cells are dealt to groups, and groups to partitions, so that none is too large."""

    def __init__(self, held: np.ndarray, searched: np.ndarray, partitions: int):
        self.subs, self.parts = np.maximum(1, -(-held // HELD)), np.maximum(1, -(-searched // SEARCHED))
        self.first = np.concatenate([[0], np.cumsum(self.subs * self.parts)])
        weight = np.repeat(held // self.subs + searched // self.parts, self.subs * self.parts)
        self.partition = np.zeros(len(weight), np.int32)
        load = [(0, k) for k in range(partitions)]
        heapify(load)
        for g in np.argsort(-weight, kind="stable").tolist():
            total, k = load[0]
            self.partition[g] = k
            heapreplace(load, (total + int(weight[g]) + 1, k))


def _dealt(tree: KdTree, dealt: Dealt):
    names = ["part", "group", "mode", "word", "n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            words = batch["word"].to_pylist()
            home, at, cell, mode = _placed(tree, words)
            crc = np.array([crc32(w.encode()) for w in words])
            # A word is held in one sub-cell, once for each part of those that search; it searches in one part, all sub-cells.
            k = np.repeat(np.arange(len(home)), dealt.parts[home])
            turn = np.arange(len(k)) - np.repeat(np.cumsum(dealt.parts[home]) - dealt.parts[home], dealt.parts[home])
            held = dealt.first[home[k]] + crc[k] % dealt.subs[home[k]] * dealt.parts[home[k]] + turn
            m = np.repeat(np.arange(len(at)), dealt.subs[cell])
            turn = np.arange(len(m)) - np.repeat(np.cumsum(dealt.subs[cell]) - dealt.subs[cell], dealt.subs[cell])
            asks = dealt.first[cell[m]] + turn * dealt.parts[cell[m]] + crc[at[m]] % dealt.parts[cell[m]]
            group, kind, take = np.concatenate([held, asks]), np.concatenate([np.full(len(k), HELD_HERE), mode[m]]), pa.array(np.concatenate([k, at[m]]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(dealt.partition[group], pa.int32()), pa.array(group, pa.int64()), pa.array(kind, pa.int32()), batch["word"].take(take), batch["n"].take(take)], names=names
            )

    return run


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Near words, both ways, from rows by group: first the words that it holds, then those that search it."""
    number, words, counts, index = -1, [], [], None
    for batch in batches:
        group, mode = batch["group"].to_numpy(), batch["mode"].to_numpy()
        cuts = np.flatnonzero((np.diff(group) != 0) | (np.diff(mode) != 0)) + 1
        for a, b in zip([0, *cuts], [*cuts, len(group)]) if len(group) else ():
            own, n = batch["word"].slice(a, b - a), batch["n"].slice(a, b - a).to_numpy()
            if group[a] != number:
                number, words, counts, index = int(group[a]), [], [], None
            if mode[a] == HELD_HERE:
                words += own.to_pylist()
                counts.append(n)
                continue
            if index is None:
                index, names, times = Group(words), pa.array(words, pa.string()), np.concatenate([np.empty(0, np.int64), *counts])
            for i, j in index.near(own.to_pylist(), INSERTED if mode[a] == INSERTED else SUBSTITUTED):
                left, right = own.take(pa.array(i)), names.take(pa.array(j))
                if mode[a] == AT_HOME:  # each of the two searches
                    once = pc.less(left, right)
                    keep = once.to_numpy(zero_copy_only=False)
                    i, j, left, right = i[keep], j[keep], left.filter(once), right.filter(once)
                yield pa.RecordBatch.from_arrays([pa.concat_arrays([left, right]), pa.concat_arrays([right, left]), pa.array(np.concatenate([times[j], n[i]]))], names=["word", "near", "n"])


def near_words(words: DataFrame, partitions: int | None = None) -> DataFrame:
    """``word, near, n``: all pairs of ``words`` that differ by one inserted, deleted or replaced letter, both ways; ``n`` of ``near``.

    ``words`` is a staged table of distinct ``word`` (of ``LETTERS``) and ``n``. The leaves of a k-d
    tree over letter counts, fitted to a bounded sample, are the cells. Each word is held by its
    cell and sent to the cells that can hold what it becomes by one edit; within a cell, k-d trees
    by length are searched the same way, and the order of the letters is compared. Cells
    with many words, or that many words search, are dealt to several groups, which together make
    all the same comparisons.
    """
    spark = words.sparkSession
    n_words = words.count()
    tree = _cells(words, n_words)
    sizes = small_batches(words).mapInArrow(tidy(_sizes(tree)), "cell long, held long, searched long")
    held, searched = np.zeros(len(tree.members), np.int64), np.zeros(len(tree.members), np.int64)
    for r in sizes.groupBy("cell").agg(F.sum("held").alias("held"), F.sum("searched").alias("searched")).collect():  # a row per cell
        held[r.cell], searched[r.cell] = r.held, r.searched
    tree.members = [()] * len(tree.members)
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    partitions = partitions or max(least, int((held.sum() + searched.sum()) // 200_000))
    dealt = Dealt(held, searched, partitions)
    rows = small_batches(words).mapInArrow(tidy(_dealt(tree, dealt)), "part int, group long, mode int, word string, n long")
    rows = rows.repartitionById(partitions, "part").sortWithinPartitions("group", "mode")
    return rows.drop("part").mapInArrow(tidy(_search), "word string, near string, n long")


def spelling_forms(words: DataFrame, times: int = 10) -> DataFrame:
    """What each word is a variant of.

    ``words`` is a table of distinct ``word`` and ``n``. Returns ``word, form, root, n, n_near,
    form_n``: ``form`` is the most frequent near word (ties: smallest in code-point order) if it is
    at least ``times`` (over 1) as frequent, else null; ``root`` is reached by following forms to
    the last; ``n_near`` counts the near words. An empty table gives an empty one.
    """
    keep = Scratch()
    words = keep(words.select("word", "n"), "words")
    best = near_words(words).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("n")).alias("less"), "near")).alias("best"))
    form = F.col("best.near"), -F.col("best.less")
    is_form = form[1] >= times * F.col("n")
    found = words.join(best, "word", "left").select(
        "word", F.when(is_form, form[0]).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(is_form, form[1]).alias("form_n")
    )
    found = stage(found, "spelling")
    # Frequencies grow from form to form, so chains end after a few steps; each round doubles them.
    roots = keep(found.where("form IS NOT NULL").select("word", F.col("form").alias("root")), "roots")
    while True:
        after = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        further = keep(roots.join(after, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        roots = further.select("word", "root")
        if further.where("moved").isEmpty():
            break
    out = stage(found.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"), "spelling")
    keep.clear()
    unstage(found)
    return out
