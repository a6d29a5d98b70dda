"""Periodic runs of words: a suffix automaton whose suffix paths are recoloured by link-cut access."""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from notemill.llm.workers import small_batches, tidy

#: Words looked through at once for places that can hold a run.
CHUNK_WORDS = 1 << 18


def squares(codes: list) -> Iterator[tuple[int, int]]:
    """``end, period`` of every primitively rooted square ``uu`` of ``codes``, ends in ascending order.

    Each appended word adds a state to the suffix automaton. The tree of its
    suffix links is kept as preferred paths in splay trees; the states of one
    path have all last occurred at the same place. Access to the new state walks
    the path segments of its suffixes: a segment of lengths ``low < n <= high``
    that last ended at ``before`` gives a square when the distance from there
    lies within those lengths. Then the whole path takes the new end.
    """
    moves: list[dict] = [{}, {}]  # state 1 is the root; 0 stands for none
    length, link = [-1, 0], [0, 0]
    left, right, up, ended = [0, 0], [0, 0], [0, 0], [-1, -1]

    def splay(x: int) -> None:
        while True:
            y = up[x]
            if not y or (left[y] != x and right[y] != x):
                return
            z = up[y]
            inner = z and (left[z] == y or right[z] == y)
            if inner:
                # The far rotation first when x, y and z lie on one side.
                if (left[y] == x) == (left[z] == y):
                    turn(y, z)
                else:
                    turn(x, y)
                    y = z
            turn(x, y)

    def turn(x: int, y: int) -> None:
        z = up[y]
        if left[y] == x:
            b = right[x]
            left[y], right[x] = b, y
        else:
            b = left[x]
            right[y], left[x] = b, y
        if b:
            up[b] = y
        up[y], up[x] = x, z
        if z and left[z] == y:
            left[z] = x
        elif z and right[z] == y:
            right[z] = x
        else:
            ended[x] = ended[y]  # the root of a splay tree knows where its path last ended

    last = 1
    for end, code in enumerate(codes):
        made = len(length)
        length.append(length[last] + 1)
        moves.append({})
        at = last
        while at and code not in moves[at]:
            moves[at][code] = made
            at = link[at]
        parent = 1
        if at:
            parent = moves[at][code]
            if length[parent] != length[at] + 1:
                below, parent = parent, made + 1
                link.extend((parent, link[below]))
                length.append(length[at] + 1)
                moves.append(dict(moves[below]))
                splay(below)
                above = left[below]
                left.extend((0, above))
                right.extend((0, 0))
                up.extend((parent, below))
                ended.extend((-1, -1))
                if above:
                    up[above] = parent
                left[below] = link[below] = parent
                while at and moves[at].get(code) == below:
                    moves[at][code] = parent
                    at = link[at]
        if parent != made + 1:
            link.append(parent)
            left.append(0)
            right.append(0)
            up.append(parent)
            ended.append(-1)
        last = made
        state, below = made, 0
        while state:
            splay(state)
            before = ended[state]
            if right[state]:
                ended[right[state]] = before
            right[state] = below
            above = up[state]
            if before >= 0 and length[above] < end - before <= length[state]:
                yield end, end - before
            state, below = above, state
        ended[below] = end


def extended(codes: list, within: range, min_length: int, min_exponent: Fraction) -> Iterator[tuple[int, int, int]]:
    """``start, length, period`` of the runs of ``codes`` that lie in ``within``, each once."""
    known: dict[int, int] = {}  # where the last run of a period ends
    for at, period in squares(codes[within.start : within.stop]):
        end = within.start + at + 1
        if known.get(period, 0) >= end:
            continue
        start = end - 2 * period
        while end < len(codes) and codes[end] == codes[end - period]:
            end += 1
        while start and codes[start - 1] == codes[start - 1 + period]:
            start -= 1
        known[period] = end
        if end - start >= min_length and end - start >= min_exponent * period:
            yield start, end - start, period


def shortest_repeat(min_length: int, min_exponent: Fraction) -> int:
    """Words at least that a run has after its first period."""
    return min(max(min_length, -(-min_exponent * q // 1)) - q for q in range(1, min_length + 1))


def places(hashes: np.ndarray, owner: np.ndarray, gram: int, min_exponent: Fraction) -> Iterator[tuple[int, int]]:
    """Ranges of words that hold every run, and little else.

    ``hashes`` are those of the words of some texts, ``owner`` the number of
    each word's text. In a run of period q each group of ``gram`` words after
    the first q words has occurred before, at most q words ago, and such groups
    stand side by side in a stretch whose size bounds q. Groups too far from
    their last occurrence for their stretch are struck out until none is left.
    """
    n = len(hashes) - gram + 1
    if n <= 0:
        return
    key = owner[:n].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for k in range(gram):
        key += hashes[k : k + n] * np.uint64(pow(0xD6E8FEB86659FD93, k, 1 << 64))
    order = np.argsort(key, kind="stable")
    again = np.flatnonzero((key[order[1:]] == key[order[:-1]]) & (owner[order[1:]] == owner[order[:-1]]))
    distance = np.zeros(n, np.int64)
    distance[order[again + 1]] = order[again + 1] - order[again]
    at = np.flatnonzero((distance > 0) & (owner[:n] == owner[gram - 1 :]))
    while len(at):
        cuts = np.flatnonzero((np.diff(at) != 1) | (owner[at[1:]] != owner[at[:-1]])) + 1
        first = np.concatenate([[0], cuts])
        size = np.diff(np.concatenate([first, [len(at)]]))
        most = ((size + gram - 1) / float(min_exponent - 1) + 1e-9).astype(np.int64)
        stay = distance[at] <= np.repeat(most, size)
        if stay.all():
            for a, s, q in zip(at[first].tolist(), size.tolist(), most.tolist()):
                yield a - q, a + s + gram - 1
            return
        at = at[stay]


def runs_of(texts: list[list[bytes]], min_length: int, min_exponent: Fraction) -> list[list[tuple[int, int, int]]]:
    """The runs of each text, given as words, by start, then period."""
    gram = shortest_repeat(min_length, min_exponent)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    begin = np.concatenate([[0], np.cumsum(sizes)])
    hashes = np.fromiter((hash(w) for ws in texts for w in ws), np.int64, int(begin[-1])).view(np.uint64)
    owner = np.repeat(np.arange(len(texts)), sizes)
    within: dict[int, list[range]] = {}
    for a, b in places(hashes, owner, gram, min_exponent):
        k = int(owner[b - 1])
        a, b = max(a - begin[k], 0), b - begin[k]
        own = within.setdefault(k, [])
        if own and a <= own[-1].stop:
            own[-1] = range(min(own[-1].start, a), max(own[-1].stop, b))
        else:
            own.append(range(a, b))
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for k, own in within.items():
        number: dict[bytes, int] = {}
        codes = [number.setdefault(w, len(number)) for w in texts[k]]
        found = {run for part in own for run in extended(codes, part, min_length, min_exponent)}
        out[k] = sorted(found, key=lambda r: (r[0], r[2]))
    return out


def without_repeats(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words that no run holds after its first period."""
    if not runs:
        return words
    keep, at = [], 0
    for start, end in sorted((s + q, s + n) for s, n, q in runs):
        if start > at:
            keep += words[at:start]
        at = max(at, end)
    return keep + words[at:]


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = 6, min_exponent: float = 4) -> DataFrame:
    """The periodic runs of words in each whole text, and the text without what they repeat.

    Words are maximal runs of bytes other than space and 0x09-0x0D. A run is a
    stretch of ``min_length`` words or more, and of ``min_exponent`` (2 or more)
    times its smallest period or more, that cannot be made longer at either end.

    Returns a row per document: ``id_col``, ``n_words``, ``runs`` (an array of
    ``start, length, period`` in words, by start, then period) and ``collapsed``
    (the words that no run holds after its first period, joined by one space).
    A null, empty or white-space text has no words, no runs and an empty
    ``collapsed``. Null ids and repeated rows are kept as they are; other
    columns are ignored; an empty table gives an empty one. Texts are read where
    they are scanned: nothing is shuffled, and one text is one task's work
    whatever its length, in time that grows a little faster than its length.
    """
    exponent = Fraction(min_exponent).limit_denominator(1000)
    if exponent < 2 or min_length < 2:
        raise ValueError("a run has two words and two periods at least")
    run_type = "array<struct<start: bigint, length: bigint, period: bigint>>"
    schema = T.StructType([
        T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("n_words", T.LongType()),
        T.StructField("runs", T.DataType.fromDDL(run_type)), T.StructField("collapsed", T.BinaryType()),
    ])
    arrow_runs = pa.list_(pa.struct([(x, pa.int64()) for x in ("start", "length", "period")]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done, texts, size = 0, [], 0
            for k, text in enumerate(batch["_text"]):
                texts.append((text.as_py() or b"").split())
                size += len(texts[-1])
                if size >= CHUNK_WORDS or k == batch.num_rows - 1:
                    found = runs_of(texts, min_length, exponent)
                    runs = [[dict(start=s, length=n, period=q) for s, n, q in own] for own in found]
                    kept = [b" ".join(without_repeats(ws, own)) for ws, own in zip(texts, found)]
                    ids = batch["_id"].slice(done, len(texts))
                    yield pa.RecordBatch.from_arrays([ids, pa.array(list(map(len, texts)), pa.int64()), pa.array(runs, arrow_runs), pa.array(kept, pa.binary())], names=schema.names)
                    done, texts, size = k + 1, [], 0

    whole = small_batches(docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("binary").alias("_text")))
    return whole.mapInArrow(tidy(run), schema).withColumn("collapsed", F.col("collapsed").cast("string"))
