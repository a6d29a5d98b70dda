"""Packing token sequences by the sum-of-squares rule."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from notemill.llm.tokens import byte_bpe, default_tokenizer
from notemill.llm.workers import small_batches, tidy
from notemill.staging import stage

CAPACITY = 2048
#: Sequences that one task packs at most, about. Its groups' open ends cost well under one part in a thousand.
GROUP_SEQUENCES = 4000


def token_pieces(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY,
    tokenizer: str | None = None, end_id: int = 0, with_ids: bool = False,
) -> DataFrame:
    """Encode every whole text, end it with ``end_id`` and cut it into pieces of at most ``capacity``.

    Only longer texts are cut, so that all pieces but the first are full. Null
    counts as empty. Returns ``id_col, piece, start, length, ids_crc32`` and,
    with ``with_ids``, ``token_ids`` (little-endian uint32).
    """
    path = tokenizer or default_tokenizer()
    fields = [T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("piece", T.IntegerType())]
    fields += [T.StructField(n, T.LongType()) for n in ("start", "length", "ids_crc32")]
    fields += [T.StructField("token_ids", T.BinaryType())] * with_ids
    end = int(end_id).to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = byte_bpe(path)
        for batch in batches:
            row, out = [], []
            for i, text in enumerate(batch[text_col]):
                ids = bpe.encode(text.as_py() or "") + end
                n = len(ids) // 4
                cuts = [0, *range(n % capacity or capacity, n + 1, capacity)] if n > capacity else [0, n]
                for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
                    part = ids[4 * a : 4 * b]
                    row.append(i)
                    out.append((k, a, b - a, zlib.crc32(part), part if with_ids else None))
            k, a, n, crc, part = zip(*out) if out else ((),) * 5
            cols = [batch[id_col].take(pa.array(row, pa.int64())), pa.array(k, pa.int32())]
            cols += [pa.array(x, pa.int64()) for x in (a, n, crc)] + [pa.array(part, pa.binary())] * with_ids
            yield pa.RecordBatch.from_arrays(cols, names=[f.name for f in fields])

    return small_batches(docs).select(id_col, text_col).mapInArrow(tidy(run), T.StructType(fields))


def sum_of_squares(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each item, placed in the given order.

    Each item goes where the sum over gaps of (open bins with that gap) squared
    becomes smallest, a new bin being one of the choices; ties go to the
    tightest gap, a new bin last.
    """
    count = np.zeros(capacity + 1, np.int64)  # open bins by gap; a full bin is not open
    open_at: list[list[int]] = [[] for _ in range(capacity + 1)]
    bins, offsets, made = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64), 0
    for k, size in enumerate(lengths.tolist()):
        gaps = size + np.flatnonzero(count[size:capacity])
        change = 2 * (count[gaps - size] - count[gaps]) + 2
        change[gaps == size] -= 1  # nothing is left open: the square of no gap grows
        fresh = 2 * int(count[capacity - size]) + 1 if size < capacity else 0
        best = int(change.argmin()) if len(gaps) else -1
        if best >= 0 and change[best] <= fresh:
            gap = int(gaps[best])
            count[gap] -= 1
            at = open_at[gap].pop()
        else:
            gap, at, made = capacity, made, made + 1
        bins[k], offsets[k] = at, capacity - gap
        left = gap - size
        if left:
            count[left] += 1
            open_at[left].append(at)
    return bins, offsets


def pack_lengths(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """Sum-of-squares packing, longest first, then again over what stayed in slack bins while that saves bins."""
    order = np.argsort(-lengths, kind="stable")
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    bins[order], offsets[order] = sum_of_squares(lengths[order], capacity)
    for slack in (0.5, 0.25, 0.1, 0.03):
        fill = np.bincount(bins, lengths)
        loose = np.flatnonzero((fill > 0) & (fill < capacity * (1 - slack)))
        items = np.flatnonzero(np.isin(bins, loose))
        items = items[np.argsort(-lengths[items], kind="stable")]
        again, at = sum_of_squares(lengths[items], capacity)
        if len(items) and again.max() + 1 < len(loose):
            bins[items], offsets[items] = loose[again], at
    return bins, offsets


def pack(pieces: DataFrame, id_col: str = "doc_id", capacity: int = CAPACITY, group_sequences: int = GROUP_SEQUENCES) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to pieces with a ``length`` of 1 to ``capacity``.

    Pieces are dealt evenly over groups of about ``group_sequences`` sequences by
    a hash of their place, whatever their key, and each group is packed by itself.
    """
    total = pieces.agg(F.sum("length").alias("n")).first().n or 0
    groups = max(1, -(-total // (capacity * group_sequences)))
    schema = T.StructType([*pieces.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def run(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values([id_col, "piece"], kind="stable").drop(columns="pack_group")
        bins, offsets = pack_lengths(part["length"].to_numpy(), capacity)
        return part.assign(sequence_id=(int(key[0]) << 32) + bins, offset=offsets)

    # Equal rows would hash alike; the task's own row numbers tell them apart.
    dealt = pieces.withColumn("pack_group", F.pmod(F.xxhash64(id_col, "piece", F.monotonically_increasing_id()), F.lit(groups)).cast("int"))
    return dealt.groupBy("pack_group").applyInPandas(run, schema)


def pack_documents(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY,
    tokenizer: str | None = None, with_ids: bool = False,
) -> DataFrame:
    """Pack whole documents into sequences of at most ``capacity`` tokens.

    One row per piece: the columns of ``token_pieces`` plus ``sequence_id`` and
    ``offset``; the offsets of a sequence have no gaps. Null and empty texts are
    one end token; repeated rows are packed one by one; an empty table gives an
    empty one; other columns are ignored. A very long text is cut into full
    sequences, of which only the first piece may be shorter.
    """
    return pack(stage(token_pieces(docs, id_col, text_col, capacity, tokenizer, with_ids=with_ids), "pieces"), id_col, capacity)
