"""Exact top-k inner-product search by a join over Voronoi cells."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from notemill.staging import stage

#: Most pivots, and so most cells and summary rows that the driver sees.
MAX_PIVOTS = 512
#: Vectors of a cell that one task solves at once; larger cells are dealt into blocks.
BLOCK_ROWS = 20_000
#: Cells in which a query's first bound is found.
FIRST_CELLS = 3


def quantised(rows: DataFrame, id_col: str, vec_col: str, scale: int = 1024) -> DataFrame:
    """``id``, ``v`` = floor(scale * x) as longs, without null vectors and those with null or non-finite components."""
    x = F.col(vec_col)
    ok = x.isNotNull() & F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    return rows.where(ok).select(F.col(id_col).alias("id"), F.transform(x, lambda e: F.floor(e.cast("double") * scale).cast("long")).alias("v"))


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    n = len(column)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(n, len(flat) // n if n else 0)


def _by_length(batch: pa.RecordBatch | pa.Table) -> Iterator[tuple[int, np.ndarray]]:
    column = batch["v"]
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    for dim in np.unique(sizes):
        yield int(dim), np.flatnonzero(sizes == dim)


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer inner products of the rows of a and b."""
    if a.shape[1] == 0:
        return np.zeros((len(a), len(b)), np.int64)
    bound = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    if bound < 2**53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T


class _Cells:
    """Pivots by length, the summary of each data cell (count, radius) and of each query group (radius), and which meet.

    Both sides are grouped by their nearest pivot. With ``q`` in the group of ``p``
    within ``U``, and ``s`` in the cell of ``c`` within ``r``, the product ``q.s``
    lies within ``U * abs(c) + (abs(p) + U) * r`` of ``p.c``. The lower ends and the
    counts of the cells give each group a floor that ``want`` rows reach for any of
    its queries; a cell whose upper end stays below the floor never meets the group.
    """

    def __init__(self, pivots: list, summary: list = (), groups: list = (), want: int = 0):
        self.pivots: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for dim in {len(p) for p in pivots}:
            own = [(i, p) for i, p in enumerate(pivots) if len(p) == dim]
            self.pivots[dim] = np.array([i for i, _ in own]), np.array([p for _, p in own], np.float64).reshape(len(own), dim)
        self.stats = {int(c): (int(n), float(r)) for c, n, r in summary}
        self.groups: dict[int, tuple[float, np.ndarray]] = {}
        reach = {int(c): float(r) for c, r in groups}
        for dim in {*self.pivots, *(-1 - c for c in reach if c < 0)}:
            _, to, n, radius = self.held(dim)
            for group, pivot in zip(*self.of(dim)):
                if (own := reach.get(int(group))) is not None:
                    middle = to @ pivot
                    size = np.sqrt((pivot**2).sum())
                    off = own * np.sqrt((to**2).sum(1)) + (size + own) * radius
                    off += 1 + 1e-9 * (np.abs(middle) + off)
                    order = np.argsort(off - middle, kind="stable")
                    enough = np.flatnonzero(np.cumsum(n[order]) >= want)
                    floor = float((middle - off)[order[enough[0]]]) if len(enough) else -np.inf
                    self.groups[int(group)] = floor, middle + off >= floor

    def of(self, dim: int) -> tuple[np.ndarray, np.ndarray]:
        """Cell ids and pivots; a length without a sampled pivot has one cell around the origin."""
        return self.pivots.get(dim, (np.array([-1 - dim]), np.zeros((1, dim))))

    def held(self, dim: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        cells, pivots = self.of(dim)
        keep = np.array([int(c) in self.stats for c in cells], bool)
        n, r = (np.array([self.stats[int(c)][k] for c in cells[keep]]) for k in (0, 1))
        return cells[keep], pivots[keep], n, r


def _assign(cells: _Cells):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, at in _by_length(batch):
                part = batch.take(pa.array(at))
                ids, pivots = cells.of(dim)
                for begin in range(0, len(at), 4096):
                    some = part.slice(begin, 4096)
                    x = _matrix(some["v"]).astype(np.float64)
                    near = ((pivots**2).sum(1) - 2 * x @ pivots.T).argmin(1)
                    far = np.sqrt(((x - pivots[near]) ** 2).sum(1))
                    yield pa.RecordBatch.from_arrays([some["id"], some["v"], pa.array(ids[near].astype(np.int32)), pa.array(far)], names=["id", "v", "cell", "far"])

    return run


def _visits(cells: _Cells, want: int, first: bool):
    """Cells that each query must see, of those that its group meets: at first the few most promising, then all whose bound reaches ``floor``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, at in _by_length(batch):
                part = batch.take(pa.array(at))
                ids, pivots, n, radius = cells.held(dim)
                if not len(ids):
                    continue
                for begin in range(0, len(at), 512):
                    some = part.slice(begin, 512)
                    q = _matrix(some["v"]).astype(np.float64)
                    toward = q @ pivots.T
                    floors, meets = zip(*(cells.groups[c] for c in some["cell"].to_pylist()))
                    meets, floor = np.array(meets), np.array(floors)
                    if first:
                        order = np.argsort(np.where(meets, -toward, np.inf), axis=1, kind="stable")
                        count = np.take_along_axis(np.where(meets, n, 0), order, 1)
                        take = ((np.cumsum(count, axis=1) - count < want) | (np.arange(len(ids)) < FIRST_CELLS)) & (count > 0)
                        row, col = np.nonzero(take)
                        col = order[row, col]
                    else:
                        floor = np.maximum(floor, some["floor"].to_numpy(zero_copy_only=False))
                        norm = np.sqrt((q**2).sum(1))
                        reach = toward + norm[:, None] * radius
                        reach += 1 + 1e-9 * (np.abs(toward) + norm[:, None] * radius)
                        row, col = np.nonzero(meets & (reach >= floor[:, None]))
                    for k in range(0, len(row), 4096):
                        r = row[k : k + 4096]
                        yield pa.RecordBatch.from_arrays(
                            [some["id"].take(pa.array(r)), some["v"].take(pa.array(r)), pa.array(floor[r]), pa.array(ids[col[k : k + 4096]].astype(np.int32))],
                            names=["id", "v", "floor", "cell"],
                        )

    return run


def _best(query: pa.RecordBatch, ids: np.ndarray, none: np.ndarray, x: np.ndarray, want: int) -> pa.RecordBatch:
    """The ``want`` best of one block's rows for each of some queries."""
    floor, names = query["floor"].to_numpy(), query["id"].to_numpy()
    scores = _products(_matrix(query["v"]), x)
    out = []
    for k in range(len(names)):
        s = scores[k]
        at = np.flatnonzero(s >= floor[k]) if floor[k] > -np.inf else np.arange(len(s))
        if len(at) > want:
            cut = np.partition(s[at], len(at) - want)[len(at) - want]
            at = at[s[at] >= cut]
        at = at[np.argsort(-s[at], kind="stable")][:want]  # ids ascend, so ties keep the smaller
        out.append((np.full(len(at), names[k]), at, s[at]))
    name, at, score = (np.concatenate(c) for c in zip(*out))
    return pa.RecordBatch.from_arrays([pa.array(name, pa.int64()), pa.array(ids[at], pa.int64(), mask=none[at]), pa.array(score, pa.int64())], names=["query", "id", "score"])


def _solve(want: int):
    """A partition holds each block's data rows, then its queries, which stream past: a block and a batch of queries are held at once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts, block = None, [], None
        for batch in batches:
            cell, number, asks = (batch[c].to_numpy(zero_copy_only=False) for c in ("cell", "block", "asks"))
            edges = np.flatnonzero(np.r_[True, (cell[1:] != cell[:-1]) | (number[1:] != number[:-1]) | (asks[1:] != asks[:-1])]) if len(cell) else []
            for a, b in zip(edges, np.r_[edges[1:], len(cell)].astype(int)):
                some = batch.slice(int(a), int(b - a))
                if (cell[a], number[a]) != now:
                    now, parts, block = (cell[a], number[a]), [], None
                if not asks[a]:
                    parts.append((some["id"].fill_null(0).to_numpy(), some["id"].is_null().to_numpy(zero_copy_only=False), _matrix(some["v"])))
                    continue
                if parts and block is None:
                    ids, none, x = (np.concatenate(c) for c in zip(*parts))
                    order = np.lexsort((ids, none))
                    block = ids[order], none[order], x[order]
                if block is not None:
                    for begin in range(0, some.num_rows, 256):
                        yield _best(some.slice(begin, 256), *block, want)

    return run


def top_k(
    queries: DataFrame, data: DataFrame, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding",
    scale: int = 1024, max_pivots: int = MAX_PIVOTS, block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """The k data rows with the highest integer inner product for every query row, its own id excluded.

    Sampled pivots (at most ``max_pivots``) split queries and data into groups,
    each summarised by its count and radius. From the summaries follow a floor
    for each group of queries and the cells that can reach it; only these meet.
    Within them a query is solved in its most promising cells first; its k-th
    score there raises its floor, and it is sent on only to cells whose bound
    ``q.p + |q| * radius`` reaches it: the queries are the small side, so they
    are what is replicated. Cells over ``block_rows`` are dealt into blocks, past
    which the queries stream. Of equal vectors the k + 1 smallest ids can be in
    an answer, so only those are searched; equal queries are solved once. Vectors
    that are null or hold null or non-finite components take no part; only
    vectors of one length meet. Ties go to the smaller id. A data row without an
    id can be in an answer, behind others of its score; a query without one has no
    answer. Repeated queries are answered once, repeated data rows are candidates each.

    Returns ``query_id, rank, id, score``. Empty tables give an empty result; other
    columns are ignored. Scores are 64-bit: the scaled products of one pair must fit.
    """
    want = k + 1
    data = quantised(data, id_col, vec_col, scale)
    same = Window.partitionBy("v").orderBy(F.asc_nulls_last("id"))
    data = stage(data.withColumn("n", F.row_number().over(same)).where(F.col("n") <= want).drop("n"), "knn-data")
    asked = stage(quantised(queries, id_col, vec_col, scale).where("id IS NOT NULL").distinct(), "knn-queries")
    distinct = asked.groupBy("v").agg(F.min("id").alias("id")).select("id", "v")
    count = data.count()
    pivots = min(max_pivots, max(1, int(count**0.5)))
    sample = [r.v for r in data.select("v", F.xxhash64("v").alias("h")).orderBy("h", "v").limit(pivots).collect()]
    id_type = T.LongType()
    held = T.StructType([T.StructField("id", id_type), data.schema["v"], T.StructField("cell", T.IntegerType()), T.StructField("far", T.DoubleType())])
    placed = stage(data.mapInArrow(_assign(_Cells(sample)), held), "knn-cells")
    grouped = stage(distinct.mapInArrow(_assign(_Cells(sample)), held), "knn-groups")
    summary = placed.groupBy("cell").agg(F.count("*").alias("n"), F.max("far").alias("r")).collect()
    groups = grouped.groupBy("cell").agg(F.max("far").alias("r")).collect()
    cells = _Cells(sample, [(r.cell, r.n, r.r) for r in summary], [(r.cell, r.r) for r in groups], want)
    blocks = placed.sparkSession.createDataFrame([(r.cell, -(-r.n // block_rows)) for r in summary], "cell int, blocks int")
    sent = T.StructType([T.StructField("id", id_type), data.schema["v"], T.StructField("floor", T.DoubleType()), T.StructField("cell", T.IntegerType())])
    there = placed.join(F.broadcast(blocks), "cell").withColumn("block", F.pmod(F.xxhash64("v", "id"), F.col("blocks")).cast("int"))
    there = there.select("id", "v", F.lit(None).cast("double").alias("floor"), "cell", "block", F.lit(False).alias("asks"))

    def solve(askers: DataFrame, first: bool) -> DataFrame:
        sends = askers.mapInArrow(_visits(cells, want, first), sent).join(F.broadcast(blocks), "cell")
        sends = sends.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks").withColumn("asks", F.lit(True))
        both = there.unionByName(sends).repartition("cell", "block").sortWithinPartitions("cell", "block", "asks")
        return both.mapInArrow(_solve(want), "query long, id long, score long")

    best = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("id"))
    askers = grouped.select("id", "v", "cell", F.lit(float("-inf")).alias("floor"))
    first = solve(askers, True)
    floors = first.withColumn("n", F.row_number().over(best)).where(F.col("n") == want).select(F.col("query").alias("id"), F.col("score").cast("double").alias("floor"))
    askers = askers.drop("floor").join(floors, "id", "left").fillna(float("-inf"), ["floor"]).select("id", "v", "cell", "floor")
    top = solve(stage(askers, "knn-floors"), False).withColumn("n", F.row_number().over(best)).where(F.col("n") <= want).drop("n")
    named = asked.select(F.col("id").alias("query_id"), "v").join(distinct.withColumnRenamed("id", "query"), "v").select("query_id", "query")
    pairs = named.join(top, "query").where(~F.col("id").eqNullSafe(F.col("query_id")))
    rank = F.row_number().over(Window.partitionBy("query_id", "query").orderBy(F.desc("score"), F.asc_nulls_last("id")))
    return pairs.select("query_id", rank.alias("rank"), F.col("id"), "score").where(F.col("rank") <= k)
