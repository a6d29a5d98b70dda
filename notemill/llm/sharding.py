"""Contiguous shards of near equal bytes that keep equal texts together."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from notemill.staging import stage

#: The ordered atoms that the driver cuts between number at most 2**ATOM_BITS at any input size.
ATOM_BITS = 17


def _fits(prefix: np.ndarray, shards: int, capacity: int) -> bool:
    """Greedy check: fill each shard as far as the capacity goes."""
    at = 0
    for _ in range(shards):
        at = int(np.searchsorted(prefix, prefix[at] + capacity, "right")) - 1
        if at == len(prefix) - 1:
            return True
    return False


def smallest_capacity(sizes: np.ndarray, shards: int) -> int:
    """The least c such that the sizes, in order, fit into ``shards`` contiguous runs of at most c."""
    if not len(sizes):
        return 0
    prefix = np.r_[0, np.cumsum(sizes)]
    low, high = max(int(sizes.max()), -(-int(prefix[-1]) // shards)), int(prefix[-1])
    while low < high:
        mid = (low + high) // 2
        low, high = (low, mid) if _fits(prefix, shards, mid) else (mid + 1, high)
    return low


def contiguous_cuts(sizes: np.ndarray, shards: int) -> np.ndarray:
    """First index of each shard, and the end: runs within the smallest capacity, each as near an even share as that allows."""
    prefix, capacity, end = np.r_[0, np.cumsum(sizes)], smallest_capacity(sizes, shards), len(sizes)
    latest = [end]  # the earliest index from which the rest still fits into k shards
    for _ in range(shards):
        latest.append(int(np.searchsorted(prefix, prefix[latest[-1]] - capacity, "left")))
    cuts = [0]
    for left in range(shards, 1, -1):
        at = cuts[-1]
        goal = prefix[at] + (prefix[-1] - prefix[at]) / left
        near = int(np.searchsorted(prefix, goal, "left"))
        if near > at and goal - prefix[near - 1] <= prefix[min(near, end)] - goal:
            near -= 1
        most = int(np.searchsorted(prefix, prefix[at] + capacity, "right")) - 1
        cuts.append(min(max(near, latest[left - 1], at), most))
    return np.r_[cuts, end]


def shard_documents(
    docs: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text", overhead: int = 16, atom_bits: int = ATOM_BITS,
) -> DataFrame:
    """Assign every document to one of ``shards`` contiguous runs of the hash order of texts.

    The size of a document is its UTF-8 bytes (null: none) plus ``overhead``.
    Equal texts form a group that is never split; null texts are one group,
    empty ones another. Groups are ordered by hash, and neighbours of one hash
    range make one atom; the driver sees only the atoms' sizes. The capacity
    is the smallest feasible, found by binary search with a greedy check.

    Returns ``id_col, size, text_crc32, shard, slot``; slots run from 0 without
    gaps. Fewer groups than shards leave shards empty. Repeated rows get a slot
    each; an empty table gives an empty one; other columns are ignored. A text
    larger than an even share fills a shard by itself.
    """
    text = F.col(text_col)
    rows = docs.select(
        F.col(id_col),
        (F.coalesce(F.octet_length(text), F.lit(0)) + overhead).cast("long").alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
        F.shiftrightunsigned(F.xxhash64(text), 64 - atom_bits).cast("int").alias("atom"),
        F.monotonically_increasing_id().alias("row"),
    )
    rows = stage(rows, "sized")
    atoms = rows.groupBy("atom").agg(F.sum("size").alias("size"), F.count("*").alias("n")).toPandas().sort_values("atom")
    cuts = contiguous_cuts(atoms["size"].to_numpy(np.int64), shards)
    order = atoms["atom"].to_numpy()
    firsts = [int(order[c]) if c < len(order) else 1 << atom_bits for c in cuts[1:-1]]
    shard = F.size(F.filter(F.array(*[F.lit(f) for f in firsts]), lambda f: f <= F.col("atom"))) if firsts else F.lit(0)
    # Slots are counted within many small parts of each shard, so that no shard is one task.
    parts = max(64, int(atoms["n"].sum()) // (shards * 100_000))
    placed = rows.select(id_col, "size", "text_crc32", "row", shard.cast("int").alias("shard"), F.pmod(F.xxhash64("row"), F.lit(parts)).cast("int").alias("part"))
    counts = placed.groupBy("shard", "part").count()
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("shard", "part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("before"))
    within = F.row_number().over(Window.partitionBy("shard", "part").orderBy("row"))
    numbered = placed.withColumn("within", within).join(F.broadcast(counts) if shards * parts <= 1 << 20 else counts, ["shard", "part"])
    return numbered.select(id_col, "size", "text_crc32", "shard", (F.col("before") + F.col("within") - 1).cast("long").alias("slot"))


def write_shards(docs: DataFrame, assigned: DataFrame, path: str, id_col: str = "doc_id") -> None:
    """Write the documents, with unique ids, as one folder of Parquet files per shard, in slot order within each file."""
    placed = docs.drop("shard", "slot").join(assigned.select(id_col, "shard", "slot"), id_col)
    placed.repartition("shard", F.pmod("slot", F.lit(16))).sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
