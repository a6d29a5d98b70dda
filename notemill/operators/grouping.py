"""Small aggregates of an import: counts, examples, ranks and distinct values."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def counts_by(rows: DataFrame, *by: str) -> DataFrame:
    return rows.groupBy(*by).agg(F.count("*").alias("n"))


def grouped(rows: DataFrame, key: str, ordinal: str, *columns: str) -> DataFrame:
    """The rows of each key as one ordered list of structs."""
    ordered = F.array_sort(F.collect_list(F.struct(ordinal, *columns)))
    return rows.groupBy(key).agg(ordered.alias("rows"))


def first_examples(rows: DataFrame, ordinal: str, *columns: str) -> DataFrame:
    """One row: of every column its first value that is not blank."""
    pick = [F.min_by(c, F.when(F.trim(F.col(c).cast("string")) != "", F.col(ordinal))).alias(c) for c in columns]
    seen = [F.count_if(F.trim(F.col(c).cast("string")) != "").alias(f"_{c}") for c in columns]
    return rows.agg(*pick, *seen).select(*[F.when(F.col(f"_{c}") > 0, F.col(c)).alias(c) for c in columns])


def distinct_tags(rows: DataFrame, key: str, tag: str, ordinal: str) -> DataFrame:
    """Tags of each key once, whatever the case, in the first spelling and order."""
    first = Window.partitionBy(key, F.lower(tag)).orderBy(ordinal)
    kept = rows.withColumn("_n", F.row_number().over(first)).where("_n = 1")
    return grouped(kept, key, ordinal, tag).select(key, F.transform("rows", lambda x: x[tag]).alias("tags"))


def importer_ranks(files: DataFrame, claims: DataFrame) -> DataFrame:
    """Importers by the files they take, most first, then by the fewest extensions they claim.

    ``files``: ``extension``; ``claims``: ``importer, extension, ordinal``.
    """
    taken = files.groupBy("extension").agg(F.count("*").alias("n"))
    claimed = claims.groupBy("importer").agg(F.count("*").alias("claims"), F.min("ordinal").alias("ordinal"))
    ranked = claims.join(taken, "extension").groupBy("importer").agg(F.sum("n").alias("taken")).join(claimed, "importer")
    return ranked.orderBy(F.desc("taken"), "claims", "ordinal").select("importer", "taken", "claims")


def progress(tables: DataFrame) -> DataFrame:
    """Records fetched so far, and the estimate of all: unknown tables count as the mean of the known ones.

    ``tables``: ``fetched`` (null if not begun).
    """
    return tables.agg(
        F.coalesce(F.sum("fetched"), F.lit(0)).alias("fetched"),
        (F.coalesce(F.sum("fetched"), F.lit(0)) + F.count_if(F.col("fetched").isNull()) * F.coalesce(F.avg("fetched"), F.lit(0.0))).alias("expected"),
    )
