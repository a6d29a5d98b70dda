"""Connected components of a link table, as joins and grouped minima."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notemill.staging import stage, unstage


def _both_ways(links: DataFrame) -> DataFrame:
    return links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _smallest_neighbour(pairs: DataFrame) -> DataFrame:
    # Staged, so that the join on it shuffles two plain tables: Spark can then
    # split the rows of a hub (a node with very many links) over many tasks.
    return pairs.groupBy("u").agg(F.min("v").alias("m"))


def _mark(links: DataFrame):
    return links.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()


def connected_components(links: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60, task_rows: int | None = None) -> DataFrame:
    """Label every node of ``links`` with the smallest node it can reach.

    Alternates large-star and small-star rounds (Kiveris et al. 2014): each
    round re-hangs the neighbours of a node on its smallest neighbour, and ends
    when the links are stars. Links are undirected; null ends, loops and
    repeated links are ignored. Nodes without links are not returned. With
    ``task_rows`` tasks are made fewer where there are fewer links for them.

    Returns ``node``, ``component``. An empty table gives an empty table.
    """
    links = links.select(
        F.greatest(F.col(src), F.col(dst)).alias("u"), F.least(F.col(src), F.col(dst)).alias("v")
    ).where("u > v")
    links = stage(links.distinct(), "cc")
    mark = _mark(links)

    def staged(df: DataFrame, label: str) -> DataFrame:
        return stage(df if task_rows is None else df.coalesce(1 + 2 * mark.n // task_rows), label)

    for _ in range(max_rounds):
        if not mark.n:
            break
        both = _both_ways(links)
        low = staged(_smallest_neighbour(both), "cc-min")
        large = (
            both.join(low, "u").where("v > u")
            .select(F.col("v").alias("u"), F.least("u", "m").alias("v"))
        )
        large = staged(large.distinct(), "cc")
        low2 = staged(_smallest_neighbour(large), "cc-min")
        small = large.join(low2, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.unionByName(low2.select("u", F.col("m").alias("v")))
        done = staged(small.distinct(), "cc")
        unstage(low, large, low2, links)
        links, before, mark = done, mark, _mark(done)
        if mark == before:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = links.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return links.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
