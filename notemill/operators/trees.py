"""Trees held as parent columns: closures by doubling, paths, roll-ups, search."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from notemill.staging import stage, unstage


def closure(nodes: DataFrame, node: str = "id", parent: str = "parent_id", max_rounds: int = 40) -> DataFrame:
    """``node, ancestor, distance`` for every node and each node above it, itself included.

    Pointers double: round k joins paths of up to 2^k steps, so a tree of depth d
    takes log2(d) rounds. Parents that are no nodes count as none. A cycle ends
    where a node would come to itself again, so its nodes are ancestors of each other.
    """
    parents = nodes.select(F.col(node).alias("node"), F.col(parent).alias("ancestor"))
    known = nodes.select(F.col(node).alias("ancestor"))
    reach = stage(parents.join(known, "ancestor", "left_semi").where("node <> ancestor").select("node", "ancestor", F.lit(1).alias("distance")), "closure")
    for _ in range(max_rounds):
        step = reach.select(F.col("node").alias("ancestor"), F.col("ancestor").alias("_far"), F.col("distance").alias("_more"))
        longer = reach.join(step, "ancestor").select("node", F.col("_far").alias("ancestor"), (F.col("distance") + F.col("_more")).alias("distance"))
        wider = reach.unionByName(longer.where("node <> ancestor")).groupBy("node", "ancestor").agg(F.min("distance").alias("distance"))
        wider = stage(wider, "closure")
        grown = wider.count() > reach.count()
        unstage(reach)
        reach = wider
        if not grown:
            break
    own = nodes.select(F.col(node).alias("node"), F.col(node).alias("ancestor"), F.lit(0).alias("distance"))
    return reach.unionByName(own)


def _pointers(nodes: DataFrame, node: str, parent: str) -> DataFrame:
    """``node, up``: the parent, null where it is no other node."""
    own = nodes.select(F.col(node).alias("node"), F.col(parent).alias("up"))
    known = nodes.select(F.col(node).alias("_up")).distinct()
    return own.join(known, (F.col("up") == F.col("_up")) & (F.col("up") != F.col("node")), "left").select("node", F.col("_up").alias("up"))


def _rolled_up(begin: DataFrame, gather: Column, both: Callable[[Column, Column], Column]) -> DataFrame | None:
    """``node, v``: the values (``node, up, v``) of each node and all below it, in rounds of doubled pointers over one row per node.

    After round k a node holds what lies less than 2^k steps below, and points 2^k
    steps up. Null if pointers are left after as many rounds as a tree of these nodes can take: there is a cycle.
    """
    now = stage(begin, "roll")
    for _ in range(now.count().bit_length() + 1):
        if now.where("up IS NOT NULL").isEmpty():
            return now.select("node", "v")
        more = now.where("up IS NOT NULL").groupBy(F.col("up").alias("node")).agg(gather.alias("more"))
        far = now.select(F.col("node").alias("up"), F.col("up").alias("far"))
        grown = now.join(more, "node", "left").withColumn("v", F.when(F.col("more").isNull(), F.col("v")).otherwise(both(F.col("v"), F.col("more"))))
        grown = stage(grown.join(far, "up", "left").select("node", F.col("far").alias("up"), "v"), "roll")
        unstage(now)
        now = grown
    return None


def pulled_down(begin: DataFrame, both: Callable[[Column, Column], Column]) -> DataFrame:
    """``node, v``, staged: the values (``node, up, v``) of each node and all above it, in rounds of doubled pointers over one row per node.

    Raises on a cycle.
    """
    now = stage(begin, "pull")
    for _ in range(now.count().bit_length() + 1):
        if now.where("up IS NOT NULL").isEmpty():
            return now.select("node", "v")
        above = now.select(F.col("node").alias("up"), F.col("v").alias("more"), F.col("up").alias("far"), F.lit(True).alias("met"))
        grown = now.join(above, "up", "left").select("node", F.col("far").alias("up"), F.when(F.col("met"), both(F.col("v"), F.col("more"))).otherwise(F.col("v")).alias("v"))
        grown = stage(grown, "pull")
        unstage(now)
        now = grown
    raise ValueError("the nodes above each other form a cycle")


def in_order(nodes: DataFrame, node: str = "id", parent: str = "parent_id", title: str = "title", collation: str = "UNICODE") -> DataFrame:
    """Nodes with ``place``: their number, from 1, when every node stands before those below it and siblings stand by title.

    Titles compare as a reader's language has it (``collation``): letters before accents before case, of equal
    titles the smaller id first. A node's place is its parent's plus one and the sizes of the subtrees of its
    earlier siblings, so sizes are summed upward and places downward, both in rounds of doubled pointers.
    """
    up = stage(_pointers(nodes, node, parent), "order")
    sizes = subtree_sums(nodes, nodes.select(F.col(node), F.lit(1).alias("n")), node, parent).select(F.col(node).alias("node"), "total")
    rows = nodes.select(F.col(node).alias("node"), F.col(title).alias("_t")).join(up, "node").join(sizes, "node")
    before = Window.partitionBy("up").orderBy(F.collate("_t", collation), "node").rowsBetween(Window.unboundedPreceding, -1)
    begin = rows.select("node", "up", (F.coalesce(F.sum("total").over(before), F.lit(0)) + 1).alias("v"))
    placed = pulled_down(begin, lambda own, above: own + above)
    unstage(up)
    return nodes.join(placed.select(F.col("node").alias("_node"), F.col("v").alias("place")), F.col(node) == F.col("_node")).drop("_node")


def forest(nodes: DataFrame, node: str = "id", parent: str = "parent_id") -> DataFrame:
    """Nodes with ``parent`` set to null where it is no node, and ``is_root``."""
    known = nodes.select(F.col(node).alias("_parent"))
    joined = nodes.join(known, F.col(parent) == F.col("_parent"), "left")
    return joined.withColumn(parent, F.col("_parent")).drop("_parent").withColumn("is_root", F.col(parent).isNull())


def paths(nodes: DataFrame, node: str = "id", parent: str = "parent_id", title: str = "title", sep: str = "/") -> DataFrame:
    """``node, path, depth``: titles from the root down."""
    named = closure(nodes, node, parent).join(nodes.select(F.col(node).alias("ancestor"), F.col(title).alias("_t")), "ancestor")
    down = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("distance")).alias("d"), "_t"))), lambda x: x["_t"])
    return named.groupBy("node").agg(F.array_join(down, sep).alias("path"), F.max("distance").alias("depth"))


def subtree_sums(nodes: DataFrame, counts: DataFrame, node: str = "id", parent: str = "parent_id", value: str = "n") -> DataFrame:
    """``node, total``: the values of a node and of all below it."""
    own = counts.groupBy(F.col(node).alias("node")).agg(F.sum(value).alias("v"))
    begin = _pointers(nodes, node, parent).join(own, "node", "left").select("node", "up", F.coalesce("v", F.lit(0)).alias("v"))
    summed = _rolled_up(begin, F.sum("v"), lambda a, b: a + b)
    if summed is not None:
        return summed.select(F.col("node").alias(node), F.col("v").alias("total"))
    below = closure(nodes, node, parent).join(own, "node", "left")
    return below.groupBy(F.col("ancestor").alias(node)).agg(F.coalesce(F.sum("v"), F.lit(0)).alias("total"))


def has_descendant(nodes: DataFrame, wanted: DataFrame, node: str = "id", parent: str = "parent_id") -> DataFrame:
    """Nodes that have one of ``wanted`` anywhere below."""
    flags = wanted.select(F.col(node).alias("node")).distinct().withColumn("w", F.lit(1))
    begin = _pointers(nodes, node, parent).join(flags, "node", "left").select("node", "up", F.coalesce("w", F.lit(0)).alias("v"))
    counted = _rolled_up(begin, F.max("v"), F.greatest)
    if counted is not None:
        below = counted.where("v > 0").select("node").join(_pointers(nodes, node, parent), "node")
        return below.where("up IS NOT NULL").select(F.col("up").alias(node)).distinct()
    found = closure(nodes, node, parent).where("distance > 0").join(wanted.select(F.col(node).alias("node")), "node")
    return found.select(F.col("ancestor").alias(node)).distinct()


def selected(nodes: DataFrame, chosen: DataFrame, node: str = "id", parent: str = "parent_id") -> DataFrame:
    """The chosen nodes and all below them."""
    return closure(nodes, node, parent).join(chosen.select(F.col(node).alias("ancestor")), "ancestor", "left_semi").select(F.col("node").alias(node)).distinct()


def search(nodes: DataFrame, query: str, node: str = "id", parent: str = "parent_id", title: str = "title") -> DataFrame:
    """Nodes whose title holds the query, whatever the case, with all above and below them."""
    hits = nodes.where(F.contains(F.lower(title), F.lower(F.lit(query)))).select(F.col(node).alias("_hit"))
    reach = closure(nodes, node, parent)
    up = reach.join(hits, reach.node == hits._hit, "left_semi").select(F.col("ancestor").alias(node))
    down = reach.join(hits, reach.ancestor == hits._hit, "left_semi").select(F.col("node").alias(node))
    return nodes.join(up.unionByName(down).distinct(), node, "left_semi")


def crawl(seeds: DataFrame, links: DataFrame, node: str = "id", max_rounds: int = 1000) -> DataFrame:
    """Nodes that can be reached from ``seeds`` over ``links`` (``src, dst``), each with the round it was first met in.

    Raises if nodes are left to go on from after ``max_rounds`` rounds.
    """
    frontier = stage(seeds.select(F.col(node)).distinct().withColumn("round", F.lit(0)), "crawl")
    seen = frontier
    for k in range(1, max_rounds + 1):
        nxt = links.join(frontier.select(F.col(node).alias("src")), "src").select(F.col("dst").alias(node)).distinct()
        nxt = stage(nxt.join(seen.select(node), node, "left_anti").withColumn("round", F.lit(k)), "crawl")
        if nxt.isEmpty():
            break
        frontier, seen = nxt, stage(seen.unionByName(nxt), "crawl")
    else:
        raise RuntimeError(f"the crawl did not end in {max_rounds} rounds")
    return seen


def outline(blocks: DataFrame, page: str, path: str, text: str, indent: str = "    ") -> DataFrame:
    """Blocks of each page as a bullet list; ``path`` is the list of ordinals from the root, which gives order and depth."""
    line = F.concat(F.repeat(F.lit(indent), F.greatest(F.size(path) - 1, F.lit(0))), F.lit("- "), F.regexp_replace(F.coalesce(text, F.lit("")), "\n", "\n  "))
    ordered = F.array_sort(F.collect_list(F.struct(F.col(path).alias("p"), line.alias("line"))))
    return blocks.groupBy(page).agg(F.array_join(F.transform(ordered, lambda x: x["line"]), "\n").alias("markdown"))


def leaf_rows(nodes: DataFrame, node: str = "id", parent: str = "parent_id", title: str = "title", width_of: str | None = None) -> DataFrame:
    """Root-to-leaf titles of every leaf as table cells, padded with empty ones to the widest row."""
    named = closure(nodes, node, parent).join(nodes.select(F.col(node).alias("ancestor"), F.col(title).alias("_t")), "ancestor")
    inner = nodes.select(F.col(parent).alias("node")).where("node IS NOT NULL").distinct()
    cells = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("distance")).alias("d"), "_t"))), lambda x: x["_t"])
    leaves = named.join(inner, "node", "left_anti").groupBy("node").agg(cells.alias("cells"))
    widest = leaves.agg(F.max(F.size("cells")).alias("_w"))
    padded = leaves.join(F.broadcast(widest))
    return padded.select("node", F.concat("cells", F.array_repeat(F.lit(""), F.col("_w") - F.size("cells"))).alias("cells"))
