"""Outlines as prose: which blocks read as lists, decided over all pages at once by relations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from notemill.operators.trees import _pointers, _rolled_up, pulled_down
from notemill.staging import Scratch, stage

# How a heading and a task begin.
HEADING, TASK = r"^#{1,6}\s+\S", r"^\[.\]\s"


def continued(text: Column, pad: Column) -> Column:
    """``text`` with ``pad`` before its later lines; empty ones get it only between code fences."""
    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit(False).alias("fenced"))

    def add(done: Column, line: Column) -> Column:
        padded = F.when(F.size(done["out"]) == 0, line).when((line != "") | done["fenced"], F.concat(pad, line)).otherwise(line)
        return F.struct(F.concat(done["out"], F.array(padded)).alias("out"), (done["fenced"] != line.rlike(r"^\s*```")).alias("fenced"))

    lines = F.aggregate(F.split(text, "\n"), start, add, lambda done: F.array_join(done["out"], "\n"))
    return F.when(F.contains(text, F.lit("\n")), lines).otherwise(text)


def shaped(blocks: DataFrame) -> DataFrame:
    """Add ``up``, ``item`` and ``in_list`` to blocks (``node``, ``parent``, ``says``, ``task``, ``heading``), staged.

    A block is an item unless it, or a block below it with no task between or above, is a heading or has
    no text. ``in_list``: whether it is one of several siblings that all are items, below a block with text.
    """
    keep = Scratch()
    linked = keep(blocks.join(_pointers(blocks, "node", "parent"), "node"), "linked")
    above = linked.select(F.col("node").alias("up"), F.col("task").alias("under_task"), F.col("says").isNotNull().alias("under_text"))
    linked = keep(linked.join(above, "up", "left"), "linked")
    # What is no item spreads upward as far as the first task.
    spoils = (F.col("says").isNull() | F.col("heading")).cast("int")
    begin = linked.select("node", F.when(~F.col("under_task"), F.col("up")).alias("up"), spoils.alias("v"))
    spoilt = _rolled_up(begin, F.max("v"), F.greatest)
    if spoilt is None:
        raise ValueError("the blocks above each other form a cycle")
    known = keep(linked.join(spoilt, "node").withColumn("item", F.col("v") == 0).drop("v"), "known")
    groups = known.where("up IS NOT NULL").groupBy("up").agg(((F.count("*") > 1) & F.bool_and("item")).alias("all_items"))
    out = stage(known.join(groups, "up", "left").withColumn("in_list", F.coalesce(F.col("all_items") & F.col("under_text"), F.lit(False))).drop("all_items", "under_task", "under_text"), "shaped")
    keep.clear()
    return out


def prose(blocks: DataFrame, page: str = "page", path: str = "path", text: str = "text", anchor: str | None = None) -> DataFrame:
    """``page, markdown``: outline blocks as prose; siblings that read as items below a block become a list, tasks always do.

    ``path`` is a block's list of ordinals from the page down; a block with a null text stands for
    its children, and one whose parent is missing stands at the top. ``anchor`` names a column of
    block ids to be put behind the text. Two facts decide a block's place: whether it is an item
    (spread upward in rounds of doubled pointers), and the highest block above it, itself
    included, that begins a list (spread downward likewise). So no page is walked by one task; only
    its finished pieces are put together in their order.
    """
    whole = blocks.select(
        F.struct(F.col(page).alias("page"), F.col(path).alias("at")).alias("node"), F.col(page).alias("_page"), F.col(path).alias("at"),
        F.when(F.size(path) > 1, F.struct(F.col(page).alias("page"), F.slice(path, F.lit(1), F.size(path) - 1).alias("at"))).alias("parent"), F.col(text).alias("says"),
        (F.col(anchor) if anchor else F.lit(None)).cast("string").alias("anchor"),
        F.coalesce(F.col(text).rlike(TASK), F.lit(False)).alias("task"), F.coalesce(F.col(text).rlike(HEADING), F.lit(False)).alias("heading"),
    )
    keep = Scratch()
    known = shaped(keep(whole, "blocks"))
    keep.frames.append(known)
    begins = F.when(F.col("task") | F.col("in_list"), F.struct(F.size("at").alias("depth"), "at"))
    first = pulled_down(known.select("node", "up", begins.alias("v")), lambda own, above: F.least(own, above))
    keep.frames.append(first)
    before = F.lag("task").over(Window.partitionBy("_page", "up").orderBy("at"))
    rows = known.withColumn("before", before).join(first.withColumnRenamed("v", "top"), "node")
    # A list begins with the first of such siblings, or with a task that follows none.
    head = (F.col("top.at") == F.col("at")) & F.when(F.col("in_list"), F.col("before").isNull()).otherwise(~F.coalesce("before", F.lit(False)))
    pad = F.when(F.col("top").isNotNull(), F.repeat(F.lit("    "), F.size("at") - F.col("top.depth")))
    inner = F.coalesce(F.concat(pad, F.lit("  ")), F.lit(""))
    body = continued(F.coalesce("says", F.lit("")), inner)
    mark = F.when(F.contains(body, F.lit("\n")), F.concat(F.lit("\n"), inner, F.lit("^"), "anchor")).otherwise(F.concat(F.lit(" ^"), "anchor"))
    said = F.concat(body, F.coalesce(mark, F.lit("")))
    piece = F.when(F.col("top").isNotNull(), F.concat(F.when(head, "\n\n").otherwise("\n"), pad, F.lit("- "), said)).when(F.col("says") != "", F.concat(F.lit("\n\n"), said))
    pieces = F.array_sort(F.collect_list(F.when(piece.isNotNull(), F.struct("at", piece.alias("piece")))))
    made = rows.groupBy("_page").agg(F.substring(F.array_join(F.transform(pieces, lambda p: p["piece"]), ""), 3, 2**31 - 1).alias("markdown"))
    out = stage(made.select(F.col("_page").alias(page), "markdown"), "prose")
    keep.clear()
    return out
