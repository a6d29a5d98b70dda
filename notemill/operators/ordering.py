"""Names, runs, numbering and merges that depend on order. Order is always a column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def unique_names(rows: DataFrame, folder: str, name: str, ordinal: str, taken: DataFrame | None = None, out: str = "unique_name", extension: str = "") -> DataFrame:
    """Give every row a name of its own in its folder: ``name``, ``name 1``, ``name 2`` ..., whatever the case.

    ``taken`` holds ``folder, name`` that exist already. Rows with one name are
    numbered in the order of ``ordinal``. A numbered name may be another row's
    own name; natural names win: the n-th row of a name takes the n-th number
    that no natural or existing name spells.
    """
    with_ext = lambda n: F.concat(n, F.lit(extension)) if extension else n
    base = rows.withColumn("_key", F.lower(with_ext(F.col(name))))
    rank = F.row_number().over(Window.partitionBy(folder, "_key").orderBy(ordinal)) - 1
    base = base.withColumn("_n", rank)
    if taken is not None:
        used = taken.select(F.col(folder), F.lower(F.col(name)).alias("_key")).distinct().withColumn("_used", F.lit(1))
        base = base.join(used, [folder, "_key"], "left").withColumn("_n", F.col("_n") + F.coalesce("_used", F.lit(0))).drop("_used")
    # A number is free if no natural or existing name of the folder spells it: the n-th row takes the n-th free number.
    # Few names end in a number, and one look at the end tells; only theirs are taken apart.
    keys = rows.select(folder, F.lower(with_ext(F.col(name))).alias("_key"))
    keys = keys if taken is None else keys.unionByName(taken.select(folder, F.lower(F.col(name)).alias("_key")))
    number_at_end = rf" ([1-9][0-9]{{0,8}}){_quoted(extension.lower())}$"
    numbered = keys.where(F.col("_key").rlike(number_at_end)).select(folder, F.regexp_extract("_key", f"(?s)^(.*){number_at_end}", 1).alias("_stem"), F.regexp_extract("_key", number_at_end, 1).cast("int").alias("_num"))
    blocked = numbered.groupBy(folder, F.concat("_stem", F.lit(extension.lower())).alias("_key")).agg(F.array_sort(F.collect_set("_num")).alias("_blocked"))
    base = base.join(blocked, [folder, "_key"], "left")
    shifted = F.aggregate(F.coalesce("_blocked", F.array().cast("array<int>")), F.col("_n"), lambda n, b: F.when(b <= n, n + 1).otherwise(n))
    number = F.when(F.col("_n") == 0, F.col("_n")).otherwise(shifted)
    made = F.when(number == 0, with_ext(F.col(name))).otherwise(with_ext(F.concat_ws(" ", F.col(name), number.cast("string"))))
    return base.withColumn(out, made).select(*rows.columns, out)


def _quoted(extension: str) -> str:
    return extension.replace(".", r"\.")


def ambiguous(rows: DataFrame, name: str, out: str = "is_unique") -> DataFrame:
    """Whether a name, whatever its case, stands once: a short link is enough then."""
    return rows.withColumn(out, F.count("*").over(Window.partitionBy(F.lower(F.col(name)))) == 1)


def collides(rows: DataFrame, name: str, ordinal: str, out: str = "needs_path") -> DataFrame:
    """Whether an earlier row has the same name, whatever its case."""
    return rows.withColumn(out, F.row_number().over(Window.partitionBy(F.lower(F.col(name))).orderBy(ordinal)) > 1)


def _islands(change: Column, order: Window) -> Column:
    return F.sum(F.when(change, 1).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))


def merge_runs(rows: DataFrame, group: str, order: list[str], same: list[str], text: str, sep: str = "") -> DataFrame:
    """Neighbours that agree in ``same`` as one row, their texts joined: ``group, run, same..., text, n``."""
    by = Window.partitionBy(group).orderBy(*order)
    changed = F.lit(False)
    for c in same:
        changed = changed | ~F.col(c).eqNullSafe(F.lag(c).over(by))
    changed = changed | F.row_number().over(by).eqNullSafe(1)
    marked = rows.withColumn("_new", changed).withColumn("run", _islands(F.col("_new"), by))
    parts = F.array_sort(F.collect_list(F.struct(*order, F.coalesce(F.col(text).cast("string"), F.lit("")).alias("_text"))))
    return marked.groupBy(group, "run", *same).agg(F.array_join(F.transform(parts, lambda x: x["_text"]), sep).alias(text), F.count("*").alias("n"))


def number_list(rows: DataFrame, group: str, ordinal: str, level: str, is_item: str, out: str = "number") -> DataFrame:
    """Numbers of ordered list items, per level; a list ends at a row that is no item, at that level or a higher one.

    (The source product goes on counting in a second list of one level; here each list begins with 1.)
    """
    by = Window.partitionBy(group).orderBy(ordinal)
    upto = by.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # A break at level b ends the lists of all levels >= b, an item those of all deeper ones:
    # for each level one running maximum, over as many levels as there are.
    ends = F.when(F.col(is_item), F.col(level) + 1).otherwise(F.col(level))
    last = F.array(*[F.max(F.when(ends <= k, F.col(ordinal))).over(upto) for k in range(_deepest(rows, level) + 1)])
    marked = rows.withColumn("_list", F.coalesce(F.get(last, F.col(level).cast("int")), F.lit(-1)))
    per = Window.partitionBy(group, level, "_list", is_item).orderBy(ordinal)
    return marked.withColumn(out, F.when(F.col(is_item), F.row_number().over(per))).drop("_list")


def _deepest(rows: DataFrame, level: str) -> int:
    """The deepest level in use; levels begin at 0."""
    return max(0, rows.agg(F.max(level).alias("m")).first().m or 0)


def block_spacing(rows: DataFrame, group: str, ordinal: str, type_: str, out: str = "after") -> DataFrame:
    """What follows each block: a line break between items of one kind of list, else an empty line; nothing after the last."""
    nxt = F.lead(type_).over(Window.partitionBy(group).orderBy(ordinal))
    tight = F.col(type_).isin("bulleted_list_item", "numbered_list_item", "to_do") & (nxt == F.col(type_))
    return rows.withColumn(out, F.when(nxt.isNull(), "").when(tight, "\n").otherwise("\n\n"))


def page_paths(rows: DataFrame, group: str, ordinal: str, level: str, title: str, out: str = "path") -> DataFrame:
    """Paths of pages from their indent levels, however deep: the nearest earlier page of each lower level, unless a shallower one came between."""
    by = Window.partitionBy(group).orderBy(ordinal).rowsBetween(Window.unboundedPreceding, -1)
    upto = lambda k: F.last(F.when(F.col(level) <= k, F.struct(F.col(level).alias("l"), F.col(title).alias("t"))), ignorenulls=True).over(by)
    parents = []
    for k in range(_deepest(rows, level)):
        near = upto(k)
        parents.append(F.when((F.col(level) > k) & (near["l"] == k), near["t"]))
    return rows.withColumn(out, F.concat_ws("/", *parents, F.col(title)))


def first_wins(*frames: DataFrame, key: str) -> DataFrame:
    """Union by name; of rows with one key the first frame's stays."""
    out = None
    for k, frame in enumerate(frames):
        marked = frame.withColumn("_from", F.lit(k))
        out = marked if out is None else out.unionByName(marked, allowMissingColumns=True)
    best = Window.partitionBy(key).orderBy("_from")
    return out.withColumn("_n", F.row_number().over(best)).where("_n = 1").drop("_n", "_from")


def merged_views(existing: DataFrame, imported: DataFrame, key: str = "name", value: str = "spec") -> DataFrame:
    """Both sets of views; of one name the imported one."""
    joined = existing.select(key, F.col(value).alias("_old")).join(imported.select(key, F.col(value).alias("_new")), key, "full_outer")
    return joined.select(key, F.coalesce("_new", "_old").alias(value))


def without(rows: DataFrame, skipped: DataFrame, path: str = "path") -> DataFrame:
    """Rows whose path is neither skipped nor below a skipped folder."""
    prefixes = F.transform(F.sequence(F.lit(1), F.size(F.split(path, "/"))), lambda n: F.array_join(F.slice(F.split(path, "/"), F.lit(1), n), "/"))
    # A path has few prefixes: the join is on equal text, where a test of prefixes would compare all pairs.
    every = rows.select(path).distinct().select(F.col(path).alias("_path"), F.explode(prefixes).alias("_prefix"))
    gone = every.join(skipped.select(F.col(path).alias("_prefix")).distinct(), "_prefix").select("_path").distinct()
    return rows.join(gone, F.col(path) == F.col("_path"), "left_anti")


def folders(rows: DataFrame, path: str = "path") -> DataFrame:
    """Distinct folders above all paths."""
    parts = F.split(path, "/")
    above = F.transform(F.filter(F.sequence(F.lit(0), F.size(parts) - 1), lambda n: n > 0), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    return rows.select(F.explode(above).alias("folder")).distinct()
