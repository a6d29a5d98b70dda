"""Links between records, as joins on ids before anything is rendered."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from notemill.functions.text import file_name, wiki_link


def edges(records: DataFrame, record: str, links: str) -> DataFrame:
    """``record, pos, target``: a row per link, and one with a null target for a record without links."""
    return records.select(record, F.posexplode_outer(links).alias("pos", "target"))


def resolve_links(links: DataFrame, notes: DataFrame, titles: DataFrame | None = None, target: str = "target") -> DataFrame:
    """Add ``link``: a note link if the target was imported, else its title, else that it is unknown; null without a target.

    ``notes`` has ``target`` and ``path``; ``titles``, of targets read for their
    titles only, ``target`` and ``title``.
    """
    found = links.join(notes.select(target, "path"), target, "left")
    title = F.lit(None).cast("string")
    if titles is not None:
        found = found.join(titles.select(target, "title"), target, "left")
        title = F.col("title")
    link = F.coalesce(wiki_link(F.col("path")), F.when(title != "", file_name(title)), F.concat(F.lit("Unknown record "), F.col(target)))
    return found.select(*links.columns, link.alias("link"))


def gathered(links: DataFrame, record: str, value: str = "link", sep: str | None = None) -> DataFrame:
    """The values of each record's links in order, as a list, or as text with ``sep``; records without links have an empty list."""
    ordered = F.transform(F.array_sort(F.collect_list(F.when(F.col("target").isNotNull(), F.struct("pos", F.col(value).alias("v"))))), lambda x: x["v"])
    return links.groupBy(record).agg((ordered if sep is None else F.array_join(ordered, sep)).alias(value))


def lookup(links: DataFrame, targets: DataFrame, record: str, value: str, sep: str | None = None) -> DataFrame:
    """Values of a field of the linked records, in link order; links to nothing have none."""
    joined = links.join(targets.select("target", value), "target", "left")
    return gathered(joined, record, value, sep)


def missing_targets(links: DataFrame, known: DataFrame, target: str = "target") -> DataFrame:
    """Distinct targets that are linked but not among the known ones."""
    return links.where(F.col(target).isNotNull()).select(target).distinct().join(known.select(target), target, "left_anti")


def view_memberships(record_view: DataFrame, views: DataFrame, record: str = "record_id", view: str = "view_id", token: str = "token") -> DataFrame:
    """The tokens of the views that show each record, in the views' order, without those that show every record."""
    return (
        record_view.join(views.select(view, token, "ordinal"), view)
        .groupBy(record)
        .agg(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", token))), lambda x: x[token]).alias("views"))
    )


def views_showing_all(record_view: DataFrame, records: DataFrame, view: str = "view_id", record: str = "record_id", table: str = "table_id", empty: str = "is_empty") -> DataFrame:
    """Views that show as many non-empty records as their table has: a filter on them is redundant."""
    filled = records.where(~F.col(empty)).select(record, table)
    totals = filled.groupBy(table).agg(F.count("*").alias("in_table"))
    shown = record_view.join(filled, record).groupBy(view, table).agg(F.count("*").alias("shown"))
    return shown.join(totals, table).where("shown = in_table").select(view, table)


def discovered(found: DataFrame, item: str = "id", parent: str = "parent_id", parent_type: str = "parent_type", most: int = 10_000) -> DataFrame:
    """Search results without those that hang on a block, and without children of those.

    Parents of more than ``most`` items (all top pages name their workspace) are looked up
    once, in a small table, so that no task gets all items of one.
    """
    dropped = found.where(F.col(parent_type) == "block_id").select(item)
    kept = found.join(dropped, item, "left_anti")
    named = found.select(F.col(parent).alias("_parent"), F.lit(1).alias("_n"), F.lit(False).alias("_gone"))
    every = named.unionByName(dropped.select(F.col(item).alias("_parent"), F.lit(0).alias("_n"), F.lit(True).alias("_gone")))
    common = every.groupBy("_parent").agg(F.sum("_n").alias("_n"), F.bool_or("_gone").alias("_gone")).where(F.col("_n") > most).select("_parent", "_gone")
    marked = kept.join(F.broadcast(common), F.col(parent) == F.col("_parent"), "left").where(~F.coalesce("_gone", F.lit(False)))
    # The others ask for their parent; items whose parent is known or that have none go by their own id, which is not among the dropped ones.
    asked = marked.withColumn("_asked", F.coalesce(F.when(F.col("_gone").isNull(), F.col(parent)), F.col(item)))
    return asked.join(dropped.select(F.col(item).alias("_asked")), "_asked", "left_anti").select(*found.columns)


def defined_and_mentioned(defined: DataFrame, mentioned: DataFrame, block: str = "block_id") -> DataFrame:
    """Blocks that have a place and that some text refers to: those that need an anchor."""
    return defined.join(mentioned.select(block).distinct(), block)


def unique_titles(notes: DataFrame, title: str = "title", path: str = "path") -> DataFrame:
    """``title, path`` with a null path where several notes have the title: such a link is ambiguous."""
    return notes.groupBy(title).agg(F.when(F.count("*") == 1, F.min(path)).alias(path))


def replace_all(text: Column, pairs: Column) -> Column:
    """Replace each ``from`` by its ``to`` in one pass from the left: at each place the longest that fits.

    What is put in is never searched again, so one key's text may hold another key. Of equal keys
    the first pair counts. Time grows with the text and the keys, not with their product.
    """

    @F.pandas_udf("string")
    def run(texts: pd.Series, old: pd.Series, new: pd.Series) -> pd.Series:
        return pd.Series([_replaced(*row) for row in zip(texts, old, new)])

    # Two lists reach the task more cheaply than a list of pairs.
    return run(text, F.transform(pairs, lambda p: p["from"]), F.transform(pairs, lambda p: p["to"]))


def _replaced(text: str | None, keys: list | None, values: list | None) -> str | None:
    known, sizes = {}, {}
    if text is None or keys is None:
        return text
    for old, new in zip(keys, values):
        if old and old not in known:
            known[old] = new
            sizes.setdefault(old[0], set()).add(len(old))
    longest = {first: sorted(own, reverse=True) for first, own in sizes.items()}
    out, begin, at = [], 0, 0
    while at < len(text):
        hit = next((n for n in longest.get(text[at], ()) if text[at : at + n] in known), 0)
        if hit:
            out += [text[begin:at], known[text[at : at + hit]] or ""]
            begin = at + hit
        at += hit or 1
    return "".join([*out, text[begin:]])


def rewrite_mentions(notes: DataFrame, targets: DataFrame, note: str, text: str, pattern: str, fallback: str = "Untitled") -> DataFrame:
    """Replace every mention that ``pattern`` matches (its group 1 the target's id) by a link.

    ``targets`` has ``target`` and ``path``. Mentions of unknown targets become
    ``fallback`` with the id. One join on ids; texts without mentions stay out of it.
    Mentions are rows with their place, so each is replaced where it stands, once,
    and a link that reads like a mention stays.
    """
    which = [F.col(note).alias("_note"), F.xxhash64(text).alias("_text")]
    found = notes.select(*which, F.posexplode(F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(0))).alias("_at", "_from")).distinct()
    found = found.withColumn("target", F.regexp_extract("_from", pattern, 1)).join(targets.select("target", "path"), "target", "left")
    to = F.coalesce(wiki_link(F.col("path")), F.concat(F.lit(f"{fallback} "), F.col("target")))
    links = found.groupBy("_note", "_text").agg(F.transform(F.array_sort(F.collect_list(F.struct("_at", to.alias("to")))), lambda x: x["to"]).alias("_links"))
    joined = notes.join(links, (F.col(note) == F.col("_note")) & (F.xxhash64(text) == F.col("_text")), "left")
    spliced = F.array_join(F.zip_with(F.split(text, pattern, -1), "_links", lambda between, link: F.concat(between, F.coalesce(link, F.lit("")))), "")
    return joined.withColumn(text, F.when(F.col("_links").isNull(), F.col(text)).otherwise(spliced)).select(*notes.columns)


def resolve_paths(links: DataFrame, files: DataFrame, link: str = "href", source_folder: str = "folder") -> DataFrame:
    """Add ``path``: the imported file that a relative link means.

    Tried in turn: beside the source, from the root, and either with ``.md`` or
    ``.html``; case counts only where several files differ by it alone.
    """
    from notemill.functions.text import normal_path

    clean = F.regexp_replace(F.try_url_decode(F.col(link)), r"[?#].*$", "")
    bases = F.array(F.concat_ws("/", F.nullif(F.col(source_folder), F.lit("")), clean), F.regexp_replace(clean, "^/+", ""))
    options = F.flatten(F.transform(bases, lambda b: F.array(b, F.concat(b, F.lit(".md")), F.concat(b, F.lit(".html")))))
    key = [source_folder, link]
    tried = links.select(*key).distinct().select(*key, F.posexplode(options).alias("_try", "_at")).withColumn("_at", normal_path(F.col("_at")))
    own = files.select("path", F.lower("path").alias("_key"), F.count("*").over(Window.partitionBy(F.lower("path"))).alias("_n"))
    hits = tried.withColumn("_key", F.lower("_at")).join(own, "_key").where((F.col("_at") == F.col("path")) | (F.col("_n") == 1))
    order = F.struct("_try", (F.col("_at") != F.col("path")).alias("inexact"), "path")
    best = hits.groupBy(F.col(source_folder).alias("_folder"), F.col(link).alias("_href")).agg(F.min_by("path", order).alias("path"))
    found = links.join(best, F.col(source_folder).eqNullSafe(F.col("_folder")) & F.col(link).eqNullSafe(F.col("_href")), "left")
    return found.select(*links.columns, "path")


def attachment_paths(attachments: DataFrame, placed: DataFrame, name: str = "name") -> DataFrame:
    """Output path of each attachment: by its full name, else by its base name if only one file has it, else its own name."""
    base = F.substring_index(F.col(name), "/", -1)
    by_base = placed.groupBy(F.substring_index("name", "/", -1).alias("_base")).agg(F.when(F.count("*") == 1, F.min("path")).alias("_by_base"))
    by_name = placed.select(F.col("name").alias("_name"), F.col("path").alias("_by_name"))
    found = attachments.withColumn("_base", base).join(by_name, F.col(name) == F.col("_name"), "left").join(by_base, "_base", "left")
    return found.select(*attachments.columns, F.coalesce("_by_name", "_by_base", name).alias("path"))


def resources_by_hash(resources: DataFrame, mentions: DataFrame, data: str = "data", hash_: str = "hash") -> DataFrame:
    """Resources of notes joined to where their MD5 is mentioned; ``data`` is Base64 text."""
    hashed = resources.withColumn(hash_, F.md5(F.try_to_binary(F.regexp_replace(data, r"\s+", ""), F.lit("base64"))))
    return mentions.join(hashed, hash_, "left")


def task_groups(tasks: DataFrame, group: str = "group_id", weight: str = "sort_weight", line: str = "line", seen: str = "ordinal") -> DataFrame:
    """Tasks of each group as text, a line each, by weight; of equal weights the last one seen stays."""
    last = tasks.groupBy(group, weight).agg(F.max_by(line, seen).alias(line))
    ordered = F.array_sort(F.collect_list(F.struct(weight, line)))
    return last.groupBy(group).agg(F.array_join(F.transform(ordered, lambda x: x[line]), "\n").alias("text"))
