"""Repeated imports: plan where each note goes, decide what to do with it, and make the next state.

Incoming notes: ``folder, title, source_id, mtime, content, ordinal``. State:
``path, source_id, mtime, content``. The state is a table that is written anew
each time, so a failed run leaves the former one as it was.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from notemill.functions.text import file_name
from notemill.operators.ordering import unique_names
from notemill.staging import stage

#: What to do with a note that was imported before.
MODES = ("update", "skip", "copy")
#: Dispositions that write, and the outcome that each disposition is reported as.
WRITES = ("create", "copy", "update")
OUTCOMES = {"create": "created", "copy": "created", "update": "updated", "skip": "skipped", "unchanged": "unchanged", "preserve": "preserved"}


def compared(kept: Column, source: Column) -> Column:
    """An equal time is untouched since, a later one was edited by the user, an earlier one is out of date."""
    return F.when(kept == source, "unchanged").when(kept > source, "preserve").otherwise("update")


def disposition(mode: str, matched: Column, path: Column, desired: Column, kept: Column, source: Column, equal: Column) -> Column:
    """What to do with a planned note; without a source time, equal contents are unchanged and others updated."""
    if mode == "copy":
        return F.when(path != desired, "copy").otherwise("create")
    known = F.lit("skip") if mode == "skip" else F.when(source.isNull(), F.when(equal, "unchanged").otherwise("update")).otherwise(compared(kept, source))
    return F.when(matched, known).otherwise("create")


def imported_index(state: DataFrame) -> DataFrame:
    """The note that each source id was last imported to; of several, the first path."""
    return state.where(F.col("source_id").isNotNull()).groupBy(F.col("source_id").alias("_id")).agg(F.min("path").alias("_by_id"))


def plan(incoming: DataFrame, state: DataFrame, mode: str = "update") -> DataFrame:
    """Incoming notes with ``desired_path, path, disposition``.

    A note matches by source id, then by path (any case), unless the note there
    belongs to another id. Each note of the state is taken once, by the first
    that asks for it; all others get a free name of their own. The decision needs
    only paths, times and content hashes, so contents are not shuffled with the names;
    a state that has a column ``hash`` (SHA-256 of the content) is not asked for contents.
    """
    if mode not in MODES:
        raise ValueError(f"mode is one of {MODES}")
    parent = F.nullif(F.col("folder"), F.lit(""))
    name = F.concat(F.regexp_replace(file_name(F.col("title")), r"(?i)\.md$", ""), F.lit(".md"))
    notes = incoming.withColumn("desired_path", F.concat_ws("/", parent, name)).withColumn("_hash", F.when(F.col("mtime").isNull(), F.sha2("content", 256)))  # asked for only without a time
    held = state.select(F.col("path").alias("_path"), F.col("source_id").alias("_owner"), F.col("mtime").alias("_kept"), (F.col("hash") if "hash" in state.columns else F.sha2("content", 256)).alias("_held"))
    light = notes.drop("content")
    none = F.lit(None).cast("string")
    if mode == "copy":
        wanted = stage(light.withColumn("_want", none), "plan")
        matched = wanted.withColumn("_match", none)
    else:
        found = light.join(imported_index(state), light.source_id == F.col("_id"), "left")
        by_path = held.groupBy(F.lower("_path").alias("_key")).agg(F.min_by("_path", "_path").alias("_at"), F.min_by("_owner", "_path").alias("_at_owner"))
        found = found.join(by_path, F.lower("desired_path") == F.col("_key"), "left")
        foreign = F.col("_at_owner").isNotNull() & F.col("source_id").isNotNull() & (F.col("_at_owner") != F.col("source_id"))
        wanted = stage(found.withColumn("_want", F.coalesce("_by_id", F.when(~foreign, F.col("_at")))).select(*light.columns, "_by_id", "_want"), "plan")
        # A match by id goes before one by path; then the order of arrival decides. Notes
        # that want none, on a first import all, take no turn.
        turn = Window.partitionBy("_want").orderBy(F.col("_by_id").isNull(), "ordinal")
        asking = wanted.where("_want IS NOT NULL").withColumn("_match", F.when(F.row_number().over(turn) == 1, F.col("_want")))
        matched = wanted.where("_want IS NULL").withColumn("_match", none).unionByName(asking).drop("_by_id")
    matched = matched.drop("_want")
    fresh = matched.where("_match IS NULL").withColumn("_folder", F.coalesce("folder", F.lit(""))).withColumn("_stem", F.regexp_replace(F.substring_index("desired_path", "/", -1), r"\.md$", ""))
    taken = held.select(F.regexp_extract("_path", r"^(.*)/[^/]*$", 1).alias("_folder"), F.substring_index("_path", "/", -1).alias("_stem"))
    named = unique_names(fresh, "_folder", "_stem", "ordinal", taken, out="_name", extension=".md")
    named = named.withColumn("path", F.concat_ws("/", F.nullif("_folder", F.lit("")), F.col("_name"))).drop("_folder", "_stem", "_name")
    # New notes match no row of the state and stay out of the join, where they would all have one key.
    known = matched.where("_match IS NOT NULL").withColumn("path", F.col("_match")).join(held, F.col("_match") == F.col("_path"), "left")
    every = named.unionByName(known, allowMissingColumns=True)
    how = disposition(mode, F.col("_match").isNotNull(), F.col("path"), F.col("desired_path"), F.col("_kept"), F.col("mtime"), F.col("_held") == F.col("_hash"))
    return every.withColumn("disposition", how).drop("_match", "_path", "_owner", "_kept", "_held", "_hash").withColumn("outcome", _outcome())


def _outcome() -> Column:
    pairs = [F.lit(x) for pair in OUTCOMES.items() for x in pair]
    return F.try_element_at(F.create_map(*pairs), F.col("disposition"))


def written(planned: DataFrame) -> DataFrame:
    """The planned notes that are written."""
    return planned.where(F.col("disposition").isin(*WRITES))


def applied(planned: DataFrame, incoming: DataFrame, state: DataFrame) -> DataFrame:
    """The next state: planned writes over the former notes."""
    writes = written(planned).select("path", "ordinal")
    new = incoming.join(writes, "ordinal").select("path", "source_id", "mtime", "content")
    return state.select("path", "source_id", "mtime", "content").join(writes.select("path"), "path", "left_anti").unionByName(new)


def report(planned: DataFrame) -> DataFrame:
    """Notes by outcome."""
    return planned.groupBy("outcome").agg(F.count("*").alias("n"))


def attachment_verdict(found: DataFrame, placed: DataFrame) -> DataFrame:
    """Whether the file at an attachment's place is the ``same``, ``stale`` (same name, other content) or absent (``new``).

    ``found``: ``path, size, digest``; ``placed``: the same of what is there.
    """
    there = placed.select("path", F.col("size").alias("_size"), F.col("digest").alias("_digest"))
    verdict = F.when(F.col("_size").isNull(), "new").when((F.col("size") == F.col("_size")) & (F.col("digest") == F.col("_digest")), "same").otherwise("stale")
    return found.join(there, "path", "left").withColumn("verdict", verdict).drop("_size", "_digest")


def attachment_folder(mode: str, vault: str, note_folder: Column, sub: str = "attachments") -> Column:
    """Where attachments go: the vault's root, one folder, beside the note, or a folder below it."""
    return {"vault": F.lit(""), "folder": F.lit(vault), "note": note_folder, "subfolder": F.concat_ws("/", F.nullif(note_folder, F.lit("")), F.lit(sub))}[mode]


def shared_blocks(copies: DataFrame, block: str = "block_id", source: str = "synced_from") -> DataFrame:
    """Add ``shared_id``: the original of each copied block; one note is made per original."""
    return copies.withColumn("shared_id", F.coalesce(source, block))


def write_notes(planned: DataFrame, incoming: DataFrame, folder: str) -> None:
    """Write planned notes as text tables, one folder of files per outcome (``create``, ``copy``, ``update``)."""
    rows = incoming.join(written(planned).select("ordinal", "path", "disposition"), "ordinal")
    rows.select("path", "content", "disposition").write.mode("overwrite").partitionBy("disposition").parquet(folder)


def new_types(known: DataFrame, found: DataFrame) -> DataFrame:
    """Property types to add: those without one keep what they have."""
    return found.join(known, "name", "left_anti")
