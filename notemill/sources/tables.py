"""Table, note and outline exports as typed tables."""

from __future__ import annotations

import sqlite3
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from notemill.functions.text import dashed_tag
from notemill.staging import stage

# --- CSV -----------------------------------------------------------------------


def read_csv(spark: SparkSession, path: str, header: bool = True) -> DataFrame:
    """A CSV export: all columns text, values trimmed, missing ones empty.

    Without a header the columns are ``Column 1`` ... Quotes are doubled inside
    quotes, and a quoted value may span lines.
    """
    rows = spark.read.csv(
        path, header=header, multiLine=True, quote='"', escape='"', ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True, inferSchema=False, enforceSchema=False
    )
    if not header:
        rows = rows.toDF(*[f"Column {i + 1}" for i in range(len(rows.columns))])
    return rows.select(*[F.coalesce(F.trim(F.col(f"`{c}`")), F.lit("")).alias(c.strip()) for c in rows.columns])


# --- JSON notes ----------------------------------------------------------------

KEEP = T.StructType([
    T.StructField("title", T.StringType()), T.StructField("textContent", T.StringType()), T.StructField("color", T.StringType()),
    *[T.StructField(n, T.BooleanType()) for n in ("isArchived", "isPinned", "isTrashed")],
    *[T.StructField(n, T.LongType()) for n in ("createdTimestampUsec", "userEditedTimestampUsec")],
    T.StructField("listContent", T.ArrayType(T.StructType([T.StructField("text", T.StringType()), T.StructField("isChecked", T.BooleanType())]))),
    T.StructField("attachments", T.ArrayType(T.StructType([T.StructField("filePath", T.StringType()), T.StructField("mimetype", T.StringType())]))),
    T.StructField("labels", T.ArrayType(T.StructType([T.StructField("name", T.StringType())]))),
])


def keep_notes(files: DataFrame, text: str = "text") -> DataFrame:
    """Notes from JSON text, with ``valid``: false where it is no note, so that a caller can report it."""
    note = F.from_json(text, KEEP)
    rows = files.withColumn("note", note)
    valid = F.col("note").isNotNull() & F.col("note.userEditedTimestampUsec").isNotNull() & F.col("note.createdTimestampUsec").isNotNull()
    return rows.withColumn("valid", F.coalesce(valid, F.lit(False)))


def keep_selected(notes: DataFrame, archived: bool = False, trashed: bool = False) -> DataFrame:
    rows = notes.where("valid")
    rows = rows if archived else rows.where(~F.coalesce("note.isArchived", F.lit(False)))
    return rows if trashed else rows.where(~F.coalesce("note.isTrashed", F.lit(False)))


def keep_tags(note: str = "note"):
    """Tags of a note: its colour, pin, attachments, state and labels."""
    at = lambda f: F.col(f"{note}.{f}")
    sentence = F.concat(F.upper(F.left(at("color"), F.lit(1))), F.lower(F.substring(at("color"), 2, 1000)))
    own = F.array(
        F.when(at("color").isNotNull() & ~at("color").isin("", "DEFAULT"), F.concat(F.lit("Keep/Color/"), sentence)), F.when(at("isPinned"), "Keep/Pinned"),
        F.when(at("attachments").isNotNull(), "Keep/Attachment"), F.when(at("isArchived"), "Keep/Archived"), F.when(at("isTrashed"), "Keep/Deleted"),
    )
    labels = F.transform(F.coalesce(at("labels"), F.array().cast("array<struct<name:string>>")), lambda x: F.concat(F.lit("Keep/Label/"), x["name"]))
    return F.transform(F.array_compact(F.concat(own, labels)), dashed_tag)


def keep_body(note: str = "note"):
    """A note's text, check list and attachments as Markdown."""
    from notemill.functions.text import clean_tags

    at = lambda f: F.col(f"{note}.{f}")
    box = lambda x: F.concat(F.lit("- ["), F.when(x["isChecked"], "X").otherwise(" "), F.lit("] "), x["text"])
    items = F.transform(F.filter(at("listContent"), lambda x: x["text"].isNotNull() & (x["text"] != "")), lambda x: clean_tags(box(x)))
    files = F.transform(at("attachments"), lambda x: F.concat(F.lit("![["), x["filePath"], F.lit("]]")))
    text = F.when(at("textContent") != "", F.concat(F.lit("\n"), clean_tags(at("textContent"))))
    return F.concat_ws("", text, F.when(at("listContent").isNotNull(), F.concat(F.lit("\n\n"), F.array_join(items, "\n"))), F.when(at("attachments").isNotNull(), F.concat(F.lit("\n\n"), F.array_join(files, ""))))


_BLOCK = "string string, uid string, heading bigint, children array<string>"


def outline_blocks(spark: SparkSession, path: str) -> DataFrame:
    """An outliner's JSON graph as ``page, uid, parent_uid, path, text, heading``; ``path`` is the ordinals from the page down.

    Children are kept as JSON text and read one level at a time, until no block has any.
    """
    files = spark.read.format("binaryFile").load(path).select("content")
    wide = F.hex(F.substring("content", 1, 2)).isin("FFFE", "FEFF")
    text = F.when(wide, F.decode("content", "UTF-16")).otherwise(F.regexp_replace(F.col("content").cast("string"), "^\ufeff", ""))
    # The reader of JSON files opens the file again for each value that is kept as text; from text in memory it is cut out.
    level = files.select(F.inline(F.from_json(text, "array<struct<title:string, uid:string, children:array<string>>>")))
    level = level.select(F.col("title").alias("page"), F.col("uid").alias("parent_uid"), F.array().cast("array<int>").alias("path"), "children")
    columns = "page", "uid", "parent_uid", "path", "text", "heading"
    out = None
    while True:
        rows = level.select("page", "parent_uid", "path", F.posexplode("children").alias("i", "b")).withColumn("b", F.from_json("b", _BLOCK))
        rows = rows.select("page", F.col("b.uid").alias("uid"), "parent_uid", F.concat("path", F.array("i")).alias("path"), F.col("b.string").alias("text"), F.col("b.heading").alias("heading"), F.col("b.children").alias("children"))
        rows = stage(rows, "outline")
        out = rows.select(*columns) if out is None else out.unionByName(rows.select(*columns))
        level = rows.where(F.size("children") > 0).select("page", F.col("uid").alias("parent_uid"), "path", "children")
        if level.isEmpty():
            return out


# --- XML notes -----------------------------------------------------------------

# Elements of the export and their attributes.
NOTE_XML = (
    "title string, content string, created string, updated string, tag array<string>, "
    "`note-attributes` struct<`source-url`:string, source:string, `source-application`:string, `reminder-time`:string, `reminder-done-time`:string>, "
    "resource array<struct<data:string, mime:string, recognition:string, `resource-attributes`:struct<`file-name`:string, timestamp:string>>>, "
    "task array<struct<title:string, taskStatus:string, taskFlag:boolean, sortWeight:string, noteLevelID:string, taskGroupNoteLevelID:string, dueDate:string, reminder:struct<reminderDate:string>>>"
)


def xml_notes(spark: SparkSession, path: str) -> DataFrame:
    """Notes of an XML export; elements that may repeat are always lists."""
    rows = spark.read.format("xml").option("rowTag", "note").option("ignoreNamespace", "true").schema(NOTE_XML).load(path)
    stamp = lambda c: F.try_to_timestamp(F.col(c), F.lit("yyyyMMdd'T'HHmmssX"))
    return rows.withColumn("created", stamp("created")).withColumn("updated", stamp("updated"))


# What marks a note as clipped from a web page, by attribute.
CLIPS = {"source-application": "webclipper.evernote", "source": "web.clip7"}


def without_clips(notes: DataFrame) -> DataFrame:
    """Notes that were not clipped from a web page: neither attribute has the clipper's value."""
    for attribute, value in CLIPS.items():
        notes = notes.where(~F.coalesce(F.col("note-attributes")[attribute] == value, F.lit(False)))
    return notes


# --- SQLite --------------------------------------------------------------------


class _Range(InputPartition):
    def __init__(self, low: int | None, high: int | None):
        self.low, self.high = low, high


_SQLITE = {"INT": "bigint", "CHAR": "string", "TEXT": "string", "CLOB": "string", "BLOB": "binary", "REAL": "double", "FLOA": "double", "DOUB": "double", "TIMESTAMP": "double"}


class SqliteSource(DataSource):
    """``spark.read.format("sqlite").option("path", ...).option("table", ...).option("partitions", n)``: a table of a database file on a mounted path."""

    @classmethod
    def name(cls) -> str:
        return "sqlite"

    def _open(self):
        return sqlite3.connect(f"file:{self.options['path']}?mode=ro", uri=True)

    def schema(self) -> str:
        with self._open() as db:
            columns = db.execute(f"PRAGMA table_info({_quoted(self.options['table'])})").fetchall()
        kind = lambda t: next((s for k, s in _SQLITE.items() if k in t.upper()), "double" if t else "binary")
        return ", ".join(f"`{c[1].lower()}` {kind(c[2])}" for c in columns)

    def reader(self, schema) -> DataSourceReader:
        return _SqliteReader(self.options, schema)


def _quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


class _SqliteReader(DataSourceReader):
    """Reads ranges of row ids side by side."""

    def __init__(self, options: dict, schema: T.StructType):
        self.path, self.table, self.n = options["path"], options["table"], int(options.get("partitions", "1"))
        self.columns = schema.names

    def partitions(self) -> list[_Range]:
        with sqlite3.connect(f"file:{self.path}?mode=ro", uri=True) as db:
            low, high = db.execute(f"SELECT min(rowid), max(rowid) FROM {_quoted(self.table)}").fetchone()
        if low is None:
            return [_Range(None, None)]
        edges = [low + (high + 1 - low) * k // self.n for k in range(self.n + 1)]
        return [_Range(a, b) for a, b in zip(edges, edges[1:]) if a < b]

    def read(self, partition: _Range) -> Iterator[tuple]:
        if partition.low is None:
            return
        wanted = ", ".join(map(_quoted, self.columns))
        with sqlite3.connect(f"file:{self.path}?mode=ro", uri=True) as db:
            yield from db.execute(f"SELECT {wanted} FROM {_quoted(self.table)} WHERE rowid >= ? AND rowid < ?", (partition.low, partition.high))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(SqliteSource)
