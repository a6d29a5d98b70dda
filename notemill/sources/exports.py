"""Exports of table bases, page workspaces and folders of notes as normalised tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from notemill.functions.values import field_value

_BASE = (
    "tables array<struct<id:string, name:string, primaryFieldId:string, fields:array<struct<id:string, name:string, type:string, options:string>>, "
    "views:array<struct<id:string, name:string, type:string, visibleFieldIds:array<string>>>, records:array<struct<id:string, createdTime:string, fields:map<string,string>>>>>, "
    "viewRecords map<string,array<string>>"
)
#: Types of views that can be taken over; the others are drawn from more than their records.
RECORD_VIEWS = ("grid", "gallery", "list")


@dataclass
class TableExport:
    """A base: ``tables``, ``fields``, ``views``, ``records`` (a map of field name to JSON text) and ``record_view``."""

    tables: DataFrame
    fields: DataFrame
    views: DataFrame
    records: DataFrame
    record_view: DataFrame

    def typed(self, table_id: str, schema: dict[str, str]) -> DataFrame:
        """Records of one table with a typed column per field (name to field type)."""
        own = self.records.where(F.col("table_id") == table_id)
        return own.select("record_id", "created_time", *[field_value(F.col("fields")[n], kind).alias(n) for n, kind in schema.items()])

    def empty_records(self) -> DataFrame:
        """``record_id, table_id, is_empty``: whether every field is blank."""
        filled = F.filter(F.map_values("fields"), lambda v: v.isNotNull() & (F.trim(v) != "") & ~v.isin("[]", "null", '""'))
        return self.records.select("record_id", "table_id", (F.coalesce(F.size(filled), F.lit(0)) <= 0).alias("is_empty"))


def table_export(spark: SparkSession, path: str) -> TableExport:
    """A base recorded as JSON files of ``tables`` (schema and records) and ``viewRecords`` (ids by view)."""
    base = spark.read.schema(_BASE).option("multiLine", "true").json(path)
    t = base.select(F.explode("tables").alias("t"))
    tables = t.select(F.col("t.id").alias("table_id"), "t.name", F.col("t.primaryFieldId").alias("primary_field_id"))
    fields = t.select(F.col("t.id").alias("table_id"), F.posexplode("t.fields").alias("ordinal", "f")).select("table_id", "ordinal", F.col("f.id").alias("field_id"), "f.name", "f.type", "f.options")
    views = t.select(F.col("t.id").alias("table_id"), F.posexplode("t.views").alias("ordinal", "v")).select("table_id", "ordinal", F.col("v.id").alias("view_id"), "v.name", "v.type", F.col("v.visibleFieldIds").alias("visible_field_ids"))
    records = t.select(F.col("t.id").alias("table_id"), F.posexplode("t.records").alias("ordinal", "r")).select(
        "table_id", F.col("r.id").alias("record_id"), "ordinal", F.try_to_timestamp("r.createdTime").alias("created_time"), "r.fields"
    )
    shown = base.select(F.explode("viewRecords").alias("view_id", "ids")).select("view_id", F.explode("ids").alias("record_id"))
    return TableExport(tables, fields, views.where(F.lower("type").isin(*RECORD_VIEWS)), records, shown)


def first_fields(fields: DataFrame) -> DataFrame:
    """Fields of several tables by name; of one name the first table's."""
    return fields.groupBy("name").agg(F.min_by(F.struct(*[c for c in fields.columns if c != "name"]), F.struct("table_id", "ordinal")).alias("f")).select("name", "f.*")


def page_export(spark: SparkSession, path: str) -> DataFrame:
    """Pages and data sources recorded as JSON lines: ``id, object, parent_type, parent_id, created_time, last_edited_time, properties`` (JSON text by name)."""
    schema = "id string, object string, parent map<string,string>, created_time string, last_edited_time string, properties map<string,string>"
    rows = spark.read.schema(schema).json(path)
    kind = F.col("parent")["type"]
    return rows.select(
        "id", "object", kind.alias("parent_type"), F.try_element_at("parent", kind).alias("parent_id"),
        F.try_to_timestamp("created_time").alias("created_time"), F.try_to_timestamp("last_edited_time").alias("last_edited_time"), "properties",
    )


def page_relations(pages: DataFrame, name: str) -> DataFrame:
    """``id, property, pos, target``: the links of one relation property."""
    from notemill.functions.values import page_value

    return pages.select("id", F.lit(name).alias("property"), F.posexplode(page_value(F.col("properties")[name], "relation")).alias("pos", "target"))


def html_export_index(entries: DataFrame, path: str = "entry") -> DataFrame:
    """``id, parent_ids, title, path`` of an HTML export whose names end in 32 hexadecimal digits."""
    parts = F.split(path, "/")
    id_of = lambda s: F.regexp_extract(s, r"([0-9a-f]{32})(?:\.html|\.csv)?$", 1)
    name = F.element_at(parts, -1)
    rows = entries.where(name.rlike(r"[0-9a-f]{32}\.html$"))
    above = F.filter(F.transform(F.slice(parts, F.lit(1), F.size(parts) - 1), id_of), lambda s: s != "")
    return rows.select(id_of(name).alias("id"), above.alias("parent_ids"), F.trim(F.regexp_replace(name, r"\s*[0-9a-f]{32}\.html$", "")).alias("title"), F.col(path).alias("path"))


def chain_paths(pages: DataFrame) -> DataFrame:
    """``id, path``: titles of the parents in their order, then the page's own, by a join on ids; unknown parents are left out."""
    chain = pages.select("id", "title", F.posexplode_outer("parent_ids").alias("pos", "parent"))
    named = chain.join(pages.select(F.col("id").alias("parent"), F.col("title").alias("_t")), "parent", "left")
    above = F.transform(F.array_sort(F.collect_list(F.when(F.col("_t").isNotNull(), F.struct("pos", "_t")))), lambda x: x["_t"])
    return named.groupBy("id").agg(F.array_join(F.concat(above, F.array(F.first("title"))), "/").alias("path"))


def into_own_folder(pages: DataFrame) -> DataFrame:
    """Add ``has_children``: pages that are some page's last parent lie in a folder of their own name."""
    parents = pages.select(F.try_element_at("parent_ids", F.lit(-1)).alias("_p")).where("_p IS NOT NULL").distinct()
    return pages.join(parents, F.col("id") == F.col("_p"), "left").withColumn("has_children", F.col("_p").isNotNull()).drop("_p")


def bundle_notes(entries: DataFrame, suffix: str = "textbundle") -> DataFrame:
    """Bundles as ``bundle, text, info``: the text file and ``info.json`` of each, joined on their folder."""
    from notemill.sources.files import bundles

    own = bundles(entries, suffix=suffix)
    body = F.decode("content", "UTF-8")
    return own.groupBy("bundle").agg(
        F.min(F.when(F.col("inner").rlike(r"^text\.(md|markdown|txt)$"), body)).alias("text"), F.min(F.when(F.col("inner") == "info.json", body)).alias("info"), F.sort_array(F.collect_list(F.when(F.col("inner").startswith("assets/"), F.col("inner")))).alias("assets")
    )


def asset_embeds(text: Column, folder: Column) -> Column:
    """A bundle's links to its own assets as embeds of the files in ``folder`` (null or ``/``: the root); other images stay."""
    prefix = F.when(F.coalesce(folder, F.lit("/")).isin("", "/"), "").otherwise(F.concat(F.regexp_replace(folder, r"([\\$])", r"\\$1"), F.lit("/")))
    return F.regexp_replace(text, F.lit(r"!\[\]\(assets/([^)]*)\)"), F.concat(F.lit("![["), prefix, F.lit("$1]]")))


def bundle_times(notes: DataFrame, key: str = "net.shinyfrog.bear") -> DataFrame:
    """Add the id, times and states that a bundle's ``info.json`` holds under ``key``."""
    at = lambda f: F.get_json_object("info", f"$['{key}'].{f}")
    return notes.withColumns({
        "unique_id": at("uniqueIdentifier"), "created": F.try_to_timestamp(at("creationDate")), "modified": F.try_to_timestamp(at("modificationDate")),
        "archived": at("archived").isin("1", "true"), "trashed": at("trashed").isin("1", "true"),
    })


def desktop_notes(spark: SparkSession, path: str) -> DataFrame:
    """Notes of a desktop wiki, one XML file each: ``title, text, tags, created, changed``; times may have a comma or long fractions."""
    schema = T.StructType([T.StructField("title", T.StringType()), T.StructField("text", T.StringType()), T.StructField("create-date", T.StringType()), T.StructField("last-change-date", T.StringType()), T.StructField("tags", T.StructType([T.StructField("tag", T.ArrayType(T.StringType()))]))])
    rows = spark.read.format("xml").option("rowTag", "note").option("ignoreNamespace", "true").schema(schema).load(path)
    plain = F.trim(F.regexp_replace(F.regexp_replace("text", r"(?s)<[^>]*>", ""), "&amp;", "&"))
    return rows.select("title", plain.alias("text"), F.col("tags.tag").alias("tags"), iso_time(F.col("create-date")).alias("created"), iso_time(F.col("last-change-date")).alias("changed"))


def iso_time(text: Column) -> Column:
    """A time with a comma for the point and any number of fraction digits."""
    return F.try_to_timestamp(F.regexp_replace(F.regexp_replace(text, ",", "."), r"(\.\d{1,6})\d*", "$1"))


def journal_entries(pages: DataFrame, name: str = "name", html: str = "html") -> DataFrame:
    """Journal pages other than the index, with ``day`` from a heading such as ``Monday, 4 March 2024``."""
    rows = pages.where(F.lower(name) != "index.html")
    said = F.regexp_extract(html, r"[A-Z][a-z]+day, (\d{1,2} [A-Z][a-z]+ \d{4})", 1)
    return rows.withColumn("day", F.try_to_timestamp(F.nullif(said, F.lit("")), F.lit("d MMMM yyyy")).cast("date"))


def apple_seconds(x: Column) -> Column:
    """Seconds since 2001 as a timestamp."""
    return F.timestamp_seconds(x + 978_307_200)


def keep_times(created: Column, edited: Column) -> dict[str, Column]:
    return {"ctime": F.timestamp_micros(created), "mtime": F.timestamp_micros(edited)}
