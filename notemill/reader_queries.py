"""Exports written from the driver's tables and read again by the sources."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notemill.catalogue import query, table
from notemill.functions.values import field_value
from notemill.operators import links
from notemill.sources import exports, files, recorded, tables
from notemill.staging import move_path, new_path, stage
from notemill.streaming import keyed


def _written(rows: DataFrame, column: str, label: str, file: str | None = None) -> str:
    """A folder of text files that hold ``column``, a row a line; one file for each value of ``file``."""
    out = new_path(rows.sparkSession, label)
    if file is None:
        rows.select(column).write.text(out)
    else:
        rows.select(column, file).write.partitionBy(file).text(out)
    return out


@query(
    """SELECT doc_id, 'Doc ' || doc_id AS title, chr(10) || text AS body, CASE WHEN lang = 'en' THEN 'Keep/Color/Red' ELSE '' END || CASE WHEN lang = 'en' AND doc_id % 2 = 0 THEN ' ' ELSE '' END || CASE WHEN doc_id % 2 = 0 THEN 'Keep/Pinned' ELSE '' END
  || CASE WHEN lang = 'en' OR doc_id % 2 = 0 THEN ' ' ELSE '' END || 'Keep/Label/' || replace(source, ' ', '-') AS tags, make_timestamp(doc_id * 1000000) AS created, make_timestamp(doc_id * 1000000 + 5000000) AS modified
FROM documents WHERE NOT contains(text, '#') AND doc_id % 5 <> 0 AND doc_id % 7 <> 0"""
)
def keep_round_trip(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").where(~F.contains("text", F.lit("#")))
    stamp = F.col("doc_id") * 1_000_000
    note = F.struct(
        F.concat(F.lit("Doc "), F.col("doc_id").cast("string")).alias("title"), F.col("text").alias("textContent"), F.when(F.col("lang") == "en", "RED").otherwise("DEFAULT").alias("color"), (F.col("doc_id") % 2 == 0).alias("isPinned"),
        (F.col("doc_id") % 5 == 0).alias("isArchived"), (F.col("doc_id") % 7 == 0).alias("isTrashed"), stamp.alias("createdTimestampUsec"), (stamp + 5_000_000).alias("userEditedTimestampUsec"),
        F.array(F.struct(F.col("source").alias("name"))).alias("labels"),
    )
    lines = docs.select(F.to_json(note).alias("line")).unionByName(spark.createDataFrame([("{broken",), ('{"title": "no times"}',)], "line string"))
    read = spark.read.text(_written(lines, "line", "keep")).withColumnRenamed("value", "text")
    kept = tables.keep_selected(tables.keep_notes(read))
    times = exports.keep_times(F.col("note.createdTimestampUsec"), F.col("note.userEditedTimestampUsec"))
    return kept.select(
        F.substring("note.title", 5, 20).cast("long").alias("doc_id"), F.col("note.title").alias("title"), tables.keep_body().alias("body"), F.array_join(tables.keep_tags(), " ").alias("tags"),
        times["ctime"].cast("timestamp_ntz").alias("created"), times["mtime"].cast("timestamp_ntz").alias("modified"),
    )


def _zip_of(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for part in parts:
        made = []
        for key, text in zip(part["key"], part["text"]):
            sink = io.BytesIO()
            with zipfile.ZipFile(sink, "w", zipfile.ZIP_DEFLATED) as archive:
                archive.writestr(f"{key}.textbundle/text.md", text)
                archive.writestr(f"{key}.textbundle/info.json", f'{{"net.shinyfrog.bear": {{"uniqueIdentifier": "U{key}", "creationDate": "2024-01-02T03:04:05Z", "trashed": "0", "archived": "1"}}}}')
                archive.writestr(f"{key}.textbundle/assets/a b.png", b"x")
                archive.writestr(f"__MACOSX/{key}", b"junk")
                archive.writestr(f".hidden/{key}", b"junk")
                inner = io.BytesIO()
                with zipfile.ZipFile(inner, "w") as nested:
                    nested.writestr("inside.txt", text[:10])
                archive.writestr("part-1.zip", inner.getvalue())
            made.append(bytearray(sink.getvalue()))
        yield pd.DataFrame({"path": part["key"].astype(str) + ".zip", "content": made})


def _archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("key"), "text")
    return docs.mapInPandas(_zip_of, "path string, content binary").unionByName(spark.createDataFrame([("broken.zip", bytearray(b"no archive"))], "path string, content binary"))


@query(
    """SELECT doc_id || '.zip' AS archive, doc_id || '.textbundle/text.md' AS entry, CAST(octet_length(encode(text)) AS BIGINT) AS size, md5(text) AS digest, false AS failed FROM documents
UNION ALL SELECT doc_id || '.zip', doc_id || '.textbundle/info.json', NULL, NULL, false FROM documents UNION ALL SELECT doc_id || '.zip', doc_id || '.textbundle/assets/a b.png', 1, md5('x'), false FROM documents
UNION ALL SELECT doc_id || '.zip/part-1.zip', 'inside.txt', CAST(octet_length(encode(left(text, 10))) AS BIGINT), md5(left(text, 10)), false FROM documents UNION ALL SELECT 'broken.zip', NULL, NULL, NULL, true"""
)
def zip_round_trip(spark, sf_dir):
    entries = files.zip_entries(_archives(spark, sf_dir), nested=True)
    info = F.col("entry").endswith("info.json")
    return entries.select("archive", "entry", F.when(~info, F.col("size")).alias("size"), F.when(~info, F.md5("content")).alias("digest"), F.col("error").isNotNull().alias("failed"))


@query("SELECT doc_id || '.textbundle' AS bundle, text, 'U' || doc_id AS unique_id, TIMESTAMP '2024-01-02 03:04:05' AS created, true AS archived, false AS trashed, 'assets/a b.png' AS asset FROM documents")
def bundle_round_trip(spark, sf_dir):
    made = exports.bundle_times(exports.bundle_notes(files.zip_entries(_archives(spark, sf_dir))))
    return made.select("bundle", "text", "unique_id", F.col("created").cast("timestamp_ntz").alias("created"), "archived", "trashed", F.array_join("assets", ",").alias("asset"))


@query(
    """SELECT o_orderkey, 'Order ' || o_orderkey AS title, o_orderstatus || ' & <' || o_orderpriority || '>' AS content, date_trunc('second', o_orderdate) AS created, 'a,' || o_orderstatus AS tags FROM orders WHERE o_orderkey % 4 <> 0"""
)
def xml_round_trip(spark, sf_dir):
    escaped = F.replace(F.replace(F.concat_ws("", "o_orderstatus", F.lit(" & <"), "o_orderpriority", F.lit(">")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    # Both marks of a clip, and a source that only sounds like one.
    marks = [(8, 0, "<source>web.clip7</source>"), (8, 4, "<source>desktop</source><source-application>webclipper.evernote</source-application>"), (4, 1, "<source>my web clip folder</source>")]
    clip = F.coalesce(*[F.when(F.col("o_orderkey") % n == k, f"<note-attributes>{inner}</note-attributes>") for n, k, inner in marks], F.lit(""))
    note = F.concat(
        F.lit("<note><title>Order "), F.col("o_orderkey").cast("string"), F.lit("</title><content>"), escaped, F.lit("</content><created>"), F.date_format("o_orderdate", "yyyyMMdd'T'HHmmss"), F.lit("Z</created><tag>a</tag><tag>"), F.col("o_orderstatus"), F.lit("</tag>"), clip, F.lit("</note>")
    )
    # An export is one document: a file for every thousand orders.
    made = table(spark, sf_dir, "orders").groupBy(F.floor(F.col("o_orderkey") / 1000).alias("file")).agg(F.array_join(F.collect_list(note), "\n").alias("notes"))
    made = made.select("file", F.concat(F.lit("<en-export>"), "notes", F.lit("</en-export>")).alias("export"))
    read = tables.without_clips(tables.xml_notes(spark, _written(made, "export", "xml", "file")))
    return read.select(F.substring("title", 7, 20).cast("long").alias("o_orderkey"), "title", "content", F.col("created").cast("timestamp_ntz").alias("created"), F.array_join("tag", ",").alias("tags"))


@query(
    """SELECT n_name AS page, 'n' || n_nationkey AS parent_uid, 'c' || c_custkey AS uid, c_name AS text, CAST(1 AS INTEGER) AS depth FROM customer JOIN nation ON c_nationkey = n_nationkey
UNION ALL SELECT n_name, 'c' || c_custkey, 'd' || c_custkey, c_mktsegment, 2 FROM customer JOIN nation ON c_nationkey = n_nationkey"""
)
def outliner_round_trip(spark, sf_dir):
    key = F.col("c_custkey").cast("string")
    below = F.array(F.struct(F.col("c_mktsegment").alias("string"), F.concat(F.lit("d"), key).alias("uid")))
    block = F.struct(F.col("c_name").alias("string"), F.concat(F.lit("c"), key).alias("uid"), below.alias("children"))
    # A page that many tasks wrote: a file for each 10,000 customers has its part of every page.
    pages = table(spark, sf_dir, "customer").groupBy(F.floor(F.col("c_custkey") / 10_000).alias("file"), "c_nationkey").agg(F.array_sort(F.collect_list(F.struct("c_custkey", block.alias("b")))).alias("rows"))
    pages = pages.join(F.broadcast(table(spark, sf_dir, "nation")), F.expr("c_nationkey = n_nationkey"))
    graph = F.to_json(F.struct(F.col("n_name").alias("title"), F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("uid"), F.transform("rows", lambda r: r["b"]).alias("children")))
    graphs = pages.groupBy("file").agg(F.concat(F.lit("["), F.array_join(F.array_sort(F.collect_list(graph)), ","), F.lit("]")).alias("graph"))
    read = tables.outline_blocks(spark, _written(graphs, "graph", "outliner", "file"))
    return read.select("page", "parent_uid", "uid", "text", F.size("path").alias("depth"))


@query(
    """SELECT 'rec' || p_partkey AS record_id, p_name AS name, CAST(p_size AS DOUBLE) AS size, TIMESTAMP '2024-05-06 07:08:09' AS created, 'viw' || (p_partkey % 3) AS view_id, false AS is_empty FROM part WHERE p_partkey % 3 < 2
UNION ALL SELECT 'rec-empty', NULL, NULL, NULL, NULL, true"""
)
def table_export_round_trip(spark, sf_dir):
    """Bases of at most 10,000 records, a file each; the first one also has an empty record."""
    parts = table(spark, sf_dir, "part").withColumn("file", F.floor(F.col("p_partkey") / 10_000))
    key = F.concat(F.lit("rec"), F.col("p_partkey").cast("string"))
    fields = F.create_map(F.lit("Name"), F.col("p_name"), F.lit("Size"), F.col("p_size").cast("string"))
    record = F.struct(key.alias("id"), F.lit("2024-05-06T07:08:09.000Z").alias("createdTime"), fields.alias("fields"))
    views = parts.where("p_partkey % 3 < 2").groupBy("file", F.concat(F.lit("viw"), (F.col("p_partkey") % 3).cast("string")).alias("v")).agg(F.collect_list(key).alias("ids"))
    views = views.groupBy("file").agg(F.map_from_entries(F.collect_list(F.struct("v", "ids"))).alias("viewRecords"))
    records = parts.groupBy("file").agg(F.collect_list(record).alias("records"))
    empty = F.struct(F.lit("rec-empty").alias("id"), F.lit(None).cast("string").alias("createdTime"), F.create_map(F.lit("Name"), F.lit(" "), F.lit("Size"), F.lit("[]")).alias("fields"))
    head = [F.lit("tbl1").alias("id"), F.lit("Parts").alias("name"), F.lit("fld1").alias("primaryFieldId")]
    field = lambda i, n, t: F.struct(F.lit(i).alias("id"), F.lit(n).alias("name"), F.lit(t).alias("type"))
    made = F.struct(*head, F.array(field("fld1", "Name", "singleLineText"), field("fld2", "Size", "number")).alias("fields"), F.array(*[F.struct(F.lit(f"viw{k}").alias("id"), F.lit(f"View {k}").alias("name"), F.lit("grid").alias("type")) for k in range(2)]).alias("views"), F.when(F.col("file") == 0, F.concat("records", F.array(empty))).otherwise(F.col("records")).alias("records"))
    base = records.join(views, "file").select("file", F.to_json(F.struct(F.array(made).alias("tables"), "viewRecords")).alias("base"))
    export = exports.table_export(spark, _written(base, "base", "base", "file"))
    kinds = {r["name"]: r["type"] for r in export.fields.select("name", "type").distinct().collect()}
    typed = export.typed("tbl1", {"Name": kinds["Name"], "Size": kinds["Size"]})
    shown = export.record_view.join(export.views.select("view_id").distinct(), "view_id")
    rows = typed.join(export.empty_records().select("record_id", "is_empty"), "record_id").join(shown, "record_id", "left").where("view_id IS NOT NULL OR is_empty")
    full = lambda c: F.when(~F.col("is_empty"), F.col(c))
    return rows.select("record_id", full("Name").alias("name"), full("Size").cast("double").alias("size"), F.col("created_time").cast("timestamp_ntz").alias("created"), "view_id", "is_empty")


@query(
    """SELECT 'p' || o_orderkey AS id, 'c' || o_custkey AS target, 'Customers/' || c_name AS path, o_orderdate AS created FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderkey % 10 <> 3 AND (o_orderkey - 1) % 10 <> 3"""
)
def page_export_round_trip(spark, sf_dir):
    """Pages with a relation; those that hang on a block, and children of those, are not discovered."""
    key, below = F.col("o_orderkey"), F.col("o_orderkey") - 1
    kind = F.when(key % 10 == 3, "block_id").when(below % 10 == 3, "page_id").otherwise("workspace")
    parent = F.create_map(F.lit("type"), kind, kind, F.when(kind == "block_id", "b1").when(kind == "page_id", F.concat(F.lit("p"), below.cast("string"))).otherwise("true"))
    relation = F.to_json(F.struct(F.lit("relation").alias("type"), F.array(F.struct(F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("id"))).alias("relation")))
    page = F.struct(
        F.concat(F.lit("p"), key.cast("string")).alias("id"), F.lit("page").alias("object"), parent.alias("parent"), F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("created_time"), F.create_map(F.lit("Customer"), F.from_json(relation, "type string, relation array<struct<id:string>>")).alias("properties"),
    )
    pages = stage(exports.page_export(spark, _written(table(spark, sf_dir, "orders").select(F.to_json(page).alias("page")), "page", "pages")), "pages")
    found = links.discovered(pages.select("id", "parent_type", "parent_id", "created_time"))  # without properties, which are wide
    edges = exports.page_relations(pages, "Customer").join(found.select("id", F.col("created_time").cast("timestamp_ntz").alias("created")), "id")
    people = table(spark, sf_dir, "customer").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("target"), F.concat(F.lit("Customers/"), "c_name").alias("path"))
    return edges.join(people, "target").select("id", "target", "path", "created")


@query(
    """SELECT o_orderkey, o_totalprice AS price, o_orderstatus AS status, o_orderstatus = 'O' AS shown FROM orders WHERE o_orderdate >= TIMESTAMP '1995-01-01'"""
)
def recorded_export(spark, sf_dir):
    """Customers and orders as the tables of one JSON document, written in parts that follow each other; orders of some time are read from its ranges of bytes."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    customers, orders = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    record = lambda id_, time, **fields: F.to_json(F.struct(id_.alias("id"), time.alias("createdTime"), F.struct(*[v.alias(k) for k, v in fields.items()]).alias("fields")))
    order = F.concat(F.lit("o"), F.col("o_orderkey").cast("string"))
    made = customers.select(F.lit(1).alias("part"), F.col("c_custkey").alias("n"), record(F.concat(F.lit("c"), F.col("c_custkey").cast("string")), F.lit("2000-01-01"), Name=F.col("c_name"), Balance=F.col("c_acctbal")).alias("line"))
    time = F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    made = made.unionByName(orders.select(F.lit(3).alias("part"), F.col("o_orderkey").alias("n"), record(order, time, Status=F.col("o_orderstatus"), Price=F.col("o_totalprice"), Note=F.lit('a ] , "records": [ \\')).alias("line")))
    made = made.unionByName(orders.where("o_orderstatus = 'O'").select(F.lit(5).alias("part"), F.col("o_orderkey").alias("n"), F.to_json(F.array(order)).alias("line")).withColumn("line", F.regexp_replace("line", r"^\[|\]$", "")))
    around = ['{"tables": [{"id": "tC", "name": "Customers", "records": [', None, ']}, {"name": "Orders", "records": [', None, '], "id": "tO", "fields": []}], "viewRecords": {"open": [', None, '], "none": []}}']
    first = made.groupBy("part").agg(F.min("n").alias("first"))
    lines = made.join(F.broadcast(first), "part").select("part", "n", F.concat(F.when(F.col("n") > F.col("first"), ",").otherwise(""), "line").alias("line"))
    lines = lines.unionByName(spark.createDataFrame([(k, 0, text) for k, text in enumerate(around) if text], "part int, n long, line string"))
    out = new_path(spark, "recorded")
    lines.orderBy("part", "n").select("line").write.text(out)
    index = recorded.index_of(spark, out, block=200_000)
    records = recorded.export_records(spark, out, only=["Price", "Status"], index=index).where("table_id = 'tO' AND created_time >= '1995-01-01'")
    shown = recorded.view_records(spark, out, index=index).where("view_id = 'open'").select("record_id", F.lit(True).alias("shown"))
    field = lambda name, kind: field_value(F.col("fields")[name], kind)
    return records.join(shown, "record_id", "left").select(
        F.substring("record_id", 2, 20).cast("long").alias("o_orderkey"), field("Price", "number").alias("price"), field("Status", "singleSelect").alias("status"), F.coalesce("shown", F.lit(False)).alias("shown")
    )


@query(
    """WITH y AS (SELECT o_custkey AS k, year(o_orderdate) AS y, max(epoch(o_orderdate)) AS m FROM orders GROUP BY 1, 2),
p AS (SELECT k, m, CASE WHEN row_number() OVER (PARTITION BY k ORDER BY y) = 1 THEN 'create' ELSE 'update' END AS disposition FROM y),
late AS (SELECT k, CAST(min(m) AS DOUBLE) AS m, CASE WHEN min(m) = max(m) AND k % 5 <> 0 THEN 'unchanged' ELSE 'preserve' END AS disposition FROM y GROUP BY 1),
log AS (SELECT k, disposition FROM p UNION ALL SELECT k, disposition FROM late)
SELECT 'c' || l.k AS source_id, 'Customers/Note ' || l.k || '.md' AS path, CAST(count(*) FILTER (l.disposition = 'create') AS BIGINT) AS created, CAST(count(*) FILTER (l.disposition = 'update') AS BIGINT) AS updated,
  CAST(count(*) FILTER (l.disposition = 'preserve') AS BIGINT) AS preserved, CAST(count(*) FILTER (l.disposition = 'unchanged') AS BIGINT) AS unchanged, max(n.m) AS mtime
FROM log l JOIN (SELECT k, CAST(max(m) AS BIGINT) AS m FROM y GROUP BY 1) n ON l.k = n.k GROUP BY l.k"""
)
def keyed_reimports(spark, sf_dir):
    """Orders as exports of a note per customer, a micro-batch for each year, then edits by users, then each customer's first year again."""
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderdate", F.year("o_orderdate").alias("y"), F.unix_timestamp(F.col("o_orderdate").cast("timestamp")).alias("m"))
    note = lambda rows, m, edited: rows.select(
        F.lit("Customers").alias("folder"), F.concat(F.lit("Note "), F.col("o_custkey").cast("string")).alias("title"), F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("source_id"),
        m.alias("mtime"), F.when(F.lit(not edited), m.cast("string")).alias("content"), F.lit(edited).alias("edited"),
    )
    source, log, marks = (new_path(spark, x) for x in ("exports", "changes", "marks"))
    years = sorted(r.y for r in orders.select("y").distinct().collect())
    batches = [note(orders.where(F.col("y") == y), F.col("m"), False) for y in years]
    ends = orders.groupBy("o_custkey", "y").agg(F.max("m").alias("m")).groupBy("o_custkey").agg(F.min("m").alias("first"), F.max("m").alias("last"))
    batches += [note(ends.where("o_custkey % 5 = 0"), F.col("last") + 7, True), note(ends, F.col("first"), False)]
    run = None
    try:
        for k, batch in enumerate(batches):  # a micro-batch reads a batch's files together, as their folder is seen when it is whole
            batch.write.parquet(f"{source}/next-{k}")
            move_path(spark, f"{source}/next-{k}", f"{source}/batch-{k}")
            run = run or keyed.start_reimport(spark.readStream.schema(keyed.INCOMING).parquet(f"{source}/batch-*"), log, marks, once=False)
            run.processAllAvailable()
    finally:
        if run is not None:
            run.stop()
    changes = spark.read.schema(keyed.CHANGES).parquet(log)
    count = lambda what: F.count_if(F.col("disposition") == what)
    kept = changes.groupBy("source_id", "path").agg(count("create").alias("created"), count("update").alias("updated"), count("preserve").alias("preserved"), count("unchanged").alias("unchanged"))
    return kept.join(keyed.current_notes(changes).select("source_id", "mtime"), "source_id")
