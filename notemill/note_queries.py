"""Parts of notes on the driver's tables: views, front matter, code, tags, attachments, trees, blocks, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from notemill.catalogue import query, table
from notemill.functions import text as tx
from notemill.functions.rollups import rollup
from notemill.operators import documents, grouping, links, notes, trees
from notemill.operators import tag_queries as tagged
from notemill.operators.claims import in_arrival_order
from notemill.plans import upsert, views
from notemill.sources import exports
from notemill.staging import new_path


@query(
    """SELECT c_custkey, c_name AS "the name", c_custkey % 5 = 0 AND c_acctbal < 0 AS blank, c_name || ' view' AS shown, 'a ' || replace(c_name, '#', '') || ' 1' AS key
FROM customer WHERE c_mktsegment = 'FURNITURE' AND c_custkey % 2 = 0"""
)
def view_filters(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select(
        "c_custkey", "c_name", F.col("c_mktsegment").alias("folder"), F.when(F.col("c_custkey") % 2 == 0, F.array(F.lit("v1"), F.lit("even"))).otherwise(F.array(F.lit("v1"))).alias("views"),
        F.when(F.col("c_custkey") % 5 != 0, "x").otherwise("").alias("note"), F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal")).alias("amount"), F.array().cast("array<string>").alias("list"),
    )
    kept = rows.where(views.in_folder("FURNITURE") & views.in_view("even"))
    kept = kept.select("c_custkey", "c_name", views.is_blank_record({"note": "text", "amount": "number", "list": "multitext"}).alias("blank"), views.view_name(F.concat(F.lit("["), "c_name", F.lit(" view]"))).alias("shown"), tx.yaml_key(F.concat(F.lit("a: "), "c_name", F.lit(" {1}"))).alias("key"))
    return views.renamed(kept, {"c_name": 'the "name\\"'})


@query("SELECT source, lang, count(*) AS n FROM documents GROUP BY 1, 2")
def folder_counts(spark, sf_dir):
    return grouping.counts_by(table(spark, sf_dir, "documents"), "source", "lang")


@query(
    """WITH t AS (SELECT user_id, event_id, CASE WHEN event_id % 2 = 0 THEN upper(event_type) ELSE event_type END AS tag FROM events),
f AS (SELECT user_id, min(event_id) AS o, arg_min(tag, event_id) AS tag FROM t GROUP BY user_id, lower(tag)) SELECT user_id, string_agg(tag, ' ' ORDER BY o) AS tags FROM f GROUP BY 1"""
)
def first_spellings(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", F.when(F.col("event_id") % 2 == 0, F.upper("event_type")).otherwise(F.col("event_type")).alias("tag"))
    return grouping.distinct_tags(rows, "user_id", "tag", "event_id").withColumn("tags", F.array_join("tags", " "))


@query(
    """SELECT c_custkey, 'title: "' || c_name || '"' || chr(10) || 'n: ' || c_custkey AS head, chr(10) || '* one  ' || chr(10) || chr(9) || '+ two' || chr(10) || chr(10) || chr(10) || chr(10) || '[' || c_name || '](notes/' || c_custkey || '.md) [out](https://x.y/a.md)' AS body,
  chr(10) || '- one' || chr(10) || '    - two' || chr(10) || chr(10) || '[[notes/' || c_custkey || '|' || c_name || ']] [out](https://x.y/a.md)' AS tidy, '[' || c_name || '](A/' || c_custkey || '.md) and [B](B.md)' AS plain FROM customer"""
)
def front_matter_parts(spark, sf_dir):
    name, key = F.col("c_name"), F.col("c_custkey").cast("string")
    written = F.concat(F.lit("\n* one  \n\t+ two\n\n\n\n["), name, F.lit("](notes/"), key, F.lit(".md) [out](https://x.y/a.md)"))
    head, body = tx.split_front_matter(F.concat(tx.front_matter({"title": name, "gone": F.lit(None), "n": key}), F.lit("\n"), written))
    wiki = F.concat(F.lit("[[A/"), key, F.lit("|"), name, F.lit("]] and [[B]]"))
    return table(spark, sf_dir, "customer").select("c_custkey", head.alias("head"), body.alias("body"), notes.tidy_markdown(notes.standard_links(body)).alias("tidy"), notes.standard_links(wiki, wiki=False).alias("plain"))


@query(
    """SELECT o_orderkey, 'a/s' || o_custkey || ' c' AS tags, 'a s' || o_custkey || ' c' AS levels, '\\#a/s' || o_custkey || ' `#code` \\#c (#no) #' || o_orderkey AS escaped, 'A/S' || o_custkey || ' `x` Y' AS upper,
  CASE o_orderkey % 4 WHEN 0 THEN '\\# ' WHEN 1 THEN '  \\- ' WHEN 2 THEN o_custkey || '\\. ' ELSE '#tag ' END || 'text' AS line FROM orders"""
)
def code_and_tags(spark, sf_dir):
    orders, key = table(spark, sf_dir, "orders"), F.col("o_custkey").cast("string")
    text = F.concat(F.lit("#a/s"), key, F.lit(" `#code` #c (#no) #"), F.col("o_orderkey").cast("string"))
    starts = F.concat(F.get(F.array(F.lit("# "), F.lit("  - "), F.concat(key, F.lit(". ")), F.lit("#tag ")), (F.col("o_orderkey") % 4).cast("int")), F.lit("text"))
    return orders.select(
        "o_orderkey", F.array_join(tx.nested_tags(text), " ").alias("tags"), F.array_join(tx.nested_tags(text, flatten=True), " ").alias("levels"), tx.escape_hashtags(text).alias("escaped"),
        tx.outside_code(F.concat(F.lit("a/s"), key, F.lit(" `x` y")), F.upper).alias("upper"), tx.line_start_escaped(starts).alias("line"),
    )


@query(
    """WITH f AS (SELECT 'in/' || c_custkey % 10 || '/' || c_custkey || '.png' AS name, c_custkey // 2 || '.png' AS base, 'out/' || c_custkey || '.png' AS path FROM customer)
SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'out/' || c_custkey || '.png' WHEN c_custkey % 3 = 1 THEN 'out/' || c_custkey || '.png' ELSE 'none/x' || c_custkey || '.png' END AS path FROM customer"""
)
def attachment_places(spark, sf_dir):
    """Attachments asked for by their full name, by their base name in another folder, and by one that no file has."""
    customers, key = table(spark, sf_dir, "customer"), F.col("c_custkey").cast("string")
    placed = customers.select(F.concat(F.lit("in/"), (F.col("c_custkey") % 10).cast("string"), F.lit("/"), key, F.lit(".png")).alias("name"), F.concat(F.lit("out/"), key, F.lit(".png")).alias("path"))
    asked = F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("in/"), (F.col("c_custkey") % 10).cast("string"), F.lit("/"), key)).when(F.col("c_custkey") % 3 == 1, F.concat(F.lit("else/"), key)).otherwise(F.concat(F.lit("none/x"), key))
    return links.attachment_paths(customers.select("c_custkey", F.concat(asked, F.lit(".png")).alias("name")), placed).select("c_custkey", "path")


@query("SELECT o_orderkey, o_custkey AS resource, CASE WHEN o_custkey % 2 = 0 THEN 'data' || o_custkey END AS content FROM orders")
def resources_by_hash(spark, sf_dir):
    """Resources of notes, in Base64 with line breaks, found by the MD5 that notes mention; odd ones are missing."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("resource"), F.md5(F.concat(F.lit("data"), F.col("o_custkey").cast("string")).cast("binary")).alias("hash"))
    packed = F.regexp_replace(F.base64(F.concat(F.lit("data"), F.col("o_custkey").cast("string")).cast("binary")), "^(.{4})", "$1\n ")
    resources = table(spark, sf_dir, "orders").where("o_custkey % 2 = 0").select("o_custkey").distinct().select(packed.alias("data"))
    return links.resources_by_hash(resources, orders).select("o_orderkey", "resource", F.decode(F.try_to_binary(F.regexp_replace("data", r"\s+", ""), F.lit("base64")), "UTF-8").alias("content"))


@query(
    """SELECT p_partkey, CASE WHEN p_partkey % 4 < 3 THEN CAST(p_size + 1 AS INTEGER) END AS width, CASE WHEN p_partkey % 4 < 3 THEN CAST(p_partkey % 60000 AS INTEGER) END AS height,
  (p_partkey % 4 = 3 OR p_size + 1 >= 10) AND p_retailprice < 1500 AS kept FROM part"""
)
def image_limits(spark, sf_dir):
    """PNG, GIF and BMP heads, and files of no known kind, against the least width of images and the largest size of attachments."""
    wide, high = F.col("p_size") + 1, F.col("p_partkey") % 60_000
    big = lambda x: F.lpad(F.hex(x), 8, "0")
    little = lambda x, n: F.concat(*[F.lpad(F.hex(F.floor(x / 256**k) % 256), 2, "0") for k in range(n)])
    heads = F.array(
        F.concat(F.lit("89504E470D0A1A0A0000000D49484452"), big(wide), big(high)), F.concat(F.lit("474946383961"), little(wide, 2), little(high, 2)),
        F.concat(F.lit("424D" + "00" * 16), little(wide, 4), little(high, 4)), F.lit("255044462D"),
    )
    width, height = notes.image_size(F.unhex(F.get(heads, (F.col("p_partkey") % 4).cast("int"))))
    made = table(spark, sf_dir, "part").select("p_partkey", width.alias("width"), height.alias("height"), F.col("p_retailprice").alias("size"))
    return made.select("p_partkey", "width", "height", (F.coalesce(F.col("width") >= 10, F.lit(True)) & (F.col("size") < 1500)).alias("kept"))


@query(
    """SELECT id, CASE WHEN kind = 'n' AND k % 7 <> 0 THEN parent END AS parent_id, NOT (kind = 'n' AND k % 7 <> 0) AS is_root, (kind = 'n' AND k % 7 <> 0 AND parent IN ('r1', 'r3')) OR id IN ('r1', 'r3') AS chosen
FROM (SELECT 'r' || r_regionkey AS id, NULL AS parent, 'r' AS kind, r_regionkey AS k FROM region UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, 'n', n_nationkey FROM nation)"""
)
def forest_selection(spark, sf_dir):
    """Nations below regions, some below none that is there; two regions chosen with all below."""
    nodes = _places(spark, sf_dir)
    wood = trees.forest(nodes)
    chosen = trees.selected(nodes, nodes.where("id IN ('r1', 'r3')")).withColumn("chosen", F.lit(True))
    return wood.join(chosen, "id", "left").select("id", "parent_id", "is_root", F.coalesce("chosen", F.lit(False)).alias("chosen"))


def _places(spark, sf_dir):
    regions = table(spark, sf_dir, "region").select(F.concat(F.lit("r"), "r_regionkey").alias("id"), F.lit(None).cast("string").alias("parent_id"), F.col("r_name").alias("title"))
    up = F.when(F.col("n_nationkey") % 7 != 0, F.concat(F.lit("r"), "n_regionkey")).otherwise("nowhere")
    return regions.unionByName(table(spark, sf_dir, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("id"), up.alias("parent_id"), F.col("n_name").alias("title")))


@query(
    """SELECT 'n' || n_nationkey AS node, CASE WHEN n_nationkey % 7 <> 0 THEN r_name || '|' || n_name ELSE n_name || '|' END AS cells FROM nation JOIN region ON n_regionkey = r_regionkey
UNION ALL SELECT 'r' || r_regionkey, r_name || '|' FROM region WHERE r_regionkey NOT IN (SELECT n_regionkey FROM nation WHERE n_nationkey % 7 <> 0)"""
)
def leaf_paths(spark, sf_dir):
    return trees.leaf_rows(_places(spark, sf_dir)).select("node", F.array_join("cells", "|").alias("cells"))


@query(
    r"""SELECT DISTINCT page_id, src FROM (SELECT page_id, unnest(regexp_extract_all(html, '(?is)<(?:img|audio|video|source)\b[^>]*\bsrc\s*=\s*["'']([^"'']*)["'']', 1)) AS src FROM pages) WHERE src <> '' AND NOT regexp_matches(src, '(?i)^data:')"""
)
def page_media(spark, sf_dir):
    return documents.media(table(spark, sf_dir, "pages"))


@query("SELECT c_custkey, unnest([0, 1]) AS pos, unnest([2, 3]) AS level, unnest(['a' || c_custkey, NULL]) AS anchor, unnest([c_name || ' & co', c_mktsegment]) AS text FROM customer")
def heading_anchors(spark, sf_dir):
    key = F.col("c_custkey").cast("string")
    html = F.concat(F.lit("<p>x</p><h2 class=\"k\" id='a"), key, F.lit("'><b>"), "c_name", F.lit("</b> &amp;\n co</h2>y<h3>"), "c_mktsegment", F.lit("</h3>"))
    return documents.headings(table(spark, sf_dir, "customer").select("c_custkey", html.alias("html")), "c_custkey")


@query(
    """SELECT p_partkey, CASE p_partkey % 11 WHEN 0 THEN '> ' || p_name || chr(10) || '> ' || p_brand WHEN 1 THEN '> [!info] ' || chr(10) || '> ' || p_name || chr(10) || '> ' || p_brand WHEN 2 THEN '> [!note] ' || p_name || chr(10) || p_brand
  WHEN 3 THEN '```sql' || chr(10) || p_name || chr(10) || p_brand || chr(10) || '```' WHEN 4 THEN '$$' || chr(10) || p_name || chr(10) || p_brand || chr(10) || '$$' WHEN 5 THEN '---' WHEN 6 THEN '![' || p_name || chr(10) || p_brand || '](http://x/' || p_partkey || ')'
  WHEN 7 THEN '[' || p_name || chr(10) || p_brand || '](http://x/' || p_partkey || ')' WHEN 8 THEN repeat('    ', 1) || '- [' || CASE WHEN p_size % 2 = 0 THEN 'x' ELSE ' ' END || '] ' || p_name || chr(10) || p_brand WHEN 9 THEN '### ' || p_name || chr(10) || p_brand ELSE '' END AS markdown FROM part"""
)
def block_kinds(spark, sf_dir):
    kinds = ["quote", "callout", "toggle", "code", "equation", "divider", "image", "bookmark", "to_do", "heading_3", "unsupported"]
    kind = F.get(F.array(*map(F.lit, kinds)), (F.col("p_partkey") % 11).cast("int"))
    text, url = F.concat_ws("\n", "p_name", "p_brand"), F.concat(F.lit("http://x/"), F.col("p_partkey").cast("string"))
    return table(spark, sf_dir, "part").select("p_partkey", documents.block_markdown(kind, text, F.lit(1), F.lit(1), F.col("p_size") % 2 == 0, F.lit("sql"), url).alias("markdown"))


@query(
    """WITH d AS (SELECT event_id, CASE WHEN event_id % 2 = 1 THEN 'create' WHEN event_id % 3 = 1 THEN 'unchanged' WHEN event_id % 3 = 2 THEN 'preserve' ELSE 'update' END AS disposition, props FROM events)
SELECT disposition, count(*) AS n, CAST(sum(length(props)) AS BIGINT) AS chars, CAST(min(event_id) AS BIGINT) AS first FROM d WHERE disposition IN ('create', 'update') GROUP BY 1"""
)
def written_notes(spark, sf_dir):
    from notemill.queries import _events_as_notes

    incoming, state = _events_as_notes(spark, sf_dir)
    out = new_path(spark, "written")
    upsert.write_notes(upsert.plan(incoming, state), incoming, out)
    number = F.regexp_extract("path", r"(\d+)\.md$", 1).cast("long")
    return spark.read.parquet(out).groupBy("disposition").agg(F.count("*").alias("n"), F.sum(F.length("content")).alias("chars"), F.min(number).alias("first"))


@query(
    """SELECT o_custkey, bool_and(o_totalprice > 20000) AS all_dear, bool_or(o_totalprice > 300000) AS some_dear FROM orders GROUP BY 1"""
)
def rollup_truth(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    edges = orders.select("o_custkey", F.row_number().over(_by_customer()).alias("pos"), F.col("o_orderkey").alias("target"))
    of = lambda test: rollup(edges, orders.select(F.col("o_orderkey").alias("target"), F.expr(test).cast("string").alias("v")), "o_custkey", "target", "v", all_="AND", some="OR")
    dear, dearer = of("o_totalprice > 20000"), of("o_totalprice > 300000")
    return dear.select("o_custkey", F.col("all_").alias("all_dear")).join(dearer.select("o_custkey", F.col("some").alias("some_dear")), "o_custkey")


@query("SELECT o_custkey, string_agg(part, ' ' ORDER BY part) AS parts FROM (SELECT o_custkey, unnest([o_orderpriority, CAST(o_orderkey AS VARCHAR)]) AS part FROM orders) GROUP BY 1")
def rollup_flattened(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    edges = orders.select("o_custkey", F.row_number().over(_by_customer()).alias("pos"), F.col("o_orderkey").alias("target"))
    lists = orders.select(F.col("o_orderkey").alias("target"), F.array("o_orderpriority", F.col("o_orderkey").cast("string")).alias("v"))
    return rollup(edges, lists, "o_custkey", "target", "v", parts="ARRAYFLATTEN").select("o_custkey", F.array_join(F.array_sort("parts"), " ").alias("parts"))


def _by_customer():
    from pyspark.sql import Window

    return Window.partitionBy("o_custkey").orderBy("o_orderkey")


@query("SELECT 'f' || n_nationkey % 7 AS name, arg_min('t' || n_regionkey, n_regionkey * 100 + n_nationkey) AS table_id, arg_min(n_name, n_regionkey * 100 + n_nationkey) AS type FROM nation GROUP BY 1")
def first_fields(spark, sf_dir):
    fields = table(spark, sf_dir, "nation").select(F.concat(F.lit("t"), "n_regionkey").alias("table_id"), F.col("n_nationkey").alias("ordinal"), F.concat(F.lit("f"), F.col("n_nationkey") % 7).alias("name"), F.col("n_name").alias("type"))
    return exports.first_fields(fields).select("name", "table_id", "type")


#: Nested queries over an event's tags: its type, its user and a decade of values; beside SQL for the same.
TAG_QUERIES = {
    "both": ("{{query: {and: [[click]] [[Even]]}}}", "type = 'click' AND even"),
    "either": ("{{[[query]]: {or: [[click]] #view}}}", "type IN ('click', 'view')"),
    "none": ("{not: [[click]] #[[view]] [[error]]}", "type NOT IN ('click', 'view', 'error')"),
    "but": ("{and: [[even]] {not: [[click]]}}", "even AND type <> 'click'"),
    "nested": ("{and: {or: [[click]] [[view]]} {or: [[even]] {and: [[user 3]] {not: [[low value]]}}}}", "type IN ('click', 'view') AND (even OR (u = 3 AND NOT low))"),
    "not either": ("{not: {or: [[even]] [[low value]]}}", "NOT (even OR low)"),
    "unknown": ("{or: [[nowhere]] {and: [[nowhere]] [[even]]}}", "false"),
    "open": ("{or: [[user 1]] {not: [[even]]}}", "u = 1 OR NOT even"),
}


@query(
    "WITH e AS (SELECT event_id, event_type AS type, event_id % 2 = 0 AS even, user_id % 10 AS u, value < 50 AS low FROM events)\n"
    + "\nUNION ALL ".join(f"SELECT '{name}' AS query, event_id FROM e WHERE {sql}" for name, (_, sql) in TAG_QUERIES.items())
)
def tag_queries(spark, sf_dir):
    tags = F.array(F.col("event_type"), F.when(F.col("event_id") % 2 == 0, "Even").otherwise("odd"), F.concat(F.lit("User "), (F.col("user_id") % 10).cast("string")), F.when(F.col("value") < 50, "low value").otherwise("high value"))
    postings = table(spark, sf_dir, "events").select("event_id", F.explode(tags).alias("tag"))
    return tagged.matching(postings, {name: text for name, (text, _) in TAG_QUERIES.items()}, "event_id")


@query(
    """WITH r AS (SELECT o_custkey AS p, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS o, o_orderpriority AS t, o_orderkey % 3 > 0 AS b, o_orderkey % 2 = 0 AS i FROM orders),
l AS (SELECT *, coalesce(lag(b) OVER w, false) AS pb, coalesce(lag(i) OVER w, false) AS pi, lead(o) OVER w IS NULL AS ends FROM r WINDOW w AS (PARTITION BY p ORDER BY o)),
x AS (SELECT p, o, CASE WHEN pi AND (pi <> i OR pb <> b) THEN '*' ELSE '' END || CASE WHEN pb AND pb <> b THEN '**' ELSE '' END || CASE WHEN b AND pb <> b THEN '**' ELSE '' END || CASE WHEN i AND (pi <> i OR pb <> b) THEN '*' ELSE '' END || t
  || CASE WHEN ends THEN CASE WHEN i THEN '*' ELSE '' END || CASE WHEN b THEN '**' ELSE '' END ELSE '' END AS piece FROM l)
SELECT p AS o_custkey, string_agg(piece, '' ORDER BY o) AS markdown FROM x GROUP BY 1"""
)
def nested_marks(spark, sf_dir):
    """The orders of a customer as runs of one paragraph, some bold, some italic."""
    runs = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderpriority", (F.col("o_orderkey") % 3 > 0).alias("bold"), (F.col("o_orderkey") % 2 == 0).alias("italic"))
    return documents.nested_marks(runs, "o_custkey", "o_orderkey", "o_orderpriority", {"bold": "**", "italic": "*"})


@query(
    """WITH t AS (SELECT 'r' || r_regionkey AS id, lower(r_name) AS a, '' AS b, '' AS c FROM region UNION ALL SELECT 'n' || n_nationkey, lower(r_name), lower(n_name), '' FROM nation JOIN region ON n_regionkey = r_regionkey
UNION ALL SELECT 'c' || c_custkey, lower(r_name), lower(n_name), lower(c_name) FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)
SELECT id, row_number() OVER (ORDER BY a, b, c) AS place FROM t"""
)
def siblings_in_order(spark, sf_dir):
    """Regions, nations and customers as a tree, titles of mixed case."""
    mixed = lambda name, key: F.when(F.col(key) % 2 == 0, F.lower(name)).otherwise(F.upper(name)).alias("title")
    part = lambda t, kind, key, up, name: table(spark, sf_dir, t).select(F.concat(F.lit(kind), F.col(key).cast("string")).alias("id"), up.alias("parent_id"), mixed(name, key))
    nodes = part("region", "r", "r_regionkey", F.lit(None).cast("string"), "r_name")
    nodes = nodes.unionByName(part("nation", "n", "n_nationkey", F.concat(F.lit("r"), F.col("n_regionkey").cast("string")), "n_name"))
    nodes = nodes.unionByName(part("customer", "c", "c_custkey", F.concat(F.lit("n"), F.col("c_nationkey").cast("string")), "c_name"))
    return trees.in_order(nodes).select("id", "place")


@query(
    """WITH r AS (SELECT p_partkey, p_name, row_number() OVER (PARTITION BY p_brand, lower(p_name) ORDER BY p_partkey) - 1 AS j FROM part)
SELECT p_partkey, p_name || CASE j WHEN 0 THEN '' WHEN 1 THEN ' 2' ELSE ' ' || (j + 2) END AS given FROM r"""
)
def names_in_arrival_order(spark, sf_dir):
    """Parts as notes of a folder per brand, where the first and the third number of every name are taken."""
    claims = table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("folder"), F.col("p_name").alias("name"), F.col("p_partkey").alias("ordinal"))
    taken = claims.select("folder", F.explode(F.array(F.concat("name", F.lit(" 1")), F.concat(F.upper("name"), F.lit(" 3")))).alias("name")).distinct()
    return in_arrival_order(claims, taken).select("p_partkey", "given")


@query(
    """SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN '---' || chr(10) || 'a: 1' || chr(10) || 'tags: "$' || c_name || '"' || chr(10) || 'b: 2' || chr(10) || '---' || chr(10) || 'body' WHEN 1 THEN '---' || chr(10) || 'a: 1' || chr(10) || 'tags: "$' || c_name || '"' || chr(10) || '---' || chr(10) || 'body'
  WHEN 2 THEN '---' || chr(10) || 'a: 1' || chr(10) || 'b: 2' || chr(10) || '---' || chr(10) || 'body' ELSE '---' || chr(10) || 'tags: "$' || c_name || '"' || chr(10) || '---' || chr(10) || 'tags: in the body' END AS note FROM customer"""
)
def property_set(spark, sf_dir):
    """A property replaced with its list, added, taken away, and set in a note without front matter."""
    kind = F.col("c_custkey") % 4
    listed = F.lit("---\na: 1\ntags:\n  - x\n  - y\nb: 2\n---\nbody")
    text = F.when(kind.isin(0, 2), listed).when(kind == 1, F.lit("---\na: 1\n---\nbody")).otherwise(F.lit("tags: in the body"))
    value = F.when(kind != 2, F.concat(F.lit("$"), "c_name"))
    return table(spark, sf_dir, "customer").select("c_custkey", tx.with_property(text, "tags", value).alias("note"))


@query(
    """SELECT c_custkey, 'x ![[' || CASE c_custkey % 3 WHEN 0 THEN 'Files $' || c_custkey || '/' ELSE '' END || c_name || ' a.png]] y ![[' || CASE c_custkey % 3 WHEN 0 THEN 'Files $' || c_custkey || '/' ELSE '' END || '$1.pdf]] ![](other/b.png) ![t](assets/c.png)' AS text FROM customer"""
)
def asset_embeds(spark, sf_dir):
    """Links of a bundle's text to its assets, put into a folder whose name looks like a pattern, or into the root."""
    folder = F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("Files $"), F.col("c_custkey").cast("string"))).when(F.col("c_custkey") % 3 == 1, "/")
    text = F.concat(F.lit("x ![](assets/"), "c_name", F.lit(" a.png) y ![](assets/$1.pdf) ![](other/b.png) ![t](assets/c.png)"))
    return table(spark, sf_dir, "customer").select("c_custkey", exports.asset_embeds(text, folder).alias("text"))
