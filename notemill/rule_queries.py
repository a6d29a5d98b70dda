"""Rules of notes, links, order and placement on the driver's tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from notemill.catalogue import query, table
from notemill.functions import dialects
from notemill.functions import text as tx
from notemill.operators import documents, grouping, links, notes, ordering, outlines, pages, trees
from notemill.plans import upsert
from notemill.sources import exports, files
from notemill.staging import new_path


@query(
    r"""SELECT doc_id, left(trim(list_filter(string_split(text, chr(10)), lambda s: trim(s) <> '')[1]), 200) AS line, CASE WHEN length(text) <= 200 THEN text ELSE regexp_replace(left(text, 200), '\s+\S*$', '') || '...' END AS cut,
  CAST(n_chars AS VARCHAR) AS num, source AS word, 'Lang' AS name, lang AS value, '**' || lang || '** [' || source || '](http://x/' || doc_id || ')' AS rich, CASE WHEN doc_id % 2 = 0 THEN '2024-03-03' ELSE 'March, 2024' END AS daily,
  '[ ] [[' || lang || ']] *it* ==' || source || '==' AS markup FROM documents"""
)
def text_rules(spark, sf_dir):
    lang, source, key = F.col("lang"), F.col("source"), F.col("doc_id").cast("string")
    none = F.lit(False)
    run = lambda t, bold, href: F.struct(t.alias("text"), F.lit(bold).alias("bold"), none.alias("italic"), none.alias("strikethrough"), none.alias("code"), href.alias("href"))
    no = F.lit(None).cast("string")
    runs = F.array(run(lang, True, no), run(F.lit(" "), False, no), run(source, False, F.concat(F.lit("http://x/"), key)))
    name, value = tx.attribute(F.concat(F.lit("Lang:: "), lang, F.lit(" ")))
    markup = F.concat(F.lit("{{[[TODO]]}} #[["), lang, F.lit("]] __it__ ^^"), source, F.lit("^^"))
    return table(spark, sf_dir, "documents").select(
        "doc_id", tx.first_line(F.col("text")).alias("line"), tx.clipped(F.col("text")).alias("cut"), tx.number_or_text(F.concat(F.lit(" "), F.col("n_chars").cast("string"))).alias("num"), tx.number_or_text(F.concat(source, F.lit(" "))).alias("word"),
        name.alias("name"), value.alias("value"), tx.rich_text(runs).alias("rich"), tx.page_date(F.when(F.col("doc_id") % 2 == 0, "March 3rd, 2024").otherwise("March, 2024")).alias("daily"), tx.outline_markup(markup).alias("markup"),
    )


@query(
    """SELECT event_id, CASE WHEN event_id % 2 = 0 THEN '- [x] ' ELSE '- [ ] ' END || event_type || ' 📅 ' || strftime(ts, '%Y-%m-%d') || CASE WHEN value > 100 THEN ' 🔼' ELSE '' END AS task,
  CASE WHEN event_id % 3 = 0 THEN strftime(ts, '%Y-%m-%d') ELSE strftime(ts, '%Y-%m-%dT%H:%M') END AS stamp FROM events WHERE event_id % 3 = 0 OR hour(ts) > 0 OR minute(ts) > 0"""
)
def task_lines(spark, sf_dir):
    ts, even = F.col("ts"), F.col("event_id") % 2 == 0
    rows = table(spark, sf_dir, "events").where("event_id % 3 = 0 OR hour(ts) > 0 OR minute(ts) > 0")
    shown = F.when(F.col("event_id") % 3 == 0, F.date_trunc("day", ts).cast("timestamp_ntz")).otherwise(ts)
    return rows.select("event_id", tx.task_line(F.col("event_type"), even, ts, F.lit(None).cast("timestamp"), F.col("value") > 100).alias("task"), tx.date_or_time(shown).alias("stamp"))


@query(
    """SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN 'Untitled Record' ELSE c_name END AS note_title,
  '---' || chr(10) || 'id: ' || c_custkey || CASE WHEN c_custkey % 3 = 0 THEN '' ELSE chr(10) || 'segment: "' || c_mktsegment || '"' END || chr(10) || 'tags:' || chr(10) || '  - "a"' || chr(10) || '  - "' || c_mktsegment || '"' || chr(10) || '---' || chr(10)
  || 'In ' || CASE WHEN c_custkey % 3 = 0 THEN '' ELSE c_mktsegment END || ': a, ' || c_mktsegment AS content FROM customer"""
)
def record_notes(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select(
        "c_custkey", F.when(F.col("c_custkey") % 5 != 0, F.col("c_name")).alias("name"), F.when(F.col("c_custkey") % 3 != 0, F.col("c_mktsegment")).alias("segment"), F.array(F.lit("a"), "c_mktsegment").alias("tags"), F.lit("").alias("blank")
    )
    made = notes.render(rows, "name", {"segment": "text", "tags": "multitext", "blank": "text"}, "In {{segment}}: {{tags}}", id_="c_custkey")
    return made.select("c_custkey", "note_title", "content")


@query(
    """SELECT l_orderkey, l_linenumber, l_suppkey, CASE WHEN l_suppkey % 4 = 3 THEN NULL WHEN l_suppkey % 4 = 2 THEN 'sup/' || l_suppkey || '.md' WHEN l_suppkey % 4 = 1 THEN 'Sup/' || l_suppkey || '.html' ELSE 'notes/' || l_suppkey || '.md' END AS path FROM lineitem"""
)
def path_links(spark, sf_dir):
    """Links beside the source, from the root, with another ending or case, and to nothing."""
    key, kind = F.col("l_suppkey").cast("string"), F.col("l_suppkey") % 4
    href = F.when(kind == 0, F.concat(F.lit("./"), key, F.lit(".md#part"))).when(kind == 1, F.concat(F.lit("/SUP/"), key)).when(kind == 2, F.concat(F.lit("../sup/"), key, F.lit("%2Emd"))).otherwise(F.concat(F.lit("none/"), key))
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", href.alias("href"), F.lit("notes").alias("folder"))
    own = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("k"), (F.col("s_suppkey") % 4).alias("m"))
    there = own.select(F.when(F.col("m") == 0, F.concat(F.lit("notes/"), "k", F.lit(".md"))).when(F.col("m") == 1, F.concat(F.lit("Sup/"), "k", F.lit(".html"))).when(F.col("m") == 2, F.concat(F.lit("sup/"), "k", F.lit(".md"))).alias("path")).where("path IS NOT NULL")
    return links.resolve_paths(rows, there).select("l_orderkey", "l_linenumber", "l_suppkey", "path")


@query(
    """WITH m AS (SELECT DISTINCT l_partkey FROM lineitem WHERE l_quantity > 45)
SELECT p_partkey, p_name || CASE WHEN m.l_partkey IS NOT NULL THEN ' ^' || p_partkey ELSE '' END AS text FROM part LEFT JOIN m ON p_partkey = l_partkey"""
)
def block_anchors(spark, sf_dir):
    blocks = table(spark, sf_dir, "part").select("p_partkey", F.col("p_partkey").cast("string").alias("block_id"), F.col("p_name").alias("text"))
    mentioned = table(spark, sf_dir, "lineitem").where("l_quantity > 45").select(F.col("l_partkey").cast("string").alias("block_id"))
    needed = links.defined_and_mentioned(blocks, mentioned).select("block_id")
    return notes.with_anchors(blocks, needed).select("p_partkey", "text")


@query(
    """WITH h AS (SELECT o_custkey, o_orderkey % 3 AS a, arg_min(o_orderstatus || o_orderkey, o_orderkey) AS heading FROM orders GROUP BY 1, 2)
SELECT o.o_orderkey, h.heading FROM orders o LEFT JOIN h ON o.o_custkey = h.o_custkey AND o.o_orderkey % 4 = h.a"""
)
def fragment_links(spark, sf_dir):
    rows = table(spark, sf_dir, "orders")
    key = F.col("o_orderkey")
    heads = rows.select(F.col("o_custkey").alias("doc"), F.concat(F.lit("h"), (key % 3).cast("string")).alias("anchor"), key.alias("pos"), F.concat("o_orderstatus", key.cast("string")).alias("text"))
    wanted = rows.select(F.col("o_custkey").alias("doc"), "o_orderkey", F.concat(F.lit("h"), (key % 4).cast("string")).alias("fragment"))
    return notes.resolve_fragments(wanted, heads).select("o_orderkey", "heading")


@query(
    """WITH w AS (SELECT o_custkey, o_orderkey // 200 AS sw, arg_max(o_orderstatus || o_orderkey, o_orderkey) AS line FROM orders GROUP BY 1, 2)
SELECT o_custkey, string_agg(line, chr(10) ORDER BY sw) AS text FROM w GROUP BY 1"""
)
def task_groups(spark, sf_dir):
    key = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("group_id"), F.floor(key / 200).alias("sort_weight"), F.concat("o_orderstatus", key.cast("string")).alias("line"), key.alias("ordinal"))
    return links.task_groups(rows).withColumnRenamed("group_id", "o_custkey")


@query(
    """SELECT (SELECT p_name FROM part WHERE p_partkey >= 3 ORDER BY p_partkey LIMIT 1) AS name, CAST(NULL AS VARCHAR) AS blank, (SELECT CAST(count(*) AS BIGINT) FROM part WHERE p_partkey % 4 <> 0) AS fetched,
  (SELECT CAST(count(*) AS DOUBLE) FROM part) AS expected"""
)
def import_estimates(spark, sf_dir):
    parts = table(spark, sf_dir, "part")
    shown = grouping.first_examples(parts.select("p_partkey", F.when(F.col("p_partkey") < 3, " ").otherwise(F.col("p_name")).alias("name"), F.lit("").alias("blank")), "p_partkey", "name", "blank")
    done = grouping.progress(parts.select(F.when(F.col("p_partkey") % 4 != 0, 1).cast("long").alias("fetched")))
    return shown.join(done)


_NEAR = ", ".join(f"last_value(CASE WHEN level <= {k} THEN level END IGNORE NULLS) OVER w AS l{k}, last_value(CASE WHEN level <= {k} THEN title END IGNORE NULLS) OVER w AS t{k}" for k in range(4))


@query(
    f"""WITH p AS (SELECT o_custkey, o_orderkey, o_orderkey * 7 % 5 AS level, o_orderstatus || o_orderkey AS title FROM orders),
n AS (SELECT *, {_NEAR} FROM p WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT o_orderkey, {" || ".join(f"CASE WHEN level > {k} AND l{k} = {k} THEN t{k} || '/' ELSE '' END" for k in range(4))} || title AS path FROM n"""
)
def page_levels(spark, sf_dir):
    key = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", (key * 7 % 5).cast("int").alias("level"), F.concat("o_orderstatus", key.cast("string")).alias("title"))
    return ordering.page_paths(rows, "o_custkey", "o_orderkey", "level", "title").select("o_orderkey", "path")


@query(
    """WITH RECURSIVE e AS (SELECT c_custkey AS src, (c_custkey * 3 + 1) % 120 AS dst FROM customer UNION ALL SELECT c_custkey, c_custkey // 2 FROM customer),
r AS (SELECT CAST(5 AS BIGINT) AS id UNION SELECT e.dst FROM r JOIN e ON e.src = r.id) SELECT id FROM r"""
)
def page_crawl(spark, sf_dir):
    key = F.col("c_custkey")
    edges = table(spark, sf_dir, "customer").select(key.alias("src"), F.explode(F.array((key * 3 + 1) % 120, F.floor(key / 2))).alias("dst"))
    return trees.crawl(spark.createDataFrame([(5,)], "id long"), edges).select("id")


@query(
    """SELECT p_type AS name, 'new' AS origin FROM part GROUP BY 1 UNION ALL SELECT p_brand, 'old' FROM part GROUP BY 1"""
)
def field_union(spark, sf_dir):
    parts = table(spark, sf_dir, "part")
    new = parts.select(F.col("p_type").alias("name")).distinct().withColumn("origin", F.lit("new"))
    old = parts.select(F.explode(F.array("p_type", "p_brand")).alias("name")).distinct().withColumn("origin", F.lit("old"))
    return ordering.first_wins(new, old, key="name")


@query(
    """WITH s AS (SELECT DISTINCT CASE WHEN o_totalprice > 200000 THEN 'large' ELSE 'done' END AS reason, o_orderpriority || ' ' || (o_orderkey % 50) AS name FROM orders WHERE o_totalprice > 200000 OR o_orderstatus = 'F'),
c AS (SELECT CASE WHEN o_totalprice > 200000 THEN 'large' ELSE 'done' END AS reason, count(*) AS n FROM orders WHERE o_totalprice > 200000 OR o_orderstatus = 'F' GROUP BY 1)
SELECT 'skipped' AS outcome, c.reason, c.n, (SELECT string_agg(name, ', ' ORDER BY name) FROM (SELECT name FROM s WHERE s.reason = c.reason ORDER BY name LIMIT 5)) AS names FROM c"""
)
def skipped_report(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").withColumn("name", F.concat("o_orderpriority", F.lit(" "), (F.col("o_orderkey") % 50).cast("string")))
    _, log = notes.kept_and_skipped(rows, "name", {"large": F.col("o_totalprice") > 200000, "done": F.col("o_orderstatus") == "F"})
    return notes.log_report(log)


@query(
    """SELECT p_partkey, '' AS vault, 'files' AS folder, 'Notes/' || p_brand AS note, 'Notes/' || p_brand || '/attachments' AS sub, 'b' || CASE WHEN p_partkey % 3 = 0 THEN p_partkey ELSE p_partkey // 3 END AS shared_id, p_size NOT IN (24, 10) AS is_new_type,
  CASE WHEN power(p_size * 5 - 250, 2) <= power(p_size * 5, 2) THEN 'red' ELSE 'black' END AS ink FROM part"""
)
def placement_rules(spark, sf_dir):
    key, note = F.col("p_partkey"), F.concat(F.lit("Notes/"), "p_brand")
    place = {alias: upsert.attachment_folder(mode, "files", note).alias(alias) for mode, alias in (("vault", "vault"), ("folder", "folder"), ("note", "note"), ("subfolder", "sub"))}
    block = F.concat(F.lit("b"), key.cast("string"))
    origin = F.when(key % 3 != 0, F.concat(F.lit("b"), F.floor(key / 3).cast("string")))
    rows = upsert.shared_blocks(table(spark, sf_dir, "part").withColumn("block_id", block).withColumn("synced_from", origin))
    known = spark.createDataFrame([(24,), (10,)], "name int")
    fresh = upsert.new_types(known, rows.select(F.col("p_size").alias("name")).distinct()).select(F.col("name").alias("p_size"), F.lit(True).alias("fresh"))
    rgb = F.concat(F.lpad(F.hex(F.col("p_size") * 5), 2, "0"), F.lit("0000"))
    ink = documents.nearest_colour(rgb, {"red": (250, 0, 0), "black": (0, 0, 0)})
    return rows.join(fresh, "p_size", "left").select("p_partkey", *place.values(), "shared_id", F.col("fresh").isNotNull().alias("is_new_type"), ink.alias("ink"))


@query(
    """SELECT 'p' || (p_partkey % 7) AS name, '.txt' AS ending, count(*) AS lines, CAST(sum(length(p_name) + 1) AS BIGINT) AS size, false AS encrypted, string_agg(p_name, chr(10) ORDER BY p_name) AS text FROM part GROUP BY p_partkey % 7"""
)
def folder_scan(spark, sf_dir):
    """Text files written by group, found again by a scan, decoded and told from encrypted ones."""
    out = new_path(spark, "scan")
    parts = table(spark, sf_dir, "part").select("p_name", F.concat(F.lit("p"), (F.col("p_partkey") % 7).cast("string")).alias("g"))
    parts.repartition("g").write.partitionBy("g").text(out)
    found = files.accepted(files.scan(spark, out), ["txt"])
    lines = F.split(F.regexp_replace(files.decoded(F.col("content")), r"\n$", ""), "\n")
    each = found.select(F.regexp_extract("path", "g=([^/]+)/", 1).alias("name"), F.concat(F.lit("."), "extension").alias("ending"), lines.alias("lines"), "size", files.is_encrypted(F.col("content")).alias("encrypted"))
    whole = each.groupBy("name", "ending", "encrypted").agg(F.sum(F.size("lines")).alias("lines"), F.sum("size").alias("size"), F.array_sort(F.flatten(F.collect_list("lines"))).alias("all"))
    return whole.select("name", "ending", "lines", "size", "encrypted", F.array_join("all", "\n").alias("text"))


@query(
    """SELECT md5('c' || c_custkey) AS id, n_name || '/' || c_name AS path, false AS has_children, c_name AS title FROM customer JOIN nation ON c_nationkey = n_nationkey
UNION ALL SELECT md5('n' || n_nationkey), n_name, EXISTS (SELECT 1 FROM customer WHERE c_nationkey = n_nationkey), n_name FROM nation"""
)
def page_folder_index(spark, sf_dir):
    nation = table(spark, sf_dir, "nation").select("n_nationkey", F.concat("n_name", F.lit(" "), F.md5(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")))).alias("n"))
    own = table(spark, sf_dir, "customer").join(F.broadcast(nation), F.expr("c_nationkey = n_nationkey"))
    below = own.select(F.concat("n", F.lit("/"), "c_name", F.lit(" "), F.md5(F.concat(F.lit("c"), F.col("c_custkey").cast("string"))), F.lit(".html")).alias("entry"))
    index = exports.html_export_index(below.unionByName(nation.select(F.concat("n", F.lit(".html")).alias("entry"))))
    return exports.chain_paths(index).join(exports.into_own_folder(index).select("id", "has_children", "title"), "id").select("id", "path", "has_children", "title")


@query(
    """SELECT page_id, CASE WHEN page_id % 2 = 0 THEN DATE '2024-03-04' END AS day, md5('x' || page_id) AS digest, html FROM pages WHERE page_id % 5 <> 0"""
)
def journal_pages(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    dated = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("<h1>Monday, 4 March 2024</h1>"), "html")).otherwise(F.col("html"))
    rows = pages.select("page_id", F.when(F.col("page_id") % 5 == 0, "Index.html").otherwise("entry.html").alias("name"), dated.alias("dated"), "html")
    url = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("data:text/plain;base64,"), F.base64(F.concat(F.lit("x"), F.col("page_id").cast("string")).cast("binary")))).otherwise(F.concat(F.lit("data:,%78"), F.col("page_id").cast("string")))
    return exports.journal_entries(rows, html="dated").select("page_id", "day", F.md5(files.data_url(url)).alias("digest"), "html")


@query("SELECT o_orderkey, 'Order ' || o_orderkey AS title, o_orderpriority || ' & more' AS text, CAST(o_orderdate AS DATE) AS created FROM orders")
def desktop_round_trip(spark, sf_dir):
    out = new_path(spark, "desktop")
    key = F.col("o_orderkey").cast("string")
    note = F.concat(
        F.lit("<note><title>Order "), key, F.lit("</title><text>"), "o_orderpriority", F.lit(" &amp; more</text><create-date>"), F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss"), F.lit(",1234567890+00:00</create-date><last-change-date>2024-01-01T00:00:00</last-change-date><tags><tag>a</tag><tag>b</tag></tags></note>")
    )
    made = table(spark, sf_dir, "orders").groupBy(F.floor(F.col("o_orderkey") / 1000).alias("file")).agg(F.concat(F.lit("<notes>"), F.array_join(F.collect_list(note), ""), F.lit("</notes>")).alias("notes"))
    made.write.partitionBy("file").text(out)
    read = exports.desktop_notes(spark, out)
    return read.select(F.substring("title", 7, 20).cast("long").alias("o_orderkey"), "title", "text", F.col("created").cast("date").alias("created"))


@query(
    """WITH n AS (SELECT n_nationkey, n_regionkey, n_name, count(*) AS k, string_agg('- ' || c_name || chr(10) || '    - ' || c_mktsegment, chr(10) ORDER BY c_custkey) AS items, string_agg(c_name || chr(10) || chr(10) || c_mktsegment, chr(10) || chr(10) ORDER BY c_custkey) AS single
FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2, 3)
SELECT r_name AS page, string_agg('## ' || n_name || chr(10) || chr(10) || CASE WHEN k > 1 THEN items ELSE single END, chr(10) || chr(10) ORDER BY n_nationkey) AS markdown FROM n JOIN region ON n_regionkey = r_regionkey GROUP BY 1"""
)
def outline_prose(spark, sf_dir):
    """Regions as pages, nations as headings, customers as blocks with one block below."""
    nation = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.expr("n_regionkey = r_regionkey")).select("n_nationkey", "n_name", F.col("r_name").alias("page"))
    own = table(spark, sf_dir, "customer").join(F.broadcast(nation), F.expr("c_nationkey = n_nationkey"))
    at = lambda *c: F.array(*[F.col(x).cast("int") if isinstance(x, str) else F.lit(x) for x in c])
    blocks = own.select("page", at("n_nationkey").alias("path"), F.concat(F.lit("## "), "n_name").alias("text")).distinct()
    blocks = blocks.unionByName(own.select("page", at("n_nationkey", "c_custkey").alias("path"), F.col("c_name").alias("text"))).unionByName(own.select("page", at("n_nationkey", "c_custkey", 0).alias("path"), F.col("c_mktsegment").alias("text")))
    return outlines.prose(blocks)


@query()
def page_trees(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", pages.page_tree_markdown(F.col("html")).alias("markdown"))


@query(
    """SELECT o_orderkey, CASE o_orderkey % 7 WHEN 0 THEN '[[DB:' || o_custkey || ']]' WHEN 1 THEN '[[PAGE:' || o_custkey || ']]'
  WHEN 2 THEN ' ' || strftime(o_orderdate, '%Y-%m-%d') || CASE WHEN o_custkey % 2 = 0 THEN ' → ' || strftime(o_orderdate + INTERVAL 3 DAY, '%Y-%m-%d') ELSE '' END || ' '
  WHEN 3 THEN '[' || CASE WHEN o_custkey % 2 = 0 THEN o_orderpriority ELSE 'plain' END || '](http://x/' || o_orderkey || ')'
  WHEN 4 THEN CASE WHEN o_custkey % 2 = 0 THEN ' [' || o_orderpriority || '](mailto:a@b.c) ' ELSE ' ' || o_orderpriority || ' ' END WHEN 5 THEN ' plain ' ELSE 'plain' END AS shown FROM orders"""
)
def mentions(spark, sf_dir):
    key, even, day = F.col("o_orderkey"), F.col("o_custkey") % 2 == 0, F.col("o_orderdate").cast("date")
    kinds = F.get(F.array(*[F.lit(k) for k in ("database", "page", "date", "link_mention", "user", "template", None)]), (key % 7).cast("int"))
    shown = dialects.mention(
        kinds, F.col("o_custkey").cast("string"), F.lit("plain"), F.date_format(day, "yyyy-MM-dd"), F.when(even, F.date_format(F.date_add(day, 3), "yyyy-MM-dd")),
        F.concat(F.lit("http://x/"), key.cast("string")), F.when(even, F.col("o_orderpriority")), F.col("o_orderpriority"), F.when(even, "a@b.c"),
    )
    return table(spark, sf_dir, "orders").select("o_orderkey", shown.alias("shown"))


@query(
    """SELECT o_orderkey, concat_ws(chr(10) || chr(10), CASE WHEN o_orderkey % 3 > 0 THEN '## ' || o_orderpriority END, CASE WHEN o_orderstatus <> 'P' THEN h || 'Summary' || chr(10) || chr(10) || o_orderpriority END,
  CASE WHEN o_orderstatus <> 'P' AND o_custkey % 2 = 0 THEN h || 'Notes' || chr(10) || chr(10) || o_orderstatus END, CASE WHEN o_orderstatus <> 'P' AND o_orderkey % 5 > 0 THEN h || 'Transcript' || chr(10) || chr(10) || o_custkey END) AS markdown
FROM (SELECT *, CASE WHEN o_orderkey % 3 > 0 THEN '### ' ELSE '## ' END AS h FROM orders)"""
)
def meetings(spark, sf_dir):
    """Orders as meetings of three sections each; some of those are blank, some missing."""
    key, orders = F.col("o_orderkey"), table(spark, sf_dir, "orders")
    ids = {f"{name}_id": key * 10 + k for k, name in enumerate(("summary", "notes", "transcript"))}
    status = F.when(F.col("o_orderstatus") == "P", "transcribing").when(F.col("o_orderstatus") == "O", "notes_ready")
    rows = orders.select(key.alias("block_id"), F.when(key % 3 > 0, F.col("o_orderpriority")).alias("title"), status.alias("status"), *[c.alias(n) for n, c in ids.items()])
    texts = F.array("o_orderpriority", F.when(F.col("o_custkey") % 2 == 0, F.col("o_orderstatus")).otherwise(" "), F.col("o_custkey").cast("string"))
    sections = orders.select("o_orderkey", F.posexplode(texts).alias("k", "markdown")).where("k < 2 OR o_orderkey % 5 > 0").select((key * 10 + F.col("k")).alias("section_id"), "markdown")
    return documents.meeting_notes(rows, sections).select(F.col("block_id").alias("o_orderkey"), "markdown")


@query(
    """SELECT event_id, CASE WHEN event_id % 5 = 0 THEN CASE WHEN event_id % 2 = 0 THEN chr(9) ELSE '' END || CASE WHEN event_id % 3 = 0 THEN '- [x] ' ELSE '- [ ] ' END
  WHEN event_id % 2 = 0 THEN chr(9) || CASE WHEN event_id % 3 = 0 THEN '1. ' ELSE '- ' END WHEN event_id % 7 BETWEEN 1 AND 6 THEN repeat('#', CAST(event_id % 7 AS INTEGER)) || ' ' ELSE '' END AS mark,
  CASE event_id % 4 WHEN 0 THEN 'important' WHEN 1 THEN 'tip' WHEN 2 THEN 'question' END AS callout, CASE WHEN event_id % 4 < 3 THEN event_type END AS title FROM events"""
)
def line_marks(spark, sf_dir):
    key = F.col("event_id")
    tag = lambda check, shape: F.struct(check.alias("checkable"), (key % 3 == 0).alias("completed"), shape.cast("int").alias("shape"), F.col("event_type").alias("label"))
    shape = F.get(F.array(*[F.lit(x) for x in (13, 21, 111, 99)]), (key % 4).cast("int"))
    tags = F.array(tag(key % 5 == 0, F.lit(17)), tag(F.lit(False), shape))
    tags = F.when(key % 5 == 0, tags).otherwise(F.slice(tags, 2, 1))
    mark = dialects.line_mark(F.concat(F.lit("H"), (key % 7).cast("string")), F.when(key % 2 == 0, key % 3 == 0), F.lit(1), tags)
    callout = dialects.line_callout(tags)
    return table(spark, sf_dir, "events").select("event_id", mark.alias("mark"), callout["type"].alias("callout"), callout["title"].alias("title"))


@query(
    """WITH l AS (SELECT user_id AS k, event_id AS n, (event_id * 7 + user_id) % 6 AS s, CASE event_type WHEN 'signup' THEN 'To Do' ELSE event_type END AS t FROM events),
h AS (SELECT k, n, CASE s WHEN 0 THEN 2 WHEN 1 THEN 4 ELSE 5 END AS level, t = 'To Do' AS todo FROM l WHERE s < 3 UNION ALL SELECT DISTINCT k, -1, 1, k % 4 = 0 FROM l),
e AS (SELECT h.k, h.n, h.todo, (SELECT min(g.n) FROM h g WHERE g.k = h.k AND g.n > h.n AND g.level <= h.level) AS until FROM h),
m AS (SELECT DISTINCT l.k, l.n FROM l JOIN e ON e.k = l.k AND e.n < l.n AND e.todo AND (until IS NULL OR until > l.n))
SELECT l.k AS user_id, l.n AS event_id, CASE s WHEN 0 THEN '## ' || t WHEN 1 THEN '#### ' || t WHEN 2 THEN '##### ' || t WHEN 5 THEN '*' || t || '*'
  ELSE '    - ' || CASE WHEN m.n IS NULL AND s = 4 THEN '~~' || t || '~~' WHEN m.n IS NULL THEN t WHEN s = 4 THEN '[x] ' || t ELSE '[ ] ' || t END END AS markdown FROM l LEFT JOIN m ON l.k = m.k AND l.n = m.n"""
)
def styled_lines(spark, sf_dir):
    """Events of a user as lines of a note: huge, large and bold ones are headings, sign-ups say to-do, as every fourth note's title."""
    style = ((F.col("event_id") * 7 + F.col("user_id")) % 6).cast("int")
    path = F.get(F.array(*[F.lit(x) for x in ("size:huge", "size:large", "bold", "note/list/list-item", "note/list/list-item/strikethrough", "italic")]), style)
    text = F.when(F.col("event_type") == "signup", "To Do").otherwise(F.col("event_type"))
    title = F.when(F.col("user_id") % 4 == 0, "My todo list").otherwise("User")
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", title.alias("title"), F.array(F.struct(path.alias("path"), text.alias("text"))).alias("sections"))
    return documents.sized_lines(rows, "user_id", "event_id").select("user_id", "event_id", "markdown")


@query(
    """SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN text ELSE '# Other' || chr(10) || text END AS body,
  CASE WHEN doc_id % 2 = 0 THEN '' ELSE '# Other' || chr(10) END || '<u>' || lang || '</u> #' || lang || '_' || source || ' `~no~ #no tag#`' || chr(10) || 'Row' || chr(10) || chr(10) || '|a|b|' || chr(10) || '|-|-|' || chr(10)
  || '![' || source || '|' || doc_id + 1 || 'x20](f.png)' || chr(10) || '```' || chr(10) || '~x~ #y z#' || chr(10) || '```' AS markdown FROM documents"""
)
def app_notes(spark, sf_dir):
    """Whole texts without a heading that says the title, and texts of every mark that the dialect has."""
    key, lang, source = F.col("doc_id"), F.col("lang"), F.col("source")
    title = F.concat(F.lit("Doc "), key.cast("string"))
    head = F.when(key % 2 == 0, F.concat(F.lit("# "), title, F.lit(" \n"))).otherwise("# Other\n")
    made = F.concat(
        head, F.lit("~"), lang, F.lit("~ #"), lang, F.lit(" "), source, F.lit("# `~no~ #no tag#`\nRow\n|a|b|\n|-|-|\n!["), source, F.lit('](f.png)<!-- {"width": '), (key + 1).cast("string"),
        F.lit(', "height": 20} -->\n```\n~x~ #y z#\n```'),
    )
    return table(spark, sf_dir, "documents").select("doc_id", dialects.without_title(F.concat(head, "text"), title).alias("body"), dialects.app_markdown(made, title).alias("markdown"))
