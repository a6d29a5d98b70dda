"""Every operator family on the driver's tables, beside the same query in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from notemill import formula_queries, function_queries, note_queries, reader_queries, rule_queries  # noqa: F401  (they register here as well)
from notemill.catalogue import QUERIES, SQL, query, table  # noqa: F401
from notemill.functions import formulas as fx
from notemill.functions import text as tx
from notemill.functions.rollups import rollup
from notemill.functions.values import date_kind, is_empty, number, truthy
from notemill.operators import documents, grouping, links, ordering, trees
from notemill.plans import upsert
from notemill.plans.views import Base, View
from notemill.sources import files, registry, tables
from notemill.staging import new_path
from notemill.streaming import imports

def _cents(x):
    return F.round(x, 2)


# --- templates and names -------------------------------------------------------


@query(
    """SELECT c.c_custkey, c.c_name AS title, 'Customers/' || n.n_name AS location,
  '---' || chr(10) || 'segment: "' || c.c_mktsegment || '"' || chr(10) || 'key: ' || c.c_custkey || chr(10) || '---' || chr(10) || '# ' || c.c_name || chr(10) || 'In ' || n.n_name || ' {{ unknown }}' AS content
FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey WHERE trim(c.c_name) <> ''"""
)
def note_template_customer(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").join(F.broadcast(table(spark, sf_dir, "nation")), F.expr("c_nationkey = n_nationkey"))
    data = {"name": F.col("c_name"), "nation": F.col("n_name")}
    head = tx.front_matter({"segment": F.col("c_mktsegment"), "key": F.col("c_custkey")})
    body = tx.fill_template("# {{name}}\nIn {{ nation }} {{ unknown }}", data)
    return rows.where(F.trim("c_name") != "").select("c_custkey", F.col("c_name").alias("title"), tx.fill_template("Customers/{{nation}}", data).alias("location"), F.concat(head, F.lit("\n"), body).alias("content"))


@query(
    """WITH r AS (SELECT p_partkey, lower(p_name) AS k, p_name, row_number() OVER (PARTITION BY lower(p_name) ORDER BY p_partkey) - 1 AS n FROM part)
SELECT p_partkey, CASE WHEN n = 0 THEN p_name ELSE p_name || ' ' || n END AS unique_name FROM r"""
)
def unique_note_names(spark, sf_dir):
    rows = table(spark, sf_dir, "part").withColumn("folder", F.lit("Parts"))
    return ordering.unique_names(rows, "folder", "p_name", "p_partkey").select("p_partkey", "unique_name")


@query("SELECT p_partkey, count(*) OVER (PARTITION BY lower(p_name)) = 1 AS is_unique, row_number() OVER (PARTITION BY lower(p_name) ORDER BY p_partkey) > 1 AS needs_path FROM part")
def basename_ambiguity(spark, sf_dir):
    rows = ordering.ambiguous(table(spark, sf_dir, "part"), "p_name")
    return ordering.collides(rows, "p_name", "p_partkey").select("p_partkey", "is_unique", "needs_path")


@query(
    r"""SELECT p_partkey, trim(regexp_replace(regexp_replace(replace(p_type || '/' || p_name, '/', '-'), '[?<>:*|"]', '', 'g'), '[\[\]#|^]', '', 'g')) || '.md' AS file, 'a-b/' || replace(p_brand, '#', '') AS folder FROM part"""
)
def sanitised_names(spark, sf_dir):
    name = tx.file_name(F.concat_ws("/", "p_type", "p_name"))
    folder = tx.file_path(F.concat(F.lit("a\\b//."), F.lit("/ /"), F.col("p_brand")))
    return table(spark, sf_dir, "part").select("p_partkey", F.concat(name, F.lit(".md")).alias("file"), F.replace(folder, F.lit("/Untitled"), F.lit("")).alias("folder"))


@query(
    """SELECT event_id, CASE event_id % 6 WHEN 0 THEN '' WHEN 1 THEN 'true' WHEN 2 THEN CAST(event_id AS VARCHAR) WHEN 3 THEN '"' || event_type || '"' WHEN 4 THEN '' ELSE '"a \\"b\\""' END AS yaml FROM events"""
)
def yaml_scalars(spark, sf_dir):
    m = F.col("event_id") % 6
    raw = F.when(m == 0, "null").when(m == 1, "TRUE").when(m == 2, F.col("event_id").cast("string")).when(m == 3, F.col("event_type")).when(m == 4, "").otherwise('a "b"')
    return table(spark, sf_dir, "events").select("event_id", tx.yaml_scalar(raw).alias("yaml"))


# --- formulas ------------------------------------------------------------------


@query(
    """SELECT p_partkey, upper(p_name) AS up, lower(p_brand) AS low, length(p_name) AS len, left(p_name, 3) AS l3, right(p_name, 3) AS r3, substring(p_name, 2, 4) AS mid,
  replace(p_name, 'a', '_') AS sub, left(p_name, 1) || 'ZZ' || substring(p_name, 4) AS rep, repeat(p_brand, 2) AS twice, p_name || ' & ' || CAST(p_size AS VARCHAR) AS cat,
  regexp_matches(p_name, '^[a-m]') AS early, regexp_replace(p_name, '[aeiou]', '', 'g') AS bare, strpos(p_name, 'e') AS at FROM part"""
)
def formula_scalar_text(spark, sf_dir):
    f, c = fx.TABLE, F.col
    return table(spark, sf_dir, "part").select(
        "p_partkey", f["UPPER"](c("p_name")).alias("up"), f["LOWER"](c("p_brand")).alias("low"), f["LEN"](c("p_name")).cast("long").alias("len"),
        f["LEFT"](c("p_name"), 3).alias("l3"), f["RIGHT"](c("p_name"), 3).alias("r3"), f["MID"](c("p_name"), 2, 4).alias("mid"),
        f["SUBSTITUTE"](c("p_name"), "a", "_").alias("sub"), f["REPLACE"](c("p_name"), 2, 2, "ZZ").alias("rep"), f["REPT"](c("p_brand"), 2).alias("twice"),
        f["CONCATENATE"](c("p_name"), " & ", c("p_size")).alias("cat"), f["REGEX_MATCH"](c("p_name"), "^[a-m]").alias("early"),
        f["REGEX_REPLACE"](c("p_name"), "[aeiou]", "").alias("bare"), f["FIND"]("e", c("p_name")).cast("long").alias("at"),
    )


@query(
    """SELECT l_orderkey, l_linenumber, abs(l_quantity - 25) AS a, CAST(ceil(l_extendedprice) AS BIGINT) AS ce, CAST(floor(l_extendedprice) AS BIGINT) AS fl, CAST(l_quantity AS BIGINT) % 7 AS m,
  CASE WHEN l_discount = 0 THEN NULL ELSE round(l_quantity / l_discount, 2) END AS ratio, round(power(l_discount, 2), 6) AS pw, round(sqrt(l_quantity), 6) AS sq, greatest(l_quantity, l_linenumber) AS mx, least(l_quantity, l_linenumber) AS mn,
  2 * CAST(ceil(l_quantity / 2) AS BIGINT) AS ev FROM lineitem"""
)
def formula_scalar_math(spark, sf_dir):
    f, p, q = fx.TABLE, fx.PAGE, F.col("l_quantity")
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", f["ABS"](q - 25).alias("a"), f["CEILING"](F.col("l_extendedprice")).alias("ce"), f["INT"](F.col("l_extendedprice")).alias("fl"),
        f["MOD"](q.cast("long"), F.lit(7).cast("long")).alias("m"), F.round(p["divide"](q, F.col("l_discount")), 2).alias("ratio"), F.round(f["POWER"](F.col("l_discount"), F.lit(2)), 6).alias("pw"),
        F.round(f["SQRT"](q), 6).alias("sq"), f["MAX"](q, F.col("l_linenumber").cast("double")).alias("mx"), f["MIN"](q, F.col("l_linenumber").cast("double")).alias("mn"), f["EVEN"](q).cast("long").alias("ev"),
    )


@query(
    """SELECT o_orderkey, year(o_orderdate) AS y, month(o_orderdate) AS mo, day(o_orderdate) AS d, dayofweek(o_orderdate) AS wd, strftime(o_orderdate, '%Y-%m-%d') AS ds,
  strftime(o_orderdate + INTERVAL 3 MONTH, '%Y-%m-%d') AS plus, strftime(o_orderdate - INTERVAL 10 DAY, '%d/%m/%Y') AS minus,
  monthname(o_orderdate) || ' ' || day(o_orderdate) || CASE WHEN day(o_orderdate) BETWEEN 11 AND 13 THEN 'th' WHEN day(o_orderdate) % 10 = 1 THEN 'st' WHEN day(o_orderdate) % 10 = 2 THEN 'nd' WHEN day(o_orderdate) % 10 = 3 THEN 'rd' ELSE 'th' END || ', ' || year(o_orderdate) AS long,
  date_diff('day', DATE '1992-01-01', CAST(o_orderdate AS DATE)) AS days, o_orderdate < TIMESTAMP '1995-06-01' AS early FROM orders"""
)
def formula_scalar_date(spark, sf_dir):
    f, d = fx.TABLE, F.col("o_orderdate")
    first = F.lit("1992-01-01").cast("timestamp_ntz")
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", f["YEAR"](d).cast("long").alias("y"), f["MONTH"](d).cast("long").alias("mo"), f["DAY"](d).cast("long").alias("d"), f["WEEKDAY"](d).cast("long").alias("wd"), f["DATESTR"](d).alias("ds"),
        f["DATETIME_FORMAT"](f["DATEADD"](d, 3, "months"), "YYYY-MM-DD").alias("plus"), f["DATETIME_FORMAT"](fx.date_subtract(d, 10, "days"), "DD/MM/YYYY").alias("minus"),
        f["DATETIME_FORMAT"](d, "MMMM Do, YYYY").alias("long"), f["DATETIME_DIFF"](F.date_trunc("day", d).cast("timestamp_ntz"), first, "days").alias("days"),
        f["IS_BEFORE"](d, F.lit("1995-06-01").cast("timestamp_ntz")).alias("early"),
    )


@query(
    """SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN 'owed' ELSE 'owing' END AS state, (c_acctbal <> 0 AND c_mktsegment <> '') AS both_set, (c_acctbal > 5000 OR c_nationkey = 0) AS either,
  (c_nationkey <> 0) <> (c_acctbal > 5000) AS one, CASE c_mktsegment WHEN 'BUILDING' THEN 1 WHEN 'MACHINERY' THEN 2 ELSE 0 END AS code, TRY_CAST(c_name AS DOUBLE) AS num, (c_nationkey = 0) AS zero FROM customer"""
)
def formula_scalar_logic(spark, sf_dir):
    f, rich, home = fx.TABLE, F.col("c_acctbal") > 5000, F.col("c_nationkey")
    return table(spark, sf_dir, "customer").select(
        "c_custkey", f["IF"](F.col("c_acctbal") > 0, "owed", "owing").alias("state"), f["AND"](truthy(F.col("c_acctbal"), "number"), ~is_empty(F.col("c_mktsegment"))).alias("both_set"),
        f["OR"](rich, home == 0).alias("either"), f["XOR"](truthy(home, "number"), rich).alias("one"), f["SWITCH"](F.col("c_mktsegment"), "BUILDING", 1, "MACHINERY", 2, 0).alias("code"),
        f["VALUE"](F.col("c_name")).alias("num"), f["NOT"](home, kind="number").alias("zero"),
    )


@query(
    """SELECT l_orderkey, round(sum(l_quantity), 2) AS s, round(avg(l_quantity), 6) AS a, CAST(count(*) AS INTEGER) AS n, max(l_quantity) AS mx, min(l_quantity) AS mn, median(l_quantity) AS md,
  string_agg(CAST(CAST(l_quantity AS BIGINT) AS VARCHAR), '; ' ORDER BY l_linenumber, l_quantity) AS joined, CAST(count(DISTINCT l_quantity) AS INTEGER) AS distinct_n FROM lineitem GROUP BY l_orderkey"""
)
def formula_aggregate_list(spark, sf_dir):
    own = grouping.grouped(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_linenumber", "l_quantity")
    v = F.transform("rows", lambda x: x["l_quantity"])
    shown = F.transform(v, lambda x: x.cast("long").cast("string"))
    p = fx.PAGE
    return own.select(
        "l_orderkey", F.round(p["sum"](v), 2).alias("s"), F.round(p["mean"](v), 6).alias("a"), fx.list_count(v).alias("n"), p["max"](v).alias("mx"), p["min"](v).alias("mn"),
        p["median"](v).alias("md"), fx.TABLE["ARRAYJOIN"](shown, "; ").alias("joined"), F.size(fx.TABLE["ARRAYUNIQUE"](v)).alias("distinct_n"),
    )


@query("SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, coalesce(TRY_CAST(json_extract_string(props, '$.k') AS BIGINT), 0) > 20 AS big FROM events")
def variant_property(spark, sf_dir):
    k = F.try_variant_get(F.parse_json("props"), "$.k", "bigint")
    return table(spark, sf_dir, "events").select("event_id", k.alias("k"), (F.coalesce(k, F.lit(0)) > 20).alias("big"))


@query(
    """SELECT o_orderpriority AS property, CASE WHEN bool_or(o_orderstatus = 'P') THEN 'text' WHEN bool_or(o_totalprice > 100000) THEN 'datetime' ELSE 'date' END AS kind FROM orders GROUP BY 1"""
)
def type_inference_dates(spark, sf_dir):
    rows = table(spark, sf_dir, "orders")
    start = F.when(F.col("o_totalprice") > 100000, "2020-01-01T10:00").otherwise("2020-01-01")
    end = F.when(F.col("o_orderstatus") == "P", "2020-02-01")
    return rows.groupBy(F.col("o_orderpriority").alias("property")).agg(date_kind(start, end).alias("kind"))


# --- links, lookups, rollups ---------------------------------------------------


def _order_links(spark, sf_dir):
    """Customers as records that link to their orders, in the orders' order."""
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey")
    pos = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")) - 1
    made = orders.select(F.col("o_custkey").alias("c_custkey"), pos.alias("pos"), F.col("o_orderkey").alias("target"))
    return table(spark, sf_dir, "customer").select("c_custkey").join(made, "c_custkey", "left")


_ROLLUP = "FROM customer c LEFT JOIN orders o ON c.c_custkey = o.o_custkey GROUP BY c.c_custkey"


@query(
    f"""SELECT c.c_custkey, count(o.o_orderkey) AS n, count(CASE WHEN o.o_orderstatus <> '' THEN 1 END) AS filled, count(CASE WHEN o.o_orderkey IS NOT NULL AND coalesce(o.o_orderstatus, '') = '' THEN 1 END) AS empty,
  count(DISTINCT o.o_orderstatus) AS uniq, CASE WHEN count(o.o_orderkey) = 0 THEN 0.0 ELSE 100.0 * count(CASE WHEN o.o_orderstatus <> '' THEN 1 END) / count(o.o_orderkey) END AS pct,
  string_agg(o.o_orderstatus, ', ' ORDER BY o.o_orderkey) IS NULL AS bare, coalesce(string_agg(o.o_orderstatus, ', ' ORDER BY o.o_orderkey), '') AS joined {_ROLLUP}"""
)
def rollup_counts(spark, sf_dir):
    targets = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("target"), "o_orderstatus")
    out = rollup(_order_links(spark, sf_dir), targets, "c_custkey", "target", "o_orderstatus", n="count", filled="count_filled", empty="empty", uniq="unique", pct="percent_not_empty", joined="ARRAYJOIN")
    return out.withColumn("bare", F.col("n") == 0)


@query(f"SELECT c.c_custkey, round(coalesce(sum(o.o_totalprice), 0), 2) AS total, round(avg(o.o_totalprice), 7) AS mean, max(o.o_totalprice) AS most, min(o.o_totalprice) AS least, count(o.o_totalprice) AS n {_ROLLUP}")
def rollup_numbers(spark, sf_dir):
    targets = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("target"), "o_totalprice")
    out = rollup(_order_links(spark, sf_dir), targets, "c_custkey", "target", "o_totalprice", total="SUM", mean="AVERAGE", most="MAX", least="MIN", n="COUNT")
    return out.withColumns({"total": _cents("total"), "mean": F.round("mean", 7)})


@query(
    f"""SELECT c.c_custkey, CAST(min(o.o_orderdate) AS DATE) AS first, CAST(max(o.o_orderdate) AS DATE) AS last,
  strftime(min(o.o_orderdate), '%Y-%m-%d') || ' → ' || strftime(max(o.o_orderdate), '%Y-%m-%d') AS span {_ROLLUP}"""
)
def rollup_dates(spark, sf_dir):
    targets = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("target"), "o_orderdate")
    return rollup(_order_links(spark, sf_dir), targets, "c_custkey", "target", "o_orderdate", first="earliest_date", last="latest_date", span="date_range")


@query("SELECT o.o_orderkey, coalesce(c.c_name, '') AS names FROM orders o LEFT JOIN customer c ON o.o_custkey = c.c_custkey")
def lookup_through_link(spark, sf_dir):
    records = table(spark, sf_dir, "orders").select("o_orderkey", F.array("o_custkey").alias("linked"))
    targets = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("target"), F.col("c_name").alias("names"))
    return links.lookup(links.edges(records, "o_orderkey", "linked"), targets, "o_orderkey", "names", ", ")


@query(
    """SELECT o.o_orderkey, CASE WHEN c.c_custkey % 3 = 0 THEN '[[Customers/' || c.c_name || ']]' WHEN c.c_custkey % 3 = 1 THEN replace(c.c_name, '#', '') ELSE 'Unknown record ' || o.o_custkey END AS link
FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey"""
)
def link_left_outer_fallback(spark, sf_dir):
    people = table(spark, sf_dir, "customer")
    known = people.where("c_custkey % 3 = 0").select(F.col("c_custkey").alias("target"), F.concat(F.lit("Customers/"), "c_name", F.lit(".md")).alias("path"))
    titled = people.where("c_custkey % 3 = 1").select(F.col("c_custkey").alias("target"), F.col("c_name").alias("title"))
    edges = links.edges(table(spark, sf_dir, "orders").select("o_orderkey", F.array("o_custkey").alias("linked")), "o_orderkey", "linked")
    return links.resolve_links(edges, known, titled).select("o_orderkey", "link")


@query("SELECT DISTINCT o_custkey AS target FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)")
def missing_targets_anti(spark, sf_dir):
    linked = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("target"))
    return links.missing_targets(linked, table(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("target")))


_VIEWS = [("open", "[[Orders#Open]]", 0), ("done", "[[Orders#Done]]", 1), ("urgent", "[[Orders#Urgent]]", 2), ("all", "[[Orders#All]]", 3)]


def _record_view(spark, sf_dir):
    rows = table(spark, sf_dir, "orders")
    shown = F.array(F.when(F.col("o_orderstatus") == "O", "open"), F.when(F.col("o_orderstatus") == "F", "done"), F.when(F.col("o_orderpriority") == "1-URGENT", "urgent"), F.when(F.col("o_totalprice") > 0, "all"))
    return rows.select(F.col("o_orderkey").alias("record_id"), F.explode(F.array_compact(shown)).alias("view_id"))


@query(
    """SELECT o_orderkey AS record_id, concat_ws(', ', CASE WHEN o_orderstatus = 'O' THEN '[[Orders#Open]]' END, CASE WHEN o_orderstatus = 'F' THEN '[[Orders#Done]]' END,
  CASE WHEN o_orderpriority = '1-URGENT' THEN '[[Orders#Urgent]]' END) AS views FROM orders WHERE o_orderstatus IN ('O', 'F') OR o_orderpriority = '1-URGENT'"""
)
def view_membership(spark, sf_dir):
    views = spark.createDataFrame([v for v in _VIEWS if v[0] != "all"], "view_id string, token string, ordinal int")
    return links.view_memberships(_record_view(spark, sf_dir), F.broadcast(views)).select("record_id", F.array_join("views", ", ").alias("views"))


@query("SELECT 'all' AS view_id, 'orders' AS table_id WHERE (SELECT count(*) FROM orders WHERE o_totalprice > 0) = (SELECT count(*) FROM orders)")
def view_redundancy(spark, sf_dir):
    records = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("record_id"), F.lit("orders").alias("table_id"), F.lit(False).alias("is_empty"))
    return links.views_showing_all(_record_view(spark, sf_dir), records)


@query("SELECT o_orderkey, o_totalprice, round(o_totalprice * 0.1, 3) AS tenth FROM orders WHERE o_orderstatus = 'O' AND o_totalprice > 1000")
def saved_view(spark, sf_dir):
    base = Base([View("all"), View("open", F.col("o_orderstatus") == "O", ["o_orderkey", "o_totalprice", "tenth"])], {"tenth": F.round(F.col("o_totalprice") * 0.1, 3)}, F.col("o_totalprice") > 1000)
    return base.apply(table(spark, sf_dir, "orders"), "open")


@query(
    """WITH e AS (SELECT event_id, event_id % 50 AS target FROM events), t AS (SELECT event_id AS target, 'E/' || event_type || '-' || event_id AS path FROM events WHERE event_id < 40)
SELECT e.event_id, 'see ' || coalesce('[[' || t.path || ']]', 'Untitled ' || e.target) || ' twice ' || coalesce('[[' || t.path || ']]', 'Untitled ' || e.target) AS text FROM e LEFT JOIN t USING (target)"""
)
def mention_rewrite(spark, sf_dir):
    rows = table(spark, sf_dir, "events")
    mark = F.concat(F.lit("[[PAGE:"), (F.col("event_id") % 50).cast("string"), F.lit("]]"))
    notes = rows.select("event_id", F.concat(F.lit("see "), mark, F.lit(" twice "), mark).alias("text"))
    targets = rows.where("event_id < 40").select(F.col("event_id").cast("string").alias("target"), F.concat(F.lit("E/"), "event_type", F.lit("-"), "event_id", F.lit(".md")).alias("path"))
    return links.rewrite_mentions(notes, targets, "event_id", "text", r"\[\[PAGE:([^\]]+)\]\]")


@query("SELECT c_name AS title, CASE WHEN count(*) = 1 THEN min(CAST(c_custkey AS VARCHAR)) END AS path FROM (SELECT left(c_name, length(c_name) - c_custkey % 2) AS c_name, c_custkey FROM customer) GROUP BY 1")
def ambiguous_titles(spark, sf_dir):
    cut = F.left("c_name", (F.length("c_name") - F.col("c_custkey") % 2).cast("int"))
    return links.unique_titles(table(spark, sf_dir, "customer").select(cut.alias("title"), F.col("c_custkey").cast("string").alias("path")))


# --- trees ---------------------------------------------------------------------


def _places(spark, sf_dir):
    """Regions, nations and customers as one tree."""
    region, nation, customer = (table(spark, sf_dir, n) for n in ("region", "nation", "customer"))
    return (
        region.select(F.concat(F.lit("r"), "r_regionkey").alias("id"), F.lit(None).cast("string").alias("parent_id"), F.col("r_name").alias("title"))
        .unionByName(nation.select(F.concat(F.lit("n"), "n_nationkey").alias("id"), F.concat(F.lit("r"), "n_regionkey").alias("parent_id"), F.col("n_name").alias("title")))
        .unionByName(customer.select(F.concat(F.lit("c"), "c_custkey").alias("id"), F.concat(F.lit("n"), "c_nationkey").alias("parent_id"), F.col("c_name").alias("title")))
    )


_PLACES = """WITH RECURSIVE t AS (SELECT 'r' || r_regionkey AS id, NULL AS parent_id, r_name AS title FROM region UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, n_name FROM nation
UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey, c_name FROM customer), w AS (SELECT id, title AS path, 0 AS depth FROM t WHERE parent_id IS NULL UNION ALL SELECT t.id, w.path || '/' || t.title, w.depth + 1 FROM t JOIN w ON t.parent_id = w.id)"""


@query(f"{_PLACES} SELECT id AS node, path, depth FROM w")
def folder_paths(spark, sf_dir):
    return trees.paths(_places(spark, sf_dir))


@query(
    """SELECT 'r' || n_regionkey AS id, CAST(count(c_custkey) AS BIGINT) AS total FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY 1
UNION ALL SELECT 'n' || n_nationkey, count(c_custkey) FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY 1 UNION ALL SELECT 'c' || c_custkey, 1 FROM customer"""
)
def subtree_counts(spark, sf_dir):
    nodes = _places(spark, sf_dir)
    return trees.subtree_sums(nodes, nodes.where("id LIKE 'c%'").select("id", F.lit(1).alias("n")))


@query(
    f"""{_PLACES}, hit AS (SELECT id, parent_id FROM t WHERE contains(lower(title), 'n_1')) SELECT t.id, t.title FROM t WHERE t.id IN (SELECT id FROM hit) OR t.parent_id IN (SELECT id FROM hit)
OR t.parent_id IN (SELECT id FROM t WHERE parent_id IN (SELECT id FROM hit)) OR t.id IN (SELECT parent_id FROM hit) OR t.id IN (SELECT p.parent_id FROM hit JOIN t p ON hit.parent_id = p.id)"""
)
def tree_search(spark, sf_dir):
    return trees.search(_places(spark, sf_dir), "N_1").select("id", "title")


@query(f"{_PLACES} SELECT DISTINCT id AS id FROM t WHERE id LIKE 'r%' AND id IN (SELECT parent_id FROM t WHERE id IN (SELECT parent_id FROM t WHERE id = 'c1' OR id = 'c7')) UNION SELECT parent_id FROM t WHERE id = 'c1' OR id = 'c7'")
def has_descendants(spark, sf_dir):
    nodes = _places(spark, sf_dir)
    return trees.has_descendant(nodes, nodes.where("id IN ('c1', 'c7')").select("id"))


@query(
    "SELECT n_name AS page, string_agg('    - ' || c_name, chr(10) ORDER BY c_custkey) AS items FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1"
)
def outline_customers(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").join(F.broadcast(table(spark, sf_dir, "nation")), F.expr("c_nationkey = n_nationkey"))
    blocks = rows.select("n_name", F.array(F.lit(0), F.col("c_custkey").cast("int")).alias("at"), "c_name")
    return trees.outline(blocks, "n_name", "at", "c_name").select(F.col("n_name").alias("page"), F.col("markdown").alias("items"))


# --- order ---------------------------------------------------------------------


@query(
    """WITH m AS (SELECT user_id, ts, event_id, event_type, lag(event_type) OVER w IS DISTINCT FROM event_type OR row_number() OVER w = 1 AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
r AS (SELECT *, sum(CASE WHEN new THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM m)
SELECT user_id, CAST(run AS BIGINT) AS run, event_type, string_agg(CAST(event_id AS VARCHAR), ' ' ORDER BY ts, event_id) AS ids, count(*) AS n FROM r GROUP BY user_id, run, event_type"""
)
def adjacent_run_merge(spark, sf_dir):
    rows = table(spark, sf_dir, "events").withColumn("ids", F.col("event_id").cast("string"))
    return ordering.merge_runs(rows, "user_id", ["ts", "event_id"], ["event_type"], "ids", " ")


@query(
    """WITH m AS (SELECT user_id, ts, event_id, event_type = 'click' AS item, sum(CASE WHEN event_type <> 'click' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS island FROM events)
SELECT event_id, CASE WHEN item THEN row_number() OVER (PARTITION BY user_id, island, item ORDER BY ts, event_id) END AS number FROM m"""
)
def list_numbering(spark, sf_dir):
    by = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", (F.col("event_type") == "click").alias("item"), F.lit(0).alias("level"), F.row_number().over(by).alias("place"))
    return ordering.number_list(rows, "user_id", "place", "level", "item").select("event_id", F.col("number").cast("long").alias("number"))


@query(
    """SELECT conv_id, string_agg('**' || role || '**' || chr(10) || '> ' || replace(coalesce(text, ''), chr(10), chr(10) || '> '), chr(10) || chr(10) ORDER BY turn) AS markdown FROM conversations GROUP BY conv_id"""
)
def conversation_notes(spark, sf_dir):
    line = F.concat(F.lit("**"), "role", F.lit("**\n"), documents.quoted(F.coalesce("text", F.lit(""))))
    rows = grouping.grouped(table(spark, sf_dir, "conversations").withColumn("line", line), "conv_id", "turn", "line")
    return rows.select("conv_id", F.array_join(F.transform("rows", lambda x: x["line"]), "\n\n").alias("markdown"))


@query(
    """WITH b AS (SELECT user_id, event_id, row_number() OVER w AS o, CASE event_type WHEN 'click' THEN 'bulleted_list_item' WHEN 'view' THEN 'to_do' ELSE 'paragraph' END AS kind FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT *, lead(kind) OVER (PARTITION BY user_id ORDER BY o) AS nxt FROM b)
SELECT user_id AS page_id, string_agg(CASE kind WHEN 'bulleted_list_item' THEN '- ' WHEN 'to_do' THEN CASE WHEN event_id % 2 = 0 THEN '- [x] ' ELSE '- [ ] ' END ELSE '' END || 'e' || event_id ||
  CASE WHEN nxt IS NULL THEN '' WHEN nxt = kind AND kind <> 'paragraph' THEN chr(10) ELSE chr(10) || chr(10) END, '' ORDER BY o) AS markdown FROM s GROUP BY user_id"""
)
def block_pages(spark, sf_dir):
    by = Window.partitionBy("user_id").orderBy("ts", "event_id")
    kind = F.when(F.col("event_type") == "click", "bulleted_list_item").when(F.col("event_type") == "view", "to_do").otherwise("paragraph")
    none = F.lit(None).cast("string")
    blocks = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("page_id"), F.row_number().over(by).alias("ordinal"), kind.alias("type"), F.concat(F.lit("e"), "event_id").alias("text"), F.lit(0).alias("depth"),
        (F.col("event_id") % 2 == 0).alias("checked"), none.alias("language"), none.alias("url"),
    )
    return documents.page_markdown(blocks)


@query(
    "SELECT r_name, '| ' || 'nation' || ' | ' || 'key' || ' |' || chr(10) || '| --- | --- |' || chr(10) || string_agg('| ' || n_name || ' | ' || CASE WHEN n_nationkey % 2 = 0 THEN CAST(n_nationkey AS VARCHAR) ELSE '' END || ' |', chr(10) ORDER BY n_nationkey) AS markdown FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name"
)
def pipe_tables(spark, sf_dir):
    region, nation = table(spark, sf_dir, "region"), table(spark, sf_dir, "nation")
    head = region.select("r_name", F.lit(-1).alias("o"), F.array(F.lit("nation"), F.lit("key")).alias("cells"))
    cells = F.when(F.col("n_nationkey") % 2 == 0, F.array("n_name", F.col("n_nationkey").cast("string"))).otherwise(F.array("n_name"))
    body = nation.join(F.broadcast(region), F.expr("n_regionkey = r_regionkey")).select("r_name", F.col("n_nationkey").alias("o"), cells.alias("cells"))
    return documents.pipe_table(head.unionByName(body), "r_name", "o", "cells")


# --- text ----------------------------------------------------------------------


@query(
    r"""WITH t AS (SELECT doc_id, text || chr(10) || 'see #' || lang || ' and #' || source || ' not `#code` nor #123 or a#b' AS t FROM documents),
o AS (SELECT doc_id, regexp_replace(regexp_replace(t, '(?s)```.*?(```|$)', ' ', 'g'), '`[^`\n]*`', ' ', 'g') AS o FROM t)
SELECT doc_id, array_to_string(list_sort(list_distinct(list_filter(regexp_extract_all(o, '(?:^|\s)#([\p{L}\p{M}\p{N}_/-]+)', 1), lambda x: NOT regexp_matches(x, '^[0-9]+$')))), ', ') AS tags FROM o"""
)
def tag_extract(spark, sf_dir):
    text = F.concat("text", F.lit("\nsee #"), "lang", F.lit(" and #"), "source", F.lit(" not `#code` nor #123 or a#b"))
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(F.array_sort(tx.inline_tags(text)), ", ").alias("tags"))


@query("SELECT doc_id, CAST(doc_id AS VARCHAR) || ',' || CAST(doc_id % 7 AS VARCHAR) AS ids FROM documents")
def placeholder_extract(spark, sf_dir):
    text = F.concat("text", F.lit(" [[PAGE:"), "doc_id", F.lit("]] [[DB:1]] [[PAGE:"), F.col("doc_id") % 7, F.lit("]]"))
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(tx.placeholder_ids(text, "PAGE"), ",").alias("ids"))


@query("SELECT doc_id, '_' || doc_id || '-' || lang AS dashed, lang || ',' || source AS merged FROM documents")
def tag_rules(spark, sf_dir):
    dashed = tx.dashed_tag(F.concat(F.lit("#"), "doc_id", F.lit(" "), "lang", F.lit("!?")))
    merged = tx.merge_tags(F.array("lang", F.concat(F.lit("#"), F.upper("lang"))), F.array("source", F.lit("#")))
    return table(spark, sf_dir, "documents").select("doc_id", dashed.alias("dashed"), F.array_join(merged, ",").alias("merged"))


@query(
    "SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(replace(replace(replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&apos;', ''''), '&amp;', '&'), '\\s+', ' ', 'g')) AS title, CAST(len(regexp_extract_all(html, '(?is)<a\\b[^>]*>.*?</a>')) AS INTEGER) AS links, CAST(len(regexp_extract_all(html, '(?is)<h[1-6][^>]*>.*?</h[1-6]>')) AS INTEGER) AS heads FROM pages"
)
def html_titles(spark, sf_dir):
    n = lambda p: F.size(F.regexp_extract_all("html", F.lit(p), F.lit(0)))
    return table(spark, sf_dir, "pages").select("page_id", documents.page_title(F.col("html")).alias("title"), n(r"(?is)<a\b[^>]*>.*?</a>").alias("links"), n(r"(?is)<h[1-6][^>]*>.*?</h[1-6]>").alias("heads"))


@query(
    """WITH h AS (SELECT page_id, unnest(regexp_extract_all(html, '(?is)<h[1-6][^>]*>.*?</h[1-6]>')) AS h, generate_subscripts(regexp_extract_all(html, '(?is)<h[1-6][^>]*>.*?</h[1-6]>'), 1) - 1 AS pos FROM pages)
SELECT page_id, CAST(pos AS INTEGER) AS pos, CAST(substring(h, 3, 1) AS INTEGER) AS level, trim(regexp_replace(replace(replace(replace(replace(replace(replace(replace(regexp_replace(h, '(?s)<[^>]*>', '', 'g'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&apos;', ''''), '&amp;', '&'), '\\s+', ' ', 'g')) AS text FROM h"""
)
def html_headings(spark, sf_dir):
    return documents.headings(table(spark, sf_dir, "pages")).drop("anchor")


def _quote(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _unescaped_sql(text: str) -> str:
    for name, char in documents.ENTITIES.items():
        text = f"replace({text}, {_quote(name)}, {_quote(char)})"
    return text


def _markdown_sql(text: str) -> str:
    for pattern, new in documents.HTML_STEPS:
        text = f"regexp_replace({text}, {_quote(pattern)}, {_quote(new)}, 'g')"
    return f"regexp_replace({_unescaped_sql(text)}, '^\\s+|\\s+$', '', 'g')"


_ANCHORS = r"regexp_extract_all(html, '(?is)<a\b[^>]*>.*?</a>')"


@query(
    rf"""WITH l AS (SELECT page_id, unnest({_ANCHORS}) AS a, generate_subscripts({_ANCHORS}, 1) - 1 AS pos FROM pages),
h AS (SELECT page_id, CAST(pos AS INTEGER) AS pos, {_unescaped_sql("replace(regexp_extract(a, '(?is)^<a[^>]*[^>a-zA-Z0-9_]href[ ]*=[ ]*[" + '"' + "'']([^" + '"' + "'']*)[" + '"' + "'']', 1), chr(92), '/')")} AS href,
  trim(regexp_replace({_unescaped_sql("regexp_replace(a, '(?s)<[^>]*>', '', 'g')")}, '\s+', ' ', 'g')) AS text FROM l)
SELECT * FROM h WHERE href <> ''"""
)
def html_links(spark, sf_dir):
    return documents.hyperlinks(table(spark, sf_dir, "pages"))


@query(f"SELECT page_id, {_markdown_sql("coalesce(nullif(regexp_extract(html, '(?is)<body[^>]*>(.*)</body>', 1), ''), html)")} AS markdown FROM pages")
def html_markdown(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", documents.html_markdown(F.col("html")).alias("markdown"))


@query("SELECT p_partkey, '../' || p_brand || '/' || p_size AS rel, p_brand || '/' || p_size AS normal FROM part")
def path_rules(spark, sf_dir):
    source, target = F.concat(F.lit("a/"), "p_type", F.lit("/x.md")), F.concat(F.lit("a/"), "p_brand", F.lit("/"), "p_size")
    messy = F.concat(F.lit("./gone/../"), "p_brand", F.lit("//./"), "p_size")
    return table(spark, sf_dir, "part").select("p_partkey", tx.relative_path(source, target).alias("rel"), tx.normal_path(messy).alias("normal"))


# --- upsert --------------------------------------------------------------------


def _events_as_notes(spark, sf_dir):
    rows = table(spark, sf_dir, "events")
    notes = rows.select(F.lit("E").alias("folder"), F.concat("event_type", F.lit("-"), "event_id").alias("title"), F.concat(F.lit("s"), "event_id").alias("source_id"), F.col("event_id").alias("mtime"), F.col("props").alias("content"), F.col("event_id").alias("ordinal"))
    state = rows.where("event_id % 2 = 0").select(
        F.concat(F.lit("Old/"), "event_id", F.lit(".md")).alias("path"), F.concat(F.lit("s"), "event_id").alias("source_id"),
        (F.col("event_id") + F.col("event_id") % 3 - 1).alias("mtime"), F.col("props").alias("content"),
    )
    return notes, state


_DISPOSITION = """SELECT event_id AS ordinal, CASE WHEN event_id % 2 = 1 THEN 'E/' || event_type || '-' || event_id || '.md' ELSE 'Old/' || event_id || '.md' END AS path,
CASE WHEN event_id % 2 = 1 THEN 'create' WHEN event_id % 3 = 1 THEN 'unchanged' WHEN event_id % 3 = 2 THEN 'preserve' ELSE 'update' END AS disposition FROM events"""


@query(_DISPOSITION)
def upsert_disposition(spark, sf_dir):
    return upsert.plan(*_events_as_notes(spark, sf_dir)).select("ordinal", "path", "disposition")


@query(f"SELECT CASE disposition WHEN 'create' THEN 'created' WHEN 'update' THEN 'updated' WHEN 'preserve' THEN 'preserved' ELSE disposition END AS outcome, count(*) AS n FROM ({_DISPOSITION}) GROUP BY 1")
def report_counts(spark, sf_dir):
    return upsert.report(upsert.plan(*_events_as_notes(spark, sf_dir)))


@query(f"WITH d AS ({_DISPOSITION}) SELECT path, 's' || ordinal AS source_id, CASE WHEN disposition IN ('create', 'update') THEN ordinal ELSE ordinal + ordinal % 3 - 1 END AS mtime FROM d")
def upsert_state(spark, sf_dir):
    notes, state = _events_as_notes(spark, sf_dir)
    return upsert.applied(upsert.plan(notes, state), notes, state).select("path", "source_id", "mtime")


@query("SELECT 'files/' || doc_id || '.txt' AS path, md5(text) AS digest, CASE doc_id % 3 WHEN 0 THEN 'new' WHEN 1 THEN 'same' ELSE 'stale' END AS verdict FROM documents")
def attachment_identity(spark, sf_dir):
    name = F.concat(F.lit("files/"), F.col("doc_id").cast("string"), F.lit(".txt"))
    rows = table(spark, sf_dir, "documents").select("doc_id", name.alias("path"), F.octet_length("text").alias("size"), "text")
    placed = rows.where("doc_id % 3 <> 0").select("path", "size", F.md5(F.when(F.col("doc_id") % 3 == 1, F.col("text")).otherwise(F.reverse("text"))).alias("digest"))
    return upsert.attachment_verdict(rows.select("path", "size", F.md5("text").alias("digest")), placed).select("path", "digest", "verdict")


@query("SELECT coalesce(a.n_name, b.n_name) AS name, CASE WHEN b.n_name IS NOT NULL THEN 'new' ELSE 'old' END AS spec FROM (SELECT n_name FROM nation WHERE n_nationkey < 15) a FULL JOIN (SELECT n_name FROM nation WHERE n_nationkey > 8) b ON a.n_name = b.n_name")
def merged_views(spark, sf_dir):
    nation = table(spark, sf_dir, "nation")
    old, new = (nation.where(w).select(F.col("n_name").alias("name"), F.lit(s).alias("spec")) for w, s in (("n_nationkey < 15", "old"), ("n_nationkey > 8", "new")))
    return ordering.merged_views(old, new)


@query("SELECT p_brand || '/' || p_type || '/' || p_partkey AS path FROM part WHERE p_brand <> (SELECT min(p_brand) FROM part)")
def skipped_folders(spark, sf_dir):
    rows = table(spark, sf_dir, "part")
    return ordering.without(rows.select(F.concat_ws("/", "p_brand", "p_type", "p_partkey").alias("path")), rows.agg(F.min("p_brand").alias("path")))


@query("SELECT DISTINCT p_brand AS folder FROM part UNION SELECT DISTINCT p_brand || '/' || p_type FROM part")
def folders_to_create(spark, sf_dir):
    return ordering.folders(table(spark, sf_dir, "part").select(F.concat_ws("/", "p_brand", "p_type", "p_partkey").alias("path")))


# --- sources and streams -------------------------------------------------------


@query("SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_name || ', \"x\"' || chr(10) || 'y' AS c_name, '' AS blank FROM customer")
def csv_round_trip(spark, sf_dir):
    out = new_path(spark, "csv")
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.concat("c_name", F.lit(', "x"\ny')).alias("c_name"), F.lit(None).cast("string").alias("blank"))
    rows.write.option("header", "true").option("escape", '"').csv(out)
    return tables.read_csv(spark, out)


_ENDINGS = ["csv", "zip", "json", "md", "enex", "htm", "xyz"]


@query(
    """WITH f AS (SELECT ['csv', 'zip', 'json', 'md', 'enex', 'htm', 'xyz'][o_custkey % 7 + 1] AS e, count(*) AS n FROM orders GROUP BY 1),
c(importer, e) AS (VALUES ('csv', 'csv'), ('keep', 'zip'), ('keep', 'json'), ('outliner', 'zip'), ('outliner', 'json'), ('xml-notes', 'enex'), ('html', 'html'), ('html', 'htm'), ('markdown', 'md'), ('markdown', 'markdown'), ('markdown', 'txt'),
  ('bundle', 'textbundle'), ('bundle', 'textpack'), ('bundle', 'zip'), ('archive', 'zip'), ('sqlite', 'sqlite'), ('sqlite', 'db')),
k AS (SELECT importer, count(*) AS claims FROM c GROUP BY 1) SELECT importer, CAST(sum(n) AS BIGINT) AS taken, claims FROM c JOIN f USING (e) JOIN k USING (importer) GROUP BY importer, claims"""
)
def importer_match(spark, sf_dir):
    """A dropped file for every order, of endings that some importers claim and one that none does."""
    ending = F.get(F.array(*map(F.lit, _ENDINGS)), (F.col("o_custkey") % len(_ENDINGS)).cast("int"))
    return grouping.importer_ranks(table(spark, sf_dir, "orders").select(ending.alias("extension")), registry.claims(spark))


#: Heads of files, and what they are.
_HEADS = [
    ("89504E470D0A", "png"), ("FFD8FFE0", "jpg"), ("52494646000000005745425000", "webp"), ("5249464600000000574156450000", "wav"), ("0000001866747970686569630000", "heic"), ("0000001866747970686569730000", "heic"),
    ("000000186674797061766966", "avif"), ("00000018667479706176696F", "avif"), ("0000001466747970717420200000", "mov"), ("000000186674797069736F6D", "mp4"), ("504B030400", "zip"), ("474946383761", "gif"), ("00", None), ("", None),
]


@query("SELECT event_id, [" + ", ".join(f"'{kind}'" if kind else "NULL" for _, kind in _HEADS) + f"][event_id % {len(_HEADS)} + 1] AS extension FROM events")
def filetype_magic(spark, sf_dir):
    """Files that begin like those of known formats and hold an event's properties after that."""
    head = F.get(F.array(*[F.lit(h) for h, _ in _HEADS]), (F.col("event_id") % len(_HEADS)).cast("int"))
    content = F.unhex(F.concat(head, F.when(head == "", "").otherwise(F.hex(F.encode("props", "UTF-8")))))
    return table(spark, sf_dir, "events").select("event_id", tx.file_type(content).alias("extension"))


@query("SELECT event_id, ['png', 'html', NULL, 'json', NULL][event_id % 5 + 1] AS extension FROM events")
def mime_join(spark, sf_dir):
    types = F.array(F.lit("image/png"), F.lit("Text/HTML; charset=utf-8"), F.lit("no/such"), F.lit(" application/json "), F.lit(None).cast("string"))
    rows = table(spark, sf_dir, "events").select("event_id", F.get(types, (F.col("event_id") % 5).cast("int")).alias("mime"))
    return files.with_extension(rows, files.mime_extensions(spark)).select("event_id", "extension")


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY 1, 2")
def window_counts(spark, sf_dir):
    return imports.window_counts(table(spark, sf_dir, "events")).withColumn("total", F.round("total", 6))


@query(
    "SELECT 'E/' || event_type || '-' || event_id || '.md' AS path, 's' || event_id AS source_id, CAST(event_id AS BIGINT) AS mtime FROM events"
)
def streamed_import(spark, sf_dir):
    notes, _ = _events_as_notes(spark, sf_dir)
    source, state, marks = (new_path(spark, x) for x in ("stream", "state", "marks"))
    notes.drop("ordinal").repartition(3).write.option("parquet.block.size", 16 << 20).parquet(source)  # several tasks share a large file
    stream = spark.readStream.schema("folder string, title string, source_id string, mtime long, content string").option("maxFilesPerTrigger", 2).parquet(source)
    imports.start_import(stream, state, marks).awaitTermination()
    return imports.current_state(spark, state)[1].select("path", "source_id", "mtime")


@query("SELECT count(*) AS n, count(DISTINCT o_custkey) AS customers, round(sum(o_totalprice), 2) AS total FROM orders WHERE o_orderstatus = 'O'")
def first_numbers(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").where("o_orderstatus = 'O'")
    return rows.agg(F.count("*").alias("n"), F.count_distinct("o_custkey").alias("customers"), _cents(F.sum(number(F.col("o_totalprice")))).alias("total"))
