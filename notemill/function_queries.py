"""The formula and rollup functions of both dialects on the driver's tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from notemill.catalogue import query, table
from notemill.functions import formulas as fx
from notemill.functions.rollups import rollup
from notemill.operators import grouping


@query(
    r"""SELECT doc_id, CAST(length(text) AS BIGINT) AS size, contains(text, 'ing') AS has, lower(text) AS low, upper(lang) AS up, replace(text, 'a', '_') AS swapped, regexp_replace(text, '[aeiou]+', '*', 'g') AS all_swapped,
  substring(text, 3, 5) AS part, right(text, 4) AS tail, reverse(lang) AS back, repeat(lang, 3) AS thrice, CAST(len(string_split(text, '. ')) AS BIGINT) AS sentences, trim(left(text, 40)) AS trimmed, coalesce(trim(text) = '', true) AS bare,
  regexp_matches(text, '[0-9]{3}') AS digits, CAST(doc_id AS VARCHAR) AS shown, TRY_CAST(source AS DOUBLE) AS num, CAST(len(regexp_extract_all(text, '[A-Z][a-z]+')) AS BIGINT) AS capitals FROM documents"""
)
def page_formula_text(spark, sf_dir):
    f, t, lang = fx.PAGE, F.col("text"), F.col("lang")
    return table(spark, sf_dir, "documents").select(
        "doc_id", f["length"](t).cast("long").alias("size"), f["contains"](t, "ing").alias("has"), f["lower"](t).alias("low"), f["upper"](lang).alias("up"), f["replace"](t, "a", "_").alias("swapped"),
        f["replaceAll"](t, "[aeiou]+", "*").alias("all_swapped"), f["substring"](t, 2, 7).alias("part"), f["substring"](t, -4).alias("tail"), f["reverse"](lang).alias("back"), f["repeat"](lang, 3).alias("thrice"),
        F.size(f["split"](t, ". ")).cast("long").alias("sentences"), f["trim"](F.left(t, F.lit(40))).alias("trimmed"), f["empty"](t).alias("bare"), f["test"](t, "[0-9]{3}").alias("digits"),
        f["format"](f["prop"]("doc_id")).alias("shown"), f["toNumber"](F.col("source")).alias("num"), F.size(f["match"](t, "[A-Z][a-z]+")).cast("long").alias("capitals"),
    )


@query(
    """WITH v AS (SELECT l_orderkey, list(CAST(l_quantity AS BIGINT) ORDER BY l_linenumber, l_quantity) AS q FROM lineitem GROUP BY 1)
SELECT l_orderkey, array_to_string(list_sort(q), ' ') AS sorted, array_to_string(list_sort(list_distinct(q)), ' ') AS distinct_sorted, array_to_string(list_concat(q, [CAST(7 AS BIGINT)]), '-') AS flat, array_to_string(list_reverse(q), ' ') AS back,
  list_contains(q, 10) AS has_ten, array_to_string(q[2:3], ' ') AS middle, array_to_string(q[greatest(len(q) - 1, 1):], ' ') AS last_two, array_to_string(list_transform(q, lambda x: x * 2), ' ') AS doubled,
  array_to_string(list_filter(q, lambda x: x > 20), ' ') AS big, len(list_filter(q, lambda x: x > 45)) > 0 AS some_big, len(list_filter(q, lambda x: x > 5)) = len(q) AS every_over, list_filter(q, lambda x: x > 30)[1] AS found,
  CAST(coalesce(list_position(list_transform(q, lambda x: x > 30), true), 0) - 1 AS BIGINT) AS found_at, q[2] AS second, q[1] AS first, q[-1] AS last, CAST(list_sum(q) AS DOUBLE) AS total, CAST(list_min(q) AS DOUBLE) AS least,
  CAST(list_max(q) AS DOUBLE) AS most, round(CAST(list_avg(q) AS DOUBLE), 6) AS mean, CAST(list_median(q) AS DOUBLE) AS middle_value FROM v"""
)
def page_formula_list(spark, sf_dir):
    own = grouping.grouped(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_linenumber", "l_quantity")
    f, q = fx.PAGE, F.transform("rows", lambda x: x["l_quantity"].cast("long"))
    text = lambda v, sep=" ": f["join"](f["map"](v, lambda x: x.cast("string")), sep)
    return own.select(
        "l_orderkey", text(f["sort"](q)).alias("sorted"), text(f["sort"](f["unique"](q))).alias("distinct_sorted"), text(f["flat"](F.array(q, F.array(F.lit(7).cast("long")))), "-").alias("flat"), text(f["reverse"](q)).alias("back"),
        f["includes"](q, F.lit(10).cast("long")).alias("has_ten"), text(f["slice"](q, 1, 3)).alias("middle"), text(f["slice"](q, -2)).alias("last_two"), text(f["map"](q, lambda x: x * 2)).alias("doubled"),
        text(f["filter"](q, lambda x: x > 20)).alias("big"), f["some"](q, lambda x: x > 45).alias("some_big"), f["every"](q, lambda x: x > 5).alias("every_over"), f["find"](q, lambda x: x > 30).alias("found"),
        f["findIndex"](q, lambda x: x > 30).cast("long").alias("found_at"), f["at"](q, 1).alias("second"), f["first"](q).alias("first"), f["last"](q).alias("last"), f["sum"](q).alias("total"), f["min"](q).alias("least"),
        f["max"](q).alias("most"), F.round(f["mean"](q), 6).alias("mean"), f["median"](q).alias("middle_value"),
    )


@query(
    """SELECT p_partkey, abs(p_retailprice - 1000) AS a, CAST(ceil(p_retailprice) AS BIGINT) AS up, CAST(floor(p_retailprice) AS BIGINT) AS down, round(p_retailprice, 0) AS whole, round(sqrt(p_size), 6) AS root, round(exp(p_size / 10.0), 6) AS ex,
  round(ln(p_retailprice), 6) AS nat, round(log10(p_retailprice), 6) AS ten, round(log2(p_retailprice), 6) AS two, CAST(sign(p_size - 25) AS DOUBLE) AS si, round(cbrt(p_size), 6) AS cube, round(pi(), 6) AS p, round(exp(1.0), 6) AS euler,
  CAST(power(p_size, 2) AS DOUBLE) AS sq, p_size + 3 AS plus, p_size - 3 AS less, p_size * 3 AS times, round(CAST(p_size AS DOUBLE) / 7, 6) AS part, p_size % 7 AS rest, p_size = 24 AS same, p_size <> 24 AS other FROM part"""
)
def page_formula_math(spark, sf_dir):
    f, price, size = fx.PAGE, F.col("p_retailprice"), F.col("p_size")
    r = lambda x: F.round(x, 6)
    return table(spark, sf_dir, "part").select(
        "p_partkey", f["abs"](price - 1000).alias("a"), f["ceil"](price).alias("up"), f["floor"](price).alias("down"), f["round"](price).alias("whole"), r(f["sqrt"](size)).alias("root"), r(f["exp"](size / 10.0)).alias("ex"),
        r(f["ln"](price)).alias("nat"), r(f["log10"](price)).alias("ten"), r(f["log2"](price)).alias("two"), f["sign"](size - 25).alias("si"), r(f["cbrt"](size)).alias("cube"), r(f["pi"]()).alias("p"), r(f["e"]()).alias("euler"),
        f["pow"](size, F.lit(2)).alias("sq"), f["add"](size, 3).alias("plus"), f["subtract"](size, 3).alias("less"), f["multiply"](size, 3).alias("times"), r(f["divide"](size.cast("double"), F.lit(7))).alias("part"),
        f["mod"](size, F.lit(7)).alias("rest"), f["equal"](size, 24).alias("same"), f["unequal"](size, 24).alias("other"),
    )


@query(
    """SELECT event_id, strftime(ts, '%d/%m/%Y %H:%M') AS shown, strptime(strftime(ts, '%Y-%m-%d %H:%M:%S'), '%Y-%m-%d %H:%M:%S') AS parsed, CAST(day(ts) AS BIGINT) AS d, CAST(isodow(ts) AS BIGINT) AS wd, CAST(year(ts) AS BIGINT) AS y,
  CAST(month(ts) AS BIGINT) AS mo, CAST(hour(ts) AS BIGINT) AS h, CAST(minute(ts) AS BIGINT) AS mi, CAST(week(ts) AS BIGINT) AS w, CAST(epoch_us(ts) // 1000 AS BIGINT) AS stamp, strftime(make_timestamp(epoch_us(ts) // 1000000 * 1000000), '%H:%M:%S') AS back,
  ts + INTERVAL 1 MONTH AS later, ts - INTERVAL 36 HOUR AS sooner, date_diff('day', TIMESTAMP '2023-12-31 00:00:00', date_trunc('day', ts)) AS days, true AS today_is, true AS now_is,
  strftime(ts + INTERVAL 1 DAY, '%Y-%m-%d') AS range_end, strftime(ts, '%Y-%m-%d') AS range_start FROM events"""
)
def page_formula_date(spark, sf_dir):
    f, ts = fx.PAGE, F.col("ts")
    span = f["dateRange"](ts, f["dateAdd"](ts, 1, "days"))
    day = lambda c: F.date_format(c, "yyyy-MM-dd")
    return table(spark, sf_dir, "events").select(
        "event_id", f["formatDate"](ts, "DD/MM/YYYY HH:mm").alias("shown"), f["parseDate"](F.date_format(ts, "yyyy-MM-dd HH:mm:ss")).cast("timestamp_ntz").alias("parsed"),
        *[f[name](ts).cast("long").alias(alias) for name, alias in (("date", "d"), ("day", "wd"), ("year", "y"), ("month", "mo"), ("hour", "h"), ("minute", "mi"), ("week", "w"))],
        f["timestamp"](ts).alias("stamp"), F.date_format(f["fromTimestamp"](f["timestamp"](ts)), "HH:mm:ss").alias("back"), f["dateAdd"](ts, 1, "months").alias("later"), f["dateSubtract"](ts, 36, "hours").alias("sooner"),
        f["dateBetween"](F.date_trunc("day", ts).cast("timestamp_ntz"), F.lit("2023-12-31").cast("timestamp_ntz"), "days").alias("days"), (f["today"]() == F.current_date()).alias("today_is"), (f["now"]() > F.lit("2024-01-01").cast("timestamp")).alias("now_is"),
        day(f["dateEnd"](span)).alias("range_end"), day(f["dateStart"](span)).alias("range_start"),
    )


@query(
    """SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN 'owed' ELSE 'owing' END AS state, CASE WHEN c_acctbal > 5000 THEN 'rich' WHEN c_acctbal > 0 THEN 'fair' ELSE 'poor' END AS class, round(c_acctbal * c_acctbal, 2) AS square,
  c_nationkey * 10 + 1 AS both FROM customer"""
)
def page_formula_logic(spark, sf_dir):
    f, money = fx.PAGE, F.col("c_acctbal")
    return table(spark, sf_dir, "customer").select(
        "c_custkey", f["if"](money > 0, "owed", "owing").alias("state"), f["ifs"](money > 5000, "rich", money > 0, "fair", "poor").alias("class"),
        F.round(f["let"](money, lambda x: x * x), 2).alias("square"), f["lets"](F.col("c_nationkey"), 10, lambda a, b: a * b + 1).alias("both"),
    )


@query(
    """SELECT doc_id, trim(left(text, 30)) AS trimmed, nullif(strpos(text, 'the'), 0) AS found, url_encode(lang || ' & ' || source || '/?') AS url, CAST(n_chars AS VARCHAR) AS shown, '' AS blank, '!ERROR' AS err, lang = 'en' AS failed, true AS yes, false AS no,
  nullif(regexp_extract(text, '[0-9]+'), '') AS digits, text || ' (' || lang || ')' AS joined, lang = 'de' AS german FROM documents"""
)
def table_formula_text(spark, sf_dir):
    f, t, lang = fx.TABLE, F.col("text"), F.col("lang")
    return table(spark, sf_dir, "documents").select(
        "doc_id", f["TRIM"](F.left(t, F.lit(30))).alias("trimmed"), f["SEARCH"]("the", t).cast("long").alias("found"), f["ENCODE_URL_COMPONENT"](f["CONCATENATE"](lang, " & ", F.col("source"), "/?")).alias("url"), f["T"](F.col("n_chars")).alias("shown"),
        f["BLANK"]().alias("blank"), f["ERROR"]().alias("err"), f["ISERROR"](F.when(lang == "en", f["ERROR"]()).otherwise(lang)).alias("failed"), f["TRUE"]().alias("yes"), f["FALSE"]().alias("no"), f["REGEX_EXTRACT"](t, "[0-9]+").alias("digits"),
        f["CONCATENATE"](t, " (", lang, ")").alias("joined"), (lang == "de").alias("german"),
    )


@query(
    """SELECT l_orderkey, l_linenumber, round(l_extendedprice, 1) AS r, round(ceil(round(l_extendedprice * 10, 6)) / 10, 6) AS ru, round(floor(round(l_extendedprice * 10, 6)) / 10, 6) AS rd, 2 * CAST(ceil((l_quantity - 1) / 2) AS BIGINT) + 1 AS od,
  CAST(floor(l_extendedprice) AS BIGINT) AS fl, CAST(floor(l_quantity / 5) * 5 AS DOUBLE) AS fl5, CAST(ceil(l_quantity / 5) * 5 AS DOUBLE) AS ce5, round(exp(l_discount), 6) AS ex, round(log10(l_quantity), 6) AS lg, round(ln(l_quantity) / ln(2), 6) AS lg2,
  CAST(CASE WHEN l_returnflag = 'N' THEN 1 ELSE 2 END AS INTEGER) AS filled, CAST(3 AS INTEGER) AS every FROM lineitem"""
)
def table_formula_math(spark, sf_dir):
    f, price, q = fx.TABLE, F.col("l_extendedprice"), F.col("l_quantity")
    clean = F.round(price * 10, 6) / 10
    cells = (F.when(F.col("l_returnflag") == "N", "").otherwise(F.col("l_returnflag")), q, None)
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", f["ROUND"](price, 1).alias("r"), F.round(f["ROUNDUP"](clean, 1), 6).alias("ru"), F.round(f["ROUNDDOWN"](clean, 1), 6).alias("rd"), f["ODD"](q).cast("long").alias("od"), f["FLOOR"](price).alias("fl"),
        f["FLOOR"](q, 5).cast("double").alias("fl5"), f["CEILING"](q, 5).cast("double").alias("ce5"), F.round(f["EXP"](F.col("l_discount")), 6).alias("ex"), F.round(f["LOG"](q), 6).alias("lg"), F.round(f["LOG"](q, 2), 6).alias("lg2"),
        f["COUNTA"](*cells).alias("filled"), f["COUNTALL"](*cells).alias("every"),
    )


@query(
    """SELECT event_id, CAST(hour(ts) AS BIGINT) AS h, CAST(minute(ts) AS BIGINT) AS mi, CAST(second(ts) AS BIGINT) AS s, CAST(week(ts) AS BIGINT) AS wn, strftime(ts, '%H:%M:%S') AS t, strptime(strftime(ts, '%d.%m.%Y %H:%M'), '%d.%m.%Y %H:%M') AS parsed,
  ts > TIMESTAMP '2024-01-10 00:00:00' AS late, date_trunc('day', ts) = TIMESTAMP '2024-01-02 00:00:00' AS that_day, strftime(ts + INTERVAL 1 HOUR, '%Y-%m-%d %H:%M') AS berlin,
  CAST(list_filter(generate_series(CAST(ts AS DATE) + INTERVAL 1 DAY, CAST(ts AS DATE) + INTERVAL 20 DAY, INTERVAL 1 DAY), lambda d: isodow(d) < 6)[7] AS DATE) AS wd7,
  CAST(list_reverse(list_filter(generate_series(CAST(ts AS DATE) - INTERVAL 20 DAY, CAST(ts AS DATE) - INTERVAL 1 DAY, INTERVAL 1 DAY), lambda d: isodow(d) < 6))[4] AS DATE) AS wd_4,
  CAST(len(list_filter(generate_series(CAST(ts AS DATE), CAST(ts AS DATE) + INTERVAL 17 DAY, INTERVAL 1 DAY), lambda d: isodow(d) < 6)) AS BIGINT) AS between,
  true AS today_is, true AS now_is, CASE WHEN date_diff('hour', date_trunc('hour', ts), TIMESTAMP '2024-01-01 00:00:00') = 0 THEN 'x' ELSE '' END AS same_hour FROM events"""
)
def table_formula_date(spark, sf_dir):
    f, ts = fx.TABLE, F.col("ts")
    day = ts.cast("date")
    return table(spark, sf_dir, "events").select(
        "event_id", *[f[name](ts).cast("long").alias(alias) for name, alias in (("HOUR", "h"), ("MINUTE", "mi"), ("SECOND", "s"), ("WEEKNUM", "wn"))], f["TIMESTR"](ts).alias("t"),
        f["DATETIME_PARSE"](F.date_format(ts, "dd.MM.yyyy HH:mm"), "DD.MM.YYYY HH:mm").cast("timestamp_ntz").alias("parsed"), f["IS_AFTER"](ts, F.lit("2024-01-10").cast("timestamp_ntz")).alias("late"),
        f["IS_SAME"](ts, F.lit("2024-01-02").cast("timestamp_ntz"), "day").alias("that_day"), F.date_format(f["SET_TIMEZONE"](ts.cast("timestamp"), "+01:00"), "yyyy-MM-dd HH:mm").alias("berlin"),
        f["WORKDAY"](day, 7).alias("wd7"), f["WORKDAY"](day, -4).alias("wd_4"), f["WORKDAY_DIFF"](day, F.date_add(day, 17)).cast("long").alias("between"), (f["TODAY"]() == F.current_date()).alias("today_is"),
        (f["NOW"]() > F.lit("2024-01-01").cast("timestamp")).alias("now_is"), F.when(f["IS_SAME"](ts, F.lit("2024-01-01 00:00:00").cast("timestamp_ntz"), "hour"), "x").otherwise("").alias("same_hour"),
    )


@query(
    """WITH v AS (SELECT o_custkey, list(CASE WHEN o_orderstatus = 'F' THEN '' ELSE o_orderstatus END ORDER BY o_orderkey) AS s, min(o_orderkey) AS k, min(o_orderdate) AS a, max(o_orderdate) AS b FROM orders GROUP BY 1)
SELECT o_custkey, array_to_string(list_filter(s, lambda x: x <> ''), ',') AS compact, array_to_string(list_concat(s, s), ',') AS flat, 'rec' || k AS id, a AS created, b AS modified,
  CASE WHEN date_diff('second', a, TIMESTAMP '2030-01-01 00:00:00') // 31536000 = 1 THEN '1 year' ELSE (date_diff('second', a, TIMESTAMP '2030-01-01 00:00:00') // 31536000) || ' years' END AS ago FROM v"""
)
def table_formula_record(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").withColumn("status", F.when(F.col("o_orderstatus") == "F", "").otherwise(F.col("o_orderstatus")))
    own = grouping.grouped(orders, "o_custkey", "o_orderkey", "status", "o_orderdate")
    f, s = fx.TABLE, F.transform("rows", lambda x: x["status"])
    dates = F.transform("rows", lambda x: x["o_orderdate"])
    rows = own.withColumns({"record_id": F.concat(F.lit("rec"), F.array_min(F.transform("rows", lambda x: x["o_orderkey"])).cast("string")), "created_time": F.array_min(dates), "modified_time": F.array_max(dates)})
    return rows.select(
        "o_custkey", f["ARRAYJOIN"](f["ARRAYCOMPACT"](s), ",").alias("compact"), f["ARRAYJOIN"](f["ARRAYFLATTEN"](F.array(s, s)), ",").alias("flat"), f["RECORD_ID"]().alias("id"), f["CREATED_TIME"]().alias("created"),
        f["LAST_MODIFIED_TIME"]().alias("modified"), f["FROMNOW"](F.col("created_time"), F.lit("2030-01-01").cast("timestamp_ntz")).alias("ago"),
    )


@query(
    """WITH x AS (SELECT c.c_custkey, o.o_orderkey, CASE WHEN o.o_orderstatus = 'F' THEN NULL WHEN o.o_orderstatus = 'P' THEN '' ELSE o.o_orderpriority END AS v, o.o_totalprice AS p FROM customer c LEFT JOIN orders o ON c.c_custkey = o.o_custkey),
g AS (SELECT c_custkey, count(o_orderkey) AS n, count(CASE WHEN v <> '' THEN 1 END) AS filled, coalesce(list(v ORDER BY o_orderkey) FILTER (v IS NOT NULL), []) AS vs, avg(p) AS mean FROM x GROUP BY 1)
SELECT c_custkey, array_to_string(vs, '|') AS original, array_to_string(list_sort(list_distinct(vs)), '|') AS distinct_values, n AS n_links, filled AS not_empty, CASE WHEN n = 0 THEN 0.0 ELSE (n - filled) * 100.0 / n END AS pct_empty, round(mean, 6) AS mean,
  filled AS filled_n, n AS every, array_to_string(list_filter(vs, lambda y: y <> ''), '|') AS compact, array_to_string(vs, '; ') AS joined, array_to_string(list_sort(list_distinct(vs)), '|') AS distinct_too FROM g"""
)
def rollup_values(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    pos = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")) - 1
    made = orders.select(F.col("o_custkey").alias("c_custkey"), pos.alias("pos"), F.col("o_orderkey").alias("target"))
    own = table(spark, sf_dir, "customer").select("c_custkey").join(made, "c_custkey", "left")
    v = F.when(F.col("o_orderstatus") == "F", None).when(F.col("o_orderstatus") == "P", "").otherwise(F.col("o_orderpriority"))
    texts = rollup(
        own, orders.select(F.col("o_orderkey").alias("target"), v.alias("v")), "c_custkey", "target", "v", original="show_original", distinct_values="show_unique", n_links="count_values", not_empty="not_empty", pct_empty="percent_empty",
        filled_n="COUNTA", every="COUNTALL", compact="ARRAYCOMPACT", joined=("ARRAYJOIN", "; "), distinct_too="ARRAYUNIQUE",
    )
    numbers = rollup(own, orders.select(F.col("o_orderkey").alias("target"), "o_totalprice"), "c_custkey", "target", "o_totalprice", mean="AVG")
    text = {c: F.array_join(c, "|") for c in ("original", "compact")} | {c: F.array_join(F.array_sort(c), "|") for c in ("distinct_values", "distinct_too")}
    return texts.withColumns(text).join(numbers.withColumn("mean", F.round("mean", 6)), "c_custkey")
