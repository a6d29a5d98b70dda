"""Formula texts of both dialects, compiled and computed on the driver's tables, each beside its own SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from notemill.catalogue import query, table
from notemill.functions import formula_text as ft
from notemill.functions.formula_text import PAGE, TABLE


def _num(sql: str) -> str:
    return f"(SELECT CASE WHEN x = floor(x) AND abs(x) < 1e15 THEN CAST(CAST(x AS BIGINT) AS VARCHAR) ELSE CAST(x AS VARCHAR) END FROM (SELECT CAST({sql} AS DOUBLE) AS x))"


def _bool(sql: str) -> str:
    return f"CASE WHEN {sql} THEN 'true' ELSE 'false' END"


def _time(sql: str) -> str:
    return f"strftime({sql}, '%Y-%m-%dT%H:%M:%S')"


def _sql(key: str, source: str, good: dict[str, tuple[str, str]], bad: dict[str, tuple[str, str]]) -> str:
    """A row per record and good formula, one per bad formula."""
    text = lambda s: "'" + s.replace("'", "''") + "'"
    names, values = ", ".join(map(text, good)), ", ".join(f"CAST({sql} AS VARCHAR)" for _, sql in good.values())
    wrong = ", ".join(f"({text(name)}, {text(problem)})" for name, (_, problem) in bad.items())
    return f"""SELECT {key}, unnest([{names}]) AS formula, unnest([{values}]) AS value, CAST(NULL AS VARCHAR) AS problem FROM {source}
UNION ALL SELECT NULL, name, NULL, problem FROM (VALUES {wrong}) AS b(name, problem)"""


#: By name: the formula, and SQL for its value as text.
ORDER_FORMULAS = {
    "net": ("ROUND({o_totalprice} * 0.81, 2)", _num("round(o_totalprice * 0.81, 2)")),
    "label": ("{o_orderkey} & \" / \" & UPPER({o_orderstatus})", "o_orderkey || ' / ' || upper(o_orderstatus)"),
    "band": ("IF({net} > 150000, \"high\", IF({net} > 60000, 'middle', \"low\"))", "CASE WHEN round(o_totalprice * 0.81, 2) > 150000 THEN 'high' WHEN round(o_totalprice * 0.81, 2) > 60000 THEN 'middle' ELSE 'low' END"),
    "banded label": ("CONCATENATE({band}, \": \", {label})", "CASE WHEN round(o_totalprice * 0.81, 2) > 150000 THEN 'high' WHEN round(o_totalprice * 0.81, 2) > 60000 THEN 'middle' ELSE 'low' END || ': ' || o_orderkey || ' / ' || upper(o_orderstatus)"),
    "precedence": ("1 + 2 * {o_custkey} - -3 % 2", _num("1 + 2 * o_custkey + 3 % 2")),
    "grouped": ("(1 + 2) * ({o_custkey} - 3)", _num("3 * (o_custkey - 3)")),
    "status": ("SWITCH({o_orderstatus}, \"O\", \"open\", \"F\", \"finished\", \"partly\")", "CASE o_orderstatus WHEN 'O' THEN 'open' WHEN 'F' THEN 'finished' ELSE 'partly' END"),
    "urgent": ("AND(VALUE(LEFT({o_orderpriority}, 1)) <= 2, NOT({o_orderstatus} = \"F\"))", _bool("CAST(left(o_orderpriority, 1) AS DOUBLE) <= 2 AND o_orderstatus <> 'F'")),
    "either": ("OR({o_custkey} < 10, {o_orderstatus} != 'O')", _bool("o_custkey < 10 OR o_orderstatus <> 'O'")),
    "odd one": ("XOR({o_custkey} > 50, {o_orderstatus} = \"O\", TRUE())", _bool("(CAST(o_custkey > 50 AS INT) + CAST(o_orderstatus = 'O' AS INT) + 1) % 2 = 1")),
    "blank": ("IF({o_custkey} > 100, {o_totalprice}, BLANK())", f"CASE WHEN o_custkey > 100 THEN {_num('o_totalprice')} END"),
    "no blank": ("IF({blank} = BLANK(), \"none\", \"some\")", "CASE WHEN o_custkey > 100 THEN 'some' ELSE 'none' END"),
    "middle": ("MID({o_orderpriority}, 3, 4) & RIGHT({o_orderpriority}, 2) & LEN({o_orderpriority})", "substring(o_orderpriority, 3, 4) || right(o_orderpriority, 2) || length(o_orderpriority)"),
    "swapped": ("SUBSTITUTE(LOWER({o_orderpriority}), \"-\", \"\\\"=\\\"\")", "replace(lower(o_orderpriority), '-', '\"=\"')"),
    "overlaid": ("REPLACE({o_orderpriority}, 1, 2, \"<>\") & REPT(\"*\", MOD({o_custkey}, 4))", "'<>' || substring(o_orderpriority, 3) || repeat('*', o_custkey % 4)"),
    "found": ("FIND(\"U\", {o_orderpriority}) + SEARCH(\"-\", {o_orderpriority})", _num("position('U' IN o_orderpriority) + position('-' IN o_orderpriority)")),
    "digits": ("REGEX_EXTRACT({o_orderpriority}, \"[0-9]+\")", "regexp_extract(o_orderpriority, '[0-9]+')"),
    "no letters": ("REGEX_REPLACE({o_orderpriority}, '[A-Z ]+', '.')", "regexp_replace(o_orderpriority, '[A-Z ]+', '.', 'g')"),
    "matches": ("REGEX_MATCH({o_orderpriority}, \"^[12]-\")", _bool("regexp_matches(o_orderpriority, '^[12]-')")),
    "total": ("SUM({o_custkey}, 5, \"7\", \"no number\")", _num("o_custkey + 12")),
    "average": ("AVERAGE({o_custkey}, {o_custkey} + 4)", _num("o_custkey + 2")),
    "counted": ("COUNT({o_custkey}, \"x\", 3) & COUNTA({o_custkey}, \"\", \"x\") & COUNTALL({o_custkey}, \"\", \"x\")", "'223'"),
    "extremes": ("MAX({o_custkey}, 40) - MIN({o_custkey}, 40)", _num("abs(o_custkey - 40)")),
    "rounded": ("INT({o_totalprice} / 1000) + CEILING({o_custkey}, 5) + FLOOR({o_custkey}, 5) + EVEN({o_custkey}) + ODD({o_custkey})", _num("floor(o_totalprice / 1000) + ceil(o_custkey / 5.0) * 5 + floor(o_custkey / 5.0) * 5 + 2 * ceil(o_custkey / 2.0) + CASE WHEN o_custkey % 2 = 0 THEN o_custkey + 1 ELSE o_custkey END")),
    "powers": ("ROUND(SQRT({o_custkey}) + POWER(2, 3) + LOG(100) + EXP(0) + 2 ^ 3 ^ 2, 4)", _num("round(sqrt(o_custkey) + 8 + 2 + 1 + 512, 4)")),
    "by zero": ("{o_custkey} / ({o_custkey} - {o_custkey})", "NULL"),
    "due": ("DATEADD({o_orderdate}, 2, \"months\")", _time("o_orderdate + INTERVAL 2 MONTH")),
    "due day": ("DATETIME_FORMAT({due}, \"ddd, D MMM YYYY [at] HH:mm\")", "strftime(o_orderdate + INTERVAL 2 MONTH, '%a, %-d %b %Y at %H:%M')"),
    "parts": ("YEAR({o_orderdate}) * 10000 + MONTH({o_orderdate}) * 100 + DAY({o_orderdate}) + WEEKDAY({o_orderdate}) / 10", _num("year(o_orderdate) * 10000 + month(o_orderdate) * 100 + day(o_orderdate) + dayofweek(o_orderdate) / 10.0")),
    "days": ("DATETIME_DIFF({due}, {o_orderdate}, \"days\")", _num("date_diff('day', o_orderdate, o_orderdate + INTERVAL 2 MONTH)")),
    "before": ("IS_BEFORE({o_orderdate}, \"1995-06-17\")", _bool("o_orderdate < TIMESTAMP '1995-06-17'")),
    "same month": ("IS_SAME({o_orderdate}, {due}, \"year\")", _bool("year(o_orderdate) = year(o_orderdate + INTERVAL 2 MONTH)")),
    "stamp": ("DATESTR({o_orderdate}) & \" \" & TIMESTR({o_orderdate})", "strftime(o_orderdate, '%Y-%m-%d %H:%M:%S')"),
    "error": ("IF(ISERROR(ERROR()), 1, 0)", "'1'"),
}
ORDER_PROBLEMS = {
    "unknown function": ("SOUNDEX({o_orderstatus})", "no function 'SOUNDEX' at 0"),
    "unknown field": ("1 + {o_comment}", "no field 'o_comment' at 5"),
    "cut short": ("{o_custkey} *", "the formula ends too soon"),
    "unclosed": ("LEFT({o_orderstatus}, 1", "expected ',' at the end"),
    "stray": ("{o_custkey} ; 2", "unexpected ';' at 12"),
    "too few": ("LEFT({o_orderstatus})", "LEFT takes 2 values, not 1"),
    "wrong kind": ("YEAR({o_custkey})", "YEAR takes a datetime, not a number"),
    "not literal": ("DATETIME_FORMAT({o_orderdate}, {o_orderstatus})", "DATETIME_FORMAT takes a text in quotes or digits here"),
    "wrong unit": ("DATEADD({o_orderdate}, 1, \"fortnights\")", "DATEADD can't take 'fortnight'"),
    "itself": ("{itself} + 1", "refers to itself"),
    "there": ("{and back}", "refers to itself through others"),
    "and back": ("{there} & \"!\"", "refers to itself through others"),
    "to a cycle": ("{there} + 1", "refers to a field that refers to itself"),
    "to an error": ("{unknown field} + 1", "refers to 'unknown field', which has an error"),
    "empty": (" ", "the formula is empty"),
    "host only": ("SET_LOCALE({o_orderdate}, \"de\")", "SET_LOCALE can't be computed"),
}


def _formulas(spark, good: dict, bad: dict):
    return spark.createDataFrame([(name, text) for name, (text, _) in {**good, **bad}.items()], "name string, text string")


@query(_sql("o_orderkey", "orders", ORDER_FORMULAS, ORDER_PROBLEMS))
def table_formula_texts(spark, sf_dir):
    return ft.formula_values(table(spark, sf_dir, "orders"), "o_orderkey", _formulas(spark, ORDER_FORMULAS, ORDER_PROBLEMS), TABLE)


_WORDS = "string_split(p_type || ' ' || p_name, ' ')"
PART_FORMULAS = {
    "price": ("prop(\"p_retailprice\") * 1.5 + 1", _num("p_retailprice * 1.5 + 1")),
    "called": ("prop(\"p_type\") + \" \" + prop(\"p_name\")", "p_type || ' ' || p_name"),
    "size": ("prop(\"called\").length() + length(prop(\"p_brand\"))", _num("length(p_type || ' ' || p_name) + length(p_brand)")),
    "by id": ("{{notion:block_property:sz%3Ap:of-page}} * 2", _num("p_size * 2")),
    "words": ("prop(\"called\").split(\" \")", f"array_to_string({_WORDS}, ', ')"),
    "shouted": ("prop(\"words\").map(current.upper() + \"!\").join(\" \")", f"array_to_string(list_transform({_WORDS}, lambda x: upper(x) || '!'), ' ')"),
    "long words": ("prop(\"words\").filter(length(current) > 5 and not current.contains(\"x\")).join(\"|\")", f"array_to_string(list_filter({_WORDS}, lambda x: length(x) > 5 AND NOT contains(x, 'x')), '|')"),
    "numbered": ("prop(\"words\").map(index + 1).sum()", _num(f"len({_WORDS}) * (len({_WORDS}) + 1) / 2")),
    "ends": ("prop(\"words\").first() + prop(\"words\").last() + prop(\"words\")[1]", f"({_WORDS})[1] || ({_WORDS})[-1] || ({_WORDS})[2]"),
    "sorted": ("prop(\"words\").unique().sort().reverse().join(\"\")", f"array_to_string(list_reverse(list_sort(list_distinct({_WORDS}))), '')"),
    "slice": ("join(slice(prop(\"words\"), 1), \"-\")", f"array_to_string(({_WORDS})[2:], '-')"),
    "tests": ("some(prop(\"words\"), current == \"widget\") ? \"widget\" : every(prop(\"words\"), length(current) > 2) ? \"long\" : \"other\"", f"CASE WHEN list_contains({_WORDS}, 'widget') THEN 'widget' WHEN len(list_filter({_WORDS}, lambda x: length(x) > 2)) = len({_WORDS}) THEN 'long' ELSE 'other' END"),
    "find": ("findIndex(prop(\"words\"), length(current) > 5) + find(prop(\"words\"), length(current) > 5).length()", _num(f"coalesce(list_position(list_transform({_WORDS}, lambda x: length(x) > 5), true), 0) - 1 + length(list_filter({_WORDS}, lambda x: length(x) > 5)[1])")),
    "sizes": ("ifs(prop(\"p_size\") < 10, \"small\", prop(\"p_size\") < 30, \"medium\", \"large\")", "CASE WHEN p_size < 10 THEN 'small' WHEN p_size < 30 THEN 'medium' ELSE 'large' END"),
    "let": ("let(half, prop(\"p_size\") / 2, half * half + half)", _num("(p_size / 2.0) * (p_size / 2.0) + p_size / 2.0")),
    "lets": ("lets(a, prop(\"p_size\"), b, a + 1, a * b)", _num("CAST(p_size AS BIGINT) * (p_size + 1)")),
    "logic": ("!(prop(\"p_size\") > 20) || prop(\"p_brand\") == \"Brand#13\" && true", _bool("p_size <= 20 OR p_brand = 'Brand#13'")),
    "chosen": ("if(empty(prop(\"p_brand\")), 0, prop(\"p_size\") % 7)", _num("CASE WHEN coalesce(p_brand, '') = '' THEN 0 ELSE p_size % 7 END")),
    "listed": ("[prop(\"p_size\"), 3, \"4\"].sum() + max(1, prop(\"p_size\")) + median([1, 2, 9])", _num("p_size + 7 + greatest(1, p_size) + 2")),
    "replaced": ("replaceAll(prop(\"p_brand\"), \"[0-9]\", \"#\") + replace(prop(\"p_brand\"), \"Brand\", \"B\")", "regexp_replace(p_brand, '[0-9]', '#', 'g') || replace(p_brand, 'Brand', 'B')"),
    "matched": ("test(prop(\"p_brand\"), \"[0-9]{2}$\") and substring(prop(\"p_brand\"), 0, 5) == \"Brand\"", _bool("regexp_matches(p_brand, '[0-9]{2}$') AND left(p_brand, 5) = 'Brand'")),
    "dates": ("dateAdd(parseDate(\"2024-01-31\"), prop(\"p_size\"), \"days\").formatDate(\"YYYY/MM/DD\")", "strftime(DATE '2024-01-31' + CAST(p_size AS INTEGER), '%Y/%m/%d')"),
    "between": ("dateBetween(dateSubtract(parseDate(\"2024-03-01\"), prop(\"p_size\"), \"weeks\"), parseDate(\"2024-03-01\"), \"days\")", _num("-7 * p_size")),
    "root": ("(prop(\"p_size\") ^ 2).sqrt().round() + abs(-3) + floor(2.7) + ceil(2.1) + sign(-9)", _num("p_size + 3 + 2 + 3 - 1")),
}
PART_PROBLEMS = {
    "unknown method": ("prop(\"p_name\").shout()", "no function 'shout' at 15"),
    "unknown id": ("{{notion:block_property:nope:of-page}} + 1", "no field 'nope' at 0"),
    "unknown name": ("current + 1", "no field 'current' at 0"),
    "not a date": ("formatDate(prop(\"p_size\"), \"YYYY\")", "formatDate takes a datetime, not a number"),
    "styled": ("style(prop(\"p_name\"), \"b\")", "style can't be computed"),
    "no else": ("prop(\"p_size\") > 3 ? 1", "expected ':' at the end"),
}


@query(_sql("p_partkey", "part", PART_FORMULAS, PART_PROBLEMS))
def page_formula_texts(spark, sf_dir):
    parts = table(spark, sf_dir, "part")
    return ft.formula_values(parts, "p_partkey", _formulas(spark, PART_FORMULAS, PART_PROBLEMS), PAGE, {"sz%3Ap": "p_size"})


@query(
    """SELECT o_custkey, CAST(count(*) AS BIGINT) AS orders, round(sum(o_totalprice) / count(*) - min(o_totalprice), 4) AS over_least, max(o_totalprice) > 300000 OR count(*) > 20 AS large FROM orders GROUP BY 1"""
)
def rollup_formula_texts(spark, sf_dir):
    values = F.collect_list(F.col("o_totalprice").cast("string"))  # the links of one record
    made = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(values.alias("linked"))
    of = lambda text, dialect=TABLE: ft.rollup_formula(text, F.col("linked"), dialect).column
    return made.select(
        "o_custkey", of("COUNTALL(values)").cast("long").alias("orders"), F.round(of("SUM(values) / COUNT(values) - MIN(values)"), 4).alias("over_least"), of("max(values) > 300000 or values.length() > 20", PAGE).alias("large")
    )
