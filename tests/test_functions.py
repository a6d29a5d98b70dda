import datetime
import datetime as dt

import pytest
from pyspark.sql import functions as F

from notemill.functions import formulas as fx
from notemill.functions import text as tx
from notemill.functions.rollups import ROLLUPS, UnsupportedRollup, rollup
from notemill.functions.values import FIELD_KINDS, field_value, page_value, truthy, typed


def one(spark, column, **values):
    row = spark.range(1)
    for k, v in values.items():
        row = row.withColumn(k, v if not isinstance(v, (str, int, float, type(None))) else F.lit(v))
    return row.select(column.alias("x")).first().x


TABLE_CASES = {
    "ABS": (lambda f: f(F.lit(-2.5)), 2.5), "CEILING": (lambda f: f(F.lit(2.1)), 3), "ROUND": (lambda f: f(F.lit(-2.5)), -3.0), "ROUNDUP": (lambda f: f(F.lit(-2.11), 1), -2.2),
    "ROUNDDOWN": (lambda f: f(F.lit(2.19), 1), 2.1), "EVEN": (lambda f: f(F.lit(-3.0)), -4.0), "ODD": (lambda f: f(F.lit(2.0)), 3.0), "MOD": (lambda f: f(F.lit(7), F.lit(0)), None),
    "SUM": (lambda f: f("1", 2, None, "x"), 3.0), "AVERAGE": (lambda f: f(F.lit(None).cast("double")), None), "COUNT": (lambda f: f("1", "x", None), 1), "COUNTA": (lambda f: f("1", "", None), 1),
    "COUNTALL": (lambda f: f("1", "", None), 3), "MAX": (lambda f: f(1.0, None, 3.0), 3.0), "MIN": (lambda f: f(1.0, None, 3.0), 1.0), "MID": (lambda f: f(F.lit("abcdef"), 2, 3), "bcd"),
    "REPLACE": (lambda f: f(F.lit("abcdef"), 2, 3, "X"), "aXef"), "SUBSTITUTE": (lambda f: f(F.lit("a.a"), "a", "b"), "b.b"), "REPT": (lambda f: f(F.lit("ab"), 3), "ababab"),
    "LEFT": (lambda f: f(F.lit("abc"), 2), "ab"), "RIGHT": (lambda f: f(F.lit("abc"), 2), "bc"), "CONCATENATE": (lambda f: f("a", 1, None), "a1"), "VALUE": (lambda f: f(F.lit("12.5")), 12.5),
    "ENCODE_URL_COMPONENT": (lambda f: f(F.lit("a b&c")), "a%20b%26c"), "ARRAYCOMPACT": (lambda f: f(F.array(F.lit("a"), F.lit(""), F.lit(None))), ["a"]), "BLANK": (lambda f: f(), ""),
    "ARRAYUNIQUE": (lambda f: f(F.array(F.lit(1), F.lit(1))), [1]), "ARRAYJOIN": (lambda f: f(F.array(F.lit("a"), F.lit("b"))), "a, b"), "REGEX_EXTRACT": (lambda f: f(F.lit("a12"), "[0-9]+"), "12"),
    "SWITCH": (lambda f: f(F.lit(2), 1, "a", 2, "b", "c"), "b"), "XOR": (lambda f: f(F.lit(True), F.lit(True), F.lit(True)), True), "SEARCH": (lambda f: f("z", F.lit("abc")), None),
    "IS_SAME": (lambda f: f(F.lit("2024-03-01").cast("timestamp_ntz"), F.lit("2024-03-31").cast("timestamp_ntz"), "month"), True),
    "WORKDAY_DIFF": (lambda f: f(F.lit("2024-03-01").cast("date"), F.lit("2024-03-11").cast("date")), 7), "DATETIME_DIFF": (lambda f: f(F.lit("2024-03-02").cast("timestamp_ntz"), F.lit("2024-03-01").cast("timestamp_ntz"), "hours"), 24),
}


@pytest.mark.parametrize("name", sorted(TABLE_CASES))
def test_table_functions(spark, name):
    call, want = TABLE_CASES[name]
    got = one(spark, call(fx.TABLE[name]))
    assert got == (pytest.approx(want) if isinstance(want, float) else want)


def test_page_functions(spark):
    p, v = fx.PAGE, F.array(F.lit(3.0), F.lit(1.0), F.lit(2.0))
    cases = [
        (p["median"](v), 2.0), (p["sum"](v), 6.0), (p["first"](v), 3.0), (p["last"](v), 2.0), (p["at"](v, 9), None), (p["slice"](v, 1), [1.0, 2.0]), (p["slice"](v, -1), [2.0]),
        (p["substring"](F.lit("abcdef"), 1, 3), "bc"), (p["divide"](F.lit(1.0), F.lit(0.0)), None), (p["sort"](v), [1.0, 2.0, 3.0]), (p["contains"](F.lit("abc"), "b"), True),
        (p["formatDate"](F.lit("2024-03-02").cast("date"), "dddd, MMMM Do YYYY [at] h"), "Saturday, March 2nd 2024 at 12"), (p["ifs"](F.lit(False), 1, F.lit(True), 2), 2),
        (p["dateAdd"](F.lit("2024-01-31").cast("timestamp_ntz"), 1, "quarter"), datetime.datetime(2024, 4, 30)), (p["map"](v, lambda x: x + 1), [4.0, 2.0, 3.0]),
    ]
    for column, want in cases:
        assert one(spark, column) == want


def test_values(spark):
    assert one(spark, truthy(F.lit(""))) is False and one(spark, truthy(F.lit(0.0), "number")) is False and one(spark, truthy(F.array(), "multitext")) is False
    assert one(spark, typed(F.lit("x1"), "number")) is None and one(spark, typed(F.lit("2024-02-30"), "date")) is None
    for kind, raw, want in [
        ("singleSelect", '"Open"', "Open"), ("singleCollaborator", '{"name":"","email":"a@b"}', "a@b"), ("aiText", '{"state":"error","value":"x"}', None), ("count", "null", 0.0),
        ("multipleSelects", '["a","b"]', ["a", "b"]), ("number", "3.5", 3.5), ("barcode", '{"text":"12"}', "12"), ("checkbox", "true", True), ("novel", '{"a":1}', '{"a":1}'),
        ("multipleCollaborators", '[{"name":"A","email":"x"},{"email":"y"}]', ["A", "y"]), ("button", "{}", None),
    ]:
        assert one(spark, field_value(F.lit(raw), kind)) == want, kind
    for kind, raw, want in [
        ("select", '{"select":{"name":"A"}}', "A"), ("multi_select", '{"multi_select":[{"id":"1","name":"A"}]}', ["A"]), ("rich_text", '{"rich_text":[{"plain_text":"a"},{"plain_text":"b"}]}', "ab"),
        ("date", '{"date":{"start":"2024-01-01","end":"2024-01-02"}}', "2024-01-01 to 2024-01-02"), ("relation", '{"relation":[{"id":"x"}]}', ["x"]), ("unique_id", '{"unique_id":{"prefix":"P","number":4}}', "P-4"),
        ("number", '{"number":4}', 4.0), ("formula", '{"formula":{"type":"string","string":"q"}}', "q"), ("place", '{"place":{"lat":1.5,"lon":2}}', ["1.5", "2"]),
    ]:
        assert one(spark, page_value(F.lit(raw), kind)) == want, kind
    assert len(FIELD_KINDS) > 25


NAMES = [
    ("a/b\\c", "a-b-c"), ('q?<>:*|"z', "qz"), ("...", "Untitled"), (".hidden", "hidden"), ("con.txt", "Untitled"), ("trail. ", "trail"), ("[x]#^|y", "xy"), (None, "Untitled"), ("  ", "Untitled"),
    ("tab\tx\x85", "tabx"), ("é" * 130, "é" * 120), ("word " * 60, ("word " * 48).strip()), ("日本" * 50, "日本" * 40),
]


@pytest.mark.parametrize("raw, want", NAMES)
def test_file_names(spark, raw, want):
    assert one(spark, tx.file_name(F.lit(raw).cast("string"))) == want


def test_text(spark):
    cases = [
        (tx.dashed_tag(F.lit("#2 do!")), "_2-do"), (tx.clean_tags(F.lit("x #a! #a!b #7")), "x #a #ab #_7"), (tx.merge_tags(F.array(F.lit("#A")), F.array(F.lit("a"), F.lit("b"))), ["A", "b"]),
        (tx.inline_tags(F.lit("#a/b `#no` #12 ```\n#no\n``` #c")), ["a/b", "c"]), (tx.nested_tags(F.lit("#a/b #a/c"), flatten=True), ["a", "b", "c"]),
        (tx.fill_template("{{ a }}-{{b}}-{{c}}", {"a": F.lit(1), "b": F.lit(None).cast("string")}), "1--{{c}}"), (tx.yaml_scalar(F.lit(" ")), " "), (tx.yaml_scalar(F.lit("0x1F")), "0x1F"),
        (tx.yaml_scalar(F.lit('a"b\n')), '"a\\"b\\n"'), (tx.split_front_matter(F.lit("---\na: 1\n---\nbody"))[0], "a: 1"), (tx.split_front_matter(F.lit("---\na: 1\n---\nbody"))[1], "body"),
        (tx.first_line(F.lit("\n  \n Title \nx")), "Title"), (tx.number_or_text(F.lit(" 4.0 ")), "4"), (tx.page_date(F.lit("March 3rd, 2024")), "2024-03-03"), (tx.page_date(F.lit("My page")), "My page"),
        (tx.attribute(F.lit("Author:: Someone"))[1], "Someone"), (tx.outline_markup(F.lit("{{[[TODO]]}} #[[x y]] __i__ ^^h^^")), "[ ] [[x y]] *i* ==h=="),
        (tx.outside_code(F.lit("a `a` a"), lambda p: F.replace(p, F.lit("a"), F.lit("b"))), "b `a` b"), (tx.escape_hashtags(F.lit("#x `#y`")), "\\#x `#y`"),
        (tx.relative_path(F.lit("a/b/n.md"), F.lit("a/c/m.png")), "../c/m.png"), (tx.relative_path(F.lit("n.md"), F.lit("c/m.png")), "c/m.png"), (tx.normal_path(F.lit("/a/./b/../../c")), "c"),
        (tx.task_line(F.lit("t"), F.lit(True), F.lit("2024-01-02").cast("date"), F.lit(None).cast("date"), F.lit(True)), "- [x] t 📅 2024-01-02 🔼"), (tx.line_start_escaped(F.lit("# a")), "\\# a"),
        (tx.date_or_time(F.lit("2024-01-02").cast("timestamp_ntz")), "2024-01-02"), (tx.clipped(F.lit("aa bb cc"), 5), "aa..."), (tx.title_of(F.lit(" ")), "Untitled Record"),
        (tx.path_parts(F.lit("a/.b"))["extension"], ""), (tx.path_parts(F.lit("x/a.tar.GZ"))["extension"], "gz"), (tx.path_parts(F.lit("x/a.tar.GZ"))["basename"], "a.tar"),
        (tx.rich_text(F.from_json(F.lit('[{"text":"b","bold":true},{"text":"l","href":"u","code":true}]'), "array<struct<text:string,bold:boolean,italic:boolean,strikethrough:boolean,code:boolean,href:string>>")), "**b**[`l`](u)"),
    ]
    for k, (column, want) in enumerate(cases):
        assert one(spark, column) == want, k


def test_rollups_cover_records_without_links(spark):
    links = spark.createDataFrame([("r1", 0, "a"), ("r1", 1, "b"), ("r1", 2, "gone"), ("r2", None, None)], "record string, pos int, target string")
    targets = spark.createDataFrame([("a", "3"), ("b", "")], "target string, v string")
    every = {f"x{k}": name for k, name in enumerate(ROLLUPS) if name != "ARRAYFLATTEN"}
    got = {r.record: {every[c]: r[c] for c in every} for r in rollup(links, targets, "record", "target", "v", **every).collect()}
    assert got["r2"]["count"] == 0 and got["r2"]["SUM"] == 0 and got["r2"]["percent_empty"] == 0 and got["r2"]["AVERAGE"] is None
    assert (got["r1"]["count"], got["r1"]["count_filled"], got["r1"]["empty"], got["r1"]["SUM"], got["r1"]["show_original"]) == (3, 1, 2, 3.0, ["3", ""])
    with pytest.raises(UnsupportedRollup):
        rollup(links, targets, "record", "target", "v", x="no_such")


@pytest.mark.parametrize("sign, want", [("89504E47", "png"), ("49492A00", "tiff"), ("5249464600000000574156450000", "wav"), ("00000018667479707174202020", "mov"), ("000000186674797069736F6D", "mp4"), ("", None)])
def test_file_types(spark, sign, want):
    assert one(spark, tx.file_type(F.unhex(F.lit(sign)))) == want


def test_dates_steps_and_workdays(spark):
    f = fx.TABLE
    days = [dt.date(2024, 2, 20) + dt.timedelta(k) for k in range(14)]
    df = spark.createDataFrame([(d, n) for d in days for n in (-13, -6, -5, -1, 0, 1, 2, 5, 9)], "d date, n int")

    def plain(d, n):
        while n:
            d += dt.timedelta(1 if n > 0 else -1)
            n -= (n > 0) - (n < 0) if d.weekday() < 5 else 0
        return d

    assert all(r.w == plain(r.d, r.n) for r in df.withColumn("w", f["WORKDAY"](F.col("d"), F.col("n"))).collect())
    one = spark.range(1).select(
        f["MAX"](F.lit(dt.date(2024, 1, 2)), F.lit(dt.date(2023, 5, 5)), kind="date").alias("most"), f["MIN"](F.lit(3), F.lit(-2.5)).alias("least"),
        f["CEILING"](F.lit(7.3), 5).alias("up"), f["FLOOR"](F.lit(-7.3), 5).alias("down"), f["CEILING"](F.lit(7.3)).alias("plain"),
        f["DATETIME_PARSE"](F.lit("3 of March 2024, 14:05"), "D [of] MMMM YYYY, HH:mm").alias("parsed"), f["DATETIME_PARSE"](F.lit("x"), "YYYY").alias("none"),
        f["WEEKNUM"](F.lit(dt.date(2024, 1, 7)), "Sunday").alias("sunday"), f["WEEKNUM"](F.lit(dt.date(2024, 1, 7)), "Monday").alias("monday"), f["WEEKNUM"](F.lit(dt.date(2021, 1, 3))).alias("iso"),
        f["FROMNOW"](F.lit("2024-01-05 00:00:00").cast("timestamp"), F.lit("2024-01-01 12:00:00").cast("timestamp")).alias("ago"),
        fx.PAGE["match"](F.lit("a1 b22"), "[0-9]+").alias("numbers"), fx.PAGE["findIndex"](F.array(F.lit(1), F.lit(5)), lambda x: x > 2).cast("int").alias("at"),
        fx.PAGE["let"](4, lambda x: x * x).alias("square"), fx.PAGE["lets"](2, 5, lambda a, b: a * b).alias("product"),
        fx.PAGE["dateEnd"](fx.PAGE["dateRange"](F.lit(1), F.lit(9))).alias("end"),
    ).first()
    assert (one.most, one.least, one.up, one.down, one.plain) == (dt.date(2024, 1, 2), -2.5, 10, -10, 8)
    assert str(one.parsed) == "2024-03-03 14:05:00" and one.none is None and (one.sunday, one.monday, one.iso) == (2, 1, 53)
    assert (one.ago, one.numbers, one.at, one.square, one.product, one.end) == ("3 days", ["1", "22"], 1, 16, 10, 9)


def test_rollup_separators_and_file_types(spark):
    links = spark.createDataFrame([(1, 0, 10), (1, 1, 11), (2, 0, None)], "r int, pos int, t int")
    got = {r.r: (r.a, r.b) for r in rollup(links, spark.createDataFrame([(10, "x"), (11, "y")], "t int, v string"), "r", "t", "v", a=("ARRAYJOIN", "; "), b="ARRAYJOIN").collect()}
    assert got == {1: ("x; y", "x, y"), 2: ("", "")}
    with pytest.raises(UnsupportedRollup):
        rollup(links, links, "r", "t", "pos", a=("SUM", "; "))
    heads = {"ftyp": b"\0\0\0\x18ftypisom", "avif": b"\0\0\0\x18ftypavif", "qt": b"\0\0\0\x18ftypqt  ", "webp": b"RIFF0000WEBP", "riff": b"RIFF0000AVI ", "zip": b"PK\x03\x04", "none": b"", "gif": b"GIF89a"}
    df = spark.createDataFrame([(k, bytearray(v)) for k, v in heads.items()] + [("null", None)], "k string, b binary")
    assert {r.k: r.e for r in df.select("k", tx.file_type(F.col("b")).alias("e")).collect()} == {"ftyp": "mp4", "avif": "avif", "qt": "mov", "webp": "webp", "riff": None, "zip": "zip", "none": None, "gif": "gif", "null": None}
