"""Text dialects of note applications."""

import pytest
from pyspark.sql import functions as F

from notemill.functions import dialects
from notemill.operators import documents


@pytest.mark.parametrize(
    "text, want",
    [
        ("# My note\nbody", "body"), ("# Other\nbody", "# Other\nbody"), ("# \nbody", "body"), ("# My note", ""), ("## My note\nx", "## My note\nx"), ("", ""), (None, None),
        ("~a b~ ~~gone~~ \\~no~ ~ x~", "<u>a b</u> ~~gone~~ \\~no~ ~ x~"),
        ("`~a~` ~b~ ``~c` ~`` ~d", "`~a~` <u>b</u> ``~c` ~`` ~d"),
        ("```\n~a~\n~~~\n#b c#\n````\n~d~", "```\n~a~\n~~~\n#b c#\n````\n<u>d</u>"),
        ("~~~py\n~a~ without an end", "~~~py\n~a~ without an end"),
        ("#one #two words# #123 #ab1 #facade #x/y, a#b #q!r", "#one #two_words #123 #ab1 #facade #x/y, a#b #q_r"),
        ("top\n|a|\n|-|\n\n|b|\n|-|\nx|y", "top\n\n|a|\n|-|\n\n|b|\n|-|\nx|y"),
        ('![](p.png)<!-- {"width":300} -->![a](p)<!-- {"width":"2","height":3.5} -->![a](p)<!-- {"width":0} -->![a](p)<!-- {no} -->', '![300](p.png)![a|2x3.5](p)![a](p)<!-- {"width":0} -->![a](p)<!-- {no} -->'),
        ("a\x00b `c`", "a�b `c`"),
    ],
)
def test_app_markdown(spark, text, want):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(dialects.app_markdown(F.col("t"), F.lit("My note"))).first()[0] == want


def test_tags_go_with_their_lines(spark):
    text = "one #tag here #12\n#alone #two words#\n\nkeep `#code`\nend #last!  \n"
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(dialects.app_markdown(F.col("t"), F.lit(""), keep_tags=False)).first()[0] == "one here #12\n\nkeep `#code`\nend!"


def test_long_texts(spark):
    n = 200_000
    df = spark.range(1).select(F.concat(F.lit("~"), F.repeat(F.lit("a `~b~` #c d# "), n // 10), F.lit("e~ x `"), F.repeat(F.lit("y\n"), n), F.lit("```\n"), F.repeat(F.lit("z "), n)).alias("t"))
    out = df.select(dialects.app_markdown(F.col("t"), F.lit("")).alias("o")).first().o
    assert out.count("#c_d ") == n // 10 and out.count("`~b~`") == n // 10 and out.startswith("<u>a") and out.endswith("z z ")


def test_tags_match(spark):
    rows = spark.createDataFrame([(1, ["A", "b"]), (2, ["b"]), (3, []), (4, None), (5, ["a", "c"])], "k int, tags array<string>")
    got = lambda **q: [r.k for r in rows.where(dialects.tags_match(F.col("tags"), **q)).collect()]
    assert got() == [1, 2, 3, 4, 5] and got(every=("a",)) == [1, 5] and got(some=("B", "c")) == [1, 2, 5] and got(every=("a",), none=("c",)) == [1] and got(none=("a", "b")) == [3, 4]


def test_to_do_holds_up_to_a_heading_of_its_level(spark):
    lines = [("todo", "size:large"), ("a", "list-item"), ("b", "list-item/strikethrough"), ("sub", "bold"), ("c", "list-item"), ("todo", "bold"), ("other", "size:large"), ("d", "list-item"), ("", "")]
    rows = [("n", k, "Title", [(path, text)]) for k, (text, path) in enumerate(lines)] + [("m", 0, None, [("list-item", "x"), ("list-item/bold", "y")]), ("m", 1, None, [])]
    df = spark.createDataFrame(rows, "note string, ordinal int, title string, sections array<struct<path string, text string>>")
    got = {(r.note, r.ordinal): r.markdown for r in documents.sized_lines(df).collect()}
    assert [got["n", k] for k in range(9)] == ["#### todo", "- [ ] a", "- [x] b", "##### sub", "- [ ] c", "##### todo", "#### other", "- d", ""]
    assert got["m", 0] == "- x**y**" and got["m", 1] == ""
    plain = {(r.note, r.ordinal): r.markdown for r in documents.sized_lines(df, todo=False).collect()}
    assert plain["n", 2] == "- ~~b~~"


def test_marks_are_nested(spark):
    rows = [
        ("P", 1, "one ", True, False, None), ("P", 2, "two", True, True, None), ("P", 3, " ", False, False, None), ("P", 4, "three", False, True, None), ("P", 5, " four", False, False, False),
        ("Q", 1, " all ", True, True, True), ("R", 1, "a", True, False, False), ("R", 2, "b", True, False, True), ("R", 3, "c", False, False, True), ("S", 1, " ", True, True, True), ("S", 2, None, True, False, False), ("T", 1, "x", False, False, False),
    ]
    df = spark.createDataFrame(rows, "p string, o int, t string, bold boolean, italic boolean, struck boolean")
    got = {r.p: r.markdown for r in documents.nested_marks(df, "p", "o", "t", {"bold": "**", "italic": "*", "struck": "~~"}).collect()}
    assert got == {"P": "**one *two*** *three* four", "Q": " ***~~all~~*** ", "R": "**a~~b~~**~~c~~", "S": " ", "T": "x"}


def test_tag_queries():
    import pytest

    from notemill.operators.tag_queries import QueryError, parse, tags_of

    assert parse("{{query: {and: [[A b]] {not: #c #[[d]]}} }}") == ("and", ("tag", "a b"), ("not", ("tag", "c"), ("tag", "d")))
    assert tags_of(parse("{or: [[x]] {and: #y [[x]]}}")) == {"x", "y"}
    for text in ("", "[[a]]", "{and: }", "{and: [[a]]", "{and: [[a]]} {or: [[b]]}", "{and: a}", "}", "{xor: [[a]]}"):
        with pytest.raises(QueryError):
            parse(text)


def test_tag_queries_over_many_tags(spark):
    """More tags than one word of bits holds, tags twice and in any case; lists of a block's tags are gathered nowhere."""
    import random

    from notemill.operators.tag_queries import matching

    rng = random.Random(1)
    blocks = {k: {f"Tag {t}" for t in rng.sample(range(150), 12)} for k in range(60)}
    postings = spark.createDataFrame([(k, rng.choice([t, t.upper()])) for k, tags in blocks.items() for t in tags for _ in range(2)], "block_id long, tag string")
    queries = {f"q{i}": f"{{or: [[tag {i}]] {{and: [[tag {149 - i}]] {{not: [[tag {i + 1}]]}}}}}}" for i in range(75)} | {"bare": "{not: [[tag 1]] [[tag 140]]}", "none": "{or: [[nowhere]]}"}
    has = lambda k, t: f"Tag {t}" in blocks[k]
    want = {(f"q{i}", k) for i in range(75) for k in blocks if has(k, i) or has(k, 149 - i) and not has(k, i + 1)} | {("bare", k) for k in blocks if not has(k, 1) and not has(k, 140)}
    found = matching(postings, queries)
    assert sorted(map(tuple, found.collect())) == sorted(want)
    assert "collect_set" not in found._jdf.queryExecution().toString()
