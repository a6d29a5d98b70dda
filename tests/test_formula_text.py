"""Formula texts: reading, kinds, errors, and fields that refer to each other."""

import pytest
from pyspark.sql import functions as F

from notemill.functions import formula_text as ft
from notemill.functions.formula_text import PAGE, TABLE, FormulaError, compile_fields, compile_formula, fields_of, formula_values, parse, typed_fields


def tree(node):
    own = (node.what, node.says) if node.says is not None else (node.what,)
    return (*own, *map(tree, node.parts))


def test_precedence():
    n = lambda x: ("number", float(x))
    assert tree(parse("1+2*3-4")) == ("-", ("+", n(1), ("*", n(2), n(3))), n(4))
    assert tree(parse("-2^2")) == ("negate", ("^", n(2), n(2)))
    assert tree(parse("2^3^2")) == ("^", n(2), ("^", n(3), n(2)))
    assert tree(parse("not a and b or c")) == ("or", ("and", ("not", ("name", "a")), ("name", "b")), ("name", "c"))
    assert tree(parse("!a == b")) == ("==", ("not", ("name", "a")), ("name", "b"))
    assert tree(parse("1 < 2 ? 3 : 4 ? 5 : 6")) == ("call", "if", ("<", n(1), n(2)), n(3), ("call", "if", n(4), n(5), n(6)))
    assert tree(parse("a.f(1)[2].g")) == ("call", "g", ("call", "at", ("call", "f", ("name", "a"), n(1)), n(2)))
    assert tree(parse("{A b} & 'it\\'s' <> \"\\n\"")) == ("!=", ("&", ("field", "A b"), ("text", "it's")), ("text", "\n"))
    assert fields_of(parse("{A} + prop(\"B\") + c + {{notion:block_property:i%3A:x}}")) == {("field", "A"), ("field", "B"), ("name", "c"), ("block", "i%3A")}


@pytest.mark.parametrize(
    ("text", "said"),
    [
        ("", "the formula is empty"), ("1 +", "the formula ends too soon"), ("(1", "expected ')' at the end"), ("1 2", "unexpected '2' at 2"), ("f(1,,2)", "unexpected ',' at 4"), ("'open", "unexpected \"'\" at 0"),
        ("a.(1)", "expected a name after '.' at 2"), ("#", "unexpected '#' at 0"), ("(" * 200 + "1" + ")" * 200, "nested more than 100 deep"), ("x ? 1", "expected ':' at the end"),
    ],
)
def test_what_is_not_well_formed(text, said):
    with pytest.raises(FormulaError) as e:
        parse(text)
    assert str(e.value) == said


ROW = "n double, t string, d date, b boolean, l array<string>, e string"


@pytest.fixture(scope="module")
def record(spark):
    return spark.createDataFrame([(7.0, "Some text", None, True, ["b", "3", "a"], "")], ROW).withColumn("d", F.lit("2024-02-29").cast("date"))


def results(record, dialect, texts):
    fields = typed_fields(record)
    made = [compile_formula(t, fields, dialect) for t in texts]
    row = record.select(*[ft.shown(v).alias(f"c{k}") for k, v in enumerate(made)]).first()
    return list(row)


def test_table_values(record):
    cases = {
        "{n} & ''": "7", "{n} / 2": "3.5", "{n} + TRUE()": "8", "\"5\" + 1": "51", "VALUE(\"5\") + 1": "6", "{t} = \"\"": "false", "{e} = BLANK()": "true", "{e} & \"!\"": "!", "1 / 0": None,
        "0.1 + 0.2": "0.30000000000000004", "12345678.5 * 1": "12345678.5", "IF({b}, 1, \"x\")": "1", "IF({e}, 1)": None, "if({n} > \"6\", 'y', 'n')": "y", "{d} = \"2024-02-29\"": "true",
        "DATEADD({d}, 1, 'year')": "2025-02-28T00:00:00", "MAX({d}, \"2024-03-01\")": None, "MAX({n}, {l})": "7", "SUM({l}, {n})": "10", "ARRAYJOIN(ARRAYUNIQUE({l}), '-')": "b-3-a", "{l}": "b, 3, a",
        "MIN({d}, {d})": "2024-02-29", "AND({b}, {e})": "false", "NOT({l})": "false", "SWITCH({n}, 1, 'a', 7, 'b')": "b", "SWITCH({n}, 1, 'a', 2, 'b')": None, "LEN({t}) * -1": "-9", "ROUND({n} / 3, -0)": "2",
    }
    assert dict(zip(cases, results(record, TABLE, cases))) == cases


def test_page_values(record):
    cases = {
        "prop('l').sort().join('')": "3ab", "l.length() + t.length()": "12", "l.map(current + index).join(' ')": "b0 31 a2", "l.filter(current > 'a').length()": "1", "[1, 'a', l].length()": "5",
        "lets(x, n, y, x * 2, x + y)": "21", "let(x, 1, let(x, 2, x) + x)": "3", "n == 7 && !empty(e) || b": "true", "not b": "false", "d.dateAdd(1, 'days').formatDate('YYYY-MM-DD')": "2024-03-01", "reverse('abc')": "cba",
        "ifs(n > 8, 1, n > 6, 2, 3)": "2", "true ? 'x' : 'y'": "x", "add(n, 'x')": "7x", "equal(n, 7)": "true", "and(b, n > 1, e)": "false", "split('a.b', '.').first()": "a", "l[1] + l.at(0)": "3b",
    }
    assert dict(zip(cases, results(record, PAGE, cases))) == cases


@pytest.mark.parametrize(
    ("text", "dialect", "said"),
    [
        ("LEFT({t})", TABLE, "LEFT takes 2 values, not 1"), ("ROUND(1, 2, 3)", TABLE, "ROUND takes 1 to 2 values, not 3"), ("{x}", TABLE, "no field 'x' at 1"), ("ABS({d})", TABLE, "ABS takes a number, not a date"),
        ("{d} + 1", TABLE, "'+' takes numbers or texts, not a date and a number"), ("YEAR({l})", TABLE, "YEAR takes a datetime, not a multitext"), ("prop(n)", PAGE, "prop takes one name in quotes"), ("let(1, 2, 3)", PAGE, "let takes pairs of a name and a value, then a formula"),
        ("shout(t)", PAGE, "no function 'shout' at 0"), ("IF(1)", TABLE, "IF takes 2 to 3 values, not 1"), ("REGEX_MATCH({t}, {t})", TABLE, "REGEX_MATCH takes a text in quotes or digits here"), ("SUM()", TABLE, "SUM takes 1 or more values, not 0"),
    ],
)
def test_what_cannot_be_computed(record, text, dialect, said):
    with pytest.raises(FormulaError) as e:
        compile_formula(text, typed_fields(record), dialect)
    assert str(e.value) == said


def test_fields_in_any_order(record):
    chain = [(f"f{k}", f"{{f{k + 1}}} + 1") for k in range(30)] + [("f30", "{n}")]
    made = compile_fields([*chain, ("f30", "ignored twice")], typed_fields(record))
    assert not made.problems and len(made.levels) == 31 and made.add_to(record).first().f0 == 37.0
    made = compile_fields([("a", "{b}"), ("b", "{c}"), ("c", "{a}"), ("d", "{c} + 1"), ("e", "{e}"), ("g", "{h}"), ("h", "{nope}"), ("ok", "{n} + 1"), ("blank", "BLANK()")], typed_fields(record), TABLE)
    assert made.problems == {
        "a": "refers to itself through others", "b": "refers to itself through others", "c": "refers to itself through others", "d": "refers to a field that refers to itself", "e": "refers to itself",
        "g": "refers to 'h', which has an error", "h": "no field 'nope' at 1",
    } and made.kinds == {"ok": "number", "blank": "text"}


def test_values_as_rows(spark, record):
    formulas = spark.createDataFrame([("ok", "{n} * 2"), ("bad", "{n} *")], "name string, text string")
    got = {tuple(r) for r in formula_values(record, "t", formulas).collect()}
    assert got == {("Some text", "ok", "14", None), (None, "bad", None, "the formula ends too soon")}
    assert formula_values(record.limit(0), "t", formulas).count() == 1 and formula_values(record, "t", formulas.where("name = 'bad'")).count() == 1
    assert formula_values(record, "t", formulas.limit(0)).collect() == []
