"""Formulas that come as text, in either dialect, compiled to columns.

A formula is read into a tree, its names are looked up among the fields, and each
call is checked against a signature that says which kinds of values it takes.
What comes out is a Spark column and its kind, so all records are computed by the
plan and none by this module. A formula that can't be computed raises
``FormulaError``; ``compile_fields`` gathers those by formula.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from notemill.functions import formulas as fx
from notemill.functions.values import KINDS, is_empty, number, truthy

#: Calls, groups and operators that may stand inside each other.
MOST_NESTED = 100
DATES = ("date", "datetime")


class FormulaError(ValueError):
    """A formula that is not well formed, or asks for what is not there."""


@dataclass(frozen=True)
class Value:
    """A column and its kind (of ``KINDS``, or ``blank``); a literal also has what it says."""

    column: Column
    kind: str
    literal: str | float | None = None


# --- reading -------------------------------------------------------------------

_PIECE = re.compile(
    r"""\s*(?:
    (?P<block>\{\{notion:block_property:(?P<id>[^:}]*)[^}]*\}\}) | \{(?P<field>[^{}]+)\} | (?P<number>(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)
    | (?P<text>"(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*') | (?P<name>[^\W\d]\w*) | (?P<mark><=|>=|<>|!=|==|&&|\|\||[-+*/%^&=<>!?:().,\[\]])
    )""",
    re.X | re.S,
)
_ESCAPED = re.compile(r"\\(.)", re.S)
_LETTER = {"n": "\n", "t": "\t", "r": "\r"}
#: How tightly two-sided operators bind; all but ``^`` from the left.
_BINDS = {"or": 1, "and": 2, "==": 4, "!=": 4, "<": 5, ">": 5, "<=": 5, ">=": 5, "&": 6, "+": 7, "-": 7, "*": 8, "/": 8, "%": 8, "^": 10}
_SAME = {"=": "==", "<>": "!=", "&&": "and", "||": "or"}
_PREFIX = 9


@dataclass(frozen=True)
class Node:
    """``what`` is number, text, field, block, name, list, call or an operator; ``at`` is its place in the text."""

    what: str
    at: int
    says: object = None
    parts: tuple = ()


class _Reader:
    def __init__(self, text: str):
        self.pieces: list[tuple[str, object, int]] = []
        end = len(text.rstrip())
        at = 0
        while at < end:
            m = _PIECE.match(text, at)
            if not m:
                rest = text[at:].lstrip()
                raise FormulaError(f"unexpected {rest[:1]!r} at {len(text) - len(rest)}")
            kind = m.lastgroup if m.lastgroup != "id" else "block"
            says = m["id"] if kind == "block" else m[kind]
            if kind == "text":
                says = _ESCAPED.sub(lambda e: _LETTER.get(e[1], e[1]), says[1:-1])
            self.pieces.append((kind, says, m.start(kind)))
            at = m.end()
        self.pieces.append(("end", "", end))
        self.place = self.depth = 0

    def mark(self) -> str:
        """The operator or mark that comes next, in its plain form."""
        kind, says, _ = self.pieces[self.place]
        if kind == "name" and str(says) in ("and", "or", "not") and self.pieces[self.place + 1][1] != "(":
            return str(says)
        return _SAME.get(says, says) if kind == "mark" else ""

    def take(self, wanted: str) -> None:
        if self.mark() != wanted:
            _, says, at = self.pieces[self.place]
            raise FormulaError(f"expected {wanted!r} at {at}, found {says!r}" if says else f"expected {wanted!r} at the end")
        self.place += 1

    def whole(self) -> Node:
        node = self.expression(0)
        kind, says, at = self.pieces[self.place]
        if kind != "end":
            raise FormulaError(f"unexpected {says!r} at {at}")
        return node

    def expression(self, least: int) -> Node:
        self.depth += 1
        if self.depth > MOST_NESTED:
            raise FormulaError(f"nested more than {MOST_NESTED} deep")
        left = self.operand()
        while True:
            op, at = self.mark(), self.pieces[self.place][2]
            if op == "?" and least == 0:
                self.place += 1
                then = self.expression(0)
                self.take(":")
                left = Node("call", at, "if", (left, then, self.expression(0)))
            elif _BINDS.get(op, -1) > least:
                self.place += 1
                left = Node(op, at, None, (left, self.expression(_BINDS[op] - (op == "^"))))
            else:
                self.depth -= 1
                return left

    def operand(self) -> Node:
        op, (kind, says, at) = self.mark(), self.pieces[self.place]
        self.place += 1
        if op in ("-", "+"):
            inner = self.expression(_PREFIX)
            return inner if op == "+" else Node("negate", at, None, (inner,))
        if op in ("!", "not"):
            return Node("not", at, None, (self.expression(_PREFIX if op == "!" else 3),))
        if op == "(":
            node = self.expression(0)
            self.take(")")
        elif op == "[":
            node = Node("list", at, None, self.several("]"))
        elif kind == "number":
            node = Node("number", at, float(says))
        elif kind in ("text", "field", "block"):
            node = Node(kind, at, says)
        elif kind == "name":
            node = Node("name", at, says)
            if self.mark() == "(":
                self.place += 1
                node = Node("call", at, says, self.several(")"))
        else:
            raise FormulaError(f"unexpected {says!r} at {at}" if kind != "end" else "the formula ends too soon")
        while self.mark() in (".", "["):
            at = self.pieces[self.place][2]
            self.place += 1
            if self.pieces[self.place - 1][1] == "[":
                node = Node("call", at, "at", (node, self.expression(0)))
                self.take("]")
                continue
            kind, says, at = self.pieces[self.place]
            if kind != "name":
                raise FormulaError(f"expected a name after '.' at {at}")
            self.place += 1
            args = ()
            if self.mark() == "(":
                self.place += 1
                args = self.several(")")
            node = Node("call", at, says, (node, *args))
        return node

    def several(self, closing: str) -> tuple[Node, ...]:
        out = []
        if self.mark() == closing:
            self.place += 1
            return ()
        while True:
            out.append(self.expression(0))
            if self.mark() == closing:
                self.place += 1
                return tuple(out)
            self.take(",")


def parse(text: str) -> Node:
    """The tree of a formula; ``FormulaError`` says where it is not well formed."""
    if not text or not text.strip():
        raise FormulaError("the formula is empty")
    return _Reader(text).whole()


def fields_of(node: Node) -> set[tuple[str, str]]:
    """What a tree refers to: (``field``, ``block`` or ``name``; its text)."""
    own = {(node.what, str(node.says))} if node.what in ("field", "block", "name") else set()
    if node.what == "call" and node.says == "prop" and len(node.parts) == 1 and node.parts[0].what == "text":
        return {("field", str(node.parts[0].says))}
    return own.union(*map(fields_of, node.parts))


# --- kinds ---------------------------------------------------------------------


def shown(v: Value) -> Column:
    """A value as text: numbers without an exponent or a needless point, lists with commas between, blank as null."""
    if v.kind == "number":
        size = F.abs(v.column)
        whole = (v.column == F.floor(v.column)) & (size < 1e15)
        digits = F.rtrim(v.column.cast("decimal(38,18)").cast("string"), F.lit("0"))
        return F.when(whole, v.column.cast("long").cast("string")).when((size >= 1e-6) & (size < 1e15), digits).otherwise(v.column.cast("string"))
    if v.kind == "multitext":
        return F.array_join(v.column, ", ")
    if v.kind == "datetime":
        return F.date_format(v.column, "yyyy-MM-dd'T'HH:mm:ss")
    return v.column.cast("string")


def _as(v: Value, kind: str, where: str) -> Column:
    """A value as the kind that an argument takes."""
    if v.kind == kind:
        return v.column
    if v.kind == "blank":
        return F.lit(None).cast(KINDS[kind])
    if kind == "text":
        return shown(v)
    if kind == "number" and v.kind in ("text", "checkbox"):
        return number(v.column) if v.kind == "text" else v.column.cast("double")
    if kind == "checkbox":
        return truthy(v.column, v.kind)
    if kind == "multitext":
        return F.when(v.column.isNotNull(), F.array(shown(v))).otherwise(F.array().cast("array<string>"))
    if kind in DATES and v.kind in (*DATES, "text"):
        return v.column.try_cast(KINDS[kind])
    raise FormulaError(f"{where} takes a {kind}, not a {v.kind}")


def _common(values: list[Value], where: str) -> tuple[str, list[Column]]:
    """Values as one kind: their own if it is the same, the later of two date kinds, else text."""
    kinds = {v.kind for v in values} - {"blank"}
    kind = "text" if not kinds else kinds.pop() if len(kinds) == 1 else "datetime" if kinds <= set(DATES) else "text"
    return kind, [_as(v, kind, where) for v in values]


# --- calls ---------------------------------------------------------------------

#: What the letters of a signature take: a kind, a date of either kind, a whole number, a literal text or number,
#: any value, all remaining values as one list, or a formula over the elements of a list.
_TAKES = {"n": "number", "t": "text", "b": "checkbox", "l": "multitext"}
_GIVES = {"n": "number", "t": "text", "b": "checkbox", "l": "multitext", "D": "date", "d": "datetime"}

# What the functions of the two products take and give; ``?`` may be left out, ``*`` comes once or more.
TABLE_SIGNATURES = {
    "NOW": ">d", "TODAY": ">D", "AND": "b*>b", "OR": "b*>b", "XOR": "b*>b", "NOT": "b>b", "TRUE": ">b", "FALSE": ">b",
    "ABS": "n>n", "CEILING": "n N?>n", "FLOOR": "n N?>n", "ROUND": "n N?>n", "ROUNDUP": "n N?>n", "ROUNDDOWN": "n N?>n", "INT": "n>n", "EVEN": "n>n", "ODD": "n>n",
    "SQRT": "n>n", "EXP": "n>n", "LOG": "n N?>n", "POWER": "n n>n", "MOD": "n n>n", "VALUE": "t>n",
    "SUM": "v>n", "AVERAGE": "v>n", "COUNT": "v>n", "COUNTA": "v>n", "COUNTALL": "v>n",
    "TRIM": "t>t", "UPPER": "t>t", "LOWER": "t>t", "LEN": "t>n", "CONCATENATE": "t*>t", "LEFT": "t i>t", "RIGHT": "t i>t", "MID": "t i i>t",
    "FIND": "T t N?>n", "SEARCH": "T t N?>n", "SUBSTITUTE": "t t t>t", "REPLACE": "t i i t>t", "REPT": "t i>t", "ENCODE_URL_COMPONENT": "t>t", "T": "t>t", "ERROR": ">t", "ISERROR": "t>b",
    "YEAR": "d>n", "MONTH": "d>n", "DAY": "d>n", "HOUR": "d>n", "MINUTE": "d>n", "SECOND": "d>n", "WEEKDAY": "d>n", "WEEKNUM": "d T?>n",
    "DATETIME_FORMAT": "d T?>t", "DATETIME_PARSE": "t T?>d", "DATEADD": "d i T>d", "DATETIME_DIFF": "d d T?>n", "DATESTR": "d>t", "TIMESTR": "d>t",
    "IS_BEFORE": "d d>b", "IS_AFTER": "d d>b", "IS_SAME": "d d T?>b", "SET_TIMEZONE": "d T>d", "WORKDAY": "d i>D", "WORKDAY_DIFF": "d d>n", "FROMNOW": "d>t", "TONOW": "d>t",
    "ARRAYJOIN": "l T?>t", "ARRAYUNIQUE": "l>l", "ARRAYCOMPACT": "l>l", "ARRAYFLATTEN": "v>l",
    "REGEX_MATCH": "t T>b", "REGEX_EXTRACT": "t T>t", "REGEX_REPLACE": "t T T>t", "RECORD_ID": ">t", "CREATED_TIME": ">d", "LAST_MODIFIED_TIME": ">d",
}
PAGE_SIGNATURES = {
    "now": ">d", "today": ">D", "toNumber": "t>n", "format": "t>t", "empty": "t>b", "contains": "t t>b", "lower": "t>t", "upper": "t>t", "trim": "t>t", "repeat": "t i>t",
    "replace": "t t t>t", "replaceAll": "t T T>t", "substring": "t N N?>t", "test": "t T>b", "match": "t T>l", "split": "t T>l",
    "sort": "l>l", "unique": "l>l", "flat": "v>l", "join": "l T>t", "includes": "l t>b", "slice": "l N N?>l", "at": "l i>t", "first": "l>t", "last": "l>t",
    "map": "l f>l", "filter": "l c>l", "some": "l c>b", "every": "l c>b", "find": "l c>t", "findIndex": "l c>n",
    "sum": "v>n", "mean": "v>n", "median": "v>n", "max": "v>n", "min": "v>n",
    "abs": "n>n", "ceil": "n>n", "floor": "n>n", "round": "n>n", "sqrt": "n>n", "exp": "n>n", "ln": "n>n", "log10": "n>n", "log2": "n>n", "sign": "n>n", "cbrt": "n>n", "pi": ">n", "e": ">n", "pow": "n n>n",
    "subtract": "n n>n", "multiply": "n n>n", "divide": "n n>n", "mod": "n n>n",
    "formatDate": "d T>t", "parseDate": "t>d", "date": "d>n", "day": "d>n", "week": "d>n", "year": "d>n", "month": "d>n", "hour": "d>n", "minute": "d>n",
    "timestamp": "d>n", "dateAdd": "d i T>d", "dateSubtract": "d i T>d", "dateBetween": "d d T>n",
}
#: Those that the signature's list makes another function of, and those that give no null.
_OVER_LIST = {
    "SUM": fx.list_sum, "AVERAGE": fx.list_mean, "COUNT": fx.list_count, "COUNTA": fx.list_count_filled, "COUNTALL": fx.list_count_all, "ARRAYFLATTEN": lambda v: v,
    "sum": fx.list_sum, "mean": fx.list_mean, "median": fx.list_median, "max": fx.list_max, "min": fx.list_min, "flat": lambda v: v,
}
_OPERATOR_CALLS = {"add": "+", "equal": "==", "unequal": "!=", "and": "and", "or": "or"}


@dataclass
class Dialect:
    """What one product's formulas can call."""

    functions: Mapping[str, Callable[..., Column]]
    signatures: Mapping[str, str]
    folded: bool  # whether names of functions are the same in either case

    def name(self, said: str) -> str:
        return said.upper() if self.folded else said


TABLE = Dialect(fx.TABLE, TABLE_SIGNATURES, True)
PAGE = Dialect(fx.PAGE, PAGE_SIGNATURES, False)


@dataclass
class Compiler:
    """Turns trees of one dialect into values; ``fields`` by name, ``ids`` the names of fields by their ids."""

    dialect: Dialect
    fields: Mapping[str, Value]
    ids: Mapping[str, str] = field(default_factory=dict)

    def value(self, node: Node, bound: Mapping[str, Value] | None = None) -> Value:
        bound = bound or {}
        if node.what == "number":
            return Value(F.lit(node.says), "number", node.says)
        if node.what == "text":
            return Value(F.lit(node.says), "text", node.says) if node.says else Value(F.lit(""), "blank", "")
        if node.what in ("field", "block"):
            return self.field(str(node.says), node.at, needed=node.what == "block")
        if node.what == "name":
            if node.says in bound:
                return bound[node.says]
            if str(node.says).lower() in ("true", "false"):
                return Value(F.lit(str(node.says).lower() == "true"), "checkbox")
            return self.field(str(node.says), node.at)
        if node.what == "list":
            return Value(self.listed([self.value(p, bound) for p in node.parts]), "multitext")
        if node.what == "call":
            return self.call(node, bound)
        return self.operator(node.what, [self.value(p, bound) for p in node.parts])

    def field(self, said: str, at: int, needed: bool = False) -> Value:
        name = self.ids.get(said, said)
        if name not in self.fields or needed and said not in self.ids:
            raise FormulaError(f"no field {said!r} at {at}")
        return self.fields[name]

    def listed(self, values: list[Value]) -> Column:
        """Values, and the elements of those that are lists, as one list of texts."""
        lists = [v.column if v.kind == "multitext" else F.array(shown(v)) for v in values]
        return F.concat(*lists) if lists else F.array().cast("array<string>")

    def operator(self, op: str, values: list[Value]) -> Value:
        if op in ("and", "or", "not"):
            a, *b = (truthy(v.column, v.kind) if v.kind != "blank" else F.lit(False) for v in values)
            return Value(~a if op == "not" else a & b[0] if op == "and" else a | b[0], "checkbox")
        if op == "negate":
            return Value(-_as(values[0], "number", "'-'"), "number")
        if op in ("==", "!=", "<", ">", "<=", ">="):
            return Value(self.compared(op, *values), "checkbox")
        if op == "&" or op == "+" and not {v.kind for v in values} <= {"number", "checkbox", "blank"}:
            if op == "+" and any(v.kind in (*DATES, "multitext") for v in values):
                raise FormulaError(f"'+' takes numbers or texts, not a {values[0].kind} and a {values[1].kind}")
            return Value(fx.concatenate(*[F.lit("") if v.kind == "blank" else shown(v) for v in values]), "text")
        a, b = (_as(v, "number", f"{op!r}") for v in values)
        made = {"+": lambda: a + b, "-": lambda: a - b, "*": lambda: a * b, "/": lambda: F.try_divide(a, b), "%": lambda: F.try_mod(a, b), "^": lambda: F.pow(a, b)}
        return Value(made[op](), "number")

    def compared(self, op: str, a: Value, b: Value) -> Column:
        """Blank texts equal blank values; an order with a blank is false."""
        if {a.kind, b.kind} & {"blank"}:
            other = b if a.kind == "blank" else a
            empty = F.lit(True) if other.kind == "blank" else is_empty(other.column, other.kind)
            return empty if op == "==" else ~empty if op == "!=" else F.lit(False)
        # A text beside a number or a date is read as one.
        kinds = {a.kind, b.kind}
        kind = next((k for k in ("number", "datetime", "date") if kinds == {k, "text"}), None)
        x, y = (_as(a, kind, op), _as(b, kind, op)) if kind else _common([a, b], op)[1]
        if op in ("==", "!="):
            text = kind is None and "text" in (a.kind, b.kind)
            same = F.coalesce(x, F.lit("")) == F.coalesce(y, F.lit("")) if text else x.eqNullSafe(y)
            return same if op == "==" else ~same
        return F.coalesce({"<": x < y, ">": x > y, "<=": x <= y, ">=": x >= y}[op], F.lit(False))

    def call(self, node: Node, bound: Mapping[str, Value]) -> Value:
        name, parts = self.dialect.name(str(node.says)), node.parts
        special = getattr(self, f"call_{name.lower()}", None)
        if special and (self.dialect.folded or name in ("if", "ifs", "let", "lets", "prop", "length", "reverse", "not")):
            return special(node, bound)
        if name in ("MAX", "MIN"):
            return self.extreme(name, [self.value(p, bound) for p in parts], node.at)
        if name == "BLANK" and not parts:
            return Value(F.lit(""), "blank", "")
        if not self.dialect.folded and name in _OPERATOR_CALLS:
            self.counted(name, parts, 2, 2 if name in ("add", "equal", "unequal") else None)
            out = self.value(parts[0], bound)
            for p in parts[1:]:
                out = self.operator(_OPERATOR_CALLS[name], [out, self.value(p, bound)])
            return out
        signature = self.dialect.signatures.get(name)
        if signature is None:
            raise FormulaError(f"{node.says} can't be computed" if name in fx.NOT_COMPUTED else f"no function {node.says!r} at {node.at}")
        takes, gives = signature.split(">")
        letters = takes.split()
        if takes == "v":
            self.counted(name, parts, 1, None)
            return Value(_number_or(_OVER_LIST[name](self.listed([self.value(p, bound) for p in parts])), gives), _GIVES[gives])
        self.counted(name, parts, sum(len(x) == 1 or x[1] == "*" for x in letters), None if takes.endswith("*") else len(letters))
        args = [self.argument(letters[min(k, len(letters) - 1)][0], p, bound, name) for k, p in enumerate(parts)]
        try:
            made = self.dialect.functions[name](*args)
        except (KeyError, re.error) as e:
            raise FormulaError(f"{name} can't take {e.args[0]!r}") from e
        return Value(_number_or(made, gives), _GIVES[gives])

    @staticmethod
    def counted(name: str, parts: tuple, least: int, most: int | None) -> None:
        if len(parts) < least or most is not None and len(parts) > most:
            raise FormulaError(f"{name} takes {least if most == least else f'{least} to {most}' if most else f'{least} or more'} values, not {len(parts)}")

    def argument(self, letter: str, node: Node, bound: Mapping[str, Value], name: str):
        if letter in "fc":  # over the elements of a list
            def each(x: Column, index: Column | None = None) -> Column:
                inner = {**bound, "current": Value(x, "text")} | ({"index": Value(index.cast("double"), "number")} if index is not None else {})
                out = self.value(node, inner)
                return truthy(out.column, out.kind) if letter == "c" else shown(out)

            takes_index = ("name", "index") in fields_of(node) and name in ("map", "filter")
            return (lambda x, k: each(x, k)) if takes_index else (lambda x: each(x))
        v = self.value(node, bound)
        if letter in "TN":
            if letter == "T" and v.kind in ("text", "blank") and v.literal is not None:
                return v.literal
            said = v.literal if v.literal is not None else -self.value(node.parts[0]).literal if node.what == "negate" and node.parts[0].what == "number" else None
            if letter == "N" and isinstance(said, float):
                return int(said) if said == int(said) else said
            raise FormulaError(f"{name} takes a {'text' if letter == 'T' else 'number'} in quotes or digits here")
        if letter == "d":
            return v.column if v.kind in DATES else _as(v, "datetime", name)
        if letter == "i":
            return F.floor(_as(v, "number", name)).cast("int")
        return _as(v, _TAKES[letter], name)

    def extreme(self, name: str, values: list[Value], at: int) -> Value:
        """The largest or smallest of dates, if all are, else of numbers; lists give their elements."""
        self.counted(name, tuple(values), 1, None)
        if all(v.kind in DATES for v in values):
            kind, columns = _common(values, name)
            pick = F.greatest if name == "MAX" else F.least
            return Value(columns[0] if len(columns) == 1 else pick(*columns), kind)
        return Value((fx.list_max if name == "MAX" else fx.list_min)(self.listed(values)), "number")

    # Functions whose result has the kind of their values.

    def call_if(self, node: Node, bound: Mapping[str, Value]) -> Value:
        self.counted(str(node.says), node.parts, 2, 3)
        test, *results = (self.value(p, bound) for p in node.parts)
        results += [Value(F.lit(""), "blank", "")] * (2 - len(results))
        kind, (then, other) = _common(results, "IF")
        return Value(F.when(_as(test, "checkbox", "IF"), then).otherwise(other), kind)

    def call_ifs(self, node: Node, bound: Mapping[str, Value]) -> Value:
        self.counted("ifs", node.parts, 2, None)
        values = [self.value(p, bound) for p in node.parts]
        return self.cases([_as(v, "checkbox", "ifs") for v in values[: len(values) // 2 * 2 : 2]], values[1::2], values[-1] if len(values) % 2 else None)

    def call_switch(self, node: Node, bound: Mapping[str, Value]) -> Value:
        self.counted("SWITCH", node.parts, 3, None)
        value, *cases = (self.value(p, bound) for p in node.parts)
        tests = [self.compared("==", value, p) for p in cases[: len(cases) // 2 * 2 : 2]]
        return self.cases(tests, cases[1::2], cases[-1] if len(cases) % 2 else None)

    def cases(self, tests: list[Column], results: list[Value], default: Value | None) -> Value:
        kind, columns = _common([*results, default or Value(F.lit(""), "blank", "")], "a case")
        out = F.when(tests[0], columns[0])
        for test, result in zip(tests[1:], columns[1:]):
            out = out.when(test, result)
        return Value(out.otherwise(columns[-1]), kind)

    def call_not(self, node: Node, bound: Mapping[str, Value]) -> Value:
        self.counted(str(node.says), node.parts, 1, 1)
        return self.operator("not", [self.value(node.parts[0], bound)])

    def call_prop(self, node: Node, bound: Mapping[str, Value]) -> Value:
        if len(node.parts) != 1 or node.parts[0].what not in ("text", "block"):
            raise FormulaError("prop takes one name in quotes")
        return self.value(node.parts[0]) if node.parts[0].what == "block" else self.field(str(node.parts[0].says), node.at)

    def call_length(self, node: Node, bound: Mapping[str, Value]) -> Value:
        self.counted("length", node.parts, 1, 1)
        v = self.value(node.parts[0], bound)
        return Value((F.size(v.column) if v.kind == "multitext" else F.length(_as(v, "text", "length"))).cast("double"), "number")

    def call_reverse(self, node: Node, bound: Mapping[str, Value]) -> Value:
        self.counted("reverse", node.parts, 1, 1)
        v = self.value(node.parts[0], bound)
        return Value(F.reverse(v.column), "multitext") if v.kind == "multitext" else Value(F.reverse(_as(v, "text", "reverse")), "text")

    def call_let(self, node: Node, bound: Mapping[str, Value]) -> Value:
        self.counted(str(node.says), node.parts, 3, None)
        *pairs, last = node.parts
        if len(pairs) % 2 or any(p.what != "name" for p in pairs[::2]):
            raise FormulaError(f"{node.says} takes pairs of a name and a value, then a formula")
        inner = dict(bound)
        for name, value in zip(pairs[::2], pairs[1::2]):
            inner[str(name.says)] = self.value(value, inner)
        return self.value(last, inner)

    call_lets = call_let


def _number_or(column: Column, gives: str) -> Column:
    return column.cast("double") if gives == "n" else column.cast("timestamp_ntz") if gives == "d" else column


def compile_formula(text: str, fields: Mapping[str, Value], dialect: Dialect = TABLE, ids: Mapping[str, str] | None = None) -> Value:
    """One formula over fields that are known already."""
    return Compiler(dialect, fields, ids or {}).value(parse(text))


# --- fields of a table -----------------------------------------------------------


def kind_of(type_: T.DataType) -> str:
    """The kind that columns of a Spark type have."""
    if isinstance(type_, T.NumericType):
        return "number"
    if isinstance(type_, T.BooleanType):
        return "checkbox"
    if isinstance(type_, T.DateType):
        return "date"
    if isinstance(type_, (T.TimestampType, T.TimestampNTZType)):
        return "datetime"
    return "multitext" if isinstance(type_, T.ArrayType) else "text"


def typed_fields(records: DataFrame) -> dict[str, Value]:
    """The columns of a table as fields, each as the Spark type of its kind."""
    columns = {f.name: kind_of(f.dataType) for f in records.schema.fields}
    return {name: Value(F.col(f"`{name.replace('`', '``')}`").cast(KINDS[kind]), kind) for name, kind in columns.items()}


@dataclass
class Computed:
    """Formula fields by level (each level refers to earlier ones), their kinds, and what is wrong with those that are left out."""

    levels: list[dict[str, Column]]
    kinds: dict[str, str]
    problems: dict[str, str]

    def add_to(self, records: DataFrame) -> DataFrame:
        for level in self.levels:
            records = records.withColumns(level)
        return records


def compile_fields(formulas: Iterable[tuple[str, str]], fields: Mapping[str, Value], dialect: Dialect = TABLE, ids: Mapping[str, str] | None = None) -> Computed:
    """Formula fields (name and text), which may refer to each other in any order.

    A field with an error, one that refers to it and those on a cycle are left
    out, each with its problem; the first of two with one name counts.
    """
    ids, trees, problems = dict(ids or {}), {}, {}
    for name, text in formulas:
        if name in trees or name in problems:
            continue
        try:
            trees[name] = parse(text)
        except FormulaError as e:
            problems[name] = str(e)
    needs = {name: {ids.get(said, said) for _, said in fields_of(tree)} & (trees.keys() | problems.keys()) for name, tree in trees.items()}
    known, kinds, levels = dict(fields), {}, []
    left = dict(needs)
    while left:
        ready = [name for name, own in left.items() if not own & left.keys()]
        if not ready:
            break
        level = {}
        for name in ready:
            bad = sorted(left.pop(name) & problems.keys())
            try:
                if bad:
                    raise FormulaError(f"refers to {bad[0]!r}, which has an error")
                level[name] = Compiler(dialect, known, ids).value(trees[name])
            except FormulaError as e:
                problems[name] = str(e)
        for name, v in level.items():
            kinds[name] = "text" if v.kind == "blank" else v.kind
            known[name] = Value(F.col(f"`{name.replace('`', '``')}`"), kinds[name])
        if level:
            levels.append({name: (F.lit(None).cast("string") if v.kind == "blank" else v.column) for name, v in level.items()})
    for name in left:
        # Those that only lead to a cycle are told apart from those on it.
        seen, todo = set(), list(left[name] & left.keys())
        while todo:
            at = todo.pop()
            if at not in seen:
                seen.add(at)
                todo += left[at] & left.keys()
        problems[name] = "refers to itself" + ("" if name in needs[name] else " through others") if name in seen else "refers to a field that refers to itself"
    return Computed(levels, kinds, problems)


def formula_values(records: DataFrame, key: str, formulas: DataFrame, dialect: Dialect = TABLE, ids: Mapping[str, str] | None = None) -> DataFrame:
    """The values of formula fields as rows: ``key, formula, value, problem``.

    ``formulas`` has a row per formula field of the table (``name``, ``text``), which the driver
    reads. Each good one gives a row per record, ``value`` as ``shown`` writes it; a bad one gives
    one row with its ``problem`` and no key. All formulas are computed in one pass over ``records``.
    """
    rows = [(r["name"], r["text"]) for r in formulas.select("name", "text").orderBy("name", "text").collect()]
    made = compile_fields(rows, typed_fields(records), dialect, ids)
    pairs = [F.struct(F.lit(name).alias("formula"), shown(Value(F.col(f"`{name.replace('`', '``')}`"), kind)).alias("value")) for name, kind in made.kinds.items()]
    no = F.lit(None).cast("string").alias("problem")
    spark, id_type = records.sparkSession, records.schema[key].dataType
    schema = T.StructType([T.StructField(key, id_type), *T._parse_datatype_string("formula string, value string, problem string").fields])
    bad = spark.createDataFrame([(None, name, None, said) for name, said in sorted(made.problems.items())], schema)
    if not pairs:
        return bad
    values = made.add_to(records).select(key, F.explode(F.array(*pairs)).alias("_f")).select(key, "_f.formula", "_f.value", no)
    return values.unionByName(bad)


def rollup_formula(text: str, values: Column, dialect: Dialect = TABLE) -> Value:
    """A formula over the ``values`` of a field of linked records, which are a list of texts."""
    return compile_formula(text, {"values": Value(values, "multitext")}, dialect)
