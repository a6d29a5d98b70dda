"""Formula functions of two table products as functions from columns to columns.

``TABLE`` and ``PAGE`` name every function of either dialect that can be
computed, and ``NOT_COMPUTED`` those that only the product itself can. Formulas
are composed in Python; field references are ``F.col``. Arithmetic never
raises: a division by zero, a text that is no number or an index past the end
is null.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from notemill.functions.values import is_empty, number, truthy

Cols = Column | str


def _lit(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


# --- lists ---------------------------------------------------------------------


def items(*values: Cols) -> Column:
    """Scalars of any types as one list of texts."""
    return F.array(*[_lit(v).cast("string") for v in values])


def numbers(values: Column) -> Column:
    """The numbers in a list of texts or numbers."""
    return F.filter(F.transform(values, lambda x: number(x)), lambda x: x.isNotNull())


def list_sum(values: Column) -> Column:
    return F.aggregate(numbers(values), F.lit(0.0), lambda a, x: a + x)


def list_mean(values: Column) -> Column:
    own = numbers(values)
    return F.try_divide(list_sum(values), F.size(own).cast("double"))


def list_median(values: Column) -> Column:
    own = F.array_sort(numbers(values))
    n = F.size(own)
    return (F.get(own, F.floor((n - 1) / 2).cast("int")) + F.get(own, F.floor(n / 2).cast("int"))) / 2


def list_max(values: Column) -> Column:
    return F.array_max(numbers(values))


def list_min(values: Column) -> Column:
    return F.array_min(numbers(values))


def list_count(values: Column) -> Column:
    return F.size(numbers(values))


def list_count_filled(values: Column) -> Column:
    return F.size(list_compact(values))


def list_count_all(values: Column) -> Column:
    return F.size(values)


def list_compact(values: Column) -> Column:
    return F.filter(values, lambda x: ~is_empty(x.cast("string")))


def list_slice(values: Column, start: int, end: int | None = None) -> Column:
    """Elements from ``start`` up to ``end``, both from 0; negative ones count from the end."""
    n = F.size(values)
    a = F.greatest(F.lit(start), F.lit(0)) if start >= 0 else F.greatest(n + start, F.lit(0))
    b = n if end is None else (F.least(F.lit(end), n) if end >= 0 else n + end)
    return F.slice(values, a + 1, F.greatest(b - a, F.lit(0)))


# --- numbers -------------------------------------------------------------------


def round_up(x: Column, places: int = 0) -> Column:
    """Away from zero."""
    scale = F.lit(10.0**places)
    return F.signum(x) * F.ceil(F.abs(x) * scale) / scale


def round_down(x: Column, places: int = 0) -> Column:
    """Toward zero."""
    scale = F.lit(10.0**places)
    return F.signum(x) * F.floor(F.abs(x) * scale) / scale


def even(x: Column) -> Column:
    """The next even number away from zero."""
    return F.signum(x) * 2 * F.ceil(F.abs(x) / 2)


def odd(x: Column) -> Column:
    """The next odd number away from zero; zero gives one."""
    return F.when(x == 0, F.lit(1.0)).otherwise(F.signum(x) * (2 * F.ceil((F.abs(x) - 1) / 2) + 1))


def multiple_above(x: Column, step: Cols = 1) -> Column:
    """The least multiple of ``step`` that is not below ``x``."""
    return F.ceil(x) if step == 1 else F.ceil(F.try_divide(x, _lit(step))) * _lit(step)


def multiple_below(x: Column, step: Cols = 1) -> Column:
    """The largest multiple of ``step`` that is not above ``x``."""
    return F.floor(x) if step == 1 else F.floor(F.try_divide(x, _lit(step))) * _lit(step)


def largest(*values: Cols, kind: str = "number") -> Column:
    """The largest of numbers, or of dates (``kind="date"``)."""
    return F.greatest(*map(_lit, values)) if kind == "date" else list_max(items(*values))


def smallest(*values: Cols, kind: str = "number") -> Column:
    """The smallest of numbers, or of dates (``kind="date"``)."""
    return F.least(*map(_lit, values)) if kind == "date" else list_min(items(*values))


# --- text ----------------------------------------------------------------------


def concatenate(*parts: Cols) -> Column:
    """Parts as text, one after the other; null counts as empty."""
    return F.concat(*[F.coalesce(_lit(p).cast("string"), F.lit("")) for p in parts])


def mid(text: Column, start: Cols, length: Cols) -> Column:
    return F.substring(text, _lit(start), _lit(length))


def overlay(text: Column, start: Cols, length: Cols, new: Cols) -> Column:
    return F.overlay(text, _lit(new), _lit(start), _lit(length))


def text_slice(text: Column, start: int, end: int | None = None) -> Column:
    n = F.length(text)
    a = F.lit(start) if start >= 0 else F.greatest(n + start, F.lit(0))
    b = n if end is None else (F.least(F.lit(end), n) if end >= 0 else n + end)
    return F.substring(text, a + 1, F.greatest(b - a, F.lit(0)))


def url_component(text: Column) -> Column:
    return F.replace(F.url_encode(text), F.lit("+"), F.lit("%20"))


# --- dates ---------------------------------------------------------------------

# Units of date arithmetic, singular, with the part of an interval they name.
UNITS = {"year": "years", "quarter": "months", "month": "months", "week": "weeks", "day": "days", "hour": "hours", "minute": "mins", "second": "secs"}


def interval(amount: Cols, unit: str) -> Column:
    one = unit.lower().rstrip("s")
    n = _lit(amount) * 3 if one == "quarter" else _lit(amount)
    return F.make_interval(**{UNITS[one]: n.cast("decimal(18,6)" if one == "second" else "int")})


def date_add(date: Column, amount: Cols, unit: str) -> Column:
    return date + interval(amount, unit)


def date_subtract(date: Column, amount: Cols, unit: str) -> Column:
    return date - interval(amount, unit)


def date_diff(later: Column, earlier: Column, unit: str = "seconds") -> Column:
    """Whole units from ``earlier`` to ``later``."""
    return F.timestamp_diff(unit.upper().rstrip("S"), earlier, later)


# Date tokens of the source products, with Spark's; ``Do`` has none.
TOKENS = {
    "YYYY": "yyyy", "YY": "yy", "MMMM": "MMMM", "MMM": "MMM", "MM": "MM", "M": "M", "DD": "dd", "D": "d", "dddd": "EEEE", "ddd": "EEE",
    "HH": "HH", "H": "H", "hh": "hh", "h": "h", "mm": "mm", "m": "m", "ss": "ss", "s": "s", "SSS": "SSS", "A": "a", "a": "a", "Z": "XXX",
}
_TOKEN = re.compile(r"\[([^\]]*)\]|Do|" + "|".join(sorted(TOKENS, key=len, reverse=True)))


def ordinal_day(date: Column) -> Column:
    """1st, 2nd, 3rd, 4th ... 31st."""
    day = F.dayofmonth(date)
    end = F.when(day.between(11, 13), "th").when(day % 10 == 1, "st").when(day % 10 == 2, "nd").when(day % 10 == 3, "rd").otherwise("th")
    return F.concat(day.cast("string"), end)


def date_format(date: Column, pattern: str = "YYYY-MM-DD") -> Column:
    """A date in a pattern of the source product's tokens; text in brackets stays as it is."""
    parts, at = [], 0
    for m in _TOKEN.finditer(pattern):
        if m.start() > at:
            parts.append(F.lit(pattern[at : m.start()]))
        at = m.end()
        parts.append(F.lit(m[1]) if m[1] is not None else ordinal_day(date) if m[0] == "Do" else F.date_format(date, TOKENS[m[0]]))
    if at < len(pattern):
        parts.append(F.lit(pattern[at:]))
    return F.concat(*parts) if parts else F.lit("")


def date_parse(text: Column, pattern: str | None = None) -> Column:
    """A text as a time, by a pattern of the source product's tokens or by ISO 8601; null if it does not fit."""
    if pattern is None:
        return F.try_to_timestamp(text)
    made, at = [], 0
    quoted = lambda s: re.sub(r"[A-Za-z]+", lambda m: f"'{m[0]}'", s)
    for m in _TOKEN.finditer(pattern):
        made += [quoted(pattern[at : m.start()]), quoted(m[1]) if m[1] is not None else TOKENS[m[0]]]
        at = m.end()
    return F.try_to_timestamp(text, F.lit("".join(made) + quoted(pattern[at:])))


def week_number(date: Column, first_day: str | None = None) -> Column:
    """ISO week; with ``first_day`` (``Sunday`` or ``Monday``) the week of the year whose first week holds January 1."""
    if first_day is None:
        return F.weekofyear(date)
    jan1 = F.trunc(date, "year")
    offset = F.weekday(jan1) if first_day == "Monday" else F.dayofweek(jan1) - 1
    return F.floor((F.dayofyear(date) - 1 + offset) / 7).cast("int") + 1


def workday(start: Column, days: Cols) -> Column:
    """The date so many Mondays to Fridays after ``start``, before it if negative."""
    n = _lit(days)
    day = F.weekday(start)
    # From the Friday on or before a weekend forward, from the Monday after it backward.
    base = F.when(n >= 0, F.date_sub(start, F.greatest(day - 4, F.lit(0)))).otherwise(F.date_add(start, F.when(day > 4, 7 - day).otherwise(0)))
    place = F.when(n >= 0, F.least(day, F.lit(4))).otherwise(F.when(day > 4, 0).otherwise(day)) + n
    moved = F.date_add(base, (F.floor(place / 5) * 7 + F.pmod(place, F.lit(5)) - (place - n)).cast("int"))
    return F.when(n == 0, start.cast("date")).otherwise(moved)


def from_now(date: Column, now: Column | None = None) -> Column:
    """How far a date is from now, in its largest unit: ``3 days``."""
    seconds = F.abs(F.timestamp_diff("SECOND", now if now is not None else F.current_timestamp(), date))
    out = None
    for size, unit in ((31_536_000, "year"), (2_592_000, "month"), (86_400, "day"), (3600, "hour"), (60, "minute")):
        n = F.floor(seconds / size)
        said = F.concat(n.cast("string"), F.when(n == 1, f" {unit}").otherwise(f" {unit}s"))
        out = F.when(seconds >= size, said) if out is None else out.when(seconds >= size, said)
    return out.otherwise(F.concat(seconds.cast("string"), F.when(seconds == 1, " second").otherwise(" seconds")))


def same(a: Column, b: Column, unit: str | None = None) -> Column:
    """Equal, or equal down to a unit."""
    return a == b if unit is None else F.date_trunc(unit.rstrip("s"), a) == F.date_trunc(unit.rstrip("s"), b)


def workdays_between(start: Column, end: Column) -> Column:
    """Monday to Friday dates in [start, end], negative if reversed."""
    low, high = F.least(start, end).cast("date"), F.greatest(start, end).cast("date")
    n = F.date_diff(high, low) + 1
    rest = F.pmod(n, F.lit(7))
    first = F.weekday(low)
    tail = F.least(rest, F.greatest(F.lit(5) - first, F.lit(0))) + F.greatest(first + rest - 7, F.lit(0))
    count = F.floor(n / 7).cast("int") * 5 + tail
    return F.when(start > end, -count).otherwise(count)


# --- logic ---------------------------------------------------------------------


def if_(condition: Column, then: Cols, otherwise: Cols = None, kind: str = "checkbox") -> Column:
    return F.when(truthy(condition, kind), _lit(then)).otherwise(_lit(otherwise))


def and_(*values: Column, kind: str = "checkbox") -> Column:
    out = F.lit(True)
    for v in values:
        out = out & truthy(v, kind)
    return out


def or_(*values: Column, kind: str = "checkbox") -> Column:
    out = F.lit(False)
    for v in values:
        out = out | truthy(v, kind)
    return out


def xor(*values: Column, kind: str = "checkbox") -> Column:
    """An odd number of truthy values."""
    n = F.lit(0)
    for v in values:
        n = n + truthy(v, kind).cast("int")
    return n % 2 == 1


def switch(value: Column, *cases: Cols) -> Column:
    """Pairs of pattern and result, then perhaps a default."""
    pairs, default = (cases[:-1], cases[-1]) if len(cases) % 2 else (cases, None)
    out = None
    for pattern, result in zip(pairs[::2], pairs[1::2]):
        test = value == _lit(pattern)
        out = F.when(test, _lit(result)) if out is None else out.when(test, _lit(result))
    return out.otherwise(_lit(default)) if out is not None else _lit(default)


# --- the dialects --------------------------------------------------------------

Function = Callable[..., Column]

# The names of both tables are those of the source products.

TABLE: dict[str, Function] = {
    "IF": if_, "NOW": F.current_timestamp, "TODAY": F.current_date, "SWITCH": switch,
    "MAX": largest, "MIN": smallest,
    "AND": and_, "OR": or_, "NOT": lambda x, kind="checkbox": ~truthy(x, kind), "XOR": xor, "TRUE": lambda: F.lit(True), "FALSE": lambda: F.lit(False),
    "ABS": F.abs, "CEILING": multiple_above, "FLOOR": multiple_below, "ROUND": lambda x, p=0: F.round(x, p), "ROUNDUP": round_up, "ROUNDDOWN": round_down,
    "INT": F.floor, "EVEN": even, "ODD": odd, "SQRT": F.sqrt, "EXP": F.exp, "LOG": lambda x, base=10.0: F.try_divide(F.log(x), F.log(F.lit(float(base)))),
    "POWER": F.pow, "MOD": F.try_mod, "VALUE": number,
    "SUM": lambda *v: list_sum(items(*v)), "AVERAGE": lambda *v: list_mean(items(*v)), "COUNT": lambda *v: list_count(items(*v)),
    "COUNTA": lambda *v: list_count_filled(items(*v)), "COUNTALL": lambda *v: list_count_all(items(*v)),
    "TRIM": F.trim, "UPPER": F.upper, "LOWER": F.lower, "LEN": F.length, "CONCATENATE": concatenate, "LEFT": lambda s, n: F.left(s, _lit(n)),
    "RIGHT": lambda s, n: F.right(s, _lit(n)), "MID": mid, "FIND": lambda what, text, start=1: F.locate(what, text, start),
    "SEARCH": lambda what, text, start=1: F.nullif(F.locate(what, text, start), F.lit(0)),
    "SUBSTITUTE": lambda s, old, new: F.replace(s, _lit(old), _lit(new)), "REPLACE": overlay, "REPT": F.repeat, "ENCODE_URL_COMPONENT": url_component,
    "T": lambda s: s.cast("string"), "BLANK": lambda: F.lit(""), "ERROR": lambda: F.lit("!ERROR"), "ISERROR": lambda x: F.coalesce(x == "!ERROR", F.lit(False)),
    "YEAR": F.year, "MONTH": F.month, "DAY": F.dayofmonth, "HOUR": F.hour, "MINUTE": F.minute, "SECOND": F.second,
    "WEEKDAY": lambda d: F.dayofweek(d) - 1, "WEEKNUM": week_number, "DATETIME_FORMAT": date_format, "DATETIME_PARSE": date_parse, "WORKDAY": workday, "FROMNOW": from_now, "TONOW": from_now,
    "DATEADD": date_add, "DATETIME_DIFF": date_diff, "DATESTR": lambda d: F.date_format(d, "yyyy-MM-dd"), "TIMESTR": lambda d: F.date_format(d, "HH:mm:ss"),
    "IS_BEFORE": lambda a, b: a < b, "IS_AFTER": lambda a, b: a > b, "IS_SAME": same, "SET_TIMEZONE": F.from_utc_timestamp, "WORKDAY_DIFF": workdays_between,
    "ARRAYJOIN": lambda v, sep=", ": F.array_join(v, sep), "ARRAYFLATTEN": F.flatten, "ARRAYUNIQUE": F.array_distinct, "ARRAYCOMPACT": list_compact,
    "REGEX_MATCH": lambda s, p: F.rlike(s, F.lit(p)), "REGEX_EXTRACT": lambda s, p: F.nullif(F.regexp_extract(s, p, 0), F.lit("")),
    "REGEX_REPLACE": lambda s, p, r: F.regexp_replace(s, p, r),
    "RECORD_ID": lambda: F.col("record_id"), "CREATED_TIME": lambda: F.col("created_time"), "LAST_MODIFIED_TIME": lambda: F.col("modified_time"),
}

PAGE: dict[str, Function] = {
    "if": if_, "ifs": lambda *v: switch(F.lit(True), *v), "now": F.current_timestamp, "today": F.current_date, "toNumber": number,
    "length": F.length, "format": lambda x: x.cast("string"), "contains": lambda s, x: F.contains(s, _lit(x)), "lower": F.lower, "upper": F.upper,
    "replace": lambda s, a, b: F.replace(s, _lit(a), _lit(b)), "replaceAll": lambda s, p, r: F.regexp_replace(s, p, r), "substring": text_slice,
    "reverse": F.reverse, "sort": F.array_sort, "unique": F.array_distinct, "flat": F.flatten, "join": lambda v, sep: F.array_join(v, sep),
    "includes": F.array_contains, "slice": list_slice, "map": F.transform, "filter": F.filter, "some": F.exists, "every": F.forall,
    "find": lambda v, f: F.get(F.filter(v, f), F.lit(0)), "at": lambda v, i: F.get(v, _lit(i)), "first": lambda v: F.get(v, F.lit(0)),
    "last": lambda v: F.try_element_at(v, F.lit(-1)), "abs": F.abs, "ceil": F.ceil, "floor": F.floor, "round": lambda x: F.round(x, 0),
    "sqrt": F.sqrt, "exp": F.exp, "ln": F.log, "log10": F.log10, "log2": F.log2, "sign": F.signum, "cbrt": F.cbrt, "pi": F.pi, "e": F.e, "pow": F.pow,
    "formatDate": date_format, "parseDate": lambda s: F.try_to_timestamp(s), "date": F.dayofmonth, "year": F.year, "month": F.month, "hour": F.hour,
    "minute": F.minute, "day": lambda d: F.weekday(d) + 1, "week": F.weekofyear, "timestamp": lambda d: F.unix_millis(d.cast("timestamp")),
    "fromTimestamp": F.timestamp_millis, "dateAdd": date_add, "dateSubtract": date_subtract, "dateBetween": date_diff,
    "add": lambda a, b: a + b, "subtract": lambda a, b: a - b, "multiply": lambda a, b: a * b, "divide": F.try_divide, "mod": F.try_mod,
    "equal": lambda a, b: a == b, "unequal": lambda a, b: a != b, "sum": list_sum, "mean": list_mean, "median": list_median, "max": list_max, "min": list_min,
    "test": lambda s, p: F.rlike(s, F.lit(p)), "repeat": F.repeat, "split": lambda s, sep: F.split(s, re.escape(sep)), "trim": F.trim, "empty": is_empty,
    "match": lambda s, p: F.regexp_extract_all(s, F.lit(p), F.lit(0)), "findIndex": lambda v, f: F.array_position(F.transform(v, f), True) - 1,
    "dateRange": lambda a, b: F.struct(a.alias("start"), b.alias("end")), "dateStart": lambda r: r["start"], "dateEnd": lambda r: r["end"],
    "let": lambda value, f: f(_lit(value)), "lets": lambda *v: v[-1](*map(_lit, v[:-1])),
    "prop": F.col,
}

#: Need the product's own state, locale or rendering.
NOT_COMPUTED = ("SET_LOCALE", "style", "unstyle", "link", "id", "name", "email")
