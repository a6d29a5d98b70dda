"""Rollups: aggregates of a property over linked records, one result per record."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notemill.functions.values import is_empty, number


def _filled(v: Column) -> Column:
    return ~is_empty(v.cast("string"))


def _in_order(v: Column, pos: Column) -> Column:
    return F.transform(F.array_sort(F.collect_list(F.struct(pos.alias("p"), v.cast("string").alias("v")))), lambda x: x["v"])


def joined_by(v: Column, pos: Column, separator: str = ", ") -> Column:
    return F.array_join(F.array_compact(_in_order(v, pos)), separator)


def _share(count: Column, all_: Column) -> Column:
    return F.coalesce(F.try_divide(count * 100.0, all_), F.lit(0.0))


#: By name: (column of values, column of positions, column that is not null for a link) -> aggregate.
ROLLUPS = {
    "show_original": lambda v, pos, link: F.array_compact(_in_order(v, pos)),
    "show_unique": lambda v, pos, link: F.array_distinct(F.array_compact(_in_order(v, pos))),
    "count": lambda v, pos, link: F.count(link),
    "count_values": lambda v, pos, link: F.count(link),
    "count_filled": lambda v, pos, link: F.count_if(_filled(v)),
    "unique": lambda v, pos, link: F.count_distinct(v),
    "empty": lambda v, pos, link: F.count_if(link.isNotNull() & ~_filled(v)),
    "not_empty": lambda v, pos, link: F.count_if(_filled(v)),
    "percent_empty": lambda v, pos, link: _share(F.count_if(link.isNotNull() & ~_filled(v)), F.count(link)),
    "percent_not_empty": lambda v, pos, link: _share(F.count_if(_filled(v)), F.count(link)),
    "earliest_date": lambda v, pos, link: F.min(v.try_cast("date")),
    "latest_date": lambda v, pos, link: F.max(v.try_cast("date")),
    "date_range": lambda v, pos, link: F.concat(F.min(v.try_cast("date")).cast("string"), F.lit(" → "), F.max(v.try_cast("date")).cast("string")),
    "SUM": lambda v, pos, link: F.coalesce(F.sum(number(v)), F.lit(0.0)),
    "AVERAGE": lambda v, pos, link: F.avg(number(v)),
    "AVG": lambda v, pos, link: F.avg(number(v)),
    "MAX": lambda v, pos, link: F.max(number(v)),
    "MIN": lambda v, pos, link: F.min(number(v)),
    "COUNT": lambda v, pos, link: F.count(number(v)),
    "COUNTA": lambda v, pos, link: F.count_if(_filled(v)),
    "COUNTALL": lambda v, pos, link: F.count(link),
    "ARRAYJOIN": lambda v, pos, link: joined_by(v, pos),
    "ARRAYUNIQUE": lambda v, pos, link: F.array_distinct(F.array_compact(_in_order(v, pos))),
    "ARRAYCOMPACT": lambda v, pos, link: F.filter(F.array_compact(_in_order(v, pos)), lambda x: x != ""),
    "ARRAYFLATTEN": lambda v, pos, link: F.flatten(F.array_agg(v)),
    "AND": lambda v, pos, link: F.coalesce(F.bool_and(F.coalesce(v.try_cast("boolean"), F.lit(False))), F.lit(True)),
    "OR": lambda v, pos, link: F.coalesce(F.bool_or(F.coalesce(v.try_cast("boolean"), F.lit(False))), F.lit(False)),
}


class UnsupportedRollup(ValueError):
    """A rollup that has no name here."""


def rollup(links: DataFrame, targets: DataFrame, record: str, target: str, value: str, **wanted: str | tuple[str, str]) -> DataFrame:
    """Aggregates over links, in one shuffle on the record.

    ``links`` has ``record``, ``pos`` and ``target``; ``targets`` has ``target``
    and ``value``. ``wanted`` names each result's rollup, ``("ARRAYJOIN", separator)`` with a separator. A record whose
    ``target`` is null has no links and keeps its row: counts are 0.
    """
    split = {name: how for name, how in wanted.items() if not isinstance(how, str)}
    if unknown := {how if isinstance(how, str) else how[0] for how in wanted.values()} - set(ROLLUPS) | {how[0] for how in split.values() if how[0] != "ARRAYJOIN"}:
        raise UnsupportedRollup(", ".join(sorted(unknown)))
    joined = links.join(targets.select(target, F.col(value).alias("_v")), target, "left")
    own = lambda how: (F.col("_v"), F.col("pos")) if how in split.values() else (F.col("_v"), F.col("pos"), F.col(target))
    made = [(joined_by(*own(how), how[1]) if how in split.values() else ROLLUPS[how](*own(how))).alias(name) for name, how in wanted.items()]
    return joined.groupBy(record).agg(*made)
