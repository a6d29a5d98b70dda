"""Saved views: a filter, computed columns and an ordered projection, per view."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notemill.functions.text import property_name, view_name


@dataclass
class View:
    """A named view of a table: rows that ``where`` keeps, ``columns`` in order, ``sort``, at most ``limit`` rows."""

    name: str
    where: Column | None = None
    columns: list[str] = field(default_factory=list)
    sort: list[Column | str] = field(default_factory=list)
    limit: int | None = None


@dataclass
class Base:
    """A table's views over the same computed columns, which are named once and evaluated where a view asks for them."""

    views: list[View]
    formulas: dict[str, Column] = field(default_factory=dict)
    where: Column | None = None

    def apply(self, table: DataFrame, name: str) -> DataFrame:
        view = next(v for v in self.views if v.name == name)
        rows = table if self.where is None else table.where(self.where)
        rows = rows.withColumns(self.formulas) if self.formulas else rows
        rows = rows if view.where is None else rows.where(view.where)
        rows = rows.orderBy(*view.sort) if view.sort else rows
        rows = rows if view.limit is None else rows.limit(view.limit)
        return rows.select(*view.columns) if view.columns else rows

    def merged(self, imported: Base) -> Base:
        """The user's views stay; of one name the imported view wins."""
        own = {v.name: v for v in self.views} | {v.name: v for v in imported.views}
        return Base(list(own.values()), self.formulas | imported.formulas, imported.where)


def in_view(token: str, views: str = "views") -> Column:
    return F.array_contains(F.col(views), token)


def in_folder(folder: str) -> Column:
    return F.col("folder") == folder


def ordered_columns(visible: list[str], known: list[str], first: str = "name") -> list[str]:
    """The name, the view's visible columns in order, then none other; all columns where a view lists none."""
    shown = [c for c in visible if c in known] or known
    return list(dict.fromkeys([first, *shown]))


def renamed(table: DataFrame, names: dict[str, str]) -> DataFrame:
    """Columns as property names without quotes and backslashes."""
    clean = {k: v.replace('"', "").replace("\\", "") for k, v in names.items()}
    return table.withColumnsRenamed(clean)


def is_blank_record(values: dict[str, str]) -> Column:
    """A record whose every field (name to kind) is empty."""
    from notemill.functions.values import is_empty

    out = F.lit(True)
    for name, kind in values.items():
        out = out & is_empty(F.col(name), kind)
    return out


__all__ = ["Base", "View", "in_folder", "in_view", "is_blank_record", "ordered_columns", "property_name", "renamed", "view_name"]
