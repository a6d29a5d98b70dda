"""What can be imported: one row per source format."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class SourceSpec:
    """A source's key, the file extensions it claims, and how it is read."""

    key: str
    extensions: tuple[str, ...]
    reader: str


SOURCES = (
    SourceSpec("csv", ("csv",), "notemill.sources.tables.read_csv"),
    SourceSpec("keep", ("zip", "json"), "notemill.sources.tables.keep_notes"),
    SourceSpec("outliner", ("zip", "json"), "notemill.sources.tables.outline_blocks"),
    SourceSpec("xml-notes", ("enex",), "notemill.sources.tables.xml_notes"),
    SourceSpec("html", ("html", "htm"), "notemill.sources.files.scan"),
    SourceSpec("markdown", ("md", "markdown", "txt"), "notemill.sources.files.scan"),
    SourceSpec("bundle", ("textbundle", "textpack", "zip"), "notemill.sources.files.bundles"),
    SourceSpec("archive", ("zip",), "notemill.sources.files.zip_entries"),
    SourceSpec("sqlite", ("sqlite", "db"), "notemill.sources.tables.SqliteSource"),
    SourceSpec("files", (), "notemill.sources.files.scan"),
)


def claims(spark: SparkSession) -> DataFrame:
    """``importer, extension, ordinal`` of every source."""
    rows = [(s.key, e, k) for k, s in enumerate(SOURCES) for e in s.extensions]
    return spark.createDataFrame(rows, "importer string, extension string, ordinal int")
