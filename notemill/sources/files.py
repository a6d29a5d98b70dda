"""Files, archives and their text as tables."""

from __future__ import annotations

import io
import mimetypes
import re
import zipfile
from collections.abc import Iterator
from datetime import datetime

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from notemill.functions.text import path_parts

#: Files that begin with this hold an encrypted compound document.
COMPOUND = "D0CF11E0A1B11AE1"


def scan(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Files below ``path`` with ``parent, name, basename, extension, mtime, size, content``; content is read only if used."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    parts = path_parts(F.col("path"))
    return files.select("path", *[c.alias(n) for n, c in parts.items()], F.col("modificationTime").alias("mtime"), F.col("length").alias("size"), "content")


def accepted(files: DataFrame, extensions: list[str], hidden: bool = False) -> DataFrame:
    """Files with one of the extensions, outside resource-fork folders and dot paths."""
    rows = files.where(F.col("extension").isin(*extensions)) if extensions else files
    return rows if hidden else rows.where(~F.col("path").rlike(r"(?:^|/)(?:__MACOSX/|\.[^/])"))


_ENTRY = "archive string, entry string, mtime timestamp_ntz, size long, content binary, error string"
_KINDS = {"archive": pa.string(), "entry": pa.string(), "mtime": pa.timestamp("us"), "size": pa.int64(), "content": pa.binary(), "error": pa.string()}
#: Entries that are handed on at once: so many, or of so many bytes.
_ROWS, _BYTES = 1_000, 8_000_000


def zip_entries(archives: DataFrame, path: str = "path", content: str = "content", nested: bool = False) -> DataFrame:
    """A row per file in each archive, and one with ``error`` for an archive that cannot be read.

    ``nested`` also opens archives in an archive's root. Resource forks and dot paths are left out.
    """

    def opened(name: str, data: bytes, deeper: bool) -> Iterator[tuple]:
        try:
            with zipfile.ZipFile(io.BytesIO(data)) as archive:
                for info in archive.infolist():
                    at = info.filename
                    if info.is_dir() or re.search(r"(?:^|/)(?:__MACOSX/|\.)", at):
                        continue
                    body = archive.read(info)
                    if deeper and at.lower().endswith(".zip") and "/" not in at:
                        yield from opened(f"{name}/{at}", body, False)
                    else:
                        yield name, at, datetime(*info.date_time), info.file_size, body, None
        except (zipfile.BadZipFile, OSError, RuntimeError, ValueError) as e:
            yield name, None, None, None, None, f"{type(e).__name__}: {e}"

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Small entries go many at a time; only so many bytes are held.
        rows, held = [], 0
        for part in parts:
            for name, data in zip(part[path], part[content]):
                for row in opened(name.as_py(), data.as_py(), nested):
                    rows.append(row)
                    held += len(row[4] or b"")
                    if len(rows) >= _ROWS or held >= _BYTES:
                        yield _entries(rows)
                        rows, held = [], 0
        if rows:
            yield _entries(rows)

    return archives.select(path, content).mapInArrow(run, _ENTRY)


def _entries(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(values, kind) for values, kind in zip(zip(*rows), _KINDS.values())], names=list(_KINDS))


def decoded(content: Column) -> Column:
    """Bytes as text: by the byte order mark, else by the charset that the first 1024 bytes declare, else UTF-8."""

    @F.pandas_udf("string")
    def run(data: pd.Series) -> pd.Series:
        def one(raw: bytes | None) -> str | None:
            if raw is None:
                return None
            for mark, name in ((b"\xef\xbb\xbf", "utf-8-sig"), (b"\xff\xfe", "utf-16"), (b"\xfe\xff", "utf-16")):
                if raw.startswith(mark):
                    return raw.decode(name, "replace")
            said = re.search(rb"""(?:charset|encoding)\s*=\s*["']?([\w.:-]+)""", raw[:1024], re.I)
            try:
                return raw.decode(said[1].decode("ascii") if said else "utf-8", "replace")
            except LookupError:
                return raw.decode("utf-8", "replace")

        return data.map(one)

    return run(content)


def is_encrypted(content: Column) -> Column:
    return F.hex(F.substring(content, 1, 8)) == COMPOUND


def bundles(entries: DataFrame, entry: str = "entry", suffix: str = "textbundle") -> DataFrame:
    """Entries with ``bundle``, the path up to the bundle folder they lie in, and ``inner``, the path in it; others go."""
    pattern = rf"^(.*?\.{suffix})/(.*)$"
    found = entries.withColumn("bundle", F.regexp_extract(entry, pattern, 1)).withColumn("inner", F.regexp_extract(entry, pattern, 2))
    return found.where("bundle <> ''")


def mime_extensions(spark: SparkSession) -> DataFrame:
    """``mime, extension`` of the types that Python's own table knows, its preferred extension each."""
    known = sorted(set(mimetypes.types_map.values()))
    return spark.createDataFrame([(m, mimetypes.guess_extension(m).lstrip(".")) for m in known], "mime string, extension string")


def with_extension(files: DataFrame, mimes: DataFrame, mime: str = "mime") -> DataFrame:
    """Add ``extension`` from a content type such as ``text/html; charset=utf-8``; unknown types give null."""
    bare = F.lower(F.trim(F.substring_index(mime, ";", 1)))
    return files.withColumn("_mime", bare).join(mimes.withColumnRenamed("mime", "_mime"), "_mime", "left").drop("_mime")


def data_url(url: Column) -> Column:
    """The bytes of a ``data:`` URL, Base64 or percent-encoded; null for others."""
    body = F.regexp_extract(url, r"(?s)^data:[^,]*,(.*)$", 1)
    plain = F.encode(F.try_url_decode(F.replace(body, F.lit("+"), F.lit("%2B"))), "UTF-8")
    return F.when(url.rlike(r"^data:[^,]*;base64,"), F.try_to_binary(body, F.lit("base64"))).when(url.rlike("^data:"), plain)
