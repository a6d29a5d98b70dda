"""One recorded export, however large, read by many tasks: the records of a JSON document in ranges of bytes.

Two short passes tell where the ranges can begin. The first counts, for each block of the file,
quotes and brackets under both assumptions about its first byte; their running sums say for each
block whether it begins within a text and how deep. The second finds the few outer brackets.
"""

from __future__ import annotations

import json
import re
from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import (
    DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual, StringStartsWith,
)

#: Blocks of a document at most: of a larger one they are longer, so that its index does not grow with it.
MOST_BLOCKS = 1_000
#: Bytes of a block, at which a range can begin; bytes read at once; bytes looked back at for a run of backslashes.
BLOCK, CHUNK, BACK = 16_000_000, 1_000_000, 4_096
#: Depth of the arrays that hang on an object in a top-level array, and of those on an object at the top.
_INNER, _OUTER = 4, 3
RECORDS = "table_id string, record_id string, at long, created_time string, fields map<string,string>"
VIEWS = "view_id string, record_id string"


_STEPS = np.zeros(256, np.int8)
_STEPS[[ord(c) for c in "[{"]], _STEPS[[ord(c) for c in "]}"]] = 1, -1


def _file_system(uri: str):
    from pyarrow.fs import FileSystem

    return FileSystem.from_uri(uri)


def parts_of(path: str) -> list[tuple[str, int]]:
    """URI and size of the files that make up a document: one file, or those of a folder in the order of their names.

    ``path`` is of any file system that pyarrow knows, a URI or a local path.
    """
    from pyarrow.fs import FileSelector, FileType

    uri = path if "://" in path or path.startswith("file:") else f"file://{path}"
    fs, at = _file_system(uri)
    info = fs.get_file_info(at)
    if info.type != FileType.Directory:
        return [(uri, fs.open_input_file(at).size())]
    held = sorted((f.base_name, f.size) for f in fs.get_file_info(FileSelector(at)) if f.type == FileType.File and f.base_name[0] not in "_.")
    return [(f"{uri.rstrip('/')}/{name}", size) for name, size in held if size]


class _Document:
    """The bytes of a document's parts, one behind the other."""

    def __init__(self, parts: list[tuple[str, int]]):
        self.parts, self.ends = parts, list(accumulate(size for _, size in parts))
        self.at, self.open, self.file = 0, None, None

    def __enter__(self):
        return self

    def __exit__(self, *_) -> None:
        if self.file is not None:
            self.file.close()

    def seek(self, at: int) -> None:
        self.at = at

    def read(self, n: int) -> bytes:
        found = []
        while n > 0 and (k := bisect_right(self.ends, self.at)) < len(self.parts):
            if self.open != k:
                self.__exit__()
                fs, at = _file_system(self.parts[k][0])
                self.open, self.file = k, fs.open_input_file(at)
            self.file.seek(self.at - (self.ends[k] - self.parts[k][1]))
            data = self.file.read(min(n, self.ends[k] - self.at))
            if not data:
                break
            found.append(data)
            n, self.at = n - len(data), self.at + len(data)
        return b"".join(found)


def structure(data: bytes, before: bytes, inside: bool, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, bool]:
    """Bytes, which of them stand outside texts, the depth after each, and whether a text goes on.

    ``before`` is what precedes ``data``: a quote behind an odd number of backslashes ends no text.
    """
    whole = np.frombuffer(before + data, np.uint8)
    slashes, escaped = np.flatnonzero(whole == ord("\\")), np.zeros(len(whole) + 1, bool)
    if len(slashes):
        first = np.concatenate([[True], np.diff(slashes) > 1])
        begins, ends = slashes[first], slashes[np.concatenate([first[1:], [True]])]
        escaped[ends[(ends - begins) % 2 == 0] + 1] = True
    escaped = escaped[len(before) : -1]
    own = whole[len(before) :]
    quote = (own == ord('"')) & ~escaped
    within = (np.cumsum(quote) + inside) % 2 == 1
    outside = ~within & ~quote
    return own, outside, depth + np.cumsum(np.where(outside, _STEPS[own], 0), dtype=np.int64), bool(within[-1]) if len(own) else inside


def _chunks(parts: list, begin: int, end: int, inside: bool, depth: int) -> Iterator[tuple]:
    """``structure`` of the bytes from ``begin`` to ``end``, with the place and bytes of each part, and whether a text goes on behind it."""
    with _Document(parts) as file:
        file.seek(max(0, begin - BACK))
        before = file.read(begin - max(0, begin - BACK))
        while begin < end and (data := file.read(min(CHUNK, end - begin))):
            own, outside, level, inside = structure(data, before, inside, depth)
            yield begin, data, own, outside, level, inside
            depth, before, begin = int(level[-1]), (before + data)[-BACK:], begin + len(data)


def _counted(parts: list, size: int, block: int):
    """By block: the change of depth if it begins outside a text, and within one; whether the first ends within one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for k in (k for batch in batches for k in batch["id"].to_pylist()):
            depth, inside, all_steps = 0, False, 0
            for _, data, *_, level, inside in _chunks(parts, k * block, min(size, (k + 1) * block), False, 0):
                depth = int(level[-1])
                all_steps += sum(data.count(c) for c in (b"[", b"{")) - sum(data.count(c) for c in (b"]", b"}"))
            # Within a text, what stands outside texts is just the other brackets.
            yield pa.RecordBatch.from_pylist([{"block": k, "without": depth, "within": all_steps - depth, "opens": inside}])

    return run


def _outer(parts: list, size: int, block: int, states: list[tuple[bool, int]]):
    """The brackets that lead to or from a depth of ``_INNER`` at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for k in (k for batch in batches for k in batch["id"].to_pylist()):
            inside, depth = states[k]
            for begin, _, own, outside, level, _ in _chunks(parts, k * block, min(size, (k + 1) * block), inside, depth):
                opens, closes = _STEPS[own] > 0, _STEPS[own] < 0
                at = np.flatnonzero(outside & (opens & (level <= _INNER) | closes & (level < _INNER)))
                yield pa.RecordBatch.from_arrays([pa.array(begin + at), pa.array(level[at].astype(np.int64)), pa.array([chr(c) for c in own[at]], pa.string())], names=["at", "depth", "bracket"])

    return run


def index_of(spark: SparkSession, path: str, block: int = BLOCK) -> dict:
    """Where the arrays of an export stand, and the state at each block: what readers of its ranges need.

    ``arrays``: ``[name of the owner's array or object, owner's id, array's name, begin, end, depth]``,
    of arrays such as ``tables[i].records`` (the owner's id is its member ``id``) and ``viewRecords.x``.
    As large as the number of tables, views and blocks; both passes over the file are Spark jobs.
    """
    files = parts_of(path)
    size = sum(n for _, n in files)
    block = max(block, -(-size // MOST_BLOCKS))
    blocks = -(-size // block)
    each = spark.range(0, blocks, 1, max(1, blocks)).select("id")
    rows = {r.block: r for r in each.mapInArrow(_counted(files, size, block), "block long, without long, within long, opens boolean").collect()}
    states, inside, depth = [], False, 0
    for k in range(blocks):
        states.append((inside, depth))
        depth += rows[k].within if inside else rows[k].without
        inside = inside != rows[k].opens
    outer = each.mapInArrow(_outer(files, size, block, states), "at long, depth long, bracket string").orderBy("at")
    arrays, opened = [], []
    with _Document(files) as file:
        def text(begin: int, end: int) -> str:
            file.seek(max(0, begin))
            return file.read(max(0, end - max(0, begin))).decode("utf-8", "replace")

        def name_before(at: int) -> str:
            m = re.search(r'"((?:[^"\\]|\\.)*)"\s*:\s*$', text(at - BACK, at), re.S)
            return json.loads(f'"{m[1]}"') if m else ""

        for r in outer.toLocalIterator():
            if r.bracket in "[{":
                opened.append({"at": r.at, "name": name_before(r.at), "since": r.at + 1, "id": None, "made": []})
                if len(opened) > 1:
                    _member_id(opened[-2], text, r.at)
                continue
            own = opened.pop()
            if r.bracket == "}":
                _member_id(own, text, r.at)
                for array in own["made"]:
                    array[1] = own["id"]
            if opened:
                opened[-1]["since"] = r.at + 1
            if r.bracket == "]" and len(opened) == _INNER - 1:
                arrays.append([opened[-2]["name"], None, own["name"], own["at"], r.at, _INNER])
                opened[-1]["made"].append(arrays[-1])
            elif r.bracket == "]" and len(opened) == _OUTER - 1 and len(opened) == 2:
                arrays.append([opened[-1]["name"], None, own["name"], own["at"], r.at, _OUTER])
    return {"files": files, "block": block, "size": size, "states": states, "arrays": arrays}


def _member_id(owner: dict, text, upto: int) -> None:
    """Look for the owner's ``id`` between its last inner bracket and ``upto``, where only plain members stand."""
    if owner["id"] is None and upto - owner["since"] < BLOCK:
        m = re.search(r'"id"\s*:\s*("(?:[^"\\]|\\.)*")', text(owner["since"], upto))
        owner["id"] = json.loads(m[1]) if m else None


def elements(parts: list, begin: int, end: int, low: int, high: int, inside: bool, depth: int, array_depth: int) -> Iterator[tuple[int, bytes]]:
    """Place and text of the elements of an array (its brackets at ``begin`` and ``end``) whose preceding comma or bracket lies in [low, high).

    ``inside``, ``depth``: the state at ``low``.
    """
    held, since = b"", None
    for at, data, own, outside, level, _ in _chunks(parts, low, end + 1, inside, depth):
        cuts = np.flatnonzero(outside & (((own == ord(",")) & (level == array_depth)) | ((own == ord("]")) & (level == array_depth - 1))))
        if at <= begin < at + len(data):
            cuts = np.concatenate([[begin - at], cuts[cuts > begin - at]])
        last = 0
        for cut in cuts.tolist():
            if since is not None:
                element = (held + data[last:cut]).strip()
                if element:
                    yield since, element
            if at + cut >= high or at + cut >= end:
                return
            held, last, since = b"", cut + 1, at + cut + 1
        held += data[last:] if since is not None else b""


class _Part(InputPartition):
    def __init__(self, owner: str, begin: int, end: int, low: int, high: int, inside: bool, depth: int, array_depth: int):
        self.owner, self.range = owner, (begin, end, low, high, inside, depth, array_depth)


_TESTS = {
    EqualTo: lambda f: lambda v: v == f.value, In: lambda f: lambda v: v in f.value, GreaterThan: lambda f: lambda v: v is not None and v > f.value,
    GreaterThanOrEqual: lambda f: lambda v: v is not None and v >= f.value, LessThan: lambda f: lambda v: v is not None and v < f.value,
    LessThanOrEqual: lambda f: lambda v: v is not None and v <= f.value, IsNotNull: lambda f: lambda v: v is not None, StringStartsWith: lambda f: lambda v: v is not None and v.startswith(f.value),
}


class RecordedExport(DataSource):
    """``spark.read.format("recorded_export")``: the records of a table export, ``RECORDS``; see ``export_records``."""

    @classmethod
    def name(cls) -> str:
        return "recorded_export"

    def schema(self) -> str:
        return RECORDS

    def reader(self, schema) -> DataSourceReader:
        return (_FilteringReader if self.options.get("push") == "true" else _Reader)(self.options)


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.index = json.loads(options["index"])
        self.only = json.loads(options.get("only", "null"))
        self.tests: list[tuple[str, object]] = []

    def partitions(self) -> list[_Part]:
        block, out = self.index["block"], []
        for _, owner, name, begin, end, depth in self.index["arrays"]:
            if name != "records" or depth != _INNER or not all(_TESTS[type(f)](f)(owner) for column, f in self.tests if column == "table_id"):
                continue
            low, inside, level = begin, False, depth - 1
            for k in range(begin // block + 1, end // block + 2):
                high = min(k * block, end + 1)
                if low < high:
                    out.append(_Part(owner, begin, end, low, high, inside, level, depth))
                if k < len(self.index["states"]):
                    low, (inside, level) = high, self.index["states"][k]
        return out

    def read(self, partition: _Part | None) -> Iterator[tuple]:
        if partition is None:  # no ranges
            return
        tests = [(column, _TESTS[type(f)](f)) for column, f in self.tests if column != "table_id"]
        for at, text in elements(self.index["files"], *partition.range):
            record = json.loads(text)
            own = {"record_id": record.get("id"), "created_time": record.get("createdTime")}
            if all(test(own[column]) for column, test in tests):
                fields = record.get("fields") or {}
                kept = {k: v if isinstance(v, str) else None if v is None else json.dumps(v, ensure_ascii=False, separators=(",", ":")) for k, v in fields.items() if self.only is None or k in self.only}
                yield partition.owner, own["record_id"], at, own["created_time"], kept


class _FilteringReader(_Reader):
    """Spark takes a reader that makes comparisons only where the session lets it."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Comparisons of a record's table, id and time are made here: of a table before its ranges are read, the others before a row is built."""
        for f in filters:
            if type(f) in _TESTS and len(f.attribute) == 1 and f.attribute[0] in ("table_id", "record_id", "created_time"):
                self.tests.append((f.attribute[0], f))
            else:
                yield f


def export_records(spark: SparkSession, path: str, only: list[str] | None = None, block: int = BLOCK, index: dict | None = None) -> DataFrame:
    """The records of one recorded export: ``table_id, record_id, at, created_time, fields``.

    ``path`` is one JSON document as ``exports.table_export`` reads it, a file or a folder of files that
    make it up in the order of their names; ``index``, from ``index_of``, saves reading it for that again. ``at`` grows in the order of the
    records. ``only`` names the fields to keep. A task reads about ``block`` bytes, or a thousandth of
    the document if that is more, whatever the tables' sizes. With ``spark.sql.python.filterPushdown.enabled`` comparisons of ``table_id``,
    ``record_id`` and ``created_time`` with literals are made by the reader: records of other tables are not read at all.
    """
    spark.dataSource.register(RecordedExport)
    reader = spark.read.format("recorded_export").option("index", json.dumps(index or index_of(spark, path, block)))
    reader = reader.option("push", spark.conf.get("spark.sql.python.filterPushdown.enabled", "false"))
    return (reader.option("only", json.dumps(only)) if only is not None else reader).load()


class RecordedViews(DataSource):
    """``spark.read.format("recorded_views")``: which records the views of a table export show, ``VIEWS``; see ``view_records``."""

    @classmethod
    def name(cls) -> str:
        return "recorded_views"

    def schema(self) -> str:
        return VIEWS

    def reader(self, schema) -> DataSourceReader:
        return _ViewReader(json.loads(self.options["index"]))


class _ViewReader(DataSourceReader):
    def __init__(self, index: dict):
        self.index = index

    def partitions(self) -> list[_Part]:
        block, out = self.index["block"], []
        for owner, _, view, begin, end, depth in self.index["arrays"]:
            if owner == "viewRecords" and depth == _OUTER:
                edges = [begin, *[k * block for k in range(begin // block + 1, end // block + 1)], end + 1]
                for low, high in zip(edges, edges[1:]):
                    inside, level = (False, depth - 1) if low == begin else self.index["states"][low // block]
                    out.append(_Part(view, begin, end, low, high, inside, level, depth))
        return out

    def read(self, partition: _Part | None) -> Iterator[tuple]:
        if partition is not None:  # there are ranges
            for _, text in elements(self.index["files"], *partition.range):
                yield partition.owner, json.loads(text)


def view_records(spark: SparkSession, path: str, block: int = BLOCK, index: dict | None = None) -> DataFrame:
    """``view_id, record_id``: which records each view of a recorded export shows; a view's list is read in ranges of about ``block`` bytes.

    A source of its own, whose size Spark does not know: taken from the few rows that name the ranges, however many
    records they hold, it would have the driver gather and broadcast them for a join.
    """
    spark.dataSource.register(RecordedViews)
    return spark.read.format("recorded_views").option("index", json.dumps(index or index_of(spark, path, block))).load()
