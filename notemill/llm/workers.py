"""Keeping Python workers small: they live on between tasks, beside the JVM."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

#: Rows that Spark hands to a worker at once; whole texts can be long.
BATCH_ROWS = 1000


def small_batches(df: DataFrame, rows: int = BATCH_ROWS) -> DataFrame:
    """``df`` itself, after lowering the session's rows per Arrow batch to ``rows`` if they are more."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(key)) <= rows:
        conf.set(key, str(rows))
    return df


_kept: dict = {}


def kept(key: object, build: Callable[[], object]) -> object:
    """What ``build`` makes, kept by this worker for its next tasks.

    A worker keeps one such object at a time: it goes when a task asks for
    another, or when a ``tidy`` task ends that asked for none.
    """
    if "key" not in _kept or _kept["key"] != key:
        _kept.clear()
        _kept.update(value=build(), key=key)
    _kept["used"] = True
    return _kept["value"]


def _begin() -> None:
    _kept.pop("used", None)


def _end() -> None:
    if "used" not in _kept:
        _kept.clear()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """``run``, giving memory back to the system when a task ends, and what earlier tasks kept if this one has no use for it."""

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _begin()
        try:
            yield from run(batches)
        finally:
            _end()

    return tidied
