"""Imports that go on: new exports are read as they arrive, and each is applied to the state once.

The windows over events are an addition; the import itself needs none.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from notemill.plans.upsert import applied, plan, written
from notemill.staging import remove_path, stage, unstage

STATE = "path string, source_id string, mtime long, content string"
#: What a version holds: each note with the digest of its content, so that planning an import reads no contents.
_HELD = STATE + ", hash string"
#: Ranges of path hashes that a new state is dealt into. A batch writes those anew that it changes.
BUCKETS = 64
#: In each version's folder, written last: the last batch of every run that it
#: holds, the number of buckets, and for each bucket the version that wrote it last.
MARK = "_applied.json"


def current_state(spark: SparkSession, folder: str) -> tuple[int, DataFrame]:
    """The newest version of the state, and its number; -1 and no rows before the first."""
    versions = _versions(spark, folder)
    newest = max(versions, default=-1)
    return newest, _read(spark, folder, versions[newest]["wrote"] if versions else {}).select("path", "source_id", "mtime", "content")


def _read(spark: SparkSession, folder: str, wrote: dict[str, int]) -> DataFrame:
    at = [f"{folder}/v={v}/bucket={b}" for b, v in sorted(wrote.items())]
    return spark.read.schema(_HELD).parquet(*at) if at else spark.createDataFrame([], _HELD)


def _versions(spark: SparkSession, folder: str) -> dict[int, dict]:
    """The marks of whole versions."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(folder)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = {}
    for entry in fs.listStatus(at) if fs.exists(at) else []:
        name, mark = entry.getPath().getName(), jvm.org.apache.hadoop.fs.Path(entry.getPath(), MARK)
        if name.startswith("v=") and fs.exists(mark):
            stream = fs.open(mark)
            try:
                found[int(name[2:])] = json.loads(bytes(stream.readAllBytes()).decode())
            except ValueError:  # half written: the version does not count
                pass
            finally:
                stream.close()
    return found


def _mark(spark: SparkSession, version: str, mark: dict) -> None:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(version, MARK)
    stream = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(at, True)
    stream.write(json.dumps(mark).encode())
    stream.close()


def apply_batch(batch: DataFrame, batch_id: int, folder: str, mode: str = "update", keep: int = 2, run: str = "", buckets: int = BUCKETS) -> None:
    """Apply one batch of notes to the state.

    A batch of a ``run`` (one checkpoint) that was applied before is passed over,
    so a retry changes nothing; another run counts its batches anew. Of the
    exports of one source the newest wins, of equal times the one whose content hashes highest.

    The plan reads paths, ids, times and digests of the state; contents are read and
    written only of the buckets that the batch changes. ``buckets`` is settled by the
    first batch. Of each bucket the versions that the last ``keep`` states use are kept.
    """
    spark = batch.sparkSession
    versions = _versions(spark, folder)
    version = max(versions, default=-1)
    before = versions.get(version, {"runs": {}, "buckets": buckets, "wrote": {}})
    if before["runs"].get(run, -1) >= batch_id:
        return
    key = F.coalesce("source_id", F.concat_ws("/", "folder", "title"))
    newest = F.max_by(F.struct(*batch.columns), F.struct("mtime", F.sha2("content", 256).alias("h"), F.xxhash64(*batch.columns).alias("x")))
    latest = batch.withColumn("_key", key).groupBy("_key").agg(newest.alias("n")).select("n.*")
    incoming = stage(latest.drop("ordinal").withColumn("ordinal", F.xxhash64("source_id", "folder", "title")), "incoming")
    bucket = F.pmod(F.xxhash64("path"), F.lit(before["buckets"])).cast("int")
    planned = stage(plan(incoming, _read(spark, folder, before["wrote"]), mode).select("ordinal", "path", "disposition"), "planned")
    changed = [str(r.b) for r in written(planned).select(bucket.alias("b")).distinct().collect()]
    held = _read(spark, folder, {b: v for b, v in before["wrote"].items() if b in changed})
    after = applied(planned, incoming, held).withColumns({"hash": F.sha2("content", 256), "bucket": bucket})
    to = f"{folder}/v={version + 1}"
    after.hint("rebalance", "bucket").write.mode("overwrite").partitionBy("bucket").parquet(to)
    wrote = before["wrote"] | {b: version + 1 for b in changed}
    _mark(spark, to, {"runs": before["runs"] | {run: batch_id}, "buckets": before["buckets"], "wrote": wrote})
    unstage(planned, incoming)
    kept = {v: versions[v]["wrote"] for v in sorted(versions)[len(versions) + 1 - keep :]} | {version + 1: wrote}
    _clear(spark, folder, version, kept)


def _clear(spark: SparkSession, folder: str, upto: int, kept: dict[int, dict[str, int]]) -> None:
    """Delete what no kept version reads; a version that is not kept loses its mark first, so it does not count."""
    used = {(v, b) for wrote in kept.values() for b, v in wrote.items()}
    for name in _names(spark, folder):
        v = int(name[2:]) if name.startswith("v=") else upto + 1
        if v > upto or v in kept:
            continue
        remove_path(spark, f"{folder}/{name}/{MARK}")
        held = [x[len("bucket=") :] for x in _names(spark, f"{folder}/{name}") if x.startswith("bucket=")]
        old = [b for b in held if (v, b) not in used]
        for path in [name] if len(old) == len(held) else [f"{name}/bucket={b}" for b in old]:
            remove_path(spark, f"{folder}/{path}")


def _names(spark: SparkSession, folder: str) -> list[str]:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return [entry.getPath().getName() for entry in fs.listStatus(at)]


def start_import(notes: DataFrame, folder: str, checkpoint: str, mode: str = "update", once: bool = True) -> StreamingQuery:
    """Apply a stream of ``folder, title, source_id, mtime, content`` to the state in ``folder``.

    With ``once`` the query ends when what is there has been read, and goes on
    from there when it is started again with the same checkpoint.
    """

    def apply(batch: DataFrame, k: int) -> None:
        # The id lies in the checkpoint: a query that goes on keeps it, a new checkpoint has its own.
        apply_batch(batch, k, folder, mode, run=batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId") or "")

    writer = notes.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def window_counts(events: DataFrame, width: str = "1 hour", late: str = "1 day", time: str = "ts", key: str = "event_type") -> DataFrame:
    """Events by tumbling window and key; on a stream, rows later than ``late`` are left out once their window is closed."""
    rows = events.withWatermark(time, late) if events.isStreaming else events
    return rows.groupBy(F.window(time, width).alias("w"), key).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), key, "n", "total")
