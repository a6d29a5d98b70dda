"""Tables written between jobs, in the folder that every executor shares."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    Where a session on one machine (master ``local[n]``, as in tests) names none, a
    temporary folder is made once per process, set as the checkpoint folder and
    removed at exit. On a cluster, where no such folder is shared, that is an error.
    """
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = tempfile.mkdtemp(prefix="notemill-")
        atexit.register(shutil.rmtree, _own[app], ignore_errors=True)
        spark.sparkContext.setCheckpointDir(_own[app])
    return f"file://{_own[app]}"


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def stage(df: DataFrame, label: str = "stage") -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    The result no longer depends on the tasks that made it, so a lost executor
    costs a re-read, not a recomputation.
    """
    path = new_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Scratch:
    """Staged tables of one computation: ``scratch(df, label)`` stages, ``clear()`` deletes all that were."""

    def __init__(self):
        self.frames: list[DataFrame] = []

    def __call__(self, df: DataFrame, label: str = "stage") -> DataFrame:
        self.frames.append(stage(df, label))
        return self.frames[-1]

    def clear(self) -> None:
        unstage(*self.frames)
        self.frames = []


def sized_broadcast(staged: DataFrame, most: int = 200_000, most_bytes: int = 32_000_000) -> DataFrame:
    """A staged table, to be broadcast if it has at most ``most`` rows and, written as JSON, ``most_bytes``; beyond that the join shuffles as usual."""
    rows = staged.limit(most + 1)  # a larger table is not measured whole
    size = rows.agg(F.count("*").alias("n"), F.sum(F.length(F.to_json(F.struct("*")))).alias("bytes")).first()
    return F.broadcast(staged) if size.n <= most and (size.bytes or 0) <= most_bytes else staged


def unstage(*frames: DataFrame) -> None:
    """Delete staged tables that nothing reads any more."""
    for df in frames:
        spark = df.sparkSession
        for file in df.inputFiles()[:1]:
            remove_path(spark, file.rsplit("/", 1)[0])


def remove_path(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def move_path(spark: SparkSession, path: str, to: str) -> None:
    """Give a folder another name within its file system, at once."""
    at, new = (spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p) for p in (path, to))
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).rename(at, new):
        raise OSError(f"{path} can't be moved to {to}")
