"""Session helpers: scratch tables in the shared folder and size-checked broadcasts."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# A broadcast side is a few narrow columns, so this many rows stay below ~32 MB.
BROADCAST_ROWS = 500_000

BLOCK_BYTES = 32 << 20  # of a scratch table; what each writing task buffers

_written: list[str] = []


def scratch_root(spark: SparkSession) -> str:
    """Shared folder for intermediate tables: ``spark.checkpoint.dir`` of the session.

    Only a local master may fall back to a temporary folder of this machine.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    context = spark.sparkContext
    if context.getCheckpointDir():
        return context.getCheckpointDir()
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that every executor can reach")
    folder = tempfile.mkdtemp(prefix="gridloom-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new place in the shared folder. ``clean_scratch`` removes all that were given out."""
    _written.append(f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}")
    return _written[-1]


def _file_system(spark: SparkSession, path: str):
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def list_names(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder of any file system that Spark reaches; none if it is missing."""
    files, place = _file_system(spark, path)
    return [status.getPath().getName() for status in files.listStatus(place)] if files.exists(place) else []


def make_mark(spark: SparkSession, path: str) -> None:
    """An empty file, made in one step; fails if it is there."""
    files, place = _file_system(spark, path)
    files.create(place, False).close()


def remove(spark: SparkSession, path: str) -> None:
    files, place = _file_system(spark, path)
    files.delete(place, True)


def clean_scratch(spark: SparkSession) -> None:
    """Remove the scratch tables that this session has written; frames that read them no longer work."""
    while _written:
        remove(spark, _written.pop())


def store(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once and read it back, so later stages restart from the files, not from the plan."""
    path = scratch_path(df.sparkSession, name)
    df.write.option("parquet.block.size", BLOCK_BYTES).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bound_batches(spark: SparkSession, size: str = "4m") -> None:
    """For rows that are whole texts, pages or files: Arrow batches of a few MB, in place of 10,000 rows or 64 MB."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def broadcast_if_small(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast only after counting; a larger side is left to a shuffled join."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df
