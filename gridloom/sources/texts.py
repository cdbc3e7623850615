"""Text blobs: one file per record on the way in, Parquet on the way out."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.functions import text as tx
from gridloom.sources.files import file_sizes, read_file, write_file
from gridloom.storage import bound_batches, store

TASK_BYTES, TASK_FILES = 64 << 20, 4096  # of one task of a scan; a larger file is a task of its own
OPEN_BYTES = 64 << 10  # what opening a file counts for
BATCH_BYTES = 2 << 20
MAX_TASKS = 100_000


def read_texts(spark: SparkSession, path: str | list[str], strict: bool = False) -> DataFrame:
    """``(path, text)`` of whole files; invalid UTF-8 is dropped, or fails the query when ``strict``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select(tx.plain_path(F.col("path")).alias("path"), tx.decode_text(F.col("content"), strict).alias("text"))


def write_corpus(df: DataFrame, path: str, overwrite: bool = False, by: tuple[str, ...] = ("split",)) -> None:
    """Write records as Parquet by split: a few large files instead of one file per record.

    ``overwrite`` empties the whole corpus first; otherwise the records are added to it.
    """
    df.write.mode("overwrite" if overwrite else "append").partitionBy(*by).parquet(path)


def read_corpus(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.read.schema(schema).parquet(path)


def scan_texts(records: DataFrame, path: str, strict: bool = False, carry: Sequence[str] | None = None) -> DataFrame:
    """Records (of them the columns ``carry``, or all) with ``found`` and the ``text`` of the file that ``path`` names.

    Executors open the files, so nothing is listed and no paths are joined. A first narrow pass asks for the sizes and
    packs each task's records into loads of about ``TASK_BYTES``; the loads are dealt out one by one, so tasks are even
    however the sizes are spread. Invalid UTF-8 is dropped, or fails the query when ``strict``. A missing file, or a NULL
    path, gives ``found`` false and a NULL text; ``strict`` fails there too. Records with equal paths are read each.
    """
    bound_batches(records.sparkSession)
    names = list(carry or records.columns)
    fields = [records.schema[n] for n in names]
    held = [f"_{i}" for i in range(len(names))]
    source = records.select(F.col(path).cast("string").alias("_path"), *(F.col(n).alias(h) for n, h in zip(names, held)))
    item = T.StructType([T.StructField("_path", T.StringType()), *(T.StructField(h, f.dataType) for h, f in zip(held, fields))])
    load = T.StructType([T.StructField("load", T.ArrayType(item)), T.StructField("found", T.ArrayType(T.BooleanType()))])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = file_sizes(batch.column("_path").to_pylist())
            low, total = 0, 0
            for i in range(batch.num_rows + 1):
                more = OPEN_BYTES + (sizes[i] or 0) if i < batch.num_rows else 0
                if i > low and (i == batch.num_rows or total + more > TASK_BYTES or i - low >= TASK_FILES):
                    part = batch.slice(low, i - low)
                    rows = pa.StructArray.from_arrays(part.columns, part.schema.names)
                    found = pa.array([s is not None for s in sizes[low:i]])
                    ends = pa.array([0, i - low], pa.int32())
                    yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(ends, x) for x in (rows, found)], load.fieldNames())
                    low, total = i, 0
                total += more

    loads = store(source.mapInArrow(pack, load), "loads")
    dealt = loads.repartition(min(max(1, loads.count()), MAX_TASKS))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, found = batch.column(0).flatten(), batch.column(1).flatten().to_pylist()
            paths, low, waiting, size = rows.field("_path").to_pylist(), 0, [], 0
            for i, (name, there) in enumerate(zip(paths, found)):
                if strict and not there:
                    raise FileNotFoundError(f"payload is missing: {name}")
                waiting.append(read_file(name) if there else None)
                size += len(waiting[-1] or b"")
                if size >= BATCH_BYTES or i + 1 == len(paths):
                    part = rows.slice(low, i + 1 - low)
                    arrays = [*(part.field(h) for h in held), pa.array(found[low : i + 1]), pa.array(waiting, pa.binary())]
                    yield pa.RecordBatch.from_arrays(arrays, [*held, "found", "content"])
                    low, waiting, size = i + 1, [], 0

    schema = T.StructType([*item.fields[1:], T.StructField("found", T.BooleanType()), T.StructField("content", T.BinaryType())])
    content = dealt.mapInArrow(read, schema)
    kept = [F.col(h).alias(n) for h, n in zip(held, names)]
    return content.select(*kept, F.col("found"), tx.decode_text(F.col("content"), strict).alias("text"))


def missing_texts(scanned: DataFrame) -> DataFrame:
    """``(id, problem)`` of scanned records without a file, as ``check_manifest`` reports them."""
    return scanned.filter(~F.col("found")).select("id", F.lit("payload is missing").alias("problem"))


def write_texts(df: DataFrame, path: str, content: str) -> int:
    """One file per record, written by the executors at the path it names; how many. NULL content writes no file."""
    bound_batches(df.sparkSession)
    rows = df.select(F.col(path).cast("string").alias("path"), F.col(content).cast("binary").alias("content"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: set[str] = set()
        for batch in batches:
            n = 0
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                if data.is_valid:
                    write_file(name, data.as_py(), made)
                    n += 1
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], ["n"])

    return rows.mapInArrow(write, "n long").agg(F.sum("n")).first()[0] or 0
