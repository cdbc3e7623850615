"""Labelled images in IDX files, read as record ranges."""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from gridloom.sources.files import locate, open_file
from gridloom.storage import scratch_path

# The magic numbers and header sizes of unsigned-byte IDX files.
IMAGE_MAGIC, IMAGE_HEADER = 0x00000803, 16
LABEL_MAGIC, LABEL_HEADER = 0x00000801, 8

SCHEMA = "split string, idx bigint, label int, pixels array<int>, w int, h int"
RECORDS_PER_BATCH = 8192


@dataclass
class RecordRange(InputPartition):
    first: int
    last: int


def _header(path: str, size: int, magic: int) -> tuple[int, ...]:
    with open_file(path) as handle:
        head = handle.read_at(size, 0)
    if len(head) < size:
        raise ValueError(f"{path}: truncated header")
    found, *dims = struct.unpack(f">{size // 4}I", head)
    if found != magic:
        raise ValueError(f"{path}: magic {found:#010x}, expected {magic:#010x}")
    return tuple(dims)


def _records(split: str, first: int, marks: np.ndarray, pixels: np.ndarray, width: int, height: int) -> pa.RecordBatch:
    """Rows of consecutive records, the first of which has the number ``first``."""
    n, size = len(marks), width * height
    offsets = np.arange(0, n * size + 1, max(size, 1), dtype=np.int32) if size else np.zeros(n + 1, np.int32)
    return pa.RecordBatch.from_arrays(
        [
            pa.array([split] * n, pa.string()),
            pa.array(np.arange(first, first + n, dtype=np.int64)),
            pa.array(marks.astype(np.int32)),
            pa.ListArray.from_arrays(pa.array(offsets), pa.array(pixels.astype(np.int32))),
            pa.array(np.full(n, width, np.int32)),
            pa.array(np.full(n, height, np.int32)),
        ],
        names=["split", "idx", "label", "pixels", "w", "h"],
    )


class _IdxReader(DataSourceReader):
    def __init__(self, options: dict):
        self.images, self.labels = options["images"], options["labels"]
        self.split = options.get("split", "train")
        self.per_partition = int(options.get("recordsperpartition", 100_000))
        self.count, self.height, self.width = _header(self.images, IMAGE_HEADER, IMAGE_MAGIC)
        (labels,) = _header(self.labels, LABEL_HEADER, LABEL_MAGIC)
        if labels != self.count:
            raise ValueError(f"{self.count} images but {labels} labels")

    def partitions(self) -> list[InputPartition]:
        starts = range(0, self.count, self.per_partition)
        return [RecordRange(a, min(a + self.per_partition, self.count)) for a in starts] or [RecordRange(0, 0)]

    def read(self, partition: RecordRange) -> Iterator[pa.RecordBatch]:
        size = self.width * self.height
        with open_file(self.images) as images, open_file(self.labels) as labels:
            for first in range(partition.first, partition.last, RECORDS_PER_BATCH):
                n = min(RECORDS_PER_BATCH, partition.last - first)
                pixels = np.frombuffer(images.read_at(n * size, IMAGE_HEADER + first * size), np.uint8)
                marks = np.frombuffer(labels.read_at(n, LABEL_HEADER + first), np.uint8)
                if len(pixels) < n * size or len(marks) < n:
                    raise ValueError(f"{self.images}: fewer records than its header states")
                yield _records(self.split, first, marks, pixels, self.width, self.height)


class IdxImages(DataSource):
    @classmethod
    def name(cls) -> str:
        return "idx_images"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return _IdxReader(dict(self.options))


def read_idx(
    spark: SparkSession, images: str, labels: str, split: str, records_per_partition: int = 100_000
) -> DataFrame:
    """``(split, idx, label, pixels, w, h)`` of an IDX image / label pair, plain or compressed by gzip.

    Each task seeks to its own range of records, and ``idx`` comes from the file position: no shuffle. Compressed pairs
    are inflated first, see ``read_idx_pairs``.
    """
    if is_gzip(images) or is_gzip(labels):
        return read_idx_pairs(spark, [(images, labels)], split, records_per_partition)
    spark.dataSource.register(IdxImages)
    return (
        spark.read.format("idx_images")
        .option("images", images)
        .option("labels", labels)
        .option("split", split)
        .option("recordsperpartition", records_per_partition)
        .load()
    )


GZIP = b"\x1f\x8b"
PIECE_BYTES = 4 << 20  # of pixels in one piece of an inflated pair
_PIECES = "pair int, first bigint, w int, h int, total bigint, pixels binary, labels binary"


def is_gzip(path: str) -> bool:
    with open_file(path) as handle:
        return handle.read_at(len(GZIP), 0) == GZIP


class _Stream:
    """The bytes of a file in order, inflated if it is compressed; holds one buffer. A damaged stream raises."""

    def __init__(self, path: str):
        self.path, self.zipped = path, is_gzip(path)
        system, inner = locate(path)
        self.handle = system.open_input_stream(inner, compression=None)
        self.inflate, self.held = None, b""

    def _more(self) -> bytes:
        """Some further bytes; none at the end of a whole stream."""
        while True:
            tail = self.inflate.unconsumed_tail if self.inflate else b""
            raw = tail or self.held or self.handle.read(1 << 18)
            self.held = b""
            if not self.zipped:
                return raw
            if not raw:
                if self.inflate and not self.inflate.eof:
                    raise ValueError(f"{self.path}: the stream ends early")
                return b""
            if self.inflate and self.inflate.eof:
                raw = raw.lstrip(b"\0")  # members may be padded
                if not raw:
                    continue
            if self.inflate is None or self.inflate.eof:
                self.inflate = zlib.decompressobj(wbits=31)  # a further member; checks its length and sum at its end
            try:
                data = self.inflate.decompress(raw, PIECE_BYTES)
            except zlib.error as error:
                raise ValueError(f"{self.path}: {error}") from error
            if self.inflate.eof:
                self.held = self.inflate.unused_data
            if data:
                return data

    def exactly(self, size: int) -> bytes:
        """The next ``size`` bytes, fewer only at the end; the rest stays."""
        buffer = bytearray()
        while len(buffer) < size and (data := self._more()):
            buffer += data
        self.rest = bytes(buffer[size:])
        return bytes(buffer[:size])


class _Records:
    """Header and body of one IDX file, read once from front to back."""

    def __init__(self, path: str, header: int, magic: int):
        self.path, self.stream = path, _Stream(path)
        head = self.stream.exactly(header)
        if len(head) < header:
            raise ValueError(f"{path}: truncated header")
        found, *self.dims = struct.unpack(f">{header // 4}I", head)
        if found != magic:
            raise ValueError(f"{path}: magic {found:#010x}, expected {magic:#010x}")
        self.buffer = bytearray(self.stream.rest)

    def take(self, size: int) -> bytes:
        while len(self.buffer) < size and (data := self.stream._more()):
            self.buffer += data
        if len(self.buffer) < size:
            raise ValueError(f"{self.path}: fewer records than its header states")
        out = bytes(self.buffer[:size])
        del self.buffer[:size]
        return out

    def finish(self) -> None:
        """Read what is left, so the sum at the end of the stream is checked."""
        while self.stream._more():
            pass


def read_idx_pairs(
    spark: SparkSession, pairs: Sequence[tuple[str, str]], split: str, records_per_partition: int = 100_000
) -> DataFrame:
    """``(split, idx, label, pixels, w, h)`` of image / label pairs, numbered through in their order.

    A compressed stream can be read from its front only, so each pair is inflated once, by one task that holds a few MB,
    into a table of pieces in the shared folder, and its sums are checked; pairs are inflated side by side. Record ranges
    are then read from the pieces by as many tasks as there are pieces. A damaged or short stream, a header that does
    not fit, or an image count that is not the label count, fails.
    """
    listed = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "pair int, images string, labels string")

    def inflate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                images = _Records(row["images"], IMAGE_HEADER, IMAGE_MAGIC)
                labels = _Records(row["labels"], LABEL_HEADER, LABEL_MAGIC)
                count, height, width = images.dims
                if labels.dims != [count]:
                    raise ValueError(f"{count} images but {labels.dims[0]} labels")
                step = max(1, min(records_per_partition, PIECE_BYTES // max(1, width * height)))
                for first in range(0, max(1, count), step):
                    n = min(step, count - first)
                    values = (row["pair"], first, width, height, count, images.take(n * width * height), labels.take(n))
                    yield pa.RecordBatch.from_pylist([dict(zip(names, values))], schema=arrow)
                images.finish()
                labels.finish()

    names = ["pair", "first", "w", "h", "total", "pixels", "labels"]
    kinds = [pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary()]
    arrow = pa.schema(list(zip(names, kinds)))
    folder = scratch_path(spark, "idx")
    inflated = listed.repartition(max(1, len(pairs)), "pair").mapInArrow(inflate, _PIECES)
    per_file = max(1, records_per_partition * 4 // 100_000)
    inflated.write.option("maxRecordsPerFile", per_file).parquet(folder)
    pieces = spark.read.schema(_PIECES).parquet(folder)
    totals = dict(pieces.groupBy("pair").agg(F.max("total")).collect())
    before = np.cumsum([0, *(totals[i] for i in sorted(totals))]).tolist()

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                marks = np.frombuffer(row["labels"], np.uint8)
                pixels = np.frombuffer(row["pixels"], np.uint8)
                yield _records(split, before[row["pair"]] + row["first"], marks, pixels, row["w"], row["h"])

    return pieces.mapInArrow(expand, SCHEMA)


def write_idx(
    df: DataFrame, folder: str, width: int, height: int, per_file: int = 1_000_000, idx_col: str = "idx", zipped: bool = True
) -> list[tuple[str, str]]:
    """Write ``label`` and ``pixels`` of densely numbered records as IDX pairs of ``per_file`` records, in order.

    A pair is written by one task that sees its records sorted and holds a few thousand of them. Gives the paths of
    the pairs, for ``read_idx_pairs``.
    """
    n = df.count()
    n_files = max(1, -(-n // per_file))
    number = F.expr(f"`{idx_col}` div {per_file}").cast("int")
    rows = df.select(number.alias("file"), F.col(idx_col).alias("idx"), F.col("label").cast("int").alias("label"), "pixels")
    dealt = rows.repartition(n_files, "file").sortWithinPartitions("file", "idx")
    suffix = ".gz" if zipped else ""

    def paths(file: int) -> tuple[str, str]:
        return f"{folder}/{file:06d}-images-idx3-ubyte{suffix}", f"{folder}/{file:06d}-labels-idx1-ubyte{suffix}"

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, file, done = None, None, 0
        for batch in batches:
            files = batch.column("file").to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(files)) + 1).tolist(), len(files)]
            for low, high in zip(edges[:-1], edges[1:]):
                if files[low] != file:
                    done += out.close() if out else 0
                    file = int(files[low])
                    out = _PairWriter(paths(file), min(per_file, n - file * per_file), width, height, zipped)
                part = batch.slice(low, high - low)
                out.add(part.column("label").to_numpy(), part.column("pixels").flatten().to_numpy())
        done += out.close() if out else 0
        yield pa.RecordBatch.from_arrays([pa.array([done], pa.int64())], ["n"])

    written = dealt.mapInArrow(write, "n long").agg(F.sum("n")).first()[0] or 0
    if written != n:
        raise ValueError(f"wrote {written} of {n} records: the numbers are not dense")
    if not n:
        _PairWriter(paths(0), 0, width, height, zipped).close()
    return [paths(i) for i in range(n_files)]


class _PairWriter:
    """One image / label pair; moved to its place once it is whole."""

    def __init__(self, paths: tuple[str, str], count: int, width: int, height: int, zipped: bool):
        self.count, self.size, self.n = count, width * height, 0
        self.outs = []
        heads = [struct.pack(">4I", IMAGE_MAGIC, count, height, width), struct.pack(">2I", LABEL_MAGIC, count)]
        for path, head in zip(paths, heads):
            system, inner = locate(path)
            system.create_dir(inner.rpartition("/")[0], recursive=True)
            beside = f"{inner}.{uuid.uuid4().hex}.part"
            out = system.open_output_stream(beside, compression="gzip" if zipped else None)
            out.write(head)
            self.outs.append((out, system, beside, inner))

    def add(self, labels: np.ndarray, pixels: np.ndarray) -> None:
        if len(pixels) != len(labels) * self.size:
            raise ValueError(f"an image has {self.size} pixels")
        self.outs[0][0].write(pixels.astype(np.uint8).tobytes())
        self.outs[1][0].write(labels.astype(np.uint8).tobytes())
        self.n += len(labels)

    def close(self) -> int:
        for out, system, beside, inner in self.outs:
            out.close()
            if self.n == self.count:
                system.move(beside, inner)
            else:
                system.delete_file(beside)
        return self.n
