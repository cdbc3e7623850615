"""Exchange of 64-bit content hashes in arrays: one row for each batch of texts and hash shard, not one for each hash.

A batch of texts is cut by the high bits of its hashes; each shard gathers what all batches sent it, sorts, and answers
every batch. Within a shard 32 bits tell hashes apart, so equality there is a superset of equality of contents: it may
only select candidates. Shards follow the size of the input, so a task holds about the same number of hashes at any size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BATCH_BYTES = 1 << 22  # text of a batch; a longer text is a batch of its own
BATCH_TEXTS = 1 << 16
SHARD_BYTES = 12 << 20  # text per shard


def shard_count(df: DataFrame, text: Column) -> int:
    size = df.agg(F.sum(F.octet_length(text).cast("long"))).first()[0] or 0
    return max(1, -(-size // SHARD_BYTES))


def batch_ids() -> Iterator[int]:
    """Numbers for the batches of this task: a repeated task gives the same numbers to the same rows."""
    low = TaskContext.get().partitionId() << 24
    return iter(range(low, low + (1 << 24)))


def shard_of(hashes: np.ndarray, shards: int) -> np.ndarray:
    return ((hashes >> np.uint64(32)) % np.uint64(shards)).astype(np.uint16 if shards <= 1 << 16 else np.uint32)


def by_shard(hashes: np.ndarray, shards: int) -> Iterator[tuple[int, np.ndarray]]:
    """Each shard with the positions of its hashes, ascending."""
    shard = shard_of(hashes, shards)
    order = np.argsort(shard, kind="stable")
    edges = np.searchsorted(shard[order], np.arange(shards + 1))
    for k in np.flatnonzero(np.diff(edges)):
        yield int(k), order[edges[k] : edges[k + 1]]


def low_bits(hashes: np.ndarray, bits: int = 32) -> np.ndarray:
    return (hashes & np.uint64((1 << bits) - 1)).astype(np.uint32)


def unpack(blobs: pa.Array | pa.ChunkedArray, kind: type) -> list[np.ndarray]:
    return [np.frombuffer(b, kind) for b in blobs.to_pylist()]
