"""Alignment of the tokens that two tokenizers make of one text, by merging their end offsets along a path.

The ends of A tokens and of B tokens are two sorted lists. Diagonals cut the path that merges them into pieces of equal
work, found by binary search, so a piece knows its part of either list without the pieces before it. Each piece emits
the offsets where both tokenizers end; where a cut parts an A end from the equal B end, the two neighbours are stitched.
These offsets cut the tokens into groups, and every A token is linked with every B token of its group.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.llm.words import release_memory, row_slices, spread, text_bytes
from gridloom.storage import scratch_path

PIECE = 1 << 16  # ends that one piece of the path merges
WIDE = 64  # links; a group of more is counted by its distinct ids
HELD_CODES = 1 << 20  # a task's counts of id pairs before it emits them
BROADCAST_CODES = 2_000_000  # id pairs; 21 bytes each


class Tokens(NamedTuple):
    """Tokens of a run of texts: ``ids[first[d]:first[d + 1]]``, and the bytes each stands for."""

    ids: np.ndarray
    first: np.ndarray
    table: ByteTable


class ByteTable(NamedTuple):
    """The bytes of every id of a vocabulary, one after another; id i has ``size[i]`` from ``start[i]`` on."""

    data: np.ndarray
    start: np.ndarray
    size: np.ndarray


def byte_table(entries: list[bytes]) -> ByteTable:
    size = np.fromiter(map(len, entries), np.int64, len(entries))
    return ByteTable(np.frombuffer(b"".join(entries), np.uint8), np.cumsum(size) - size, size)


class Aligned(NamedTuple):
    """Groups of a run of texts. Group g has the A tokens ``a_cut[g]:a_cut[g + 1]`` and the B tokens likewise.

    Text d has the groups ``first[d]:first[d + 1]``. Texts whose tokens do not spell it have none.
    """

    a_ids: np.ndarray
    b_ids: np.ndarray
    a_cut: np.ndarray
    b_cut: np.ndarray
    first: np.ndarray


def diagonal(a: np.ndarray, b: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How many of the first ``at`` merged values come from ``a``; of equal values, that of ``a`` comes first."""
    low, high = np.maximum(0, at - len(b)), np.minimum(at, len(a))
    while (low < high).any():
        middle = (low + high) // 2
        open_ = low < high
        take = np.zeros(len(at), bool)
        m = middle[open_]
        take[open_] = a[m] <= b[at[open_] - 1 - m]
        low = np.where(open_ & take, middle + 1, low)
        high = np.where(open_ & ~take, middle, high)
    return low


def common_ends(a: np.ndarray, b: np.ndarray, work: int = PIECE) -> tuple[np.ndarray, np.ndarray]:
    """How many values of ``a``, and of ``b``, lie up to each value that both hold; both strictly ascending."""
    total = len(a) + len(b)
    at = np.append(np.arange(0, total, work), total)
    a_at = diagonal(a, b, at)
    b_at = at - a_at
    found = [_piece(a, b, *edges) for edges in zip(a_at[:-1], a_at[1:], b_at[:-1], b_at[1:])]
    for (_, last_a, a_end, _, _), (_, _, _, first_b, b_begin) in zip(found[:-1], found[1:]):
        if last_a is not None and last_a == first_b:
            found.append((np.array([[a_end], [b_begin + 1]]), None, 0, None, 0))
    pairs = np.concatenate([f[0] for f in found], axis=1) if found else np.empty((2, 0), np.int64)
    pairs = pairs[:, np.argsort(pairs[0], kind="stable")]
    return pairs[0], pairs[1]


def _piece(a: np.ndarray, b: np.ndarray, a_low: int, a_high: int, b_low: int, b_high: int) -> tuple:
    """Overlaps within one piece, its last A end and its first B end."""
    own_a, own_b = a[a_low:a_high], b[b_low:b_high]
    where = np.searchsorted(own_b, own_a)
    hit = np.zeros(len(own_a), bool)
    inside = where < len(own_b)
    hit[inside] = own_b[where[inside]] == own_a[inside]
    at = np.flatnonzero(hit)
    pairs = np.stack([a_low + at + 1, b_low + where[at] + 1])
    return pairs, own_a[-1] if len(own_a) else None, a_high, own_b[0] if len(own_b) else None, b_low


def _spells(tokens: Tokens, data: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Whether the bytes of each text's tokens are the text."""
    size = tokens.table.size[tokens.ids]
    ends = np.append(0, np.cumsum(size))[tokens.first]
    right = np.diff(ends) == np.diff(edges)
    if right.all():
        made = spread(tokens.table.data, tokens.table.start[tokens.ids], size)
        wrong = np.flatnonzero(made != data)
        right[np.searchsorted(edges, wrong, "right") - 1] = False
        return right
    for d in np.flatnonzero(right):  # some text is spelled at another length, so places do not agree
        own = slice(tokens.first[d], tokens.first[d + 1])
        made = spread(tokens.table.data, tokens.table.start[tokens.ids[own]], size[own])
        right[d] = np.array_equal(made, data[edges[d] : edges[d + 1]])
    return right


def align(column: pa.Array, a: Tokens, b: Tokens) -> Aligned:
    """Align the tokens of the texts in ``column``; NULL and the empty text have no groups."""
    data, edges = text_bytes(column)
    use = (np.diff(edges) > 0) & _spells(a, data, edges) & _spells(b, data, edges)
    sides = []
    for tokens in (a, b):
        keep = np.repeat(use, np.diff(tokens.first))
        ids = tokens.ids[keep]
        sides.append((ids, np.cumsum(tokens.table.size[ids])))
    (a_ids, a_end), (b_ids, b_end) = sides
    a_cut, b_cut = common_ends(a_end, b_end)
    text_end = np.cumsum(np.where(use, np.diff(edges), 0))
    first = np.append(0, np.searchsorted(a_end[a_cut - 1], text_end, "right"))
    return Aligned(a_ids, b_ids, np.append(0, a_cut), np.append(0, b_cut), first)


def link_codes(found: Aligned, n_b: int, n_codes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, code ``a * n_b + b`` and number of links of every distinct id pair of every text, by text and code."""
    n_first, n_second = np.diff(found.a_cut), np.diff(found.b_cut)
    text = np.repeat(np.arange(len(found.first) - 1), np.diff(found.first))
    small = np.flatnonzero(n_first * n_second <= WIDE)
    links = (n_first * n_second)[small]
    nth = np.arange(links.sum()) - np.repeat(np.cumsum(links) - links, links)
    per_a = np.repeat(n_second[small], links)
    a = found.a_ids[np.repeat(found.a_cut[small], links) + nth // per_a]
    b = found.b_ids[np.repeat(found.b_cut[small], links) + nth % per_a]
    keys = [np.repeat(text[small], links) * n_codes + a.astype(np.int64) * n_b + b]
    counts = []
    for g in np.flatnonzero(n_first * n_second > WIDE):
        own_a, times_a = np.unique(found.a_ids[found.a_cut[g] : found.a_cut[g + 1]], return_counts=True)
        own_b, times_b = np.unique(found.b_ids[found.b_cut[g] : found.b_cut[g + 1]], return_counts=True)
        keys.append((text[g] * n_codes + own_a.astype(np.int64)[:, None] * n_b + own_b).ravel())
        counts.append((times_a[:, None] * times_b).ravel())
    key, count = sum_by(np.concatenate(keys), [np.ones(len(keys[0]), np.int64), *counts] if counts else None)
    return key // n_codes, key % n_codes, count


def sum_by(keys: np.ndarray, counts: list[np.ndarray] | None) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys, and the sum of the counts of each; a count of 1 each where none are given."""
    if counts is None:
        keys = np.sort(keys)
    else:
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
    new = np.ones(len(keys), bool)
    np.not_equal(keys[1:], keys[:-1], out=new[1:])
    at = np.flatnonzero(new)
    if counts is None:
        return keys[at], np.diff(np.append(at, len(keys)))
    return keys[at], np.add.reduceat(np.concatenate(counts)[order], at) if len(at) else np.empty(0, np.int64)


Make = Callable[[pa.Array], tuple[Tokens, Tokens]]


def align_texts(
    df: DataFrame,
    key: str,
    text: str,
    tokenizers: Callable[[], Make],
    sizes: tuple[int, int],
    outputs: T.StructType,
    project: Callable[[Aligned], list[pa.Array]],
) -> DataFrame:
    """``key``, what ``project`` makes of the groups, and ``n_links``, ``n_best``, ``count_sum`` of every row.

    ``tokenizers`` gives, once per task, a function from texts to their A and B tokens; ``sizes`` are the numbers of A
    and B ids. An id pair counts the rows that hold it linked, over the whole table. ``n_best`` are the links whose pair
    counts as much as any pair of its A id, ``count_sum`` sums the counts over the links.

    NULL, empty texts, and texts that the tokens do not spell have no groups and no links. Keys may be NULL or
    repeated; every row counts for itself. An empty table gives an empty table. Other columns are left out, so their
    names cannot clash. Tokens are made once: groups and pairs are written to the shared folder, distinct pairs and
    their numbers as sorted codes. Counts are combined per task, then summed.
    """
    n_b, n_codes = sizes[1], sizes[0] * sizes[1]
    code_type = np.dtype("<u4") if n_codes <= 1 << 32 else np.dtype("<u8")
    source = df.select(F.col(key).alias("_key"), F.col(text).alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make, row = None, TaskContext.get().partitionId() << 33
        for batch in batches:
            for part in row_slices(batch, "_text"):
                make = make or tokenizers()
                found = align(spaced(part.column("_text")), *make(part.column("_text")))
                texts, codes, links = link_codes(found, n_b, n_codes)
                at = np.searchsorted(texts, np.arange(part.num_rows + 1))
                columns = [_binary(codes.astype(code_type), at), _binary(links.astype("<u4"), at)]
                n_links = pa.array(np.diff(np.append(0, np.cumsum(links))[at]))
                rows = pa.array(np.arange(row, row + part.num_rows))
                row += part.num_rows
                yield pa.RecordBatch.from_arrays(
                    [rows, part.column("_key"), *project(found), n_links, *columns],
                    ["_row", "_key", *(f"_{n}" for n in outputs.names), "_n_links", "_codes", "_links"],
                )
        release_memory()

    fields = [T.StructField("_row", T.LongType()), T.StructField("_key", df.schema[key].dataType)]
    fields += [T.StructField(f"_{f.name}", f.dataType) for f in outputs.fields]
    fields += [T.StructField("_n_links", T.LongType())]
    fields += [T.StructField(n, T.BinaryType()) for n in ("_codes", "_links")]
    schema = T.StructType(fields)
    path = scratch_path(df.sparkSession, "aligned")
    source.mapInArrow(run, schema).write.option("compression", "zstd").parquet(path)
    stored = df.sparkSession.read.schema(schema).parquet(path)
    scored = _score(stored, pair_counts(stored, code_type), n_b, code_type)
    names = [F.col(f"_{n}").alias(n) for n in (*outputs.names, "n_links")]
    return scored.select(F.col("_key").alias(key), *names, "n_best", "count_sum")


def spaced(column: pa.Array) -> pa.Array:
    """The texts with a space before each; NULL and the empty text stay empty."""
    filled = pc.fill_null(column.cast(pa.large_string()), "")
    lead = pc.if_else(pc.equal(pc.binary_length(filled), 0), "", " ").cast(pa.large_string())
    return pc.binary_join_element_wise(lead, filled, pa.scalar("", pa.large_string()))


def _binary(values: np.ndarray, at: np.ndarray) -> pa.Array:
    offsets = pa.py_buffer(np.ascontiguousarray(at * values.itemsize, np.int32))
    return pa.BinaryArray.from_buffers(pa.binary(), len(at) - 1, [None, offsets, pa.py_buffer(values.tobytes())])


def _values(column: pa.Array, kind: np.dtype) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of a binary column, and where each row's begin."""
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1] // kind.itemsize
    values = np.frombuffer(data, kind)[at[0] : at[-1]] if data is not None and at[-1] > at[0] else np.empty(0, kind)
    return values, at - at[0]


def pair_counts(stored: DataFrame, code_type: np.dtype) -> DataFrame:
    """``code`` and ``n``, the number of rows that hold it. Combined per task; a task holds so many codes at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, waiting, n_waiting = (np.empty(0, np.int64), np.empty(0, np.int64)), [], 0

        def merged():
            keys = np.concatenate([held[0], *waiting])
            return sum_by(keys, [held[1], *(np.ones(len(w), np.int64) for w in waiting)])

        for batch in batches:
            values, _ = _values(batch.column(0), code_type)
            waiting.append(values.astype(np.int64))
            n_waiting += len(values)
            if n_waiting > HELD_CODES:
                held, waiting, n_waiting = merged(), [], 0
                if len(held[0]) > HELD_CODES:
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in held], ["code", "n"])
                    held = (np.empty(0, np.int64), np.empty(0, np.int64))
        held = merged()
        if len(held[0]):
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in held], ["code", "n"])
        release_memory()

    return stored.select("_codes").mapInArrow(run, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))


def _score(stored: DataFrame, counts: DataFrame, n_b: int, code_type: np.dtype) -> DataFrame:
    """``stored`` with ``n_best`` and ``count_sum``: by a table in every task if it is small, else by a join."""
    path = scratch_path(stored.sparkSession, "pairs")
    counts.withColumn("a", F.floor(F.col("code") / n_b)).write.parquet(path)
    counts = stored.sparkSession.read.parquet(path)
    best = counts.groupBy("a").agg(F.max("n").alias("most"))
    counts = counts.join(best, "a").select("code", "n", (F.col("n") == F.col("most")).alias("best"))
    if counts.limit(BROADCAST_CODES + 1).count() > BROADCAST_CODES:
        return _score_by_join(stored, counts, code_type)
    known = counts.toArrow().sort_by("code")
    shared = stored.sparkSession.sparkContext.broadcast(
        tuple(known.column(n).to_numpy() for n in ("code", "n", "best"))
    )
    names = stored.columns[:-2]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, n, best = shared.value
        for batch in batches:
            codes, at = _values(batch.column("_codes"), code_type)
            links, _ = _values(batch.column("_links"), np.dtype("<u4"))
            where = np.searchsorted(code, codes.astype(np.int64))
            links = links.astype(np.int64)
            sums = [np.append(0, np.cumsum(v))[at] for v in (links * best[where], links * n[where])]
            arrays = [*map(batch.column, names), *(pa.array(np.diff(s)) for s in sums)]
            yield pa.RecordBatch.from_arrays(arrays, [*names, "n_best", "count_sum"])
        release_memory()

    fields = [T.StructField(n, T.LongType()) for n in ("n_best", "count_sum")]
    return stored.mapInArrow(run, T.StructType([*stored.schema.fields[:-2], *fields]))


def _score_by_join(stored: DataFrame, counts: DataFrame, code_type: np.dtype) -> DataFrame:
    """The same by a shuffled join on codes; a code that most rows hold is split by adaptive execution."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, at = _values(batch.column(1), code_type)
            links, _ = _values(batch.column(2), np.dtype("<u4"))
            rows = np.repeat(batch.column(0).to_numpy(), np.diff(at))
            arrays = [pa.array(rows), pa.array(codes.astype(np.int64)), pa.array(links.astype(np.int64))]
            yield pa.RecordBatch.from_arrays(arrays, ["_row", "code", "links"])

    held = stored.select("_row", "_codes", "_links").mapInArrow(run, "_row long, code long, links long")
    sums = held.join(counts, "code").groupBy("_row").agg(
        F.sum(F.when(F.col("best"), F.col("links")).otherwise(0)).alias("n_best"),
        F.sum(F.col("links") * F.col("n")).alias("count_sum"),
    )
    joined = stored.drop("_codes", "_links").join(sums, "_row", "left")
    return joined.fillna(0, ["n_best", "count_sum"])
