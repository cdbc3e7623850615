"""Words of whole texts as numpy arrays: one pass over the UTF-8 bytes of an Arrow batch.

A word is a maximal run of bytes outside ``\\x20 \\x09-\\x0D``. These bytes never occur inside a multi-byte
character, so the byte cut equals the cut into characters.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator, Sequence
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True

SLICE_BYTES = 1 << 21
_HASH_BYTES = 1 << 18
_ODD = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)
_MULTIPLIER = 0xD6E8FEB86659FD93  # odd, hence invertible modulo 2**64


def release_memory() -> None:
    """Give freed memory back to the system. Workers stay for further tasks, and glibc would keep it for them.

    A function that travelled to a task lies in a reference cycle with its module's names, so what these hold would wait
    for the garbage collector, once for each task: the tables of powers are emptied here.
    """
    _POWER_TABLES.clear()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def releasing(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run``, and its memory given back after its last batch, when nothing of it is held any more."""

    def whole(batches: Iterator) -> Iterator:
        yield from run(batches)
        release_memory()

    return whole


class Words(NamedTuple):
    """``data[start[i]:end[i]]`` is word i; text d has the words ``first[d]`` to ``first[d + 1]``."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray
    text_at: np.ndarray


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column, NULL as empty, and the offsets of its rows within them."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None or at[-1] == at[0]:
        return np.empty(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def row_slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows of about ``limit`` text bytes, so that work arrays stay small."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    group = np.cumsum(sizes) // limit
    edges = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
    for low, high in zip(edges, edges[1:]):
        if high > low:
            yield batch.slice(low, high - low)


def carrying(df: DataFrame, text: str, columns: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """``text`` as ``_text``, with ``columns`` under names that cannot clash; the text itself goes along only once."""
    names = ["_text" if c == text else f"_{i}" for i, c in enumerate(columns)]
    others = [F.col(c).alias(n) for c, n in zip(columns, names) if c != text]
    return df.select(F.col(text).alias("_text"), *others), names


def split_words(column: pa.Array) -> Words:
    data, text_at = text_bytes(column)
    black = np.zeros(len(data) + 1, bool)
    np.logical_not(SPACE[data], out=black[:-1])
    opens = black[:-1].copy()
    opens[1:] &= ~black[:-2]
    inner = text_at[(text_at > 0) & (text_at < len(data))]
    opens[inner] = black[inner]
    closes = black[:-1] & ~black[1:]
    closes[inner - 1] = black[inner - 1]
    start = np.flatnonzero(opens)
    return Words(data, start, np.flatnonzero(closes) + 1, np.searchsorted(start, text_at), text_at)


def byte_slices(data: np.ndarray, cuts: np.ndarray) -> pa.Array:
    """``data`` cut at ``cuts``, without a copy."""
    cuts = np.ascontiguousarray(cuts, np.int64)
    buffers = [None, pa.py_buffer(cuts), pa.py_buffer(np.ascontiguousarray(data))]
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(cuts) - 1, buffers)


def spread(values: np.ndarray, first: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The runs ``values[first:first + counts]``, one after another."""
    ends = np.cumsum(counts)
    at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(first - (ends - counts), counts)
    return values[at]


def distinct(values: np.ndarray) -> np.ndarray:
    """Sorted distinct values."""
    ordered = np.sort(values)
    keep = np.ones(len(ordered), bool)
    np.not_equal(ordered[1:], ordered[:-1], out=keep[1:])
    return ordered[keep]


def cut_points(n: int, *places: np.ndarray) -> np.ndarray:
    """All places in ascending order, each once, with the ends of ``range(n)``."""
    marked = np.zeros(n + 1, bool)
    marked[[0, n]] = True
    for some in places:
        marked[some] = True
    return np.flatnonzero(marked)


def flat_lists(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """The values of all lists, and the length of each."""
    sizes = np.fromiter(map(len, lists), np.int64, len(lists))
    return np.fromiter(chain.from_iterable(lists), np.int32, sizes.sum()), sizes


class PieceCache:
    """Encodes byte slices. ``encode`` gives all ids of a list of slices and the count of each.

    Slices that occur again in one call are kept for later calls of the task, each encoded once, ``most`` of them. With
    ``direct``, which does the same for the slices ``data[low:high]``, the others are encoded in passing.
    """

    def __init__(
        self,
        encode: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]],
        most: int = 100_000,
        direct: Callable[[np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]] | None = None,
    ):
        self._encode, self._most, self._direct = encode, most, direct
        self._forget()

    def _forget(self) -> None:
        self._number, self._flat, self._ends = {}, np.empty(1 << 16, np.int32), np.zeros(1 << 16, np.int64)

    def _learn(self, fresh: list[bytes], n_known: int) -> None:
        ids, sizes = self._encode(fresh)
        used = self._ends[n_known - 1] if n_known else 0
        ends = used + np.cumsum(sizes)
        while len(self._flat) < ends[-1]:
            self._flat = np.concatenate([self._flat, np.empty_like(self._flat)])
        while len(self._ends) < n_known + len(fresh):
            self._ends = np.concatenate([self._ends, np.zeros_like(self._ends)])
        self._flat[used : ends[-1]] = ids
        self._ends[n_known : n_known + len(fresh)] = ends

    def ids(self, data: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all slices in order, and how many each slice has."""
        coded = byte_slices(data, cuts).dictionary_encode()
        codes = coded.indices.to_numpy(zero_copy_only=False)
        if self._direct is None:
            return self._known(coded.dictionary, codes)
        again = np.bincount(codes, minlength=len(coded.dictionary)) > 1
        kept = again[codes]
        once = np.flatnonzero(~kept)
        number = np.cumsum(again) - 1
        ids, counts = self._known(coded.dictionary.filter(pa.array(again)), number[codes[kept]])
        alone, n_alone = self._direct(data, cuts[once], cuts[once + 1])
        sizes = np.empty(len(codes), np.int64)
        sizes[kept], sizes[once] = counts, n_alone
        out = np.empty(sizes.sum(), np.int32)
        from_kept = np.repeat(kept, sizes)
        out[from_kept], out[~from_kept] = ids, alone
        return out, sizes

    def _known(self, dictionary: pa.Array, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        pieces = dictionary.to_pylist()
        if len(self._number) > self._most:
            self._forget()
        number = self._number
        n_known = len(number)
        numbers = np.fromiter((number.setdefault(p, len(number)) for p in pieces), np.int64, len(pieces))
        fresh = np.flatnonzero(numbers >= n_known)
        if len(fresh):
            self._learn([pieces[i] for i in fresh.tolist()], n_known)
        low = np.concatenate([[0], self._ends])[numbers]
        sizes = self._ends[numbers] - low
        counts = sizes[codes]
        return spread(self._flat, low[codes], counts), counts


def mix(values: np.ndarray) -> np.ndarray:
    """Scramble 64-bit values."""
    values = (values ^ (values >> np.uint64(30))) * _MIX
    values = (values ^ (values >> np.uint64(27))) * _ODD
    return values ^ (values >> np.uint64(31))


_BYTE_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * _ODD)
_POWER_TABLES: dict[int, np.ndarray] = {}


def _powers(n: int, base: int) -> np.ndarray:
    table = _POWER_TABLES.get(base)
    if table is None or len(table) < n:
        table = np.full(max(n, 1 << 12), base % 2**64, np.uint64)
        table[0] = 1
        table = _POWER_TABLES[base] = np.multiply.accumulate(table)
    return table[:n]


def range_hashes(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of each run ``values[start:end]`` of 64-bit values, in time linear in values and runs.

    A polynomial modulo 2**64 from prefix sums, scrambled at the end; the values must be hashes themselves.
    """
    n = len(values)
    prefix = np.zeros(n + 1, np.uint64)
    np.cumsum(values * _powers(n, _MULTIPLIER), out=prefix[1:])
    undo = _powers(n + 1, pow(_MULTIPLIER, -1, 2**64))
    return mix((prefix[end] - prefix[start]) * undo[start] + (end - start).astype(np.uint64) * _ODD)


def slice_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte run; ``start`` ascending, runs disjoint."""
    out = np.empty(len(start), np.uint64)
    edges = np.unique(np.searchsorted(start, np.arange(0, len(data) + _HASH_BYTES, _HASH_BYTES)))
    for low, high in zip(edges[:-1], edges[1:]):
        base = start[low]
        values = _BYTE_VALUES[data[base : end[high - 1]]]
        out[low:high] = range_hashes(values, start[low:high] - base, end[low:high] - base)
    return out


def word_hashes(words: Words) -> np.ndarray:
    """A 64-bit content hash of each word."""
    return slice_hashes(words.data, words.start, words.end)
