"""Lexical retrieval packing: windows of a fixed length, filled with documents that resemble their seed.

Documents are tokenised once, with a BM25 weight for every word known corpus-wide. Shards are ranges of a locality
key, so copies and texts with the same rare words meet; many copies of one text fill several shards in a row. Each
shard holds an inverted index of its words: a seed queries it, and the best unused neighbours fill the window in the
order of their scores. The document that the end of the window cuts goes on in the next window and is its seed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.llm.tokens import ByteBpe
from gridloom.llm.words import distinct, mix, range_hashes, releasing, row_slices, spread
from gridloom.storage import store

SHARD_TOKENS = 750_000
SLOTS = 1 << 17  # words share a slot of the document frequencies by hash, so the table never grows
QUERY_WORDS, NEIGHBOURS = 24, 64
K1, B = 1.2, 0.75


class Vocabulary(NamedTuple):
    """What the tokeniser is made of; ``end`` closes every document."""

    ranks: bytes
    pattern: str
    specials: dict[str, int]
    end: int


def crc_pieces(pieces: list[np.ndarray]) -> pa.Array:
    from zlib import crc32

    return pa.array([crc32(p.astype("<u4").tobytes()) for p in pieces], pa.int64())


def id_pieces(pieces: list[np.ndarray]) -> pa.Array:
    return pa.array([p.astype(np.int32) for p in pieces], pa.list_(pa.int32()))


def pack(
    df: DataFrame,
    key: str,
    text: str,
    vocabulary: Vocabulary,
    window: int = 2048,
    column: tuple[str, T.DataType] = ("ids", T.ArrayType(T.IntegerType())),
    project: Callable[[list[np.ndarray]], pa.Array] = id_pieces,
) -> DataFrame:
    """Pieces of all documents with their place in the windows.

    Gives ``key``, ``start`` (ids of the document before the piece), ``length``, ``doc_tokens``, ``sequence_id``,
    ``offset`` (within the sequence) and ``column``, made from the ids of the piece. All windows of a shard are full but
    for the rest, which is cut into sequences whose lengths are powers of two, so nothing needs padding.

    NULL is the empty text, which is the end id alone. Rows with equal or NULL keys are packed each. Texts longer
    than a window run on through the next ones. An empty table gives an empty table. Other columns are left out.
    ``window`` must be a power of two.
    """
    if window < 1 or window & (window - 1):
        raise ValueError("window must be a power of two")
    documents, statistics = _tokenise(df, key, text, vocabulary)
    total, shards = _corpus(documents)
    slots = statistics.groupBy("slot").agg(F.sum("n").alias("n")).toArrow()  # SLOTS rows at most
    frequency = np.zeros(SLOTS, np.int64)
    frequency[slots["slot"].to_numpy()] = slots["n"].to_numpy()
    idf = np.log1p((total.rows - frequency + 0.5) / (frequency + 0.5)).astype(np.float32)
    spark = df.sparkSession
    shared = spark.sparkContext.broadcast((idf, total.words / max(total.rows, 1), _opens(vocabulary)))
    kind = df.schema[key].dataType
    order = ("place", "tie", "row")  # rows differ between copies, so a group of them is cut like any other range
    placed = documents.repartitionByRange(shards, *order).sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [b for b in batches if b.num_rows]
        if not rows:
            return
        rows = pa.Table.from_batches(rows).select(["key", "ids"]).combine_chunks()
        idf, mean_words, opens = shared.value
        docs = _views(rows["ids"].combine_chunks(), np.dtype(id_type(len(opens))))
        doc, start, length, sequence, offset = fill(docs, Index(docs, opens, idf, mean_words), window)
        shard = TaskContext.get().partitionId() << 32
        for low in range(0, len(doc), 4096):
            at = slice(low, low + 4096)
            pieces = [docs[d][s : s + n] for d, s, n in zip(doc[at], start[at], length[at])]
            sizes = np.array([len(docs[d]) for d in doc[at]], np.int64)
            numbers = (start[at], length[at], sizes, sequence[at] + shard, offset[at])
            arrays = [rows["key"].take(pa.array(doc[at])).combine_chunks(), *map(pa.array, numbers), project(pieces)]
            yield pa.RecordBatch.from_arrays([_whole(a) for a in arrays], names)

    longs = ("start", "length", "doc_tokens", "sequence_id", "offset")
    names = [key, *longs, column[0]]
    fields = [T.StructField(key, kind), *(T.StructField(n, T.LongType()) for n in longs), T.StructField(*column)]
    return placed.mapInArrow(releasing(run), T.StructType(fields))


def _views(column: pa.BinaryArray, kind: np.dtype) -> list[np.ndarray]:
    """The numbers of each row, without a copy."""
    column = _whole(column)
    _, offsets, data = column.buffers()
    at = (np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1] // kind.itemsize).tolist()
    flat = np.frombuffer(data, np.uint8)[: at[-1] * kind.itemsize].view(kind)
    return [flat[a:b] for a, b in zip(at, at[1:])]


def _whole(array: pa.Array | pa.ChunkedArray) -> pa.Array:
    return pa.concat_arrays(array.chunks) if isinstance(array, pa.ChunkedArray) else array


def _opens(vocabulary: Vocabulary) -> np.ndarray:
    return ByteBpe(*vocabulary[:3]).opens_word


def id_type(n_ids: int) -> str:
    """Ids are stored in two bytes where they fit."""
    return "<u2" if n_ids <= 1 << 16 else "<u4"


class Totals(NamedTuple):
    rows: int
    tokens: int
    words: int


def _corpus(documents: DataFrame) -> tuple[Totals, int]:
    sums = documents.agg(F.count("*"), F.sum("n_tokens"), F.sum("n_words")).first()
    total = Totals(*(s or 0 for s in sums))
    return total, max(1, -(-total.tokens // SHARD_TOKENS))


def _tokenise(df: DataFrame, key: str, text: str, vocabulary: Vocabulary) -> tuple[DataFrame, DataFrame]:
    """Token table and word statistics, from one pass: each task ends with the document frequencies it saw."""
    spark = df.sparkSession
    shared = spark.sparkContext.broadcast(vocabulary)
    kind = df.schema[key].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, bpe, seen = shared.value, None, np.zeros(SLOTS, np.int64)
        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            for part in row_slices(batch, "text"):
                bpe = bpe or ByteBpe(*vocabulary[:3])
                ids, first = bpe.encode(part.column("text"))
                n = len(first) - 1
                ids, first = np.insert(ids, first[1:], vocabulary.end), first + np.arange(n + 1)
                words, doc = doc_words(ids, first, bpe.opens_word)
                slots = distinct(doc * SLOTS + (words % np.uint64(SLOTS)).astype(np.int64)) % SLOTS
                seen += np.bincount(slots, minlength=SLOTS)
                place = np.minimum.reduceat(words, np.searchsorted(doc, np.arange(n))).view(np.int64)
                tie = mix(range_hashes(mix(ids.astype(np.uint64)), first[:-1], first[1:])).view(np.int64)
                stored = ids.astype(id_type(len(bpe.opens_word)))
                blobs = [stored[a:b].tobytes() for a, b in zip(first[:-1], first[1:])]
                counts = np.bincount(doc, minlength=n)
                longs = [pa.array(x, pa.int64()) for x in (np.diff(first), counts, place, tie, row + np.arange(n))]
                row += n
                none = pa.nulls(n, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [part.column("key"), pa.array(blobs, pa.binary()), *longs, none, none], names
                )
        slots = np.flatnonzero(seen)
        for low in range(0, len(slots), 1 << 14):
            some = slots[low : low + (1 << 14)]
            empty = [pa.nulls(len(some), t) for t in (pa_key, pa.binary(), *[pa.int64()] * 5)]
            yield pa.RecordBatch.from_arrays([*empty, pa.array(some), pa.array(seen[some])], names)

    from pyspark.sql.pandas.types import to_arrow_type

    pa_key = to_arrow_type(kind)
    names = ["key", "ids", "n_tokens", "n_words", "place", "tie", "row", "slot", "n"]
    fields = [T.StructField("key", kind), T.StructField("ids", T.BinaryType())]
    schema = T.StructType([*fields, *(T.StructField(c, T.LongType()) for c in names[2:])])
    source = df.select(F.col(key).alias("key"), F.col(text).alias("text"))
    stored = store(source.mapInArrow(releasing(run), schema), "tokens")
    return stored.filter("slot IS NULL").drop("slot", "n"), stored.filter("slot IS NOT NULL").select("slot", "n")


def doc_words(ids: np.ndarray, first: np.ndarray, opens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each run of ids that starts at white space or at a document's start, and its document."""
    starts = opens[ids]
    starts[first[:-1]] = True
    at = np.flatnonzero(starts)
    hashes = range_hashes(mix(ids.astype(np.uint64) + np.uint64(1)), at, np.append(at[1:], len(ids)))
    return hashes, np.searchsorted(first, at, side="right") - 1


class Index:
    """BM25 inverted index of one shard, with the best query words of each of its documents."""

    def __init__(self, docs: list[np.ndarray], opens: np.ndarray, idf: np.ndarray, mean_words: float):
        self.n = len(docs)
        first = np.concatenate([[0], np.cumsum([len(d) for d in docs])])
        words, doc = doc_words(np.concatenate(docs), first, opens)
        slot = (words % np.uint64(SLOTS)).astype(np.int64)
        _, word = np.unique(words, return_inverse=True)
        pairs, at, tf = np.unique(word * self.n + doc, return_index=True, return_counts=True)
        word, doc, weight = pairs // self.n, pairs % self.n, idf[slot[at]]
        size = np.bincount(doc, weights=tf, minlength=self.n)
        damp = K1 * (1 - B + B * size[doc] / max(mean_words, 1))
        self.score = (weight * tf * (K1 + 1) / (tf + damp)).astype(np.float32)
        self.doc = doc.astype(np.int32)
        self.low = np.searchsorted(word, np.arange(word[-1] + 2 if len(word) else 1))
        shared = np.flatnonzero(np.diff(self.low)[word] > 1)  # a word of one document finds no neighbour
        order = shared[np.lexsort((word[shared], -weight[shared], doc[shared]))]
        rank = np.arange(len(order)) - np.searchsorted(doc[order], doc[order])
        order = order[rank < QUERY_WORDS]
        self.query = word[order]
        self.query_low = np.searchsorted(doc[order], np.arange(self.n + 1))

    def neighbours(self, seed: int, used: np.ndarray) -> list[int]:
        """The best unused documents for ``seed``, best first; ties in shard order."""
        words = self.query[self.query_low[seed] : self.query_low[seed + 1]]
        low = self.low[words]
        counts = self.low[words + 1] - low
        scores = np.bincount(spread(self.doc, low, counts), spread(self.score, low, counts), self.n)
        scores[used] = 0
        found = np.flatnonzero(scores)
        if len(found) > NEIGHBOURS:
            found = found[np.argpartition(-scores[found], NEIGHBOURS)[:NEIGHBOURS]]
        return found[np.lexsort((found, -scores[found]))].tolist()


def fill(docs: list[np.ndarray], index: Index, window: int) -> tuple[np.ndarray, ...]:
    """Cut the documents into windows; gives document, start, length, sequence and offset of each piece."""
    used = np.zeros(len(docs), bool)
    left = sum(len(d) for d in docs)
    pieces, queue, cursor, sequence, room = [], [], 0, 0, _room(left, window)
    at, seeded, seed, more = 0, False, 0, False
    while left:
        while queue and used[queue[-1]]:
            queue.pop()
        if more and not queue:  # the index gave its most, and all of these are used
            queue = index.neighbours(seed, used)[::-1]
            more = len(queue) == NEIGHBOURS
        if queue:
            doc = queue.pop()
        else:
            while used[cursor]:
                cursor += 1
            doc = cursor
        used[doc] = True
        start, n = 0, len(docs[doc])
        while start < n:
            take = min(room, n - start)
            pieces.append((doc, start, take, sequence, at))
            start, at, room, left = start + take, at + take, room - take, left - take
            if not room:
                sequence, at, seeded = sequence + 1, 0, False
                room = _room(left, window)
        if left and at and not seeded:  # the document that opened this window is its seed
            queue, seeded, seed = index.neighbours(doc, used)[::-1], True, doc
            more = len(queue) == NEIGHBOURS
        elif not at:
            queue, more = [], False
    columns = np.array(pieces, np.int64).reshape(-1, 5)
    return tuple(np.ascontiguousarray(c) for c in columns.T)


def _room(left: int, window: int) -> int:
    return window if left >= window else 1 << (left.bit_length() - 1) if left else 0
