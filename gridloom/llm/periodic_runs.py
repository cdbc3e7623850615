"""Periodic runs of words, found by recompression.

The words of a batch of texts are compressed by turns: maximal blocks of one symbol become one symbol, then pairs of a
left and a right symbol do, until each text is one symbol. Equal passages are parsed alike but for their edges, so the
levels of this run-length grammar answer how far two places agree in a number of steps that grows with the number of
levels, for a whole array of queries at once. For every period the places of a grid as wide as the shortest run are
compared with the places one period on; where the words agree, the grammar extends exactly in both directions.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from gridloom.llm.words import byte_slices, carrying, mix, release_memory, row_slices, split_words

CANDIDATES = 1 << 20  # compared at once
_NEITHER = 2


class Level(NamedTuple):
    """``first[k]`` to ``first[k + 1]`` are the symbols of the level below that symbol k stands for."""

    symbols: np.ndarray
    first: np.ndarray
    parent: np.ndarray  # of the symbols below
    blocks: bool


class Grammar:
    """Levels of symbols over ``symbols``; the first ``n_marks`` numbers are marks, each used once, never compressed."""

    def __init__(self, symbols: np.ndarray, n_marks: int):
        self.levels = [Level(symbols, np.empty(0, np.int32), np.empty(0, np.int32), False)]
        marks = symbols < n_marks
        texts = np.count_nonzero(marks[:-1] & ~marks[1:])
        fresh, turn = int(symbols.max(initial=0)) + 1, 0
        while len(symbols) > n_marks + texts:
            symbols, fresh = self._blocks(symbols, fresh)
            symbols, fresh = self._pairs(symbols, fresh, n_marks, turn)
            turn += 1

    def _add(self, symbols: np.ndarray, keep: np.ndarray, named: np.ndarray, keys: np.ndarray, fresh: int, blocks: bool):
        """A level of the kept places; those at ``named`` get a new symbol for each distinct key."""
        distinct, numbers = np.unique(keys, return_inverse=True)
        above = symbols[keep]
        above[named] = fresh + numbers
        first = np.append(np.flatnonzero(keep), len(symbols)).astype(np.int32)
        parent = (np.cumsum(keep) - 1).astype(np.int32)
        self.levels.append(Level(above, first, parent, blocks))
        return above, fresh + len(distinct)

    def _blocks(self, symbols: np.ndarray, fresh: int) -> tuple[np.ndarray, int]:
        keep = np.ones(len(symbols), bool)
        np.not_equal(symbols[1:], symbols[:-1], out=keep[1:])
        if keep.all():
            return symbols, fresh
        sizes = np.diff(np.append(np.flatnonzero(keep), len(symbols)))
        named = np.flatnonzero(sizes > 1)
        return self._add(symbols, keep, named, symbols[keep][named] << 32 | sizes[named], fresh, True)

    def _pairs(self, symbols: np.ndarray, fresh: int, n_marks: int, turn: int) -> tuple[np.ndarray, int]:
        salt = np.uint64(turn + 1) << np.uint64(40)
        side = (mix(symbols.astype(np.uint64) + salt) >> np.uint64(63)).astype(np.int8)
        side[symbols < n_marks] = _NEITHER
        at = np.flatnonzero((side[:-1] == 0) & (side[1:] == 1))
        if not len(at):
            return symbols, fresh
        keep = np.ones(len(symbols), bool)
        keep[at + 1] = False
        named = at - np.arange(len(at))  # one symbol went for each pair before
        return self._add(symbols, keep, named, symbols[at] << 32 | symbols[at + 1], fresh, False)

    def extend(self, low: np.ndarray, high: np.ndarray, forward: bool) -> np.ndarray:
        """For how many symbols the places from ``low`` and from ``high`` on agree, rightward or leftward.

        The places include the ones given. A mark must lie between any two places and the ends of the text.
        """
        step = 1 if forward else -1
        low, high, begin = low.astype(np.int64), high.astype(np.int64), low
        stop = np.full(len(low), len(self.levels) - 1)
        active = np.arange(len(low))
        for k, level in enumerate(self.levels[1:]):
            p, r = low[active], high[active]
            below = self.levels[k].symbols
            same = below[p] == below[r]
            stop[active[~same]] = k
            active, p, r = active[same], p[same], r[same]
            if not len(active):
                break
            edge_p, left_p = _inside(level, p, forward)
            edge_r, left_r = _inside(level, r, forward)
            ahead = np.where(edge_p & edge_r, 0, np.minimum(left_p, left_r)) * step
            p, r = p + ahead, r + ahead
            up = _inside(level, p, forward)[0] & _inside(level, r, forward)[0]
            low[active], high[active] = np.where(up, level.parent[p], p), np.where(up, level.parent[r], r)
            stop[active[~up]] = k
            active = active[up]
        order = np.argsort(-stop, kind="stable")
        until = np.searchsorted(-stop[order], -np.arange(len(self.levels)), "right")
        for k in range(len(self.levels) - 1, 0, -1):
            level, now = self.levels[k], order[: until[k]]
            if not len(now):
                continue
            p, r = low[now], high[now]
            size = np.minimum(level.first[p + 1] - level.first[p], level.first[r + 1] - level.first[r])
            p, r = (level.first[p], level.first[r]) if forward else (level.first[p + 1] - 1, level.first[r + 1] - 1)
            below = self.levels[k - 1].symbols
            ahead = np.where(below[p] == below[r], size if level.blocks else 1, 0) * step
            low[now], high[now] = p + ahead, r + ahead
        return (low - begin) * step


def _inside(level: Level, at: np.ndarray, forward: bool) -> tuple[np.ndarray, np.ndarray]:
    """Whether places open their parent (close it, leftward), and how many symbols of it lie ahead, themselves included."""
    parent = level.parent[at]
    first, last = level.first[parent], level.first[parent + 1] - 1
    return (at == first, last - at + 1) if forward else (at == last, at - first + 1)


class Runs(NamedTuple):
    """Runs of a batch, by text and start: words ``[start, start + length)`` of text ``text``."""

    text: np.ndarray
    start: np.ndarray
    length: np.ndarray
    period: np.ndarray


def _candidates(sizes: np.ndarray, first: np.ndarray, least: int, exponent: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Text, place and period of all grid points, some at a time; ``first`` is where each text begins.

    A run of period q holds ``max(least, exponent * q) - q`` places in a row that agree with the place q on, hence a
    point of the grid of that width.
    """
    periods = np.where(sizes >= least, sizes // exponent, 0)
    total = np.cumsum(periods)
    low = 0
    while low < (total[-1] if len(total) else 0):
        # The points of a period q are about n / q, of which there are at most a few n for one text.
        number = np.arange(low, min(total[-1], low + CANDIDATES // 4))
        text = np.searchsorted(total, number, "right")
        period = number - (total[text] - periods[text]) + 1
        width = np.maximum(least, exponent * period) - period
        points = -(-(sizes[text] - period) // width)
        ends = np.cumsum(points)
        most = max(1, int(np.searchsorted(ends, CANDIDATES, "right")))
        text, period, width, points, ends = (x[:most] for x in (text, period, width, points, ends))
        at = np.arange(ends[-1]) - np.repeat(ends - points, points)
        text, period = np.repeat(text, points), np.repeat(period, points)
        yield text, first[text] + at * np.repeat(width, points), period
        low += most


def find_runs(words: np.ndarray, text_first: np.ndarray, least: int, exponent: int) -> Runs:
    """All runs of at least ``least`` words and ``exponent`` periods. ``text_first`` bounds the texts within ``words``."""
    sizes = np.diff(text_first)
    n_marks = len(sizes) + 1
    marks = text_first + np.arange(n_marks)
    symbols = np.empty(len(words) + n_marks, np.int64)
    symbols[marks] = np.arange(n_marks)
    inner = np.ones(len(symbols), bool)
    inner[marks] = False
    symbols[inner] = words.astype(np.int64) + n_marks
    first = marks[:-1] + 1
    hits = []
    for text, at, period in _candidates(sizes, first, least, exponent):
        same = np.flatnonzero(symbols[at] == symbols[at + period])
        hits.append(np.stack([text[same], at[same], period[same]]))
    text, at, period = np.concatenate(hits, axis=1) if hits else np.empty((3, 0), np.int64)
    if not len(at):
        return Runs(text, at, at, period)
    grammar = Grammar(symbols, n_marks)
    begin = at - grammar.extend(at - 1, at + period - 1, False)
    end = at + grammar.extend(at, at + period, True) + period
    long = np.flatnonzero(end - begin >= np.maximum(least, exponent * period))
    long = long[np.lexsort((period[long], end[long], begin[long]))]
    new = np.ones(len(long), bool)  # of equal stretches, the smallest period
    new[1:] = (np.diff(begin[long]) != 0) | (np.diff(end[long]) != 0)
    long = long[new]
    long = long[np.lexsort((period[long], begin[long]))]
    return Runs(text[long], begin[long] - first[text[long]], end[long] - begin[long], period[long])


RUN = T.StructType([T.StructField(n, T.LongType()) for n in ("start", "length", "period")])


def collapse(
    df: DataFrame, key: str, text: str, least: int = 24, exponent: int = 3, carry: Sequence[str] = ()
) -> DataFrame:
    """``key``, the columns ``carry``, ``n_words``, ``runs`` by start and period, and ``collapsed``.

    A run is a maximal stretch of words of smallest period q, at least ``least`` words and ``exponent`` q long.
    ``collapsed`` keeps of each run the first period: a word goes if any run holds it after that run's first q words;
    kept words are joined by one space. NULL is the text without words, with no run and an empty ``collapsed``. Keys
    may be NULL or repeated; repeated rows fare alike. Only the named columns are read, so others cannot clash. A text
    is compared with itself only and never moves.
    """
    source, carried = carrying(df, text, [key, *carry])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in row_slices(batch, "_text"):
                arrays = [*map(part.column, carried), *_collapsed(part.column("_text"), least, exponent)]
                yield pa.RecordBatch.from_arrays(arrays, [key, *carry, "n_words", "runs", "collapsed"])
        release_memory()

    kept = [T.StructField(c, df.schema[c].dataType) for c in (key, *carry)]
    made = [
        T.StructField("n_words", T.LongType()),
        T.StructField("runs", T.ArrayType(RUN)),
        T.StructField("collapsed", T.StringType()),
    ]
    return source.mapInArrow(run, T.StructType([*kept, *made]))


def _collapsed(column: pa.Array, least: int, exponent: int) -> list[pa.Array]:
    words = split_words(column)
    cuts = np.empty(2 * len(words.start) + 1, np.int64)
    cuts[:-1:2], cuts[1::2], cuts[-1] = words.start, words.end, words.end[-1] if len(words.end) else 0
    coded = byte_slices(words.data, cuts).take(pa.array(np.arange(0, len(cuts) - 1, 2))).dictionary_encode()
    runs = find_runs(coded.indices.to_numpy(zero_copy_only=False), words.first, least, exponent)
    base = words.first[runs.text] + runs.start
    covered = np.zeros(len(words.start) + 1, np.int64)
    np.add.at(covered, base + runs.period, 1)
    np.add.at(covered, base + runs.length, -1)
    keep = np.cumsum(covered[:-1]) == 0
    raw = words.data.tobytes()
    texts = []
    for d, (low, high) in enumerate(zip(words.text_at[:-1].tolist(), words.text_at[1:].tolist())):
        pieces = raw[low:high].split()
        chosen = keep[words.first[d] : words.first[d + 1]]
        if not chosen.all():
            pieces = [pieces[i] for i in np.flatnonzero(chosen).tolist()]
        texts.append(b" ".join(pieces))
    offsets = np.searchsorted(runs.text, np.arange(len(column) + 1)).astype(np.int32)
    fields = [pa.array(x.astype(np.int64)) for x in (runs.start, runs.length, runs.period)]
    listed = pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays(fields, ["start", "length", "period"]))
    return [pa.array(np.diff(words.first).astype(np.int64)), listed, pa.array(texts, pa.binary()).cast(pa.string())]
