"""Quality rules: base counts of a text, and bands for its zstandard ratio.

Ratio is compressed bytes over bytes. Repetitive text compresses too well, random characters too badly. Both are judged
over the whole text and over chunks of a fixed size, with limits that depend on the length, as short inputs compress
worse.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.llm.words import (
    Words,
    carrying,
    mix,
    range_hashes,
    release_memory,
    row_slices,
    slice_hashes,
    split_words,
    word_hashes,
)

SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True


class Bands(NamedTuple):
    """Texts of at least ``at_least[i]`` bytes must have a ratio in ``low[i]..high[i]``; shorter ones have no band.

    The defaults lie 10 to 20 % outside of the range that labelled good documents of the same length have.
    """

    at_least: tuple[int, ...] = (256, 1024, 4096, 16384)
    low: tuple[float, ...] = (0.42, 0.385, 0.36, 0.335)
    high: tuple[float, ...] = (0.85, 0.72, 0.62, 0.58)
    chunk: int = 4096
    bad_chunks: float = 0.5  # a text of two chunks or more goes if a larger share of them leaves the band
    level: int = 3


class Rules(NamedTuple):
    """Base rules: too few words, or too many of them in repeated 3-word windows."""

    min_words: int = 50
    repeat_percent: int = 50
    bands: Bands = Bands()


def base_counts(words: Words) -> list[np.ndarray]:
    """Per text: words, code points in words, symbols, repeated lines, words in repeated 3-word windows."""
    n_texts = len(words.first) - 1
    n_words = np.diff(words.first)
    leads = np.concatenate([[0], np.cumsum((words.data & 0xC0) != 0x80)])
    chars = np.concatenate([[0], np.cumsum(leads[words.end] - leads[words.start])])
    symbols = np.concatenate([[0], np.cumsum(SYMBOLS[words.data])])
    doc = np.repeat(np.arange(n_texts), n_words)
    return [
        n_words,
        np.diff(chars[words.first]),
        np.diff(symbols[words.text_at]),
        _repeated_lines(words, n_texts),
        _repeated_words(words, doc, n_texts),
    ]


def _keyed(hashes: np.ndarray, doc: np.ndarray) -> np.ndarray:
    return mix(hashes ^ mix(doc.astype(np.uint64)))


def _repeated_lines(words: Words, n_texts: int) -> np.ndarray:
    breaks = np.flatnonzero(words.data == 0x0A)
    start = np.union1d(breaks + 1, words.text_at[:-1])
    start = start[start < len(words.data)]
    if not len(start):
        return np.zeros(n_texts, np.int64)
    end = np.append(start[1:], len(words.data))
    end = end - (words.data[end - 1] == 0x0A)  # the break itself is no part of the line
    spoken = np.searchsorted(words.start, end) > np.searchsorted(words.start, start)
    start, end = start[spoken], end[spoken]
    doc = np.searchsorted(words.text_at, start, side="right") - 1
    _, first = np.unique(_keyed(slice_hashes(words.data, start, end), doc), return_index=True)
    return np.bincount(doc, minlength=n_texts) - np.bincount(doc[first], minlength=n_texts)


def _repeated_words(words: Words, doc: np.ndarray, n_texts: int) -> np.ndarray:
    n = len(doc)
    if n < 3:
        return np.zeros(n_texts, np.int64)
    at = np.flatnonzero(doc[:-2] == doc[2:])
    keys = _keyed(range_hashes(word_hashes(words), at, at + 3), doc[at])
    order = np.argsort(keys)
    same = keys[order[1:]] == keys[order[:-1]]
    twice = np.zeros(len(at), bool)
    twice[order[1:]] |= same
    twice[order[:-1]] |= same
    covered = np.zeros(n, bool)
    for k in range(3):
        covered[at[twice] + k] = True
    return np.bincount(doc[covered], minlength=n_texts)


def out_of_band(size: int, packed: int, bands: Bands) -> bool:
    i = np.searchsorted(bands.at_least, size, side="right") - 1
    return bool(i >= 0 and not bands.low[i] <= packed / size <= bands.high[i])


def compression_verdict(text: bytes, bands: Bands, compressor: zstandard.ZstdCompressor) -> tuple[int, int, int, bool]:
    """Compressed bytes of the whole text, its chunks, those out of their band, and whether the text passes.

    The last chunk is judged by the limits of its own length.
    """
    packed = len(compressor.compress(text))
    chunks = [text[i : i + bands.chunk] for i in range(0, len(text), bands.chunk)]
    bad = 0
    if len(chunks) > 1:
        bad = sum(out_of_band(len(c), len(compressor.compress(c)), bands) for c in chunks)
    passes = not out_of_band(len(text), packed, bands) and bad <= bands.bad_chunks * len(chunks)
    return packed, len(chunks), bad, passes


COLUMNS = {
    "n_words": "long",
    "word_chars": "long",
    "n_symbols": "long",
    "n_dup_lines": "long",
    "n_repeat_words": "long",
    "base_failed": "boolean",
    "kept": "boolean",
    "n_bytes": "long",
    "zstd_bytes": "long",
    "n_chunks": "long",
    "n_bad_chunks": "long",
}


def judge(df: DataFrame, key: str, text: str, rules: Rules = Rules(), carry: Sequence[str] = ()) -> DataFrame:
    """``key`` and the columns ``carry``, with the counts, the ratios and the verdict of every row.

    NULL is the empty text, which fails for want of words. Rows with equal or NULL keys are judged each, by their text
    alone, so copies share a verdict. Texts of any length are judged whole. An empty table gives an empty table.
    Other columns are left out.
    """
    source, carried = carrying(df, text, [key, *carry])
    names = [key, *carry, *COLUMNS]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compressor = zstandard.ZstdCompressor(level=rules.bands.level)
        for batch in batches:
            for part in row_slices(batch, "_text"):
                words = split_words(part.column("_text"))
                counts = base_counts(words)
                n_words, repeats = counts[0], counts[4]
                failed = (n_words < rules.min_words) | (100 * repeats > rules.repeat_percent * n_words)
                raw, at = words.data.tobytes(), words.text_at.tolist()
                found = [compression_verdict(raw[a:b], rules.bands, compressor) for a, b in zip(at, at[1:])]
                packed, chunks, bad, passes = (np.array(c) for c in zip(*found))
                longs = [pa.array(c, pa.int64()) for c in counts]
                flags = [pa.array(failed), pa.array(passes & ~failed)]
                sizes = [pa.array(c, pa.int64()) for c in (np.diff(words.text_at), packed, chunks, bad)]
                yield pa.RecordBatch.from_arrays([*map(part.column, carried), *longs, *flags, *sizes], names)
        release_memory()

    fields = [T.StructField(c, T.BooleanType() if k == "boolean" else T.LongType()) for c, k in COLUMNS.items()]
    kept = [T.StructField(c, df.schema[c].dataType) for c in (key, *carry)]
    return source.mapInArrow(run, T.StructType([*kept, *fields]))
