"""Repeatable randomness: every draw is a hash of (seed, key), never of row order or partitioning."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from gridloom.functions.arrow import list_rows

_PER_HASH = 4  # an md5 has 32 hex digits: four words of 32 bits
_VECTOR = ArrayType(DoubleType())


def _unit(word: Column) -> Column:
    """Eight hex digits to the open interval (0, 1)."""
    return (F.conv(word, 16, 10).cast("double") + 0.5) / 4294967296.0


def _digest(seed: int, keys: tuple) -> Column:
    parts = [k.cast("string") if isinstance(k, Column) else F.lit(str(k)) for k in (seed, *keys)]
    return F.md5(F.concat_ws(":", *parts))


def uniform(seed: int, *keys) -> Column:
    """One uniform per key."""
    return _unit(F.substring(_digest(seed, keys), 1, 8))


def _words(n: int, seed: int, keys: tuple) -> Column:
    """Big-endian 32-bit words of the hashes of one key, as many as ``n`` values need."""
    blocks = F.sequence(F.lit(0), F.lit((n - 1) // _PER_HASH))
    return F.unhex(F.array_join(F.transform(blocks, lambda b: _digest(seed, (*keys, b))), ""))


def _units(words: pa.Array) -> np.ndarray:
    """One row of uniforms per key. The hash is never NULL: an absent key hashes like any other."""
    data = np.frombuffer(b"".join(words.to_pylist()), ">u4")
    return (data.astype(np.float64).reshape(len(words), -1) + 0.5) / 4294967296.0


def uniforms(n: int, seed: int, *keys) -> Column:
    """``n`` uniforms per key; one hash serves four of them. Batches are converted in numpy."""

    @F.arrow_udf(_VECTOR)
    def spread(words: pa.Array) -> pa.Array:
        units = _units(words)[:, :n]
        return list_rows(units)

    return spread(_words(n, seed, keys))


def sequence_words(length: Column | int, n: int, seed: int, *keys) -> Column:
    """Hash words for ``n`` draws at each of ``length`` positions of a key, as bytes; see ``normal_rows``.

    A position draws what ``normals(n, seed, *keys, position)`` draws.
    """
    places, blocks = F.sequence(F.lit(0), F.lit(length) - 1), F.sequence(F.lit(0), F.lit((n - 1) // _PER_HASH))
    at = lambda p: F.array_join(F.transform(blocks, lambda b: _digest(seed, (*keys, p, b))), "")
    return F.unhex(F.array_join(F.transform(places, at), ""))


def normal_rows(words: bytes, n: int) -> np.ndarray:
    """Standard normals from hash words, ``n`` per row, by Box-Muller."""
    per_row = -(-n // _PER_HASH) * _PER_HASH
    units = (np.frombuffer(words, ">u4").astype(np.float64).reshape(-1, per_row) + 0.5) / 4294967296.0
    return _polar(units)[:, :n]


def _polar(units: np.ndarray) -> np.ndarray:
    radius = np.sqrt(-2.0 * np.log(units[:, 0::2]))
    angle = 2.0 * math.pi * units[:, 1::2]
    return np.stack([radius * np.cos(angle), radius * np.sin(angle)], axis=2).reshape(len(units), -1)


def normals(n: int, seed: int, *keys) -> Column:
    """``n`` standard normals per key by Box-Muller; one hash serves four of them."""

    @F.arrow_udf(_VECTOR)
    def box_muller(words: pa.Array) -> pa.Array:
        return list_rows(_polar(_units(words))[:, :n])

    return box_muller(_words(n, seed, keys))
