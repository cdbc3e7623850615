"""Keyed permutations of 0..n-1 whose values are computed, not sorted.

A Feistel network over the two halves of the smallest even number of bits that holds n - 1, with four rounds of a keyed
function, permutes a domain of at most 4n numbers; a value outside 0..n-1 walks on along its cycle until it is inside.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

ROUNDS = 4
PRIME = 2**31 - 1


def round_keys(seed: int, epoch: int) -> list[tuple[int, int]]:
    """Two numbers below the prime for each round."""
    digests = [hashlib.md5(f"{seed}:{epoch}:{r}".encode()).hexdigest() for r in range(ROUNDS)]
    return [(int(d[:8], 16) % PRIME, int(d[8:16], 16) % PRIME) for d in digests]


def half_bits(n: np.ndarray) -> np.ndarray:
    """Bits of each half: the least k with 4**k >= n, and 1 at least."""
    k = np.ones(len(n), np.int64)
    while (short := (np.int64(1) << (2 * k)) < n).any():
        k[short] += 1
    return k


def _mixed(half: np.ndarray, keys: tuple[int, int], mask: np.ndarray) -> np.ndarray:
    for key in keys:
        half = (half + key) % PRIME
        half = half * half % PRIME
    return half & mask


def permuted(x: np.ndarray, n: np.ndarray, keys: list[tuple[int, int]], inverse: bool = False) -> np.ndarray:
    """The places of ``x`` in 0..n-1, each under its own ``n``; or what stands at the places ``x``."""
    k = half_bits(n)
    mask = (np.int64(1) << k) - 1
    out, walking = x.copy(), np.arange(len(x))
    while len(walking):
        left, right = out[walking] >> k[walking], out[walking] & mask[walking]
        for key in keys[::-1] if inverse else keys:
            if inverse:
                left, right = right ^ _mixed(left, key, mask[walking]), left
            else:
                left, right = right, left ^ _mixed(right, key, mask[walking])
        out[walking] = left << k[walking] | right
        walking = walking[out[walking] >= n[walking]]
    return out


def place(idx: Column, n: Column, seed: int, epoch: int, inverse: bool = False) -> Column:
    """The place of number ``idx`` of 0..n-1 in the order of an epoch, or with ``inverse`` the number at a place.

    NULL gives NULL; a number outside 0..n-1, or n of 2**60 or more, fails. Narrow, and nothing is sorted.
    """
    keys = round_keys(seed, epoch)

    @F.arrow_udf("long")
    def permute(idx: pa.Array, n: pa.Array) -> pa.Array:
        known = ~(idx.is_null().to_numpy(zero_copy_only=False) | n.is_null().to_numpy(zero_copy_only=False))
        x, size = (c.to_numpy(zero_copy_only=False)[known].astype(np.int64) for c in (idx, n))
        if ((x < 0) | (x >= size) | (size >= 1 << 60)).any():
            raise ValueError("a number must lie in 0..n-1, and n below 2**60")
        out = np.zeros(len(idx), np.int64)
        out[known] = permuted(x, size, keys, inverse)
        return pa.array(out, mask=~known)

    return permute(idx.cast("long"), n.cast("long"))


def sql_place(source: str, columns: str, epochs: int, seed: int) -> str:
    """CTEs that end in ``placed``: ``columns``, epoch and pos of every row of ``source``, which has ``idx`` and ``n``."""
    keys = ", ".join(
        f"({e}, {r}, {a}, {b})" for e in range(epochs) for r, (a, b) in enumerate(round_keys(seed, e))
    )
    square = lambda x, key: f"((({x} + {key}) % {PRIME}) * (({x} + {key}) % {PRIME}) % {PRIME})"
    mixed = square(square("r", "a"), "b")
    value = "(l << k | r)"
    return f"""keys(epoch, round, a, b) AS (SELECT * FROM (VALUES {keys})),
shaped AS (SELECT *, greatest(1, ceil(log2(n) / 2))::bigint AS k FROM {source}),
walks AS (SELECT {columns}, n::bigint AS n, k, e.epoch::bigint AS epoch, 0::bigint AS step,
    idx::bigint >> k AS l, idx::bigint & ((1::bigint << k) - 1) AS r
  FROM shaped, range({epochs}) e(epoch)
  UNION ALL SELECT {columns}, n, k, w.epoch, step + 1, r, xor(l, {mixed} & ((1::bigint << k) - 1))
  FROM walks w JOIN keys q ON q.epoch = w.epoch AND q.round = step % {ROUNDS}
  WHERE step = 0 OR step % {ROUNDS} > 0 OR {value} >= n),
placed AS (SELECT {columns}, epoch, {value} AS pos FROM walks WHERE step > 0 AND step % {ROUNDS} = 0 AND {value} < n)"""
