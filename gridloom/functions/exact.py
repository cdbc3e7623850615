"""Sums of doubles that do not depend on the order of their terms.

A finite double is a whole number times a power of two. It is cut into limbs of 32 bits at fixed places; the limbs of
all terms are added as integers, which is exact, and the total is rounded once, to the nearest double. So the partial
sums of any partitioning merge to the same bits.
"""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions.arrow import null_mask

_LIMB_BITS, _LOWEST = 32, 1152  # limb 0 begins at 2**-1152, below the last bit of the smallest double
_NAN, _PLUS, _MINUS = -1, -2, -3  # limbs that count terms which are not finite

LIMBS = "array<struct<limb:int,part:bigint>>"


def _cut(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Place of the value, number of the limb and its part; three parts for every finite value, one for any other."""
    finite = np.flatnonzero(np.isfinite(values))
    fraction, power = np.frexp(values[finite])
    whole = np.abs(fraction * 2.0**53).astype(np.int64)  # 53 bits, exact
    place = power.astype(np.int64) - 53 + _LOWEST
    sign, limb, shift = np.where(fraction < 0, -1, 1), place // _LIMB_BITS, place % _LIMB_BITS
    mask = (1 << _LIMB_BITS) - 1
    low, high = whole & mask, whole >> _LIMB_BITS  # of 32 and 21 bits, so that a shift by 31 stays below 2**63
    low, high = low << shift, high << shift
    carried = (low >> _LIMB_BITS) + (high & mask)
    parts = np.stack([low & mask, carried & mask, (carried >> _LIMB_BITS) + (high >> _LIMB_BITS)], axis=1)
    odd = np.flatnonzero(~np.isfinite(values))
    special = np.where(np.isnan(values[odd]), _NAN, np.where(values[odd] > 0, _PLUS, _MINUS))
    at = np.concatenate([np.repeat(finite, 3), odd])
    limbs = np.concatenate([(limb[:, None] + np.arange(3)).ravel(), special])
    return at, limbs, np.concatenate([(parts * sign[:, None]).ravel(), np.ones(len(odd), np.int64)])


def limbs(value: Column) -> Column:
    """The limbs of a double, those that are not 0; none for NULL."""

    @F.arrow_udf(LIMBS)
    def cut(values: pa.Array) -> pa.Array:
        known = ~null_mask(values)
        at, limb, part = _cut(values.drop_null().to_numpy(zero_copy_only=False))
        keep = part != 0
        at, limb, part = np.flatnonzero(known)[at[keep]], limb[keep], part[keep]
        order = np.argsort(at, kind="stable")
        ends = np.searchsorted(at[order], np.arange(len(values) + 1)).astype(np.int32)
        fields = [pa.array(limb[order].astype(np.int32)), pa.array(part[order])]
        return pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays(fields, ["limb", "part"]))

    return cut(value.cast("double"))


def _value(parts: list[dict], divisor: int | None) -> float | None:
    special = {p["limb"] for p in parts if p["limb"] < 0}
    if _NAN in special or {_PLUS, _MINUS} <= special:
        return float("nan")
    if special:
        return float("inf") if _PLUS in special else float("-inf")
    total = Fraction(sum(p["part"] << (_LIMB_BITS * p["limb"]) for p in parts), 1 << _LOWEST)
    if divisor is not None:
        if divisor == 0:
            return None
        total /= divisor
    try:
        return float(total)
    except OverflowError:
        return float("inf") if total > 0 else float("-inf")


def nearest(parts: Column, divisor: Column | None = None) -> Column:
    """The sum that merged limbs stand for, divided by a whole number if asked, rounded once; NULL for a divisor of 0."""

    @F.arrow_udf("double")
    def rounded(found: pa.Array, by: pa.Array) -> pa.Array:
        return pa.array([_value(p or [], d) for p, d in zip(found.to_pylist(), by.to_pylist())], pa.float64())

    return rounded(parts, (F.lit(None) if divisor is None else divisor).cast("long"))


def exact_sums(df: DataFrame, by: list[str], doubles: dict[str, Column], wholes: dict[str, Column]) -> DataFrame:
    """One row per group: merged limbs of each of ``doubles``, to be read by ``nearest``, and the sums of ``wholes``.

    Limbs are added per task before they are shuffled, so a group moves some tens of integers per task. Without ``by``
    there is always one row. NULL adds nothing; a limb holds the parts of 2**31 rows.
    """
    names = [*doubles, *wholes]
    one = lambda v: F.array(F.struct(F.lit(0).alias("limb"), v.cast("long").alias("part")))
    cut = [limbs(v) for v in doubles.values()] + [one(v) for v in wholes.values()]

    def tagged(i: int, parts: Column) -> Column:
        return F.transform(parts, lambda p: F.struct(F.lit(i).alias("which"), p["limb"].alias("limb"), p["part"].alias("part")))

    # The entry of every row keeps groups whose values are all NULL or 0.
    mark = F.array(F.struct(F.lit(-1).alias("which"), F.lit(0).alias("limb"), F.lit(0).cast("long").alias("part")))
    terms = df.select(*by, F.explode(F.concat(mark, *[tagged(i, c) for i, c in enumerate(cut)])).alias("_t")).select(*by, "_t.*")
    summed = terms.groupBy(*by, "which", "limb").agg(F.sum("part").alias("part"))
    found = summed.groupBy(*by).agg(F.collect_list(F.struct("which", "limb", "part")).alias("_all"))

    def of(i: int, name: str) -> Column:
        own = F.filter("_all", lambda p: p["which"] == i)
        if name in doubles:
            return F.transform(own, lambda p: F.struct(p["limb"].alias("limb"), p["part"].alias("part"))).alias(name)
        return F.coalesce(F.get(own, F.lit(0))["part"], F.lit(0).cast("long")).alias(name)

    return found.select(*by, *[of(i, n) for i, n in enumerate(names)])
