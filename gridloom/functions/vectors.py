"""Arithmetic on ``array<double>`` columns."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once, however often the body mentions it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def doubles(vec: Column) -> Column:
    return vec.cast("array<double>")


def add(x: Column, y: Column) -> Column:
    return F.zip_with(x, y, lambda a, b: a + b)


def scale(k: Column, x: Column) -> Column:
    return F.transform(x, lambda a: k * a)


def blend(k: Column, x: Column, m: Column, y: Column) -> Column:
    """``k*x + m*y`` per component."""
    return F.zip_with(x, y, lambda a, b: k * a + m * b)


def total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda acc, a: acc + a)


def squared_error(x: Column, y: Column) -> Column:
    """Sum over components of the squared difference."""
    return F.aggregate(F.zip_with(x, y, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda acc, d: acc + d)


def softmax(logits: Column) -> Column:
    """Softmax of one row, shifted by its maximum."""
    shifted = lambda row: let(F.array_max(row), lambda top: F.transform(row, lambda x: F.exp(x - top)))
    share = lambda weights: let(total(weights), lambda t: F.transform(weights, lambda w: w / t))
    return let(let(logits, shifted), share)


def log_sum_exp(logits: Column) -> Column:
    def of(row):
        return let(
            F.array_max(row),
            lambda top: top + F.ln(F.aggregate(row, F.lit(0.0), lambda acc, x: acc + F.exp(x - top))),
        )

    return let(logits, of)


def argmax(scores: Column) -> Column:
    """0-based position of the largest score; equal scores give the lowest position."""
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("int")


def guide(uncond: Column, cond: Column, strength: Column) -> Column:
    """Guided logits ``u + s*(c - u)``."""
    return F.zip_with(uncond, cond, lambda u, c: u + strength * (c - u))


def gumbel_scores(logits: Column, draws: Column, temperature: Column) -> Column:
    """Scores whose argmax is one draw from ``softmax(logits / temperature)``."""
    return F.zip_with(logits, draws, lambda x, u: x / temperature - F.ln(-F.ln(u)))


def sinusoidal(value: Column, dim: int) -> Column:
    """Sine then cosine of ``value`` at frequencies log-spaced from 1e-4 to 1, zero padded when odd."""
    half = dim // 2
    step = math.log(1.0 / 1e-4) / (half - 1) if half > 1 else 0.0
    freqs = F.array(*[F.lit(math.exp(math.log(1e-4) + step * i)) for i in range(half)])
    parts = [
        F.transform(freqs, lambda f: F.sin(value * f)),
        F.transform(freqs, lambda f: F.cos(value * f)),
    ]
    if dim % 2:
        parts.append(F.array(F.lit(0.0)))
    return F.concat(*parts)


def place_rates(dim: int) -> list[float]:
    """Angle per place of each sine / cosine pair of the positional features."""
    if dim % 2:
        raise ValueError("positional features need an even width")
    return [math.exp(-math.log(10000.0) * i / dim) for i in range(0, dim, 2)]


def positional(pos: Column, dim: int) -> Column:
    """Interleaved sine / cosine of a position, to be added to the vector at that position."""
    freqs = F.array(*map(F.lit, place_rates(dim)))
    return F.flatten(F.transform(freqs, lambda f: F.array(F.sin(pos * f), F.cos(pos * f))))
