"""Evaluation metrics over prediction tables."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.functions import exact
from gridloom.functions import random as rnd
from gridloom.functions import vectors as vec
from gridloom.functions.arrow import checked_ids

CE_WEIGHT = 0.5  # weight of the cross-entropy next to the noise error
_RECORDS_PER_SLICE = 64


def cross_entropy(logits: Column, target: Column) -> Column:
    """``-log softmax(logits)[target]`` of one row."""
    return vec.log_sum_exp(logits) - F.element_at(logits, target.cast("int") + 1)


_ERRORS = T.StructType([T.StructField("ce", T.DoubleType()), T.StructField("sq_err", T.DoubleType())])


def sequence_errors(
    df: DataFrame, ids_col: str, codes: np.ndarray, schedule: DataFrame, seed: int, key_col: str, t_col: str = "t"
) -> DataFrame:
    """Noise the vectors of every token sequence at its own ``t`` and add two numbers: ``ce`` and ``sq_err``.

    The noise is drawn per (record, position). Logits are the products of a noised vector with the codes, and the
    vector expected under them gives back a noise estimate. ``ce`` is the mean cross-entropy of the sequence against its
    ids, ``sq_err`` the squared error of the noise over all positions and components; ``size`` counts these. Only the
    schedule is joined, by a broadcast; a sequence is reduced where it is read, a slice of records at a time. A NULL or
    empty sequence has NULL errors.
    """
    width, names = codes.shape[1], df.columns
    at = schedule.select(F.col("t").alias(t_col), "alpha_bar")
    length = F.greatest(F.coalesce(F.size(ids_col), F.lit(0)), F.lit(1))
    words = rnd.sequence_words(length, width, seed, "eps", F.col(key_col))
    rows = df.join(at, t_col).withColumn("_words", words)

    def errors(ids: np.ndarray, words: bytes, alpha_bar: float) -> tuple[float, float]:
        noise = rnd.normal_rows(words, width)
        x = math.sqrt(alpha_bar) * codes[ids] + math.sqrt(1 - alpha_bar) * noise
        logits = x @ codes.T
        top = logits.max(axis=1, keepdims=True)
        shares = np.exp(logits - top)
        total = shares.sum(axis=1, keepdims=True)
        ce = (top + np.log(total))[:, 0] - logits[np.arange(len(ids)), ids]
        guess = (x - math.sqrt(alpha_bar) * (shares / total @ codes)) / math.sqrt(1 - alpha_bar + 1e-8)
        return float(ce.mean()), float(((guess - noise) ** 2).sum())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, _RECORDS_PER_SLICE):
                part = batch.slice(start, _RECORDS_PER_SLICE)
                checked_ids(part.column(ids_col).drop_null(), len(codes))
                listed = zip(*(part.column(c).to_pylist() for c in (ids_col, "_words", "alpha_bar")))
                found = [errors(np.array(ids), words, ab) if ids else (None, None) for ids, words, ab in listed]
                arrays = [pa.array([f[i] for f in found], pa.float64()) for i in (0, 1)]
                yield pa.RecordBatch.from_arrays([*map(part.column, names), *arrays], [*names, "ce", "sq_err"])

    reduced = rows.select(*df.columns, "_words", "alpha_bar").mapInArrow(run, T.StructType([*df.schema.fields, *_ERRORS]))
    return reduced.withColumn("size", F.coalesce(F.size(ids_col), F.lit(0)) * width)


def batch_losses(df: DataFrame, ce_col: str, sq_err_col: str, size_col: str, by: Sequence[str]) -> DataFrame:
    """Per batch: ``n``, mean cross-entropy, mean squared error and their weighted sum.

    The sums are exact and rounded once, so the partitioning cannot change a bit of them. As with an average, rows whose
    cross-entropy is NULL do not count in its mean.
    """
    ce = F.col(ce_col)
    wholes = {"n": F.lit(1), "n_ce": ce.isNotNull().cast("int"), "size": F.coalesce(F.col(size_col), F.lit(0))}
    sums = exact.exact_sums(df, list(by), {"ce": ce, "sq_err": F.col(sq_err_col)}, wholes)
    means = sums.select(
        *by, "n", exact.nearest(F.col("ce"), F.col("n_ce")).alias("ce"), exact.nearest(F.col("sq_err"), F.col("size")).alias("mse")
    )
    return means.withColumn("loss", combined(F.col("mse"), F.col("ce")))


def combined(mse: Column, ce: Column, weight: float = CE_WEIGHT) -> Column:
    return mse + weight * ce


def weighted_mean(df: DataFrame, loss_cols: Sequence[str], n_col: str = "n") -> DataFrame:
    """Size-weighted means of batch losses, from exact sums of the products; 0.0 when there is no batch."""
    products = {c: F.col(c) * F.col(n_col) for c in loss_cols}
    sums = exact.exact_sums(df, [], products, {n_col: F.coalesce(F.col(n_col), F.lit(0))})
    means = [exact.nearest(F.col(c), F.greatest(F.lit(1), F.col(n_col))).alias(c) for c in loss_cols]
    return sums.select(F.col(n_col).alias("n"), *means)
