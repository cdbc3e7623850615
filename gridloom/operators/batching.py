"""Ordered batches, record lookup and repeatable shuffles."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions import permute
from gridloom.operators.indexing import with_dense_index
from gridloom.storage import broadcast_if_small


def batch_id(idx_col: str, size: int) -> Column:
    return F.expr(f"`{idx_col}` div {size}")


def assemble(
    df: DataFrame, size: int, payload: Sequence[str], idx_col: str = "idx", within: Sequence[str] = ()
) -> DataFrame:
    """One row per ``size`` consecutive records: each payload column becomes an array in index order.

    Groups hold at most ``size`` rows because the index is dense; the last batch may be partial.
    """
    record = F.struct(idx_col, *payload)
    grouped = df.groupBy(*within, batch_id(idx_col, size).alias("batch_id")).agg(
        F.array_sort(F.collect_list(record)).alias("rows")
    )
    return grouped.select(
        *within, "batch_id", F.size("rows").alias("n"), *[F.col(f"rows.{name}").alias(name) for name in payload]
    )


def rows_of(flat: Column, width: int) -> Column:
    """A flat array cut into rows of ``width`` values."""
    starts = F.sequence(F.lit(1), F.greatest(F.size(flat), F.lit(1)), F.lit(width))
    rows = F.transform(starts, lambda at: F.slice(flat, at, F.lit(width)))
    return F.when(F.size(flat) > 0, rows).when(flat.isNotNull(), F.slice(rows, 1, 0))


def in_first(n: int, size: int, idx_col: str = "idx") -> Column:
    """The record lies in the first ``n`` batches: a condition on the index alone."""
    return F.col(idx_col) < n * size


def at(positions: Sequence[int], idx_col: str = "idx") -> Column:
    return F.col(idx_col).isin(*positions)


def first_batches(df: DataFrame, n: int, size: int, idx_col: str = "idx") -> DataFrame:
    """Records of the first ``n`` batches, filtered before they are grouped."""
    return df.filter(in_first(n, size, idx_col))


def record_at(df: DataFrame, positions: Sequence[int], idx_col: str = "idx") -> DataFrame:
    return df.filter(at(positions, idx_col))


def shuffled_index(df: DataFrame, key: str, seed: int, within: Sequence[str] = (), out: str = "pos") -> DataFrame:
    """Add the record's position in a seeded shuffle: dense order of md5(seed:key), ties by key."""
    ticket = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")))
    return with_dense_index(df.withColumn("_ticket", ticket), key, within, ["_ticket", key], out).drop("_ticket")


def epoch_orders(
    df: DataFrame, epochs: Sequence[int], seed: int, idx_col: str = "idx", within: Sequence[str] = (), out: str = "pos"
) -> DataFrame:
    """Every record once per epoch, with its place in that epoch's order of its group: ``epoch`` and ``out``.

    ``idx_col`` numbers the records of a group densely from 0, as one sort has left them; the orders of all epochs are
    computed from it by a keyed permutation, so a further epoch sorts and shuffles nothing. A group's size is counted,
    and joined by a broadcast of checked size.
    """
    names = [f"_of_{c}" for c in within]
    if within:
        sizes = df.groupBy(*(F.col(c).alias(n) for c, n in zip(within, names))).agg(F.count("*").alias("_size"))
        same = [F.col(c).eqNullSafe(F.col(n)) for c, n in zip(within, names)]
        counted = df.join(broadcast_if_small(sizes), same)
    else:
        counted = df.withColumn("_size", F.lit(df.count()))
    orders = [
        F.struct(F.lit(e).cast("long").alias("epoch"), permute.place(F.col(idx_col), F.col("_size"), seed, e).alias("pos"))
        for e in epochs
    ]
    placed = counted.withColumn("_order", F.explode(F.array(*orders)))
    return placed.withColumns({"epoch": F.col("_order.epoch"), out: F.col("_order.pos")}).drop("_order", "_size", *names)


def epoch_batch(n: int, epoch: int, batch: int, size: int, seed: int) -> list[int]:
    """The numbers of the records of one batch of an epoch over ``n`` records, in its order: found without the others."""
    places = np.arange(batch * size, min(n, (batch + 1) * size), dtype=np.int64)
    return permute.permuted(places, np.full(len(places), n), permute.round_keys(seed, epoch), inverse=True).tolist()
