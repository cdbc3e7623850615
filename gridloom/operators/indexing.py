"""Dense 0-based record numbers without a single-task window."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.storage import broadcast_if_small, store


def dense_index(
    df: DataFrame, order_by: Sequence[str], within: Sequence[str] = (), out: str = "idx", unique: bool = True
) -> DataFrame:
    """Number the rows 0..n-1 by ``order_by`` inside each ``within`` group.

    The rows are range partitioned over ``(within, order_by)``, so a group with most of the rows is
    spread over many tasks, and written once: partition bounds come from sampling, so they must not
    be computed twice. The window below sees one row per written partition and group. NULL is a group, and
    a place in the order, like any value. Where ``order_by`` is not ``unique``, a row number keeps equal rows
    from meeting in one task.
    """
    keys = [*within, *order_by]
    rows = df
    if not unique:
        rows = df.withColumn("_tie", F.monotonically_increasing_id())
        keys.append("_tie")
    placed = store(
        rows.repartitionByRange(*keys)
        .sortWithinPartitions(*keys)
        .select(*df.columns, F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_slot")),
        "index",
    )
    by_part = Window.partitionBy(*within).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = (
        placed.groupBy("_part", *within)
        .agg(F.count("*").alias("_n"), F.min("_slot").alias("_first"))
        .withColumn("_before", F.coalesce(F.sum("_n").over(by_part), F.lit(0)))
        .select(F.col("_part").alias("_in"), *(F.col(c).alias(f"_of_{c}") for c in within), "_before", "_first")
    )
    # Without groups there is one row per written partition, a number known to be small.
    side = broadcast_if_small(parts) if within else F.broadcast(parts)
    same = F.col("_part") == F.col("_in")
    for name in within:
        same &= F.col(name).eqNullSafe(F.col(f"_of_{name}"))
    return (
        placed.join(side, same)
        .withColumn(out, F.col("_before") + F.col("_slot") - F.col("_first"))
        .select(*df.columns, out)
    )


def with_dense_index(
    df: DataFrame,
    key: str,
    within: Sequence[str] = (),
    order_by: Sequence[str] | None = None,
    out: str = "idx",
    keep: Column | None = None,
    keys: DataFrame | None = None,
) -> DataFrame:
    """Add a dense index to wide rows with a unique ``key``, of which one may be NULL.

    Only the key columns are sampled, sorted and written; the payload moves once, in the join on ``key``.
    ``keep``, a condition on ``within`` and ``out``, drops index rows before that join; where few are left the payload
    does not move at all. ``keys`` gives the key columns of the same rows by a cheaper plan. A repeated key fails.
    """
    order = list(order_by or [key])
    narrow = (df if keys is None else keys).select(*dict.fromkeys([key, *within, *order]))
    index = dense_index(narrow, order, within, out)
    index = index if keep is None else index.filter(keep)
    # Grouped by the key that the join needs anyway, so that copies cannot multiply each other.
    index = index.groupBy(F.col(key).alias("_key")).agg(F.min(out).alias("_idx"), F.count("*").alias("_n"))
    if keep is not None:
        index = broadcast_if_small(index)
    repeated = F.raise_error(F.concat_ws(": ", F.lit("the key is not unique"), F.col("_key").cast("string"))).cast("bigint")
    joined = df.join(index, F.col(key).eqNullSafe(F.col("_key")))
    return joined.withColumn(out, F.when(F.col("_n") == 1, F.col("_idx")).otherwise(repeated)).drop("_key", "_idx", "_n")


def append_index(
    df: DataFrame, key: str, within: Sequence[str], state: DataFrame | None, out: str = "idx"
) -> tuple[DataFrame, DataFrame]:
    """Number appended rows on from ``state``, and give the state to go on from: ``within``, ``n`` and ``last_key``.

    ``state`` is None at first. Rows are numbered by ``key`` within their group, after all that came before, so builds
    in parts number like one build. A key that does not lie after the last key of its group would have belonged before
    rows that have their number: it fails, and so does a NULL or repeated key. The state has one row per group. Both
    results must be written before the next rows come.
    """
    names = [f"_of_{c}" for c in within]
    late = F.raise_error(F.concat_ws(": ", F.lit("the key comes too late or is NULL"), F.col(key).cast("string"))).cast("bigint")
    numbered = with_dense_index(df, key, within, out=out)
    if state is not None:
        known = broadcast_if_small(
            state.select(*(F.col(c).alias(n) for c, n in zip(within, names)), F.col("n").alias("_n"), F.col("last_key").alias("_last"))
        )
        same = F.lit(True)
        for c, n in zip(within, names):
            same &= F.col(c).eqNullSafe(F.col(n))
        numbered = numbered.join(known, same, "left")
    else:
        numbered = numbered.withColumns({"_n": F.lit(0).cast("long"), "_last": F.lit(None).cast(df.schema[key].dataType)})
    right = F.col(key).isNotNull() & (F.col("_last").isNull() | (F.col(key) > F.col("_last")))
    placed = numbered.withColumn(out, F.when(right, F.col(out) + F.coalesce("_n", F.lit(0))).otherwise(late))
    placed = placed.drop("_n", "_last", *names)
    seen = placed.groupBy(*within).agg((F.max(out) + 1).alias("n"), F.max(key).alias("last_key"))
    if state is not None:
        seen = state.select(*within, "n", "last_key").union(seen.select(*within, "n", "last_key"))
        seen = seen.groupBy(*within).agg(F.max("n").alias("n"), F.max("last_key").alias("last_key"))
    return placed, seen
