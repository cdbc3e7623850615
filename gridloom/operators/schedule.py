"""Noise schedule, posterior coefficients, forward noising and one reverse step."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridloom.functions import random as rnd
from gridloom.functions import vectors as vec
from gridloom.storage import BROADCAST_ROWS

# Fixed values of the model family: 400 steps, betas from 1e-4 to 2e-2, null class 10 dropped in at 10 %.
STEPS, BETA_FIRST, BETA_LAST = 400, 1e-4, 2e-2
NULL_LABEL, DROP_RATE = 10, 0.1


def noise_schedule(
    spark: SparkSession, steps: int = STEPS, beta_first: float = BETA_FIRST, beta_last: float = BETA_LAST
) -> DataFrame:
    """``(t, beta, alpha, alpha_bar)`` for ``steps`` evenly spaced betas, both ends included.

    The window runs over the schedule only. Its size is known here, so the joins on ``t`` broadcast it
    by a hint, not by an estimate; beyond the bound they are left to a shuffle.
    """
    slope = (beta_last - beta_first) / (steps - 1) if steps > 1 else 0.0
    grid = spark.range(steps).select(
        F.col("id").cast("int").alias("t"), (F.lit(beta_first) + F.lit(slope) * F.col("id")).alias("beta")
    )
    upto = Window.orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    table = grid.withColumn("alpha", 1.0 - F.col("beta")).withColumn("alpha_bar", F.product("alpha").over(upto))
    return F.broadcast(table) if steps <= BROADCAST_ROWS else table


def posterior(schedule: DataFrame) -> DataFrame:
    """Add ``alpha_bar_prev, c_x0, c_x, var``: the mean weights and the variance of one reverse step."""
    before = F.lag("alpha_bar", 1, 1.0).over(Window.orderBy("t"))
    ab, prev = F.col("alpha_bar"), F.col("alpha_bar_prev")
    return (
        schedule.withColumn("alpha_bar_prev", before)
        .withColumn("c_x0", F.sqrt(prev) * F.col("beta") / (1.0 - ab))
        .withColumn("c_x", F.sqrt("alpha") * (1.0 - prev) / (1.0 - ab))
        .withColumn("var", F.greatest(F.col("beta") * (1.0 - prev) / (1.0 - ab + 1e-8), F.lit(1e-20)))
    )


def draw_timestep(steps: int, seed: int, key: Column) -> Column:
    """A uniform integer in [0, steps) per key."""
    return F.floor(rnd.uniform(seed, "t", key) * steps).cast("int")


def drop_labels(label: Column, seed: int, key: Column, rate: float = DROP_RATE, null_label: int = NULL_LABEL) -> Column:
    """Replace a label by the null class with probability ``rate``."""
    return F.when(rnd.uniform(seed, "drop", key) < rate, F.lit(null_label)).otherwise(label)


def gaussian(dim: int, seed: int, key: Column, what: str = "eps") -> Column:
    """A standard normal vector per key; ``what`` separates independent draws."""
    return rnd.normals(dim, seed, what, key)


def add_noise(df: DataFrame, schedule: DataFrame, vec_col: str, eps_col: str, out: str = "x_t", t_col: str = "t") -> DataFrame:
    """``x_t = sqrt(ab_t)*e0 + sqrt(1-ab_t)*eps``; also leaves ``alpha_bar`` for the recovery."""
    at = schedule.select(F.col("t").alias(t_col), "alpha_bar")
    ab = F.col("alpha_bar")
    return df.join(at, t_col).withColumn(
        out, vec.blend(F.sqrt(ab), F.col(vec_col), F.sqrt(1.0 - ab), F.col(eps_col))
    )


def recover_noise(x_t: Column, x0_hat: Column, alpha_bar: Column) -> Column:
    """``(x_t - sqrt(ab)*x0_hat) / sqrt(1 - ab + 1e-8)``."""
    shrink, spread = F.sqrt(alpha_bar), F.sqrt(1.0 - alpha_bar + 1e-8)
    return F.zip_with(x_t, x0_hat, lambda x, x0: (x - shrink * x0) / spread)


def reverse_step(
    df: DataFrame, posterior_table: DataFrame, x_col: str, x0_col: str, z_col: str, out: str = "x_prev", t_col: str = "t"
) -> DataFrame:
    """One reverse step for every row at its own ``t``; no noise is added at ``t = 0``."""
    at = posterior_table.select(F.col("t").alias(t_col), "c_x0", "c_x", "var")
    mean = vec.blend(F.col("c_x0"), F.col(x0_col), F.col("c_x"), F.col(x_col))
    spread = F.when(F.col(t_col) > 0, F.sqrt("var")).otherwise(F.lit(0.0))
    step = F.zip_with(mean, F.col(z_col), lambda m, z: m + F.col("_spread") * z)
    return df.join(at, t_col).withColumn("_spread", spread).withColumn(out, step).drop("_spread", "c_x0", "c_x", "var")
