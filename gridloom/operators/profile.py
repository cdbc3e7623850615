"""Corpus profiles: line dimensions, code points, record counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions import text as tx


def dimension_histogram(df: DataFrame, text_col: str, order_col: str, k: int = 5) -> DataFrame:
    """``(dimension, rank, value, n)``: the ``k`` commonest text widths and heights.

    Equal counts keep the value seen first by ``order_col``. Counts are pre-aggregated per task and
    the rank filter keeps ``k`` rows per task, so neither step gathers the corpus.
    """
    measured = df.select(F.col(order_col), tx.text_size(F.col(text_col)).alias("size"))
    sizes = measured.select(
        order_col, F.stack(F.lit(2), F.lit("width"), "size.width", F.lit("height"), "size.height").alias("dimension", "value")
    )
    counted = sizes.groupBy("dimension", "value").agg(F.count("*").alias("n"), F.min(order_col).alias("first"))
    ranked = Window.partitionBy("dimension").orderBy(F.desc("n"), "first")
    return (
        counted.withColumn("rank", F.row_number().over(ranked))
        .filter(F.col("rank") <= k)
        .select("dimension", "rank", "value", "n")
    )


def codepoints(df: DataFrame, text_col: str) -> DataFrame:
    """``(ch, cp, hex, n_records)``: code points of raw texts without CR and LF."""
    chars = df.select(F.explode(tx.distinct_chars(F.col(text_col))).alias("ch"))
    counted = chars.filter(~F.col("ch").isin("\n", "\r")).groupBy("ch").agg(F.count("*").alias("n_records"))
    return counted.select(
        "ch",
        F.ascii("ch").alias("cp"),
        F.concat(F.lit("0x"), F.lower(F.hex(F.ascii("ch").cast("bigint")))).alias("hex"),
        "n_records",
    )


def split_counts(df: DataFrame, split_col: str = "split") -> DataFrame:
    return df.groupBy(split_col).agg(F.count("*").alias("n"))
