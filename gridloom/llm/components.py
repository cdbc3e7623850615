"""Connected components of a table of links, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.storage import store


def components(links: DataFrame) -> DataFrame:
    """``id`` and ``label``, the smallest id that links reach, for every id of the columns ``a`` and ``b``.

    Each round hangs the neighbours of every node on their smallest member, first the larger ones, then the smaller
    ones; rounds grow with the logarithm of the number of nodes. Minima are combined before they move, and only joins
    carry the links of a hub, so no task collects them. Every round is a table in the shared folder.
    """
    edges = store(_larger_first(links), "links")
    seen = None
    while True:
        size, digest = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if (size, digest) == seen:
            break
        seen = size, digest
        edges = store(_small_star(_large_star(edges)), "links")
    roots = edges.select(F.col("b").alias("id"), F.col("b").alias("label")).distinct()
    return edges.select(F.col("a").alias("id"), F.col("b").alias("label")).union(roots)


def _larger_first(links: DataFrame) -> DataFrame:
    ordered = links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    return ordered.distinct()


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("c"), F.least("a", "m").alias("m"))
    hung = both.join(least, F.col("a") == F.col("c")).filter("b > a")
    return _larger_first(hung.select(F.col("b").alias("a"), F.col("m").alias("b")))


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("c"), "m")
    hung = edges.join(least, F.col("a") == F.col("c"))
    return _larger_first(hung.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.toDF("a", "b")))
