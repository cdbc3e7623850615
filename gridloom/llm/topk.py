"""Exact top-k inner products by norm-bucketed retrieval.

Vectors are grouped by length: a bucket holds lengths within a few per cent of each other, and is cut by a hash of the id
into blocks of bounded size. The block of the longest vectors is searched first and gives every query a score that its
k-th answer cannot fall below. From it follow, bucket by bucket, the least length a candidate needs and the least cosine
to the query. A bucket that is too short is skipped without moving the query there. Elsewhere a high cosine limit prunes
by coordinates, a low one by length; what is left is verified by its product.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.storage import store

CANDIDATE_ROWS, QUERY_ROWS = 8192, 2048
STEPS_PER_OCTAVE = 16  # length buckets within a doubling of the length
COORDINATES = 5  # focus coordinates of coordinate pruning
COSINE_SWITCH = 0.6  # local cosine threshold from which coordinates prune better than lengths


def usable(vector: Column) -> Column:
    """No NULL, and finite components only."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & ~bad


def quantise(vector: Column, scale: int = 256) -> Column:
    return F.transform(vector, lambda x: F.floor(x.cast("double") * scale))


def _squares(vector: Column) -> Column:
    return F.aggregate(vector, F.lit(0.0), lambda s, x: s + x.cast("double") * x)


def _blocks(vectors: DataFrame) -> DataFrame:
    """Vectors with ``dim``, ``bucket`` (higher is longer), squared length and a number, by which a bucket is cut."""
    vectors = vectors.withColumn("row", F.monotonically_increasing_id())  # stored with it, so it stays
    step = F.floor(F.log2(F.greatest(F.col("sq"), F.lit(1.0))) * (STEPS_PER_OCTAVE / 2)).cast("int")
    sized = vectors.withColumn("sq", _squares(F.col("v"))).withColumn("dim", F.size("v")).withColumn("bucket", step)
    return sized


def top_k(df: DataFrame, key: str, vector: str, is_query: Column, k: int = 5) -> DataFrame:
    """``query_id``, ``rank`` (from 1), ``vec_id`` and ``score`` of the ``k`` largest integer products of each query.

    ``vector`` holds integers. ``is_query`` selects the queries; candidates are all rows but those with the query's own
    key. Ties go to the smaller key; fewer candidates give fewer rows. Rows with a NULL key or vector, or a NULL
    component, take no part. Vectors of different dimension do not meet. Repeated rows are candidates each; a key that
    queries twice is answered once, for the smallest of its vectors. An empty table gives an empty table. Products must
    stay below 2**53.
    """
    clean = df.filter(F.col(key).isNotNull() & F.col(vector).isNotNull() & ~F.exists(vector, lambda x: x.isNull()))
    rows = store(
        _blocks(
            clean.select(
                F.col(key).cast("long").alias("id"),
                F.col(vector).cast("array<long>").alias("v"),
                F.coalesce(is_query, F.lit(False)).alias("q"),
            )
        ),
        "vectors",
    )
    # One row per dimension and length step: at most a few hundred for each dimension, as lengths are below 2**32.
    counts = rows.groupBy("dim", "bucket").agg(F.count("*").alias("n"), F.max("sq").alias("max_sq"))
    counts = counts.withColumn("n_blocks", F.ceil(F.col("n") / CANDIDATE_ROWS).cast("int"))
    n_queries = rows.filter("q").count()
    spread = F.pmod(F.xxhash64("id"), F.lit(max(1, -(-n_queries // QUERY_ROWS)))).cast("int")
    queries = rows.filter("q").groupBy("id").agg(F.min(F.struct("dim", "v", "sq")).alias("s")).select("id", "s.*")
    queries = queries.withColumn("group", spread)
    candidates = rows.join(F.broadcast(counts), ["dim", "bucket"]).withColumn(
        "block", F.pmod(F.xxhash64("row"), F.col("n_blocks")).cast("int")
    )
    candidates = candidates.select("dim", "bucket", "block", "id", "v", "sq")
    top = counts.groupBy("dim").agg(F.max("bucket").alias("bucket"))
    pilot = candidates.filter("block = 0").join(F.broadcast(top), ["dim", "bucket"], "left_semi")
    unbounded = F.lit(None).cast("double").alias("floor")
    asked = queries.join(F.broadcast(top), "dim").select("*", F.lit(0).alias("block"), unbounded)
    floors = _search(asked, pilot, k).groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("floor"))
    floors = floors.filter(F.col("n") >= k).select(F.col("query_id").alias("id"), F.col("floor").cast("double"))
    limits = F.broadcast(
        counts.groupBy("dim").agg(F.collect_list(F.struct("bucket", "n_blocks", "max_sq")).alias("buckets"))
    )
    reach = F.sqrt(F.col("sq")) * F.sqrt(F.col("b.max_sq")) * (1 + 1e-9)
    asked = (
        queries.join(floors, "id", "left")
        .join(limits, "dim")
        .select("id", "dim", "v", "sq", "group", "floor", F.explode("buckets").alias("b"))
        .filter(F.col("floor").isNull() | (F.col("floor") <= reach))
        .select("*", F.explode(F.sequence(F.lit(0), F.col("b.n_blocks") - 1)).alias("block"))
        .select("id", "dim", "v", "sq", "group", "floor", F.col("b.bucket").alias("bucket"), "block")
    )
    found = _search(asked, candidates, k)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def _search(queries: DataFrame, candidates: DataFrame, k: int) -> DataFrame:
    """The best ``k`` of each block for each query that asks it, at or above the query's floor.

    A task sees one block and one group of the queries that ask it; both are bounded.
    """
    at = ["dim", "bucket", "block", "group"]
    groups = queries.groupBy(at).agg(F.lit(True).alias("asked")).drop("asked")
    asked = queries.select(*(F.col(c).alias(c) for c in (*at, "id", "v", "floor")))
    held = candidates.join(groups, at[:3]).select(*(F.col(c).alias(c) for c in (*at, "id", "v")))
    left, right = asked.groupBy(*at), held.groupBy(*at)

    def run(queries: pa.Table, candidates: pa.Table) -> pa.Table:
        if not queries.num_rows or not candidates.num_rows:
            return pa.table({n: pa.array([], pa.int64()) for n in ("query_id", "vec_id", "score")})
        out = search_block(
            queries["id"].to_numpy(), _matrix(queries["v"]), queries["floor"].to_numpy(),
            candidates["id"].to_numpy(), _matrix(candidates["v"]), k,
        )
        return pa.table(dict(zip(("query_id", "vec_id", "score"), map(pa.array, out))))

    return left.cogroup(right).applyInArrow(run, "query_id long, vec_id long, score long")


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    lists = column.combine_chunks()
    lists = pa.concat_arrays(lists.chunks) if isinstance(lists, pa.ChunkedArray) else lists
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(lists), -1)


def search_block(
    query_id: np.ndarray, queries: np.ndarray, floors: np.ndarray, vec_id: np.ndarray, vectors: np.ndarray, k: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Answers of one block. Float arithmetic is exact here, as products stay below 2**53."""
    length = np.sqrt((vectors * vectors).sum(axis=1))
    order = np.argsort(-length, kind="stable")
    vec_id, vectors, length = vec_id[order], vectors[order], length[order]
    directions = vectors / np.maximum(length, 1e-300)[:, None]
    by_coordinate = np.argsort(directions, axis=0, kind="stable")
    found = []
    for qid, q, floor in zip(query_id, queries, floors):
        rows = _prune(q, floor, length, directions, by_coordinate)
        rows = rows[vec_id[rows] != qid]
        score = vectors[rows] @ q
        if floor == floor:
            keep = score >= floor
            rows, score = rows[keep], score[keep]
        if len(rows) > k:  # all that tie with the k-th stay until the ids decide
            least = np.partition(score, len(score) - k)[len(score) - k]
            rows, score = rows[score >= least], score[score >= least]
        best = np.lexsort((vec_id[rows], -score))[:k]
        found.append((np.full(len(best), qid), vec_id[rows[best]], score[best]))
    columns = zip(*found) if found else ([], [], [])
    return tuple(np.concatenate(c).astype(np.int64) if c else np.empty(0, np.int64) for c in columns)


def _prune(
    q: np.ndarray, floor: float, length: np.ndarray, directions: np.ndarray, by_coordinate: np.ndarray
) -> np.ndarray:
    """Rows that may reach ``floor``; ``length`` descends. Bounds are widened by rounding errors."""
    everything = np.arange(len(length))
    size = np.sqrt(q @ q)
    if not floor > 0 or size == 0 or not len(length):
        return everything
    if length[0] * size * (1 + 1e-9) < floor:
        return everything[:0]
    cosine = min(floor / (size * length[0]), 1.0) - 1e-9
    if cosine < COSINE_SWITCH:
        return everything[: np.searchsorted(-length, -floor / size * (1 - 1e-9), side="right")]
    u = q / size
    focus = np.argsort(-np.abs(u), kind="stable")[:COORDINATES]
    width = np.sqrt(np.maximum(1 - u[focus] ** 2, 0) * max(1 - cosine * cosine, 0)) + 1e-9
    low, high = u[focus] * cosine - width, u[focus] * cosine + width
    high = np.where(u[focus] >= cosine, 1.0, high)  # the query's own direction lies inside the cap
    low = np.where(-u[focus] >= cosine, -1.0, low)
    lists = by_coordinate[:, focus]
    spans = [
        (np.searchsorted(directions[lists[:, i], f], low[i]), np.searchsorted(directions[lists[:, i], f], high[i], "right"))
        for i, f in enumerate(focus)
    ]
    narrow = min(range(len(focus)), key=lambda i: spans[i][1] - spans[i][0])
    rows = lists[spans[narrow][0] : spans[narrow][1], narrow]
    inside = ((directions[rows][:, focus] >= low) & (directions[rows][:, focus] <= high)).all(axis=1)
    return np.sort(rows[inside])
