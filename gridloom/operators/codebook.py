"""Vectors against a codebook: lookup, scores, decoding, expected vectors.

A codebook is a small table. Its size in bytes is checked, it is brought to the driver and shipped with
the expressions, so no operator here joins or shuffles.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from gridloom.functions import random as rnd
from gridloom.functions import vectors as vec
from gridloom.functions.arrow import checked_ids, list_rows, lists, matrix, null_mask
from gridloom.storage import store

_VECTOR = ArrayType(DoubleType())
RECORDS_PER_SLICE = 256
MAX_CODES, MAX_CODEBOOK_BYTES = 1 << 16, 32 << 20


def load_codebook(df: DataFrame) -> np.ndarray:
    """The ``(tok_id, vec)`` table as a V x D matrix; ids must be 0..V-1."""
    names, codes = load_named_codes(df)
    if names != list(range(len(names))):
        raise ValueError("a codebook numbers its vectors from 0")
    return codes


def load_named_codes(df: DataFrame) -> tuple[list, np.ndarray]:
    """The ``(tok_id, vec)`` table as its names in order and a matrix; row i belongs to name i, gaps are no matter.

    It is written first, so its plan runs once: for the check of its size, and for the rows. A larger one is for
    ``wide_codebook``.
    """
    stored = store(df.select("tok_id", "vec"), "codebook")
    size = stored.agg(F.count("*"), F.sum(F.coalesce(F.size("vec"), F.lit(0)))).first()
    if 8 * (size[1] or 0) > MAX_CODEBOOK_BYTES or size[0] > MAX_CODES:
        raise ValueError(f"a collected codebook has at most {MAX_CODES} vectors and {MAX_CODEBOOK_BYTES} bytes")
    rows = stored.collect()
    names = [r["tok_id"] for r in rows]
    if None in names or len(set(names)) < len(names) or len({len(r["vec"]) for r in rows}) > 1:
        raise ValueError("a codebook has one vector per name, all of one length")
    rows.sort(key=lambda r: r["tok_id"])
    return [r["tok_id"] for r in rows], np.array([r["vec"] for r in rows], dtype=np.float64)


def code_of(name: Column, names: Sequence[int]) -> Column:
    """Row of the codebook that belongs to a name; NULL if there is none. ``names`` ascend."""
    known = np.array(names, np.int64)

    @F.arrow_udf("int")
    def find(wanted: pa.Array) -> pa.Array:
        values = wanted.fill_null(0).to_numpy(zero_copy_only=False)
        at = np.searchsorted(known, values)
        found = at < len(known)
        found[found] = known[at[found]] == values[found]
        return pa.array(at.astype(np.int32), mask=~found | null_mask(wanted))

    return find(name.cast("long"))


def name_of(code: Column, names: Sequence[int]) -> Column:
    """Name of a row of the codebook; NULL for NULL."""
    known = np.array(names, np.int64)

    @F.arrow_udf("long")
    def take(codes: pa.Array) -> pa.Array:
        missing = null_mask(codes)
        return pa.array(known[codes.fill_null(0).to_numpy(zero_copy_only=False)] if len(known) else np.zeros(len(codes), np.int64), mask=missing)

    return take(code.cast("int"))


def scores(vector: Column, codebook: np.ndarray) -> Column:
    """Dot product of each vector with every code, as ``array<double>`` in token order."""
    codes = np.ascontiguousarray(codebook.T)

    @F.arrow_udf(_VECTOR)
    def dot(vectors: pa.Array) -> pa.Array:
        return list_rows(matrix(vectors, codes.shape[0]) @ codes, null_mask(vectors))

    return dot(vec.doubles(vector))


def expected_vector(logits: Column, codebook: np.ndarray) -> Column:
    """``softmax(logits) @ codebook``: the mean code under the predicted distribution."""
    codes = np.ascontiguousarray(codebook)

    @F.arrow_udf(_VECTOR)
    def mix(logits: pa.Array) -> pa.Array:
        rows = matrix(logits, codes.shape[0])
        weights = np.exp(rows - rows.max(axis=1, keepdims=True))
        return list_rows(weights / weights.sum(axis=1, keepdims=True) @ codes, null_mask(logits))

    return mix(logits)


def place_features(length: int, dim: int) -> np.ndarray:
    """Sine / cosine features of the places 0..length-1 of a sequence."""
    angles = np.outer(np.arange(length), vec.place_rates(dim))
    return np.stack([np.sin(angles), np.cos(angles)], axis=2).reshape(length, dim)


def embed_tokens(df: DataFrame, ids_col: str, codebook: np.ndarray, out: str, places: bool = False) -> DataFrame:
    """Add the vectors of ``ids_col`` as ``array<array<double>>``, with positional features if asked.

    A record grows from one id to a whole vector per position, so an incoming batch is answered in
    slices of a few records. Narrow; select the columns to keep before. An id outside the codebook fails.
    """

    def listed(vectors: np.ndarray, offsets: np.ndarray, missing: np.ndarray) -> pa.Array:
        return lists(list_rows(vectors), offsets, missing)

    return reduce_embedded(df, ids_col, codebook, StructField(out, ArrayType(_VECTOR)), listed, places)


def reduce_embedded(
    df: DataFrame,
    ids_col: str,
    codebook: np.ndarray,
    out: StructField,
    reduce: Callable[[np.ndarray, np.ndarray, np.ndarray], pa.Array],
    places: bool = False,
) -> DataFrame:
    """Add what ``reduce`` makes of the vectors of ``ids_col``, so that a number per record never becomes rows.

    ``reduce`` gets the vectors of a slice of records, the offsets of the records, and which are NULL.
    """
    codes = np.ascontiguousarray(codebook)
    dim = codes.shape[1]
    if places:
        vec.place_rates(dim)

    def embed(ids: pa.Array) -> pa.Array:
        missing = null_mask(ids)
        sizes = np.where(missing, 0, pc.list_value_length(ids).fill_null(0).to_numpy(zero_copy_only=False))
        ends = np.cumsum(sizes)
        vectors = codes[checked_ids(ids, len(codes))]
        if places:
            at = np.arange(len(vectors)) - np.repeat(ends - sizes, sizes)
            vectors = vectors + place_features(int(sizes.max(initial=0)), dim)[at]
        return reduce(vectors, np.concatenate([[0], ends]), missing)

    def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, RECORDS_PER_SLICE):
                part = batch.slice(start, RECORDS_PER_SLICE)
                yield part.append_column(out.name, embed(part.column(ids_col)))

    return df.mapInArrow(slices, StructType([*df.schema.fields, out]))


def nearest_code(logits: Column) -> Column:
    """Token with the largest score; the lowest id wins a tie."""
    return vec.argmax(logits)


def sample_code(logits: Column, temperature: Column | float, n_codes: int, seed: int, *keys) -> Column:
    """One draw per key from ``softmax(logits / temperature)``; a temperature of 0 or less takes the best."""
    heat = temperature if isinstance(temperature, Column) else F.lit(float(temperature))
    draws = rnd.uniforms(n_codes, seed, "gumbel", *keys)
    return F.when(heat <= 0, vec.argmax(logits)).otherwise(
        vec.let(vec.gumbel_scores(logits, draws, heat), vec.argmax)
    )


def guidance_sweep(
    df: DataFrame, cond_col: str, uncond_col: str, settings: list[tuple[float, float]], out: str = "guided"
) -> DataFrame:
    """Every row under every ``(strength, temperature)`` setting, with its guided logits.

    ``setting`` is the position of the setting: a key under which no two settings share a draw.
    """
    grid = F.array(
        *[
            F.struct(F.lit(i).alias("setting"), F.lit(float(s)).alias("strength"), F.lit(float(t)).alias("temperature"))
            for i, (s, t) in enumerate(settings)
        ]
    )
    swept = df.withColumn("_setting", F.explode(grid)).select("*", "_setting.*").drop("_setting")
    return swept.withColumn(out, vec.guide(F.col(uncond_col), F.col(cond_col), F.col("strength")))
