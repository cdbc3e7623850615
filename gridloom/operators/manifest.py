"""Manifest rows: ids, paths, measured heights, per-split caps and completeness checks."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions import text as tx
from gridloom.sources.manifest import MANIFEST

IMAGE_DIR = "orig_imgs"
TEXT_DIR = "ascii_txt"


def record_id(split: Column, idx: Column) -> Column:
    """``train-000020``: at least six digits, never cut."""
    return F.format_string("%s-%06d", split, idx)


def image_path(root: str, split: Column, uid: Column) -> Column:
    return F.concat(F.lit(root.rstrip("/") + "/"), split, F.lit(f"/{IMAGE_DIR}/"), uid, F.lit(".png"))


def text_path(root: str, split: Column, uid: Column) -> Column:
    return F.concat(F.lit(root.rstrip("/") + "/"), split, F.lit(f"/{TEXT_DIR}/"), uid, F.lit("-ascii-art.txt"))


def within_limits(limits: Mapping[str, int | None]) -> Column:
    """The record is one of the first ``limits[split]`` of its split by index; no entry or None keeps all."""
    keep = F.lit(True)
    for split, limit in limits.items():
        if limit is not None:
            keep = keep & (~F.col("split").eqNullSafe(split) | (F.col("idx") < limit))
    return keep


def cap_splits(df: DataFrame, limits: Mapping[str, int | None]) -> DataFrame:
    return df.filter(within_limits(limits))


def build_manifest(
    records: DataFrame, root: str, width: int, limits: Mapping[str, int | None] | None = None
) -> DataFrame:
    """``(split, idx, label, height)`` records to the seven manifest columns. Narrow."""
    capped = cap_splits(records, limits or {}).withColumn("id", record_id(F.col("split"), F.col("idx")))
    return capped.select(
        "id",
        "split",
        F.col("label").cast("int").alias("label"),
        image_path(root, F.col("split"), F.col("id")).alias("orig_img_path"),
        text_path(root, F.col("split"), F.col("id")).alias("ascii_txt_path"),
        F.lit(width).cast("int").alias("ascii_width"),
        F.col("height").cast("int").alias("ascii_height"),
    )


def attach_texts(manifest: DataFrame, texts: DataFrame, *columns: str) -> DataFrame:
    """Join each manifest record by path to ``columns`` of its text (default ``text``); NULL where it is missing.

    The joined columns are shuffled, so reduce a text to what is needed of it, such as its grid, before.
    """
    right = texts.select(tx.plain_path(F.col("path")).alias("_path"), *(columns or ("text",)))
    # Records without a path are spread by a number of their own instead of meeting in the one task of NULL.
    alone = F.concat(F.lit("no path "), F.monotonically_increasing_id().cast("string"))
    keyed = manifest.withColumn("_path", F.coalesce(tx.plain_path(F.col("ascii_txt_path")), alone))
    return keyed.join(right, "_path", "left").drop("_path")


def _unset_fields(manifest: DataFrame) -> list[Column]:
    required = [name for name in MANIFEST.fieldNames() if name in manifest.columns]
    return [F.when(F.col(name).isNull(), F.lit(f"{name} is missing")) for name in required]


def _report(df: DataFrame, problems: list[Column], strict: bool) -> DataFrame:
    found = F.filter(F.array(*problems), lambda problem: problem.isNotNull())
    report = df.select("id", F.explode(found).alias("problem"))
    if strict:
        first = report.take(1)
        if first:
            raise ValueError(f"incomplete manifest: {first[0]['id']}: {first[0]['problem']}")
    return report


def check_fields(manifest: DataFrame, strict: bool = False) -> DataFrame:
    """``(id, problem)``: required fields that are NULL. Narrow."""
    return _report(manifest, _unset_fields(manifest), strict)


def check_manifest(manifest: DataFrame, payload: DataFrame, key: str, payload_key: str, strict: bool = False) -> DataFrame:
    """``(id, problem)``: required fields that are NULL and records without payload.

    ``strict`` fails the job on the first finding instead of leaving a partial result behind.
    """
    # distinct() combines copies of one payload per task and shares its shuffle with the join.
    present = payload.select(F.col(payload_key).cast("string").alias("_key"), F.lit(True).alias("_found")).distinct()
    # Records without a key are spread by id instead of meeting in the one partition of NULL.
    keyed = manifest.withColumn("_key", F.coalesce(F.col(key).cast("string"), "id")).join(present, "_key", "left")
    absent = F.when(F.col(key).isNotNull() & F.col("_found").isNull(), F.lit("payload is missing"))
    return _report(keyed, [*_unset_fields(manifest), absent], strict)
