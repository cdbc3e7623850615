"""Vocabulary and run configuration as small Parquet tables."""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import types as T

from gridloom.storage import list_names, make_mark, remove

CONFIG = T.StructType(
    [
        T.StructField("W", T.IntegerType()),
        T.StructField("H", T.IntegerType()),
        T.StructField("L", T.IntegerType()),
        T.StructField("emb_dim", T.IntegerType()),
        T.StructField("steps", T.IntegerType()),
        T.StructField("betas", T.ArrayType(T.DoubleType())),
    ]
)
VOCAB = T.StructType([T.StructField("tok_id", T.IntegerType()), T.StructField("ch", T.StringType())])


_DATA, _DONE = "versions", "committed"


def save_artifacts(vocab: DataFrame, config: dict, path: str, keep: int = 2) -> str:
    """Write the vocabulary table and the one-row configuration table under ``path`` in one commit.

    Both go into a folder of a version of their own; the version counts from the moment its mark is made, which is the
    last step. A save that fails on the way, or two at a time, leave whole pairs only. The newest ``keep`` versions stay.
    """
    spark = vocab.sparkSession
    version = f"{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"
    vocab.select("tok_id", "ch").repartition(1).write.parquet(f"{path}/{_DATA}/{version}/vocab")
    row = Row(**{name: config[name] for name in CONFIG.fieldNames()})
    spark.createDataFrame([row], CONFIG).coalesce(1).write.parquet(f"{path}/{_DATA}/{version}/config")
    make_mark(spark, f"{path}/{_DONE}/{version}")
    done = committed_versions(spark, path)
    for old in done[:-keep] if keep else []:
        remove(spark, f"{path}/{_DONE}/{old}")  # the mark first, so no reader finds half a version
        remove(spark, f"{path}/{_DATA}/{old}")
    return version


def committed_versions(spark: SparkSession, path: str) -> list[str]:
    """Versions that are complete, the oldest first."""
    return sorted(list_names(spark, f"{path}/{_DONE}"))


def load_artifacts(spark: SparkSession, path: str, version: str | None = None) -> tuple[DataFrame, dict]:
    """Vocabulary and configuration of one version; of the newest complete one if none is named."""
    done = committed_versions(spark, path)
    if not done or version is not None and version not in done:
        raise ValueError(f"no complete {'artifacts' if version is None else version} under {path}")
    chosen = f"{path}/{_DATA}/{version or done[-1]}"
    vocab = spark.read.schema(VOCAB).parquet(f"{chosen}/vocab")
    config = spark.read.schema(CONFIG).parquet(f"{chosen}/config").first()
    return vocab, config.asDict()
