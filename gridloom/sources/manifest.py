"""JSON-lines manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.storage import list_names

MANIFEST = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("split", T.StringType()),
        T.StructField("label", T.IntegerType()),
        T.StructField("orig_img_path", T.StringType()),
        T.StructField("ascii_txt_path", T.StringType()),
        T.StructField("ascii_width", T.IntegerType()),
        T.StructField("ascii_height", T.IntegerType()),
    ]
)

_AS_TEXT = T.StructType([T.StructField(name, T.StringType()) for name in MANIFEST.fieldNames()])

# ``split`` is a directory as well as a field; the directory needs a name of its own,
# or the writer would take the field out of the lines.
_SPLIT_DIR, _BUILD_DIR = "split_dir", "build_dir"


def read_manifest(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Read manifest lines. Blank lines are skipped, a malformed line or number fails the query.

    Numbers are read as text and cast, as a label may be quoted.
    """
    lines = spark.read.schema(_AS_TEXT).option("mode", "FAILFAST").json(path)
    return lines.select(*(_whole(f.name) if f.dataType == T.IntegerType() else f.name for f in MANIFEST.fields))


def _whole(name: str) -> Column:
    text = F.trim(name)
    bad = F.raise_error(F.concat(F.lit(f"{name} is no integer: "), text)).cast("int")
    return F.when(text.isNull() | text.rlike(r"^[+-]?\d+$"), text.cast("int")).otherwise(bad).alias(name)


def write_manifest(df: DataFrame, path: str, build: str | None = None) -> None:
    """Replace the manifest under ``path``: one directory per split, seven keys per line in fixed order.

    ``build`` names what the lines belong to; it is part of the path, hence replaced together with them.
    """
    rows = df.select(*MANIFEST.fieldNames(), F.col("split").alias(_SPLIT_DIR))
    rows = rows if build is None else rows.withColumn(_BUILD_DIR, F.lit(build))
    folders = [_SPLIT_DIR] if build is None else [_BUILD_DIR, _SPLIT_DIR]
    rows.write.mode("overwrite").partitionBy(*folders).json(path, ignoreNullFields=False)


def manifest_build(spark: SparkSession, path: str) -> str:
    """The build that the manifest was written with."""
    prefix = f"{_BUILD_DIR}="
    builds = [name.removeprefix(prefix) for name in list_names(spark, path) if name.startswith(prefix)]
    if len(builds) != 1:
        raise ValueError(f"no manifest of one build under {path}")
    return builds[0]
