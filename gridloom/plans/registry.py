"""Query registry and the output conventions shared by both engines."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class Query(NamedTuple):
    run: Callable[[SparkSession, str], DataFrame]
    sql: str


REGISTRY: dict[str, Query] = {}


def query(sql: str):
    """Register a plan under its function name, with the SQL it must agree with."""

    def add(run: Callable[[SparkSession, str], DataFrame]):
        REGISTRY[run.__name__] = Query(run, sql)
        return run

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def csv(values: Column) -> Column:
    return F.array_join(values.cast("array<string>"), ",")


def rounded(value: Column) -> Column:
    return F.round(value, 6)


def micro_csv(values: Column) -> Column:
    """Doubles as whole millionths, comma separated: the same text in both engines."""
    return csv(F.transform(values, lambda x: F.floor(x * 1e6 + 0.5)))


def sql_rounded(expr: str) -> str:
    return f"(round({expr}, 6) + 0.0)"


def sql_micro_csv(expr: str) -> str:
    return f"array_to_string(list_transform({expr}, lambda x: floor(x * 1e6 + 0.5)::bigint), ',')"


def sql_uniform(*keys: str) -> str:
    """The uniform of a key, from the first eight hex digits of its md5."""
    return sql_word(f"md5(concat_ws(':', {', '.join(keys)}))", "1")


def sql_word(digest: str, start: str) -> str:
    return f"((('0x' || substr({digest}, {start}, 8))::bigint::double + 0.5) / 4294967296.0)"
