"""Dense numbers with NULL and repeated groups and keys; scratch tables."""

import os

import pytest
from pyspark.sql import functions as F

from gridloom import storage
from gridloom.operators import batching, manifest, render, schedule
from gridloom.operators.indexing import dense_index, with_dense_index

ROWS = [(5, "a"), (3, "a"), (None, "a"), (4, None), (1, None), (2, "b")]


def table(spark, rows=ROWS):
    return spark.createDataFrame(rows, "key long, grp string").repartition(3)


def numbered(rows):
    groups = {}
    for key, grp in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):  # NULL sorts first
        groups.setdefault(grp, []).append((key, grp))
    return sorted(((*row, i) for g in groups.values() for i, row in enumerate(g)), key=str)


def test_null_groups_and_keys_are_numbered(spark):
    found = dense_index(table(spark), ["key"], ["grp"]).collect()
    assert sorted(map(tuple, found), key=str) == numbered(ROWS)
    joined = with_dense_index(table(spark).withColumn("payload", F.lit("x")), "key", ["grp"])
    assert sorted(((r.key, r.grp, r.idx) for r in joined.collect()), key=str) == numbered(ROWS)


@pytest.mark.parametrize("again", [(5, "a"), (5, "b"), (None, "b")])
def test_a_repeated_key_fails(spark, again):
    with pytest.raises(Exception, match="the key is not unique"):
        with_dense_index(table(spark, [*ROWS, again]), "key", ["grp"]).collect()


def test_copies_are_numbered_apart(spark):
    rows = [(1, "a")] * 4 + [(None, None)] * 3
    found = dense_index(table(spark, rows), ["key"], ["grp"], unique=False).collect()
    assert sorted(r.idx for r in found) == [0, 0, 1, 1, 2, 2, 3]


@pytest.mark.parametrize("kind", ["at", "first", "limits"])
def test_keep_drops_index_rows_before_the_join(spark, kind):
    keep = {
        "at": lambda: batching.at([0, 2]),
        "first": lambda: batching.in_first(1, 2),
        "limits": lambda: manifest.within_limits({"split": 1}),
    }[kind]()
    rows = spark.range(9).selectExpr("id as key", "'split' as split", "repeat('x', 10) as payload")
    every = with_dense_index(rows, "key", ["split"])
    kept = with_dense_index(rows, "key", ["split"], keep=keep)
    assert sorted(map(tuple, kept.collect())) == sorted(map(tuple, every.filter(keep).collect()))


def test_the_payload_is_not_exchanged_for_few_rows(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = spark.range(100).selectExpr("id as key", "repeat('x', 10) as payload")
        plan = with_dense_index(rows, "key", keep=batching.at([3]))._jdf.queryExecution().executedPlan().toString()
        steps = schedule.noise_schedule(spark)
        joined = spark.range(5).selectExpr("cast(id as int) as t").join(schedule.posterior(steps).select("t", "c_x"), "t")
        noise = joined._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    assert "BroadcastHashJoin" in noise and "SortMergeJoin" not in noise


def test_rows_of_an_empty_array_and_a_sheet_without_height(spark):
    rows = spark.createDataFrame([([],), ([1, 2, 3],), (None,)], "a array<int>")
    assert [r[0] for r in rows.select(batching.rows_of(F.col("a"), 2)).collect()] == [[], [[1, 2], [3]], None]
    items = spark.createDataFrame([("s", 0, "")], "s string, item long, grid string")
    assert render.contact_sheet(items, ["s"], "item", "grid", 3, 0).count() == 0


def test_clean_scratch(spark):
    place = storage.scratch_path(spark, "kept").removeprefix("file:")
    assert storage.store(spark.range(3), "gone").count() == 3
    spark.range(2).write.parquet(place)
    assert os.path.exists(place)
    storage.clean_scratch(spark)
    assert not os.path.exists(place) and storage.list_names(spark, place) == []


def test_height_follows_the_shape(spark):
    assert [render.height_for(8, 8, 10), render.height_for(8, 4, 10), render.height_for(100, 1, 3)] == [5, 3, 1]
    image = spark.createDataFrame([([0] * 64, 8, 8), ([255] * 32, 8, 4)], "p array<int>, w int, h int")
    art = image.select(render.render_grid(F.col("p"), F.col("w"), F.col("h"), 6).alias("a")).collect()
    assert [r.a.split("\n") for r in art] == [[" " * 6] * 3, ["@" * 6] * 2]
