"""Manifests, corpora, IDX images, dense indices, batches."""

import json
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.operators import batching, manifest
from gridloom.operators.indexing import dense_index, with_dense_index
from gridloom.sources.artifacts import load_artifacts, save_artifacts
from gridloom.sources.images import read_idx
from gridloom.sources.manifest import MANIFEST, read_manifest, write_manifest
from gridloom.sources.texts import read_corpus, read_texts, write_corpus
from gridloom.storage import broadcast_if_small

KEYS = ["id", "split", "label", "orig_img_path", "ascii_txt_path", "ascii_width", "ascii_height"]


def records(spark, rows):
    return spark.createDataFrame(rows, "split string, idx bigint, label int, height int")


def test_manifest_rows(spark):
    rows = [("train", 20, 7, 3), ("test", 999_999, 1, 0), ("train", 1_000_000, 2, 5)]
    made = manifest.build_manifest(records(spark, rows), "/data/", 80)
    assert made.columns == KEYS
    got = {r["id"]: r for r in made.collect()}
    assert set(got) == {"train-000020", "test-999999", "train-1000000"}
    row = got["train-000020"]
    assert row["orig_img_path"] == "/data/train/orig_imgs/train-000020.png"
    assert row["ascii_txt_path"] == "/data/train/ascii_txt/train-000020-ascii-art.txt"
    assert (row["label"], row["ascii_width"], row["ascii_height"]) == (7, 80, 3)


@pytest.mark.parametrize(
    "limits, kept",
    [
        ({}, (4, 4)),
        ({"train": None}, (4, 4)),
        ({"train": 2, "test": 9}, (2, 4)),
        ({"train": 0, "test": -1}, (0, 0)),
    ],
)
def test_caps(spark, limits, kept):
    rows = records(spark, [(s, i, 0, 1) for s in ("train", "test") for i in range(4)])
    left = manifest.cap_splits(rows, limits).groupBy("split").agg(F.count("*"), F.max("idx")).collect()
    got = {r[0]: (r[1], r[2]) for r in left}
    assert got == {s: (n, n - 1) for s, n in zip(("train", "test"), kept) if n}


def test_manifest_roundtrip_and_line_format(spark, tmp_path):
    path = str(tmp_path / "m")
    made = manifest.build_manifest(records(spark, [("train", 0, 1, 2), ("test", 0, None, 0)]), "/d", 80)
    write_manifest(made, path)
    write_manifest(made, path)  # always replaced
    assert sorted(map(tuple, read_manifest(spark, path).collect()), key=str) == sorted(map(tuple, made.collect()), key=str)
    lines = [json.loads(line) for f in (tmp_path / "m").rglob("*.json") for line in f.read_text().splitlines()]
    assert len(lines) == 2 and all(list(line) == KEYS for line in lines)


def test_manifest_reader_skips_blanks_and_fails_on_malformed_lines(spark, tmp_path):
    good = '{"id":"a","split":"train","label":3}'
    (tmp_path / "ok.jsonl").write_text(f"\n   \n{good}\n\n")
    (tmp_path / "bad.jsonl").write_text(f"{good}\n{{oops\n")
    rows = read_manifest(spark, str(tmp_path / "ok.jsonl")).collect()
    assert [(r["id"], r["label"], r["ascii_txt_path"]) for r in rows] == [("a", 3, None)]
    with pytest.raises(Exception, match="MALFORMED_RECORD"):
        read_manifest(spark, str(tmp_path / "bad.jsonl")).collect()


def test_check_manifest(spark):
    rows = [("a", 1, "/x/a"), ("b", None, "/x/b"), ("c", 3, None), ("d", 4, "/x/d")]
    listed = spark.createDataFrame(rows, "id string, label int, ascii_txt_path string")
    files = spark.createDataFrame([("/x/a",), ("/x/b",), ("/x/b",), ("c",)], "path string")
    report = manifest.check_manifest(listed, files, "ascii_txt_path", "path")
    assert {tuple(r) for r in report.collect()} == {
        ("b", "label is missing"), ("c", "ascii_txt_path is missing"), ("d", "payload is missing")
    }
    with pytest.raises(ValueError, match="incomplete manifest"):
        manifest.check_manifest(listed, files, "ascii_txt_path", "path", strict=True)
    manifest.check_manifest(listed.filter("id = 'a'"), files, "ascii_txt_path", "path", strict=True)


def test_text_files_join_their_manifest(spark, tmp_path):
    for name, blob in {"a": b"x\r\ny\rz", "b": b"q\xffr", "c": "é".encode()}.items():
        (tmp_path / f"{name}.txt").write_bytes(blob)
    texts = read_texts(spark, str(tmp_path))
    listed = spark.createDataFrame([(n, f"{tmp_path}/{n}.txt") for n in "abcd"], "id string, ascii_txt_path string")
    got = {r["id"]: r["text"] for r in manifest.attach_texts(listed, texts).collect()}
    assert got == {"a": "x\ny\nz", "b": "qr", "c": "é", "d": None}
    with pytest.raises(Exception, match="INVALID_UTF8"):
        read_texts(spark, str(tmp_path), strict=True).collect()


def test_corpus_appends_or_replaces(spark, tmp_path):
    path = str(tmp_path / "corpus")
    rows = spark.createDataFrame([("a", "train", "x"), ("b", "test", "y")], "id string, split string, text string")
    write_corpus(rows, path)
    write_corpus(rows, path)
    assert read_corpus(spark, path, rows.schema).count() == 4
    write_corpus(rows, path, overwrite=True)
    assert sorted(r["text"] for r in read_corpus(spark, path, rows.schema).collect()) == ["x", "y"]


def write_idx(folder, pixels, labels):
    n, h, w = pixels.shape
    (folder / "images").write_bytes(struct.pack(">4I", 0x803, n, h, w) + pixels.tobytes())
    (folder / "labels").write_bytes(struct.pack(">2I", 0x801, len(labels)) + labels.tobytes())
    return str(folder / "images"), str(folder / "labels")


@pytest.mark.parametrize("per_partition", [7, 1000])
def test_idx_pair(spark, tmp_path, per_partition):
    rng = np.random.default_rng(1)
    pixels, labels = rng.integers(0, 256, (50, 3, 5), np.uint8), rng.integers(0, 10, 50, np.uint8)
    paths = write_idx(tmp_path, pixels, labels)
    frame = read_idx(spark, *paths, split="test", records_per_partition=per_partition)
    assert frame.rdd.getNumPartitions() == -(-50 // per_partition)
    rows = frame.orderBy("idx").collect()
    assert [r["idx"] for r in rows] == list(range(50))
    assert [r["label"] for r in rows] == labels.tolist()
    assert [r["pixels"] for r in rows] == pixels.reshape(50, -1).tolist()
    assert {(r["split"], r["w"], r["h"]) for r in rows} == {("test", 5, 3)}
    # pixels survive the Parquet image sink
    frame.write.parquet(str(tmp_path / "stored"))
    assert spark.read.parquet(str(tmp_path / "stored")).count() == 50


def test_idx_errors(spark, tmp_path):
    pixels, labels = np.zeros((4, 2, 2), np.uint8), np.zeros(3, np.uint8)
    with pytest.raises(Exception, match="4 images but 3 labels"):
        read_idx(spark, *write_idx(tmp_path, pixels, labels), split="train").collect()
    images, marks = write_idx(tmp_path, np.zeros((20, 2, 2), np.uint8), np.zeros(20, np.uint8))
    with pytest.raises(Exception, match="magic"):
        read_idx(spark, marks, images, split="train").collect()


def test_dense_index_with_a_hot_group(spark):
    n = 20_000
    rows = spark.range(n).select(
        (F.col("id") * 7919 % n).alias("key"), F.when(F.col("id") % 50 == 0, F.col("id") % 7).otherwise(99).alias("g")
    )
    got = dense_index(rows.repartition(16), ["key"], ["g"]).toPandas().sort_values(["g", "key"])
    assert len(got) == n
    assert (got.groupby("g").cumcount().to_numpy() == got["idx"].to_numpy()).all()


def test_dense_index_of_equal_rows(spark):
    rows = spark.range(5000).select(F.lit("a").alias("g"), (F.col("id") % 2).alias("key")).repartition(4)
    got = dense_index(rows, ["key"], ["g"], unique=False).orderBy("idx").collect()
    assert [r["idx"] for r in got] == list(range(5000))
    assert [r["key"] for r in got] == [0] * 2500 + [1] * 2500


def test_dense_index_spreads_one_group_over_tasks(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        placed = spark.range(10_000).withColumn("g", F.lit(1)).repartitionByRange("g", "id")
        sizes = placed.groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(sizes) == 8 and max(r["count"] for r in sizes) < 3000


def test_dense_index_is_the_same_for_any_partitioning(spark):
    rows = spark.range(500).select(F.md5(F.col("id").cast("string")).alias("key"))
    one, many = (dense_index(rows.repartition(p), ["key"]).orderBy("key").collect() for p in (1, 8))
    assert one == many and [r["idx"] for r in one] == list(range(500))
    assert dense_index(rows.limit(0), ["key"]).collect() == []


def test_batches(spark):
    rows = spark.range(10).select(F.col("id").alias("key"), (F.col("id") * 2).alias("v"), F.lit("s").alias("split"))
    indexed = with_dense_index(rows.repartition(5), "key", ["split"])
    made = batching.assemble(indexed, 4, ["v"], within=["split"]).orderBy("batch_id").collect()
    assert [(r["batch_id"], r["n"], r["v"]) for r in made] == [(0, 4, [0, 2, 4, 6]), (1, 4, [8, 10, 12, 14]), (2, 2, [16, 18])]
    head = batching.assemble(batching.first_batches(indexed, 2, 4), 4, ["v"])
    assert sorted(r["batch_id"] for r in head.collect()) == [0, 1]
    assert batching.assemble(indexed.limit(0), 4, ["v"]).collect() == []
    assert [r["v"] for r in batching.record_at(indexed, [3]).collect()] == [6]


def test_rows_of(spark):
    frame = spark.createDataFrame([(list(range(6)),)], "x array<int>")
    assert frame.select(batching.rows_of(F.col("x"), 3)).first()[0] == [[0, 1, 2], [3, 4, 5]]


def test_shuffle_is_a_repeatable_permutation(spark):
    rows = spark.range(200).withColumnRenamed("id", "key")
    pos = lambda seed, p: [r["pos"] for r in batching.shuffled_index(rows.repartition(p), "key", seed).orderBy("key").collect()]
    assert pos(1, 2) == pos(1, 7) != pos(2, 2)
    assert sorted(pos(1, 2)) == list(range(200)) != pos(1, 2)


def test_artifacts(spark, tmp_path):
    config = {"W": 20, "H": 10, "L": 200, "emb_dim": 16, "steps": 400, "betas": [1e-4, 2e-2]}
    vocab = spark.createDataFrame([(0, " "), (1, "a")], "tok_id int, ch string")
    save_artifacts(vocab, config, str(tmp_path))
    save_artifacts(vocab, config, str(tmp_path))
    loaded, back = load_artifacts(spark, str(tmp_path))
    assert back == config and sorted(map(tuple, loaded.collect())) == [(0, " "), (1, "a")]


def test_broadcast_is_checked(spark):
    small, large = broadcast_if_small(spark.range(10), 10), broadcast_if_small(spark.range(11), 10)
    hinted = [d._jdf.queryExecution().logical().toString() for d in (small, large)]
    assert "Hint broadcast" in hinted[0] and "Hint" not in hinted[1]


def test_manifest_schema_order():
    assert MANIFEST.fieldNames() == KEYS
