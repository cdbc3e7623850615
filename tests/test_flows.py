"""The end-to-end runs on a small IDX pair."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.operators.vocab import decode
from gridloom.plans import flows
from gridloom.sources.images import read_idx
from gridloom.sources.manifest import read_manifest
from tests.test_manifest import write_idx
from tests.test_vectors import brute_render


def test_build_load_encode(spark, tmp_path):
    rng = np.random.default_rng(4)
    pixels, labels = rng.integers(0, 256, (30, 6, 6), np.uint8), rng.integers(0, 10, 30, np.uint8)
    paths = write_idx(tmp_path, pixels, labels)
    images = read_idx(spark, *paths, split="train", records_per_partition=8).unionByName(
        read_idx(spark, *paths, split="test", records_per_partition=8)
    )
    out = str(tmp_path / "out")
    flows.build_dataset(images, out, 4, 3, limits={"test": 5})
    flows.build_dataset(images, out, 3, 2, limits={"test": 7})  # payloads accumulate, the manifest is replaced
    rows = read_manifest(spark, f"{out}/manifest").orderBy("id").collect()
    assert [r["split"] for r in rows] == ["test"] * 7 + ["train"] * 30
    assert {(r["ascii_width"], r["ascii_height"]) for r in rows} == {(3, 2)}
    assert spark.read.parquet(f"{out}/texts").count() == 35 + 37

    grids = flows.load_grids(spark, out, 5, 3)
    encoded, chars = flows.encode_splits(grids)
    got = {r["id"]: (r["label"], r["back"]) for r in encoded.select("id", "label", decode(F.col("ids"), chars).alias("back")).collect()}
    seen = {" "}
    for i in range(30):
        lines = brute_render(pixels[i], 6, 6, 3, 2, " .:-=+*#%@").split("\n")
        want = "".join(line.ljust(5) for line in lines + [""])
        seen |= set(want)
        assert got[f"train-{i:06d}"] == (labels[i], want)
    assert len(got) == 37 and chars == sorted(seen)

    flows.build_dataset(images, out, 4, 3, overwrite=True)
    assert spark.read.parquet(f"{out}/texts").count() == 60


def test_a_record_without_pixels_fails_the_build(spark, tmp_path):
    schema = "split string, idx bigint, label int, pixels array<int>, w int, h int"
    images = spark.createDataFrame([("train", 0, 1, [1, 2, 3, 4], 2, 2), ("train", 1, 1, None, 2, 2)], schema)
    with pytest.raises(ValueError, match="train-000001: ascii_height is missing"):
        flows.build_dataset(images, str(tmp_path / "out"), 2, 2)
    assert not (tmp_path / "out" / "manifest").exists()


def test_sample_sheets(spark):
    tokens = spark.range(23).selectExpr("id as idx", "cast(id % 3 as int) as tok_id", "1.0d as strength").repartition(4)
    sheet = flows.sample_sheets(tokens, [" ", "a", "b"], 3, 2, ["strength"])
    got = {(r["strip"], r["row"]): r["line"] for r in sheet.collect()}
    assert got == {(0, 0): " ab   ab   ab   ab  ", (0, 1): " ab   ab   ab   a   "}


def load(spark, out):
    return {r["id"]: (r["label"], r["grid"]) for r in flows.load_grids(spark, out, 4, 2).collect()}


@pytest.mark.parametrize("overwrite", [False, True])
def test_a_failed_build_leaves_the_good_one(spark, tmp_path, overwrite):
    schema = "split string, idx bigint, label int, pixels array<int>, w int, h int"
    out = str(tmp_path / "out")
    good = spark.createDataFrame([("train", i, i, [10 * i, 250, 0, 99], 2, 2) for i in range(3)], schema)
    flows.build_dataset(good, out, 2, 2)
    before = load(spark, out)
    bad = spark.createDataFrame([("train", 0, 7, [255] * 4, 2, 2), ("train", 1, 7, None, 2, 2)], schema)
    with pytest.raises(ValueError):
        flows.build_dataset(bad, out, 2, 2, overwrite=overwrite)
    assert load(spark, out) == before and len(before) == 3
    flows.build_dataset(good.limit(1), out, 2, 2, overwrite=True)
    assert len(load(spark, out)) == 1 and spark.read.parquet(f"{out}/texts").count() == 1


def test_load_dataset_from_files(spark, tmp_path):
    texts = {"a": "xy\nz", "b": "\u2013q", "c": "r\u00e9"}
    lines = []
    for i, (name, text) in enumerate(texts.items()):
        path = tmp_path / "texts" / f"{name}.txt"
        path.parent.mkdir(exist_ok=True)
        path.write_bytes(text.encode())
        label = f'"{i}"' if i else "0"
        split = "test" if name == "c" else "train"
        lines.append(
            f'{{"id": "{name}", "split": "{split}", "label": {label}, "orig_img_path": "", "ascii_txt_path": "{path}", '
            f'"ascii_width": 3, "ascii_height": "2"}}'
        )
    lines += ["", '{"id": "d", "split": "test", "label": null, "ascii_txt_path": null}', '{"id": "e", "split": "test"}']
    (tmp_path / "manifest.jsonl").write_text("\n".join(lines))
    encoded, chars = flows.load_dataset(spark, str(tmp_path / "manifest.jsonl"), str(tmp_path / "texts"), 2, 2)
    got = {r["id"]: (r["label"], r["grid"]) for r in encoded.collect()}
    assert got == {"a": (0, "xyz "), "b": (1, "-q  "), "c": (2, "r   "), "d": (None, None), "e": (None, None)}
    assert chars == [" ", "-", "q", "x", "y", "z"]
    (tmp_path / "bad.jsonl").write_text('{"id": "a", "label": "x7"}')
    with pytest.raises(Exception, match="label is no integer"):
        read_manifest(spark, str(tmp_path / "bad.jsonl")).collect()
