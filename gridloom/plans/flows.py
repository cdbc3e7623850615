"""The three runs a user makes end to end: build a dataset, load and encode it, show samples."""

from __future__ import annotations

import time
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions import text as tx
from gridloom.operators import batching, manifest, render, vocab
from gridloom.operators.normalize import normalize_grid
from gridloom.sources.manifest import manifest_build, read_manifest, write_manifest
from gridloom.sources.texts import read_corpus, read_texts, write_corpus
from gridloom.storage import list_names, remove, store

# Each build writes payloads of its own; the manifest is replaced last and carries the build in its path, so
# readers follow the build that the manifest belongs to, whatever a failed one has left.
IMAGES = "id string, idx bigint, label int, pixels array<int>, w int, h int, build string, split string"
TEXTS = "id string, idx bigint, label int, path string, text string, build string, split string"
_LAYOUT = ("build", "split")


def build_dataset(
    images: DataFrame,
    out: str,
    width: int,
    height: int | None = None,
    ramp: str = render.DEFAULT_RAMP,
    limits: Mapping[str, int | None] | None = None,
    overwrite: bool = False,
) -> None:
    """Labelled images ``(split, idx, label, pixels, w, h)`` to pixels, texts and a manifest under ``out``.

    Every table is made from the one written before it, so nothing is computed twice and nothing
    is shuffled. A record without text or with an unset field fails the build, and the one before
    stays in force. ``overwrite`` drops all other builds once this one is in force. Without
    ``height``, each image gets the rows that keep its shape.
    """
    spark = images.sparkSession
    build = str(time.time_ns())
    chosen = manifest.cap_splits(images, limits or {}).withColumn("id", manifest.record_id(F.col("split"), F.col("idx")))
    pictures = chosen.select("id", "idx", "label", "pixels", "w", "h", F.lit(build).alias("build"), "split")
    write_corpus(pictures, f"{out}/images", by=_LAYOUT)

    stored = read_corpus(spark, f"{out}/images", IMAGES).filter(F.col("build") == build)
    art = render.render_grid(F.col("pixels"), F.col("w"), F.col("h"), width, height, ramp)
    path = manifest.text_path(out, F.col("split"), F.col("id"))
    rendered = stored.select("id", "idx", "label", path.alias("path"), art.alias("text"), "build", "split")
    write_corpus(rendered, f"{out}/texts", by=_LAYOUT)

    texts = read_corpus(spark, f"{out}/texts", TEXTS).filter(F.col("build") == build)
    sized = texts.select("split", "idx", "label", tx.text_height(F.col("text")).alias("height"))
    rows = store(manifest.build_manifest(sized, out, width), "manifest")  # small, and checked before it counts
    manifest.check_fields(rows, strict=True)
    write_manifest(rows, f"{out}/manifest", build)
    if overwrite:
        drop_builds(spark, out, build)


def drop_builds(spark: SparkSession, out: str, keep: str) -> None:
    """Remove the payloads of every other build, complete or not."""
    for folder in ("images", "texts"):
        for name in list_names(spark, f"{out}/{folder}"):
            if name.startswith("build=") and name != f"build={keep}":
                remove(spark, f"{out}/{folder}/{name}")


def load_grids(spark: SparkSession, out: str, width: int, height: int) -> DataFrame:
    """``(id, split, label, grid)`` of a built dataset, written once.

    Texts become grids before they meet the manifest, so the join moves W*H bytes per record.
    """
    build = manifest_build(spark, f"{out}/manifest")
    texts = read_corpus(spark, f"{out}/texts", TEXTS).filter(F.col("build") == build)
    return _gridded(read_manifest(spark, f"{out}/manifest"), texts, width, height)


def load_dataset(
    spark: SparkSession, manifest_path: str | list[str], texts: DataFrame | str | list[str], width: int, height: int
) -> tuple[DataFrame, list[str]]:
    """An existing dataset in one call: manifest lines and the text files they name, to encoded splits.

    ``texts`` are the folders of the files, or a table ``(path, text)`` of them. Gives ``(id, split,
    label, grid, ids)`` and the vocabulary of the train split.
    """
    found = texts if isinstance(texts, DataFrame) else read_texts(spark, texts)
    return encode_splits(_gridded(read_manifest(spark, manifest_path), found, width, height))


def _gridded(records: DataFrame, texts: DataFrame, width: int, height: int) -> DataFrame:
    gridded = normalize_grid(texts, "text", "grid", width, height)
    joined = manifest.attach_texts(records, gridded, "grid")
    return store(joined.select("id", "split", "label", "grid"), "grids")


def encode_splits(grids: DataFrame, vocab_split: str = "train") -> tuple[DataFrame, list[str]]:
    """Token ids of every split, with the vocabulary of one."""
    chars = vocab.vocab_chars(vocab.build_vocab(grids.filter(F.col("split") == vocab_split), "grid"))
    return grids.withColumn("ids", vocab.encode(F.col("grid"), chars)), chars


def sample_sheets(
    tokens: DataFrame, chars: Sequence[str], width: int, height: int, within: Sequence[str], idx_col: str = "idx"
) -> DataFrame:
    """Decoded tokens to grids of W*H consecutive positions, shown ten to a strip."""
    sequences = batching.assemble(tokens, width * height, ["tok_id"], idx_col, within)
    decoded = sequences.withColumn("grid", F.rpad(vocab.decode(F.col("tok_id"), chars), width * height, " "))
    return render.contact_sheet(decoded, within, "batch_id", "grid", width, height)
