"""Corpus preparation: whole documents through the operators, each stage on all that the one before kept.

``run`` gives the pieces that the last stage packs: the columns of ``op2_packing``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm import jaccard, langid, quality, queries, substring_dedup
from gridloom.llm.registry import bound_batches
from gridloom.storage import broadcast_if_small, store

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
LEAST_SCORE = 0.5  # of the predicted language
BATCH_SIZE = "1m"  # small, as the workers of one stage are still there in the next
READ_ROWS = 512  # rows that a scan decodes at once, as they are whole texts; the heap of an executor never shrinks again


def bound_memory(spark: SparkSession) -> None:
    bound_batches(spark, BATCH_SIZE)
    spark.conf.set("spark.sql.parquet.columnarReaderBatchSize", READ_ROWS)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that fail the base rules or leave their compression bands; a NULL text fails them.

    Rows are judged each, so repeated rows and rows without an id fare as their text does.
    """
    bound_memory(spark)
    return quality.judge(docs, "doc_id", "text", carry=COLUMNS[1:]).filter("kept").select(*COLUMNS)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without a letter, or whose language stays in doubt; repeated rows and NULL ids fare as their text."""
    bound_memory(spark)
    predicted = langid.predict(docs, "doc_id", "text", queries.language_model(docs), COLUMNS[1:])
    sure = (F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= LEAST_SCORE)
    return predicted.filter(sure).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near duplicates, the document with the smallest id stays; one without an id comes last.

    A document is an id and its text: of repeated rows with both alike one stays, and an id that stands for several texts
    keeps or loses each by itself.
    """
    bound_memory(spark)
    own = F.struct(
        F.col("doc_id").isNull().alias("unnamed"),
        F.coalesce("doc_id", F.lit(0)).alias("id"),
        F.xxhash64("text").alias("body"),
    )
    rows = docs.select(*COLUMNS, own.alias("own"))
    found = store(jaccard.component_ids(rows, "own", "text").select("own", "component_id"), "components")
    dropped = store(found.filter("component_id <> own").select("own").distinct(), "dropped")
    again = store(found.groupBy("own").count().filter("count > 1").select("own"), "again")
    kept = rows.join(broadcast_if_small(dropped), "own", "left_anti")
    once = kept.join(broadcast_if_small(again), "own", "left_anti")
    twice = kept.join(broadcast_if_small(again), "own", "left_semi").dropDuplicates(["own"])
    return once.union(twice).select(*COLUMNS)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut passages of 35 words or more that occur elsewhere; documents of which nothing is left go."""
    bound_memory(spark)
    cut = substring_dedup.deduplicate(docs, "doc_id", "text", rejoin=False, carry=COLUMNS[2:])
    size = F.when(F.col("n_removed") > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))
    left = cut.filter("n_removed < greatest(n_words, 1)")
    return left.withColumn("n_chars", size).select(*COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Fill windows of 2048 tokens with the kept documents. Repeated rows, and rows without an id, are packed each."""
    bound_memory(spark)
    return queries.packed(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("packing", packing),
]

#: Language models, components and retrieval are beyond SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = store(stage(spark, docs, sf_dir), name)
    return docs
