"""Registered queries on whole small tables, and the stages of the pipeline."""

import hashlib

import __spark_entry__ as contract
import corpus_pipeline
import duckdb
import pytest
from gridloom.llm.registry import QUERIES, SQL
from gridloom.storage import store

import brute
from test_pieces import check_packing

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def documents(spark):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()]


def test_every_operator_is_registered():
    numbers = sorted(int(n[2:].split("_")[0]) for n in QUERIES)
    assert numbers == list(range(1, 14)) and set(QUERIES) | {"pipeline"} <= set(contract.queries())


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("embeddings", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF_DIR}/{t}.parquet'")
    want = con.execute(SQL[name])
    columns = [c[0] for c in want.description]
    found = QUERIES[name](spark, SF_DIR).select(*columns)
    assert sorted(map(tuple, found.collect()), key=str) == sorted(want.fetchall(), key=str)


def test_dedup_and_components(spark, documents):
    cut = {r.doc_id: tuple(r)[1:] for r in QUERIES["op5_substring"](spark, SF_DIR).collect()}
    plain = brute.dedup([t for _, t in documents])
    assert cut == {k: (n, m, hashlib.sha256(t.encode()).hexdigest()) for (k, _), (n, m, t) in zip(documents, plain)}
    linked = sorted(map(tuple, QUERIES["op7_jaccard"](spark, SF_DIR).collect()))
    assert linked == sorted(brute.components(documents))


def test_packing(spark, documents):
    rows = QUERIES["op2_packing"](spark, SF_DIR).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"
    )
    check_packing(list(map(tuple, rows.collect())), dict(documents))


def test_pipeline_stages(spark, documents):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    extra = docs.limit(1).selectExpr("CAST(NULL AS long) doc_id", "CAST(NULL AS string) text", "lang", "source", "n_chars")
    docs = store(docs.union(docs.limit(3)).union(extra), "input")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = store(stage(spark, docs, SF_DIR), name)
        seen[name] = docs
        if name != "packing":
            assert docs.columns == list(corpus_pipeline.COLUMNS)
    before = {n: [(r.doc_id, r.text) for r in d.collect()] for n, d in seen.items() if n != "packing"}
    words = {k: brute.base_counts(t) for k, t in documents}
    good = {k for k, (n, _, _, _, rep) in words.items() if n >= 50 and 2 * rep <= n}
    assert {k for k, _ in before["quality_rules"]} <= good
    assert len({k for k, _ in before["quality_rules"]}) >= 0.95 * len(good)
    assert {k for k, _ in before["language_id"]} == {k for k, _ in before["quality_rules"]}
    firsts = sorted({(k, t) for (k, t), c in zip(before["language_id"], brute.components(before["language_id"])) if c[2] == k})
    assert sorted(before["near_duplicates"]) == firsts
    cut = {k: (t if not gone else kept) for (k, t), (n, gone, kept) in zip(firsts, brute.dedup([t for _, t in firsts])) if n > gone}
    assert dict(before["repeated_passages"]) == cut
    rows = seen["packing"].select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
    check_packing(list(map(tuple, rows.collect())), cut)


def test_pipeline_of_nothing(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        docs = store(stage(spark, docs, SF_DIR), name)
        assert docs.count() == 0


@pytest.mark.parametrize("texts", [[None], [None, None, ""], [" ", "\n\n"]], ids=["null", "nulls", "blank"])
def test_tables_without_words(spark, tmp_path, texts):
    rows = [(i or None, t, None, None, None, 1) for i, t in enumerate(texts)]
    columns = "doc_id long, text string, lang string, source string, n_chars long, n_words long"
    spark.createDataFrame(rows, columns).coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    pages = [(i or None, None, t, "x") for i, t in enumerate(texts)]
    spark.createDataFrame(pages, "page_id long, url string, html string, key string").write.parquet(f"{tmp_path}/pages.parquet")
    vectors = [(0, None, 1), (None, [1.0], 1), (50, [], 1), (50, [None], 1)]
    columns = "vec_id long, embedding array<float>, score int"
    spark.createDataFrame(vectors, columns).write.parquet(f"{tmp_path}/embeddings.parquet")
    turns = [(i or None, None, "user", t, 1) for i, t in enumerate(texts)]
    columns = "conv_id long, turn long, role string, text string, states int"
    spark.createDataFrame(turns, columns).write.parquet(f"{tmp_path}/conversations.parquet")
    labels = [(i or None, i % 2, None, "x") for i in range(3)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int, text string").write.parquet(f"{tmp_path}/labels.parquet")
    for name, run in QUERIES.items():
        assert run(spark, str(tmp_path)).count() == (0 if name == "op4_topk" else len(texts)), name
    assert contract.queries()["pipeline"](spark, str(tmp_path)).count() == 0
