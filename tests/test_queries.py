"""Every registered query that has SQL against it in DuckDB, on whole tables."""

import os

import duckdb
import pytest

import __spark_entry__ as contract
from gridloom.operators.vocab import MAX_TOKENS

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = ["documents", "labels", "embeddings", "conversations", "pages", "benchmark"]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF_DIR}/{name}.parquet'")
    return con


def ordered(columns, rows):
    by_name = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in by_name], sorted((tuple(row[i] for i in by_name) for row in rows), key=repr)


@pytest.mark.parametrize("name", sorted(contract.oracle_sql()))
def test_query_matches_sql(spark, duck, name):
    frame = contract.queries()[name](spark, SF_DIR)
    result = duck.execute(contract.oracle_sql()[name])
    want = ordered([c[0] for c in result.description], result.fetchall())
    got = ordered(frame.columns, frame.collect())
    assert got[0] == want[0] and len(got[1]) == len(want[1]) > 0
    assert list(map(repr, got[1])) == list(map(repr, want[1]))


def test_entry(spark):
    rows = contract.entry(spark).collect()
    assert len(rows) == 200
    for row in rows:
        ids = [int(i) for i in row["ids_csv"].split(",")]
        assert len(ids) == 200 and max(ids) < MAX_TOKENS and row["n_nonspace"] == sum(i != 0 for i in ids)
