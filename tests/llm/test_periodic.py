"""Periodic runs against a plain scan of every period."""

import hashlib
import random
from fractions import Fraction
from zlib import crc32

import pyarrow as pa
import pytest
from gridloom.llm import periodic_runs, queries
from hypothesis import given, settings
from hypothesis import strategies as st

from brute import words

SF_DIR = "/root/testdata/sf0.001"


def plain_runs(w, least=24, exponent=3):
    """(start, length, period) of all runs."""
    found = {}
    for q in range(1, len(w) // exponent + 1):
        low = 0
        while low < len(w) - q:
            high = low
            while high < len(w) - q and w[high] == w[high + q]:
                high += 1
            if high - low + q >= max(least, exponent * q):
                found.setdefault((low, high - low + q), q)
            low = high + 1
    return sorted((s, n, q) for (s, n), q in found.items())


def plain_collapse(w, runs):
    return " ".join(x for i, x in enumerate(w) if not any(s + q <= i < s + n for s, n, q in runs))


def rewritten(doc_id, w):
    if doc_id is None or not w:
        return w
    h = crc32(str(doc_id).encode())
    g, n = h // 10, len(w)
    if h % 10:
        return w
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]


def plain_row(doc_id, text):
    w = rewritten(doc_id, words(text))
    runs = plain_runs(w)
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if runs else None
    lines = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    top = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(runs), *top, sha(lines), sha(plain_collapse(w, runs)))


def test_query_against_brute_force(spark, tmp_path):
    some = spark.read.parquet(f"{SF_DIR}/documents.parquet").filter("n_chars < 6000").select("doc_id", "text").collect()
    rows = [(r.doc_id, r.text) for r in some]
    more = [None, "", " \n", "a " * 24, "a " * 23, "x " + "a b " * 40 + "a c " + "a b a b c " * 9, "漢 é " * 30, "a b " * 30]
    rows += [(10_000 + i, t) for i, t in enumerate(more)] + [(None, "a " * 30), (3, "a b c " * 20), (3, "a b c " * 20)]
    frame = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, runs int, w string")
    frame.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    found = queries.op12_periodic_runs(spark, str(tmp_path))
    want = [plain_row(*r) for r in rows]
    assert any(r[1] > 1 for r in want) and sorted(map(tuple, found.collect()), key=str) == sorted(want, key=str)


@settings(max_examples=150, deadline=None)
@given(
    st.lists(st.tuples(st.integers(0, 90), st.integers(1, 6), st.integers(1, 15), st.integers(0, 10**6)), max_size=6),
    st.sampled_from([(24, 3), (6, 2), (4, 3)]),
)
def test_runs_of_any_texts(shapes, limits):
    texts = []
    for n, letters, period, seed in shapes:
        draw = random.Random(seed)
        w = [draw.choice("abcdef"[:letters]) for _ in range(n)]
        low = draw.randint(0, n)
        for i in range(low + period, min(n, low + 60)):
            w[i] = w[i - period]
        texts.append(w)
    column = pa.array([" ".join(w) for w in texts], pa.string())
    n_words, runs, collapsed = periodic_runs._collapsed(column, *limits)
    for w, n, found, kept in zip(texts, n_words.to_pylist(), runs.to_pylist(), collapsed.to_pylist()):
        want = plain_runs(w, *limits)
        assert n == len(w) and [tuple(r.values()) for r in found] == want and kept == plain_collapse(w, want)


def test_candidates_in_several_portions(monkeypatch):
    w = list("abcab" * 30 + "xyz" * 20 + "q" * 50)
    whole = periodic_runs._collapsed(pa.array([" ".join(w)] * 3), 6, 2)
    monkeypatch.setattr(periodic_runs, "CANDIDATES", 8)
    assert periodic_runs._collapsed(pa.array([" ".join(w)] * 3), 6, 2) == whole


@pytest.mark.parametrize("text", ["a " * 100_000, "a b " * 50_000, " ".join(map(str, range(60_000)))])
def test_long_texts(text):
    runs = periodic_runs._collapsed(pa.array([text]), 24, 3)[1].to_pylist()[0]
    n = len(text.split())
    assert [tuple(r.values()) for r in runs] == ([] if n == 60_000 else [(0, n, 100_000 // n if n == 50_000 else len(set(text.split())))])
