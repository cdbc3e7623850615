"""Vocabulary, tokens, profiles, byte decoding, line cutting."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from gridloom.functions import text as tx
from gridloom.operators import profile, vocab


def one(spark, column, *values, schema="x string"):
    frame = spark.createDataFrame([(v,) for v in values], schema)
    return [r[0] for r in frame.coalesce(1).select(column).collect()]


def test_vocabulary_is_sorted_and_starts_with_space(spark):
    grids = spark.createDataFrame([("zaz",), ("b~!",), (None,)], "grid string")
    rows = vocab.build_vocab(grids, "grid").collect()
    assert [(r["tok_id"], r["ch"]) for r in rows] == list(enumerate([" ", "!", "a", "b", "z", "~"]))
    assert vocab.vocab_chars(vocab.build_vocab(grids.limit(0), "grid")) == [" "]


def test_vocab_chars_rejects_gaps_and_missing_space(spark):
    with pytest.raises(ValueError):
        vocab.vocab_chars(spark.createDataFrame([(0, " "), (2, "a")], "tok_id int, ch string"))
    with pytest.raises(ValueError):
        vocab.vocab_chars(spark.createDataFrame([(0, "a")], "tok_id int, ch string"))


def test_encode_and_decode(spark):
    chars = [" ", "a", "b", "~"]
    texts = ["ab~ ", "", "xaé😀b", "\x01\x7fa", None, "b"]
    ids = one(spark, vocab.encode(F.col("x"), chars), *texts)
    want = [None if t is None else [max(chars.index(c), 0) if c in chars else 0 for c in t] for t in texts]
    assert ids == want
    back = one(spark, vocab.decode(F.col("x"), chars), *want, schema="x array<int>")
    assert back == [None if w is None else "".join(chars[i] for i in w) for w in want]


def test_encode_many_batches(spark):
    rnd = random.Random(3)
    texts = ["".join(rnd.choices("abc é", k=rnd.randint(0, 9))) for _ in range(25_000)]
    frame = spark.createDataFrame(list(enumerate(texts)), "i int, x string").repartition(3)
    got = {r["i"]: r["ids"] for r in frame.select("i", vocab.encode(F.col("x"), [" ", "a", "b"]).alias("ids")).collect()}
    assert got == {i: [" ab".find(c) if c in "ab" else 0 for c in t] for i, t in enumerate(texts)}


def test_unknown_chars_count_occurrences(spark):
    grids = spark.createDataFrame([("a<<b",), ("  a ",), (">a>",)], "grid string")
    rows = vocab.unknown_chars(grids, "grid", [" ", "a", "b"]).collect()
    assert {r["ch"]: r["n"] for r in rows} == {"<": 2, ">": 2}


def test_position_weights(spark):
    assert one(spark, vocab.position_weights(F.col("x")), [0, 3, 0], schema="x array<int>") == [[0.3, 1.0, 0.3]]


def test_to_lines_and_preview(spark):
    assert one(spark, tx.to_lines(F.col("x"), 3), "abcdefgh", "abcdef", "", "ab") == ["abc\ndef\ngh", "abc\ndef", "", "ab"]
    assert one(spark, tx.preview(F.col("x"), 4), "a b cd", "") == ["a·b·", ""]


def test_text_height(spark):
    cases = ["", "\n\n", "a", "\na\n", "a\n\nb", "   ", "\n  \n", "a\r\nb"]
    want = [t.strip("\n").count("\n") + 1 if t.strip("\n") else 0 for t in cases]
    assert one(spark, tx.text_height(F.col("x")), *cases) == want


BOUNDARIES = ["\n", "\r", "\r\n", "\x0b", "\x0c", "\x1c", "\x1d", "\x1e", "\x85", "\u2028", "\u2029"]


def test_text_size_knows_every_boundary(spark):
    cases = ["", "\n", "\n\n", "abc"] + [f"ab{b}cde{b}" for b in BOUNDARIES] + ["\r\n\n\r", "é\u2028😀😀"]
    got = one(spark, tx.text_size(F.col("x")), *cases)
    assert [(r["width"], r["height"]) for r in got] == [
        (max(map(len, t.splitlines()), default=0), len(t.splitlines())) for t in cases
    ]


def test_dimension_histogram_ties_keep_first_seen(spark):
    texts = ["aa", "b", "cc", "d", "eee", "f\ng", "hhhh", "iiiii", "jjjjjj"]
    frame = spark.createDataFrame(list(enumerate(texts)), "i int, t string").repartition(4)
    rows = profile.dimension_histogram(frame, "t", "i", 5).collect()
    for dimension, size in (("width", lambda ls: max(map(len, ls))), ("height", len)):
        want = Counter(size(t.splitlines()) for t in texts).most_common(5)
        got = sorted((r["rank"], r["value"], r["n"]) for r in rows if r["dimension"] == dimension)
        assert [(v, n) for _, v, n in got] == want


def test_codepoints(spark):
    texts = ["ab\r\n", "b😀", ""]
    rows = profile.codepoints(spark.createDataFrame([(t,) for t in texts], "t string"), "t").collect()
    assert {(r["ch"], r["cp"], r["hex"], r["n_records"]) for r in rows} == {
        ("a", 97, "0x61", 1), ("b", 98, "0x62", 2), ("😀", 0x1F600, "0x1f600", 1)
    }


def test_decode_text_drops_or_raises(spark):
    blobs = [b"a\xffb", b"a\r\nb\rc\n", "é".encode(), b"", None, b"\xe2\x82"]
    got = one(spark, tx.decode_text(F.col("x")), *blobs, schema="x binary")
    assert got == ["ab", "a\nb\nc\n", "é", "", None, ""]
    with pytest.raises(Exception, match="INVALID_UTF8"):
        one(spark, tx.decode_text(F.col("x"), strict=True), b"a\xff", schema="x binary")


def test_plain_path(spark):
    paths = ["file:/a/b", "file:///a/b", "hdfs://host:9000/a/b", "/a/b", "s3a://bucket/a/b"]
    assert one(spark, tx.plain_path(F.col("x")), *paths) == ["/a/b"] * 5
