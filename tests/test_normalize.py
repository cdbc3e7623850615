"""Grid normalisation: specification vectors, Unicode folding, grid properties."""

import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from gridloom.functions import text as tx
from gridloom.operators.normalize import clean_text, normalize_grid

# (input, expected 4 x 2 grid with _ for space)
VECTORS = [
    ("", "________"),
    ("ab\ncd", "ab__cd__"),
    ("abcdef\ng", "abcdg___"),
    ("a\nb\nc", "a___b___"),
    ("\n\na", "________"),
    ("a\n \n\n", "a_______"),
    ("a\tb", "a_b_____"),
    ("a\r\nb", "a___b___"),
    ("a\rb", "ab______"),
    ("e\u0301x", "_x______"),
    ("\u2026", "..._____"),
    ("\u2013\u2014\u2010\u2011\u2212", "----____"),
    ("\uFB01", "fi______"),
    ("\u3000x", "_x______"),
    ("a\u00A0b", "a_b_____"),
    ("a\x0bb", "a_b_____"),
    ("a\u2028b", "a_b_____"),
    ("\u00E9", "________"),
    ("\uFF0B\uFF03\uFF20\n\uFF0A\uFF05\uFF1A\uFF1D", "+#@_*%:="),
    ("\U0001F600x\U0001D400", "_xA_____"),
    ("a\x7f\x00b", "a__b____"),
]
SHIFTED = [
    ("  a\n b", "_a__b___"),
    ("   a\n \n   b", "a_______"),
    ("\n  \n", "________"),
    ("\u00A0\u00A0a\n\t\tb", "a___b___"),
    ("    a\n    b\n  c", "__a___b_"),
    ("  ab", "ab______"),
]


def grid_of(spark, texts, width, height, **options):
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    made = normalize_grid(rows, "text", "grid", width, height, **options)
    return [r["grid"] for r in made.orderBy("i").collect()]


def test_vectors(spark):
    grids = grid_of(spark, [text for text, _ in VECTORS], 4, 2)
    assert [g.replace(" ", "_") for g in grids] == [want for _, want in VECTORS]


def test_shift_left_vectors(spark):
    grids = grid_of(spark, [text for text, _ in SHIFTED], 4, 2, shift_left=True)
    assert [g.replace(" ", "_") for g in grids] == [want for _, want in SHIFTED]


def test_null_text_gives_null_grid(spark):
    assert grid_of(spark, [None, "a"], 2, 1) == [None, "a "]
    assert grid_of(spark, [None, "a"], 2, 1, shift_left=True) == [None, "a "]


def test_empty_grid_and_bad_size(spark):
    assert grid_of(spark, ["ab"], 0, 3) == [""]
    assert grid_of(spark, ["ab"], 3, 0) == [""]
    with pytest.raises(ValueError):
        grid_of(spark, ["ab"], -1, 3)


def expected_grid(text, width, height, shift_left=False):
    """Brute force over characters."""
    cells = []
    for ch in unicodedata.normalize("NFKC", text):
        if ch == "\r":
            continue
        if ch in tx.DASHES:
            ch = "-"
        cells.append(ch if ch == "\n" or " " <= ch <= "~" else " ")
    lines = "".join(cells).split("\n")
    if shift_left:
        leads = [len(line) - len(line.lstrip()) for line in lines if line.strip()]
        lines = [line[min(leads, default=0) :] for line in lines]
    rows = [line[:width].ljust(width) for line in lines[:height]]
    return "".join(rows).ljust(width * height)


ALPHABET = list("ab -#\n\n\r\t~\x7f") + ["é", "e\u0301", "ﬁ", "…", "—", "‑", "Å", "\u1100\u1161", "①", "\u3000", "\u2028", "𝐀", "😀"]


@pytest.mark.parametrize("shift_left", [False, True])
def test_random_texts_match_brute_force(spark, shift_left):
    rnd = random.Random(7)
    texts = ["".join(rnd.choices(ALPHABET, k=rnd.randint(0, 60))) for _ in range(400)]
    grids = grid_of(spark, texts, 6, 4, shift_left=shift_left)
    assert grids == [expected_grid(t, 6, 4, shift_left) for t in texts]
    assert all(len(g) == 24 and all(" " <= c <= "~" for c in g) for g in grids)


def test_normalising_a_cut_grid_changes_nothing(spark):
    grids = grid_of(spark, [text for text, _ in VECTORS], 4, 2)
    frame = spark.createDataFrame(list(enumerate(grids)), "i int, grid string")
    again = normalize_grid(frame.withColumn("text", tx.to_lines(F.col("grid"), 4)), "text", "again", 4, 2)
    assert all(r["grid"] == r["again"] for r in again.collect())


def test_folding_matches_unicodedata(spark):
    texts = [chr(c) + "\u0301x" + chr(c) for c in range(0x80, 0x30000, 37) if not 0xD800 <= c < 0xE000] + ["plain", ""]
    frame = spark.createDataFrame(list(enumerate(texts)), "i int, text string").repartition(4)
    got = {r["i"]: r["n"] for r in frame.select("i", tx.fold(F.col("text")).alias("n")).collect()}
    dashes = str.maketrans(tx.DASHES, "-" * len(tx.DASHES))
    assert got == {i: unicodedata.normalize("NFKC", t).translate(dashes) for i, t in enumerate(texts)}


def test_trimmed_lines(spark):
    cases = ["", "\n\n", "a", "a\n", "a\n \n\n", "\n\na", " \na \n", "a\n\nb\n   "]
    frame = clean_text(spark.createDataFrame(list(enumerate(cases)), "i int, text string"), "text", "t")
    got = [r["l"] for r in frame.orderBy("i").select(tx.trimmed_lines(F.col("t")).alias("l")).collect()]
    want = []
    for case in cases:
        lines = case.splitlines()
        while lines and not lines[-1].strip():
            lines.pop()
        want.append(lines)
    assert got == want


def test_streaming_frames_are_accepted(spark, tmp_path):
    """Normalising and encoding are stateless, so they run unchanged on a stream."""
    from gridloom.operators import vocab

    source, sink = str(tmp_path / "in"), str(tmp_path / "out")
    spark.createDataFrame([("ab\ncd",), ("é",)], "text string").write.parquet(source)
    stream = spark.readStream.schema("text string").parquet(source)
    grids = normalize_grid(stream, "text", "grid", 4, 2)
    encoded = grids.select(vocab.encode(F.col("grid"), [" ", "a", "b"]).alias("ids"))
    run = encoded.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start(sink)
    run.awaitTermination(60)
    got = sorted(tuple(r["ids"]) for r in spark.read.parquet(sink).collect())
    assert got == [(0,) * 8, (1, 2, 0, 0, 0, 0, 0, 0)]
