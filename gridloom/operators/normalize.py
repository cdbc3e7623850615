"""Raw text to a fixed W x H grid of printable ASCII, row-major, always W*H characters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.functions import text as tx


def clean_text(df: DataFrame, text_col: str, out_col: str) -> DataFrame:
    """Fold and clean a whole text to line feeds and U+0020..U+007E."""
    folded = df.withColumn(out_col, tx.fold(F.col(text_col)))
    return folded.withColumn(out_col, tx.printable(tx.drop_cr(F.col(out_col))))


def normalize_grid(
    df: DataFrame, text_col: str, out_col: str, width: int, height: int, shift_left: bool = False
) -> DataFrame:
    """Add ``out_col``: the first ``height`` lines, each cut or padded to ``width``, joined.

    A line feed is inert under NFKC and no other character turns into one, so lines the grid
    cannot show are cut off before folding. Cleaning maps code point to code point, so it
    comes last, on W*H characters. ``shift_left`` needs the smallest indent of all lines and
    cleans the whole text first. Narrow in both cases: no shuffle.
    """
    if width < 0 or height < 0:
        raise ValueError("width and height must not be negative")
    if shift_left:
        lined = _shifted_lines(clean_text(df, text_col, out_col), out_col, height)
    else:
        head = df.withColumn(out_col, F.substring_index(text_col, "\n", height))
        folded = head.withColumn(out_col, tx.fold(F.col(out_col)))
        lined = folded.withColumn(out_col, F.split(tx.drop_cr(F.col(out_col)), "\n", -1))
    padded = F.transform(F.col(out_col), lambda line: F.rpad(line, width, " "))
    grid = lined.withColumn(out_col, F.rpad(F.array_join(padded, ""), width * height, " "))
    return grid if shift_left else grid.withColumn(out_col, tx.printable(F.col(out_col)))


def _shifted_lines(df: DataFrame, col: str, height: int) -> DataFrame:
    lead_col = f"{col}__lead"
    lines = F.split(F.col(col), "\n", -1)
    leads = F.transform(
        F.filter(lines, lambda line: F.trim(line) != ""), lambda line: F.octet_length(line) - F.octet_length(F.ltrim(line))
    )
    return (
        df.withColumn(lead_col, F.coalesce(F.array_min(leads), F.lit(0)))
        .withColumn(
            col,
            F.transform(
                F.slice(F.split(F.col(col), "\n", -1), 1, height),
                lambda line: F.substring(line, F.col(lead_col) + 1, F.length(line)),
            ),
        )
        .drop(lead_col)
    )
