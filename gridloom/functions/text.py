"""Text expressions: Unicode folding, printable cleaning, line counting and line cutting."""

from __future__ import annotations

import unicodedata

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

# What is left to substitute after NFKC folding (minus, en dash, em dash, hyphen).
DASHES = "−–—‐"
_UNPRINTABLE = r"[^\x20-\x7E\n]"

_SIZE = StructType([StructField("width", IntegerType()), StructField("height", IntegerType())])


def _fold_text(text: str) -> str:
    text = unicodedata.normalize("NFKC", text)
    for dash in DASHES:
        text = text.replace(dash, "-")
    return text


@F.arrow_udf(StringType())
def _fold(texts: pa.Array) -> pa.Array:
    return pa.array([None if t is None else _fold_text(t) for t in texts.to_pylist()], pa.string())


@F.arrow_udf(StringType())
def _decode_lossy(blobs: pa.Array) -> pa.Array:
    return pa.array(
        [None if b is None else bytes(b).decode("utf-8", errors="ignore") for b in blobs.to_pylist()], pa.string()
    )


@F.arrow_udf(_SIZE)
def text_size(texts: pa.Array) -> pa.Array:
    """Longest line and number of lines, at every boundary Python's ``splitlines`` knows.

    Over six times faster here than splitting on the same boundaries with a JVM pattern.
    """
    lined = [None if t is None else t.splitlines() for t in texts.to_pylist()]
    widths = [None if ls is None else max(map(len, ls), default=0) for ls in lined]
    heights = [None if ls is None else len(ls) for ls in lined]
    columns = [pa.array(widths, pa.int32()), pa.array(heights, pa.int32())]
    return pa.StructArray.from_arrays(columns, names=["width", "height"])


@F.arrow_udf(ArrayType(StringType()))
def distinct_chars(texts: pa.Array) -> pa.Array:
    """The set of characters of each text; over three times faster than splitting it into an array."""
    return pa.array([None if t is None else list(set(t)) for t in texts.to_pylist()], pa.list_(pa.string()))


def fold(text: Column) -> Column:
    """Unicode NFKC, then every dash to ``-``.

    Only rows with a character outside ASCII travel to Python; ASCII is stable under both steps.
    """
    has_wide = F.octet_length(text) > F.char_length(text)
    return F.coalesce(_fold(F.when(has_wide, text)), text)


def drop_cr(text: Column) -> Column:
    return F.replace(text, F.lit("\r"), F.lit(""))


def printable(text: Column) -> Column:
    """Keep line feeds and U+0020..U+007E; blank every other code point, one for one."""
    return F.when(text.rlike(_UNPRINTABLE), F.regexp_replace(text, _UNPRINTABLE, " ")).otherwise(text)


def universal_newlines(text: Column) -> Column:
    return F.when(F.contains(text, F.lit("\r")), F.regexp_replace(text, "\r\n?", "\n")).otherwise(text)


def decode_text(content: Column, strict: bool = False) -> Column:
    """UTF-8 bytes to text with ``\\n`` line ends.

    Invalid bytes are dropped, or fail the query when ``strict``. Valid blobs never leave the JVM.
    """
    as_text = content.cast("string")
    if strict:
        return universal_newlines(F.validate_utf8(as_text))
    valid = F.is_valid_utf8(as_text)
    lossy = _decode_lossy(F.when(~valid, content))
    return universal_newlines(F.coalesce(F.when(valid, as_text), lossy))


def count_newlines(text: Column) -> Column:
    """Counted in bytes, as counting characters would walk both strings."""
    return F.octet_length(text) - F.octet_length(F.replace(text, F.lit("\n"), F.lit("")))


def text_height(text: Column) -> Column:
    """Rows of a rendered text: newlines at either end do not count, a text of only newlines has none."""
    newline, size = F.lit("\n"), F.octet_length(text)
    leading = size - F.octet_length(F.ltrim(text, newline))
    trailing = size - F.octet_length(F.rtrim(text, newline))
    return F.when(leading == size, 0).otherwise(count_newlines(text) - leading - trailing + 1).cast("int")


def trimmed_line_count(text: Column) -> Column:
    """Lines of cleaned text once blank lines at the end are dropped."""
    inner = F.rtrim(text, F.lit(" \n"))
    return F.when(inner == "", 0).otherwise(count_newlines(inner) + 1).cast("int")


def trimmed_lines(text: Column) -> Column:
    """The lines of cleaned text without its blank lines at the end."""
    return F.slice(F.split(text, "\n", -1), F.lit(1), trimmed_line_count(text))


def to_lines(text: Column, width: int) -> Column:
    """Cut a row-major string every ``width`` characters and join the pieces with line feeds."""
    if width < 1:
        raise ValueError("width must be at least 1")
    return F.regexp_replace(text, f"(?s)(.{{{width}}})(?=.)", "$1\n")


def preview(text: Column, n: int = 200) -> Column:
    """The first ``n`` characters with blanks made visible."""
    return F.translate(F.substring(text, 1, n), " ", "·")


def plain_path(path: Column) -> Column:
    """A path without scheme and authority, so that file listings and manifests join."""
    return F.regexp_replace(path, r"^[A-Za-z][A-Za-z0-9+.\-]*:(//[^/]*)?/*", "/")
