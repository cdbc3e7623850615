"""Pixels to character grids, and character grids side by side."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from gridloom.functions.arrow import null_mask

DEFAULT_RAMP = " .:-=+*#%@"
SHEET_COLUMNS = 10  # items side by side on one sheet
GAP = "  "
CELL_ASPECT = 2.0  # a character cell is about twice as high as wide


def quantise(values: Column) -> Column:
    """[0, 1] intensities to 0..255 by truncation."""
    return F.transform(values, lambda x: F.floor(x * 255).cast("int"))


def _cells(size: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """First and one-past-last source line of each of ``n`` cells; a cell has at least one line."""
    at = np.arange(n)
    first = at * size // n
    return first, np.maximum((at + 1) * size // n, first + 1)


def _block_sums(images: np.ndarray, width: int, height: int) -> tuple[np.ndarray, np.ndarray]:
    """Cell sums (N, H, W) and cell areas (H, W) from an integral image."""
    top, bottom = _cells(images.shape[1], height)
    left, right = _cells(images.shape[2], width)
    area = np.pad(images.cumsum(1).cumsum(2), ((0, 0), (1, 0), (1, 0)))
    rows = area[:, bottom] - area[:, top]
    return rows[:, :, right] - rows[:, :, left], np.outer(bottom - top, right - left)


def height_for(w: int, h: int, width: int, aspect: float = CELL_ASPECT) -> int:
    """Rows that keep the shape of a ``w`` x ``h`` image at ``width`` columns; at least one."""
    return max(1, int(width * h / w / aspect + 0.5))


def render_grid(
    pixels: Column, w: Column, h: Column, width: int, height: int | None = None, ramp: str = DEFAULT_RAMP
) -> Column:
    """8-bit images to ``height`` lines of ``width`` ramp characters, darkest first.

    Without ``height`` it follows from the width and the shape of each image.

    Each character shows the mean of its cell: ``floor(mean / 256 * len(ramp))``, in integers.
    Images of one shape within an Arrow batch are rendered together; nothing is shuffled.
    """
    if width < 1 or height is not None and height < 1 or not ramp:
        raise ValueError("a rendered grid needs a width, a height and a ramp")
    shades = np.array(list(ramp))

    @F.arrow_udf(StringType())
    def render(pixels: pa.Array, ws: pa.Array, hs: pa.Array) -> pa.Array:
        out = np.full(len(pixels), None, dtype=object)
        known = ~null_mask(pixels)
        shape = np.stack([ws.fill_null(0).to_numpy(), hs.fill_null(0).to_numpy()], axis=1)
        for w, h in np.unique(shape[known], axis=0):
            rows = np.flatnonzero(known & (shape == (w, h)).all(axis=1))
            flat = pixels.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False)
            n_lines = height or height_for(int(w), int(h), width)
            sums, areas = _block_sums(flat.reshape(len(rows), h, w).astype(np.int64), width, n_lines)
            lines = shades[sums * len(ramp) // (256 * areas)]
            out[rows] = ["\n".join("".join(line) for line in image) for image in lines]
        return pa.array(out, pa.string())

    return render(pixels, w, h)


def contact_sheet(
    df: DataFrame,
    sheet: Sequence[str],
    order_col: str,
    grid_col: str,
    width: int,
    height: int,
    columns: int = SHEET_COLUMNS,
) -> DataFrame:
    """``(*sheet, strip, row, line)``: row r shows line r of every item, each followed by two blanks.

    Items are W x H grids numbered from 0 by ``order_col``. A sheet with more than ``columns`` items
    continues on further strips, so a group never collects more than ``columns`` grids.
    """
    strips = df.groupBy(*sheet, F.expr(f"`{order_col}` div {columns}").alias("strip")).agg(
        F.array_sort(F.collect_list(F.struct(F.col(order_col).alias("item"), F.col(grid_col).alias("grid")))).alias(
            "items"
        )
    )
    line = lambda r: F.array_join(
        F.transform("items", lambda it: F.concat(F.substring(it["grid"], r * width + 1, F.lit(width)), F.lit(GAP))), ""
    )
    if height < 1:
        return strips.select(*sheet, "strip", F.lit(0).alias("row"), F.lit("").alias("line")).limit(0)
    rows = F.transform(F.sequence(F.lit(0), F.lit(height - 1)), line)
    return strips.select(*sheet, "strip", F.posexplode(rows).alias("row", "line"))
