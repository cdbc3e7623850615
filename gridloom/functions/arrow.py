"""Moves between Arrow columns and numpy for the vectorised functions."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def null_mask(column: pa.Array) -> np.ndarray:
    return column.is_null().to_numpy(zero_copy_only=False)


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """The rows of a list column that are not NULL; fails unless each holds ``width`` values, none of them NULL."""
    rows = column.drop_null()
    if not pc.all(pc.equal(pc.list_value_length(rows), width)).as_py() and len(rows):
        raise ValueError(f"vectors must have {width} components")
    values = rows.flatten()
    if values.null_count:
        raise ValueError("vectors must not hold NULL")
    return values.to_numpy(zero_copy_only=False).reshape(-1, width)


def checked_ids(column: pa.Array, n: int) -> np.ndarray:
    """The ids of all rows of a list column; fails unless each is one of 0..n-1."""
    ids = column.flatten()
    if ids.null_count:
        raise ValueError("ids must not be NULL")
    ids = ids.to_numpy(zero_copy_only=False)
    if len(ids) and not 0 <= ids.min() <= ids.max() < n:
        raise ValueError(f"ids must lie in 0..{n - 1}")
    return ids


def list_rows(values: np.ndarray, missing: np.ndarray | None = None) -> pa.Array:
    """Matrix rows as a list column, with NULL where ``missing``."""
    if missing is None:
        missing = np.zeros(len(values), bool)
    ends = np.cumsum(np.where(missing, 0, values.shape[1]))
    return lists(values.ravel(), np.concatenate([[0], ends]), missing)


def lists(values: np.ndarray | pa.Array, offsets: np.ndarray, missing: np.ndarray) -> pa.Array:
    mask = pa.array(missing) if missing.any() else None
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values), mask=mask)


def string_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and the offsets of its rows within them."""
    column = column.cast(pa.string())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1]
    if data is None:
        return np.empty(0, np.uint8), np.zeros(len(column) + 1, np.int32)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]
