"""Rows of vectors as numpy matrices."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def finite_rows(column: pa.Array, length: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a list column: the numbers of the rows that are whole, their lengths, and their components one after another as float64.

    Whole rows are not null, hold no null and nothing non-finite, and have ``length`` components, or at least one."""
    sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    wanted = sizes == length if length else sizes > 0
    column = column.filter(pa.array(wanted))
    rows, sizes = np.flatnonzero(wanted), sizes[wanted]
    values = column.flatten().cast(pa.float64())
    good = np.isfinite(np.asarray(pc.fill_null(values, np.nan)))
    if not good.all():
        whole = np.logical_and.reduceat(good, np.cumsum(sizes) - sizes)
        column = column.filter(pa.array(whole))
        rows, sizes, values = rows[whole], sizes[whole], column.flatten().cast(pa.float64())
    return rows, sizes, np.asarray(values)


def matrix(sizes: np.ndarray, values: np.ndarray, width: int) -> np.ndarray:
    """The rows of ``finite_rows``, each filled up to ``width`` with zeros."""
    if (sizes == width).all():
        return values.reshape(-1, width)
    out = np.zeros((len(sizes), width))
    out[np.arange(width) < sizes[:, None]] = values
    return out
