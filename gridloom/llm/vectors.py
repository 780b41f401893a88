"""Arrow list columns of floats as numpy matrices."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def matrix(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(rows as float64, padded with 0 to the longest; which rows have finite components only).

    A null vector, and one that holds a null or a non-finite component, is not ok; its row is 0.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    ok = np.ones(n, bool) if not column.null_count else np.asarray(column.is_valid())
    offsets = np.asarray(column.offsets).astype(np.int64)
    flat = column.values
    values = np.asarray(flat.cast(pa.float64()).fill_null(float("nan")) if flat.null_count else flat.cast(pa.float64()))
    size = np.where(ok, np.diff(offsets), 0)
    width = int(size.max()) if n else 0
    if n and (size == width).all() and offsets[-1] - offsets[0] == n * width:
        out = values[offsets[0] : offsets[-1]].reshape(n, width).copy()
    else:
        out = np.zeros((n, width))
        for i in np.flatnonzero(size):
            out[i, : size[i]] = values[offsets[i] : offsets[i] + size[i]]
    ok &= np.isfinite(out).all(axis=1)
    out[~ok] = 0
    return out, ok
