"""Arrow columns of vectors as numpy matrices, and back, without an object for each row."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """The vectors of a column with at least one row."""
    vectors = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    widths = np.diff(vectors.offsets.to_numpy())
    if (widths != widths[0]).any():
        raise ValueError("vectors differ in length")
    return vectors.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(vectors), -1)


def lists(values: np.ndarray) -> pa.Array:
    """The rows of a matrix as lists."""
    begins = np.arange(len(values) + 1, dtype=np.int32) * values.shape[1]
    return pa.ListArray.from_arrays(pa.array(begins), pa.array(np.ascontiguousarray(values, float).ravel()))
