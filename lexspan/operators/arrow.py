"""Arrow columns to numpy and back, without a Python object per row."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def to_matrix(vectors: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """A list column of equally long vectors as a matrix of doubles."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    if not len(vectors):
        return np.zeros((0, 0))
    sizes = pc.list_value_length(vectors)
    if sizes.null_count or pc.min(sizes) != pc.max(sizes):
        raise ValueError("vectors must be present and of one length")
    flat = vectors.flatten().to_numpy(zero_copy_only=False)
    return flat.astype(np.float64).reshape(len(vectors), -1)


def from_matrix(matrix: np.ndarray, kind: pa.DataType, present: np.ndarray | None = None) -> pa.Array:
    """The rows of a matrix as a list column.

    With `present`, the rows belong to its true places and the others are null.
    """
    values = pa.array(matrix.ravel(), kind)
    taken = np.ones(len(matrix), dtype=bool) if present is None else present
    ends = np.cumsum(np.where(taken, matrix.shape[1], 0))
    offsets = np.r_[0, ends].astype(np.int32)
    mask = None if taken.all() else np.r_[~taken, False]
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32(), mask=mask), values)


def to_ids(ids: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """An id column as a sortable array."""
    if isinstance(ids, pa.ChunkedArray):
        ids = ids.combine_chunks()
    values = ids.to_numpy(zero_copy_only=False)
    return values.astype(str) if values.dtype == object else values


def blocks(batch: pa.RecordBatch | pa.Table, vector_col: str, values: int = 4_000_000) -> Iterator:
    """Cut a batch so that the vectors of a block have about `values` numbers."""
    if batch.num_rows:
        width = pc.list_value_length(batch.column(vector_col).slice(0, 1))[0].as_py() or 1
        rows = max(values // width, 1)
        for lo in range(0, batch.num_rows, rows):
            yield batch.slice(lo, rows)
