"""Small helpers for the operators that work on Arrow batches."""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa

# One piece of work for a Python worker: at most this much text, or one row.
SLICE_BYTES = 2 << 20


def sliced(batches: Iterable[pa.RecordBatch], column: str) -> Iterator[pa.RecordBatch]:
    """Cut batches so that none holds much more than `SLICE_BYTES` of `column`."""
    for batch in batches:
        texts = batch.column(column)
        if batch.num_rows < 2 or texts.nbytes <= SLICE_BYTES:
            if batch.num_rows:
                yield batch
            continue
        sizes = np.array([len(t) if t is not None else 0 for t in as_bytes(texts)], dtype=np.int64)
        part = np.cumsum(sizes) // SLICE_BYTES
        edges = np.flatnonzero(np.diff(part)) + 1
        for start, end in zip([0, *edges], [*edges, batch.num_rows], strict=True):
            yield batch.slice(int(start), int(end - start))


def as_bytes(column: pa.Array) -> list[bytes | None]:
    """The UTF-8 bytes of a string column."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return column.cast(kind).to_pylist()


def held_out(doc_ids: Iterable[int | None], folds: int, fold: int) -> list[bool]:
    """Whether CRC-32 of the id as text falls into `fold`; a row without id does not."""
    return [d is not None and zlib.crc32(str(d).encode()) % folds == fold for d in doc_ids]
