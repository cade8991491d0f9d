"""Rows of Arrow batches, sorted and grouped in numpy."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def codes(column: pa.Array) -> np.ndarray:
    """Whole numbers that are equal where values are; -1 for null."""
    return pc.fill_null(pc.dictionary_encode(column).indices, -1).to_numpy(zero_copy_only=False).astype(np.int64)


def groups(batch: pa.RecordBatch, n_keys: int) -> tuple[np.ndarray, np.ndarray]:
    """First rows of stretches of equal keys, and the stretch of each row."""
    new = np.zeros(batch.num_rows, dtype=bool)
    new[:1] = True
    for i in range(n_keys):
        own = codes(batch.column(i))
        new[1:] |= own[1:] != own[:-1]
    return np.flatnonzero(new), np.cumsum(new) - 1


def distinct(columns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Order of rows by the columns, and which rows in that order differ from the one before."""
    order = np.lexsort(columns[::-1])
    fresh = np.zeros(len(order), dtype=bool)
    fresh[:1] = True
    for c in columns:
        c = c[order]
        fresh[1:] |= c[1:] != c[:-1]
    return order, fresh


def glued(a: pa.RecordBatch, b: pa.RecordBatch) -> pa.RecordBatch:
    return pa.Table.from_batches([a, b.cast(a.schema) if b.schema != a.schema else b]).combine_chunks().to_batches()[0]
