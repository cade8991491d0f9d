"""Texts in Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are turned into Python strings together.
SLICE_BYTES = 1 << 20


def slices(batch: pa.RecordBatch, column: int, limit: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, list[str | None]]]:
    """Slices of a batch whose texts have about ``limit`` bytes together (a longer text stands alone), and those texts."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 16
    ends = np.cumsum(sizes)
    start = 0
    while start < batch.num_rows:
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + limit, side="right")))
        part = batch.slice(start, stop - start)
        yield part, part.column(column).to_pylist()
        start = stop
