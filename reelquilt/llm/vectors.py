"""Dense vectors in array columns: cleaning in Spark, matrices in Arrow batches."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F


def usable(z: Column, size: int | None = None) -> Column:
    """True for vectors of the given size (any, if None) without null, NaN or infinite values that aren't all zero."""
    wrong = F.exists(z, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    some = F.exists(z, lambda x: x.cast("double") != 0)
    right_size = F.size(z) == size if size is not None else F.size(z) > 0
    return F.coalesce(right_size & ~wrong & some, F.lit(False))


def unit_rows(x: np.ndarray) -> np.ndarray:
    """Rows at length 1, rounded to 12 digits so that copies at other lengths become equal (and without negative zeros)."""
    scaled = x / np.abs(x).max(axis=1, keepdims=True)  # against overflow of squares
    return np.round(scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True)), 12) + 0.0


def common_size(df: DataFrame, column: str) -> int | None:
    """The size that most vectors have (of equally frequent ones the largest); None without any."""
    row = df.where(F.size(column) > 0).groupBy(F.size(column).alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return row["d"] if row else None


def matrix(column: pa.Array, size: int) -> np.ndarray:
    """Rows of a list column of equally long vectors."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return pc.list_flatten(column).to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(-1, size)


def lists(rows: np.ndarray) -> pa.ListArray:
    offsets = np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.ascontiguousarray(rows, dtype=np.float64).ravel()))


def square_distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :]
    out -= 2 * (a @ b.T)
    return np.maximum(out, 0, out=out)
