"""Small dense algebra over distributed rows: sums of outer products on the executors, eigenvectors on the driver."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Widest matrix whose Gram matrix (8 bytes times the square) is put together on the driver.
MAX_COLUMNS = 4096


def matrix_of(column: pa.Array, size: int) -> np.ndarray:
    return pc.list_flatten(column).to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(-1, size)


def list_of(rows: np.ndarray) -> pa.ListArray:
    offsets = np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.ascontiguousarray(rows, dtype=np.float64).ravel()))


def packed(scores: DataFrame, *, row: str = "video_idx", column: str = "statement_index", value: str = "score") -> tuple[DataFrame, list]:
    """Long scores as one vector per row (``row``, ``x``) over the sorted distinct columns; a missing score counts as 0."""
    columns = [r[0] for r in scores.select(column).distinct().orderBy(column).limit(MAX_COLUMNS + 1).collect()]
    if len(columns) > MAX_COLUMNS:
        raise ValueError(f"more than {MAX_COLUMNS} columns")
    held = F.map_from_entries(F.collect_list(F.struct(column, value)))
    wide = scores.groupBy(row).agg(held.alias("m"))
    return wide.select(row, F.array(*(F.coalesce(F.try_element_at("m", F.lit(c)), F.lit(0.0)) for c in columns)).alias("x")), columns


@dataclass
class Moments:
    n: int
    total: np.ndarray
    gram: np.ndarray

    @property
    def mean(self) -> np.ndarray:
        return self.total / max(self.n, 1)

    @property
    def covariance(self) -> np.ndarray:
        return self.gram / max(self.n, 1) - np.outer(self.mean, self.mean)


def moments(vectors: DataFrame, column: str, size: int) -> Moments:
    """Count, column sums and Gram matrix in one pass: every task sends one matrix, merged in the cluster by position."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, gram = 0, np.zeros((size + 1, size))
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                x = matrix_of(batch.column(0).slice(at, 4096), size)
                n += len(x)
                gram[:size] += x.T @ x
                gram[size] += x.sum(axis=0)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(size + 1, dtype=np.int32)), pa.array(np.full(size + 1, n)), list_of(gram)], names=["i", "n", "row"])

    parts = vectors.select(column).mapInArrow(run, "i int, n long, row array<double>")
    cells = parts.select("i", "n", F.posexplode("row").alias("j", "v")).groupBy("i", "j").agg(F.sum("v").alias("v"), F.sum("n").alias("n")).toArrow()
    out = np.zeros((size + 1, size))
    if cells.num_rows:
        out[cells.column("i").to_numpy(), cells.column("j").to_numpy()] = cells.column("v").to_numpy()
    n = int(cells.column("n")[0].as_py()) if cells.num_rows else 0
    return Moments(n, out[size], out[:size])


def project(vectors: DataFrame, column: str, size: int, basis: np.ndarray, out: str = "z", *, unit: bool = False, eps: float = 1e-12) -> DataFrame:
    """The rows' other columns and ``out``, the vector times ``basis`` (of a size bounded by MAX_COLUMNS), at length 1 if asked."""
    shared = vectors.sparkSession.sparkContext.broadcast(basis)
    rest = [c for c in vectors.columns if c != column]
    schema = T.StructType([*(vectors.schema[c] for c in rest), T.StructField(out, T.ArrayType(T.DoubleType()))])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            z = matrix_of(batch.column(len(rest)), size) @ shared.value
            if unit:
                z = z / (np.linalg.norm(z, axis=1, keepdims=True) + eps)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(rest)], list_of(z)], names=[*rest, out])

    return vectors.select(*rest, column).mapInArrow(run, schema)


def right_vectors(gram: np.ndarray, k: int) -> np.ndarray:
    """First k right singular vectors (columns) of the matrix whose Gram matrix this is; each one's largest entry is positive."""
    values, vectors = np.linalg.eigh((gram + gram.T) / 2)
    chosen = vectors[:, np.argsort(values, kind="stable")[::-1][:k]]
    signs = np.sign(chosen[np.abs(chosen).argmax(axis=0), np.arange(chosen.shape[1])])
    return chosen * np.where(signs == 0, 1, signs)


def component_limit(n: int, m: int) -> int:
    return max(1, min(n - 1, m - 1, 128))


def long_matrix(spark, values: np.ndarray, rows: Sequence, columns: Sequence, names: tuple[str, str, str]) -> DataFrame:
    data = [(r, c, float(values[i, j])) for i, r in enumerate(rows) for j, c in enumerate(columns)]
    return spark.createDataFrame(data, f"{names[0]} int, {names[1]} int, {names[2]} double")
