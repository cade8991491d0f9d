"""k-means over array columns: parallel oversampled seeding, distributed Lloyd rounds, mini-batches on a bounded sample."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from reelquilt.llm.vectors import lists, matrix, square_distances


def weighted_seeds(points: np.ndarray, weights: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """k-means++ over weighted points; fewer than k centres if there are fewer distinct points."""
    if not len(points):
        return points
    chosen = [int(rng.choice(len(points), p=weights / weights.sum()))]
    d = square_distances(points, points[chosen[-1:]])[:, 0]
    while len(chosen) < k:
        mass = d * weights
        total = mass.sum()
        if total <= 1e-18:
            break
        chosen.append(int(np.searchsorted(np.cumsum(mass), rng.random() * total, side="right").clip(0, len(points) - 1)))
        d = np.minimum(d, square_distances(points, points[chosen[-1:]])[:, 0])
    return points[chosen]


def lloyd(points: np.ndarray, weights: np.ndarray, centres: np.ndarray, rounds: int) -> np.ndarray:
    """Weighted Lloyd rounds on the driver over a bounded set of candidates; an empty cluster keeps its centre."""
    centres = centres.copy()
    for _ in range(rounds):
        near = square_distances(points, centres).argmin(axis=1)
        mass = np.bincount(near, weights, minlength=len(centres))
        sums = np.stack([np.bincount(near, weights * points[:, j], minlength=len(centres)) for j in range(points.shape[1])], axis=1)
        centres = np.where(mass[:, None] > 0, sums / np.maximum(mass, 1e-300)[:, None], centres)
    return centres


def mini_batch(points: np.ndarray, k: int, *, batch: int = 1024, steps: int = 100, seed: int = 1234) -> np.ndarray:
    """Mini-batch k-means: every step moves the centres of one random batch by rates that fall with what they have seen."""
    rng = np.random.default_rng(seed)
    if not len(points):
        return points
    start = points[rng.permutation(len(points))[: max(batch, 10 * k)]]
    centres = weighted_seeds(start, np.ones(len(start)), k, rng)
    seen = np.zeros(len(centres))
    for _ in range(steps):
        part = points[rng.integers(len(points), size=min(batch, len(points)))]
        near = square_distances(part, centres).argmin(axis=1)
        n = np.bincount(near, minlength=len(centres))
        hit = np.flatnonzero(n)
        seen[hit] += n[hit]
        sums = np.zeros_like(centres)
        np.add.at(sums, near, part)
        centres[hit] += (sums[hit] - n[hit, None] * centres[hit]) / seen[hit, None]
    return centres


def seeds(rows: DataFrame, vector: str, size: int, k: int, *, rounds: int = 4, oversample: float = 2.0, seed: int = 1234) -> np.ndarray:
    """k-means||: every round draws rows with a chance proportional to their cost, about ``oversample * k`` a round.

    What reaches the driver is bounded by the rounds times a few ``k``; candidates are weighted by the rows nearest to
    them and reduced to ``k`` centres there.
    """
    spark = rows.sparkSession
    rng = np.random.default_rng(seed)
    hashed = F.xxhash64(F.lit(seed), vector)
    first = rows.orderBy(hashed).limit(1).select(vector).toArrow()
    if not first.num_rows:
        return np.zeros((0, size))
    chosen = matrix(first.column(0), size)
    for turn in range(rounds):
        shared = spark.sparkContext.broadcast(chosen)

        def cost(batches: Iterable[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, 2048):
                    part = batch.slice(at, 2048)
                    yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(square_distances(matrix(part.column(0), size), shared.value).min(axis=1))], names=["z", "h", "cost"])

        costs = rows.select(F.col(vector).alias("z"), F.xxhash64(F.lit(seed + turn + 1), vector).alias("h")).mapInArrow(cost, T.StructType([T.StructField("z", T.ArrayType(T.DoubleType())), T.StructField("h", T.LongType()), T.StructField("cost", T.DoubleType())]))
        total = costs.agg(F.sum("cost")).first()[0] or 0.0
        if total <= 1e-18:
            break
        chance = F.col("cost") * F.lit(oversample * k / total)
        draw = (F.col("h").cast("double") / F.lit(2.0**64)) + F.lit(0.5)
        new = costs.where(draw < chance).select("z").limit(int(4 * oversample * k) + 16).toArrow()
        if new.num_rows:
            chosen = np.unique(np.concatenate([chosen, matrix(new.column("z"), size)]), axis=0)
    weight = np.zeros(len(chosen))
    for r in assign(rows.select(vector), vector, size, chosen).groupBy("cluster").agg(F.count("*").alias("n")).collect():
        weight[r["cluster"]] = r["n"]
    start = weighted_seeds(chosen, np.maximum(weight, 1e-9), k, rng)
    return lloyd(chosen, np.maximum(weight, 1e-9), start, 5)


def assign(rows: DataFrame, vector: str, size: int, centres: np.ndarray, *, shared=None) -> DataFrame:
    """All columns and ``cluster`` (nearest centre, the first on a tie) and ``distance``."""
    shared = shared or rows.sparkSession.sparkContext.broadcast(centres)
    at_column = rows.columns.index(vector)
    names = [*rows.columns, "cluster", "distance"]
    schema = T.StructType([*rows.schema.fields, T.StructField("cluster", T.IntegerType()), T.StructField("distance", T.DoubleType())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                d = square_distances(matrix(part.column(at_column), size), shared.value)
                near = d.argmin(axis=1)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(near.astype(np.int32)), pa.array(np.sqrt(d[np.arange(len(d)), near]))], names=names)

    return rows.mapInArrow(run, schema)


def refine(rows: DataFrame, vector: str, size: int, centres: np.ndarray, rounds: int) -> np.ndarray:
    """Distributed Lloyd rounds: each task adds up its rows by centre, the driver sees k sums; empty clusters stay put."""
    spark = rows.sparkSession
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast(centres)

        def sums(batches: Iterable[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            k = len(shared.value)
            total, n = np.zeros((k, size)), np.zeros(k, dtype=np.int64)
            for batch in batches:
                for at in range(0, batch.num_rows, 2048):
                    x = matrix(batch.column(0).slice(at, 2048), size)
                    near = square_distances(x, shared.value).argmin(axis=1)
                    np.add.at(total, near, x)
                    n += np.bincount(near, minlength=k)
            some = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(n[some]), lists(total[some])], names=["cluster", "n", "total"])

        parts = rows.select(vector).mapInArrow(sums, "cluster int, n long, total array<double>")
        added = parts.select("cluster", "n", F.posexplode("total").alias("j", "v")).groupBy("cluster", "j").agg(F.sum("v").alias("v"), F.sum("n").alias("n"))
        moved = centres.copy()
        for r in added.collect():
            moved[r["cluster"], r["j"]] = r["v"] / r["n"]
        if np.abs(moved - centres).max(initial=0.0) < 1e-9:
            return moved
        centres = moved
    return centres
