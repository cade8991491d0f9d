"""Embedding, prototypes by farthest-first traversal, strata and the choice of their number."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reelquilt.config import INITS, METRICS
from reelquilt.operators import linalg, pooling
from reelquilt.plans.materialize import cut

#: Prototypes that one traversal may have; they are sent to every task.
MAX_PROTOTYPES = 4096


def build_embedding(scores: DataFrame, k_embed: int = 16, *, normalize: bool = True, row: str = "video_idx", column: str = "statement_index", value: str = "score") -> tuple[DataFrame, int]:
    """``row`` and ``z``, the scores in their leading ``k_embed`` right singular vectors; the number of them used."""
    vectors, columns = linalg.packed(scores, row=row, column=column, value=value)
    vectors = cut(vectors)
    got = linalg.moments(vectors, "x", len(columns))
    k = max(1, min(k_embed, linalg.component_limit(got.n, len(columns))))
    return linalg.project(vectors, "x", len(columns), linalg.right_vectors(got.gram, k), unit=normalize), k


def euclidean(x: np.ndarray, point: np.ndarray) -> np.ndarray:
    return np.sqrt(((x - point) ** 2).sum(axis=1))


def cosine(x: np.ndarray, point: np.ndarray) -> np.ndarray:
    """1 - cosine within [0, 2]; a zero vector counts as one of length 1."""
    a, b = np.linalg.norm(x, axis=1), np.linalg.norm(point)
    return np.clip(1 - (x @ point) / (np.where(a == 0, 1, a) * (b or 1)), 0, 2)


DISTANCE = {"euclidean": euclidean, "cosine": cosine}


def vector_size(rows: DataFrame, vector: str) -> int:
    first = rows.select(F.size(vector).alias("d")).limit(1).collect()
    return first[0]["d"] if first else 0


def centroid(rows: DataFrame, vector: str) -> np.ndarray:
    got = rows.select(F.posexplode(vector).alias("j", "v")).groupBy("j").agg(F.avg("v").alias("v")).collect()
    return np.array([r["v"] for r in sorted(got, key=lambda r: r["j"])])


def _ends(rows: DataFrame, index: str, vector: str, size: int, points: np.ndarray, metric: str, farthest: bool, n: int = 1) -> list[tuple[float, int, np.ndarray]]:
    """The ``n`` rows farthest from (or nearest to) their nearest point as (distance, index, vector), ties by the smaller index.

    A column ``near`` of the rows, if they have it, is their distance from points settled before.  Each batch sends
    ``n`` rows at most.
    """
    shared = rows.sparkSession.sparkContext.broadcast(points)
    settled = "near" in rows.columns
    schema = T.StructType([T.StructField("d", T.DoubleType()), T.StructField("i", rows.schema[index].dataType), T.StructField("z", T.ArrayType(T.DoubleType()))])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d = _near(batch, 1, size, shared.value, metric, 2 if settled else None)
            order = np.lexsort([batch.column(0).to_numpy(zero_copy_only=False), -d if farthest else d])[:n]
            take = pa.array(order)
            yield pa.RecordBatch.from_arrays([pa.array(d[order]), batch.column(0).take(take), batch.column(1).take(take)], names=["d", "i", "z"])

    found = rows.select(index, vector, *(["near"] if settled else [])).mapInArrow(run, schema)
    best = found.orderBy(F.desc("d") if farthest else F.asc("d"), "i").limit(n).collect()
    return [(r["d"], r["i"], np.array(r["z"])) for r in best]


def _near(batch: pa.RecordBatch, vector: int, size: int, points: np.ndarray, metric: str, settled: int | None) -> np.ndarray:
    x = linalg.matrix_of(batch.column(vector), size)
    d = [DISTANCE[metric](x, p) for p in points]
    if settled is not None:
        d.append(batch.column(settled).to_numpy(zero_copy_only=False))
    return np.min(d, axis=0) if len(x) else np.zeros(0)


def _settle(rows: DataFrame, index: str, vector: str, size: int, points: np.ndarray, metric: str) -> DataFrame:
    """``index``, ``vector`` and ``near``, the distance from the nearest of the points and of those settled before."""
    shared = rows.sparkSession.sparkContext.broadcast(points)
    own = rows.select(index, vector, *(["near"] if "near" in rows.columns else []))
    schema = T.StructType([*own.schema.fields[:2], T.StructField("near", T.DoubleType())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d = _near(batch, 1, size, shared.value, metric, 2 if batch.num_columns > 2 else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(d)], names=schema.names)

    return cut(own.mapInArrow(run, schema))


#: Candidates that a pass of a traversal brings to the driver, and points after which distances are kept in the rows.
CANDIDATES, SETTLE = 256, 32


def _traverse(rows: DataFrame, index: str, vector: str, size: int, first: tuple[int, np.ndarray], k: int, metric: str) -> list[tuple[int, np.ndarray]]:
    """Always the row farthest from all chosen, ``k`` in all.

    A pass brings the CANDIDATES farthest rows.  Rows that aren't among them are no farther than the last of them, and
    never will be, so the farthest candidate is the next choice as long as it is beyond that; then comes the next pass.
    Distances from every SETTLE points are kept in the rows, so that a pass costs as many distances at most.
    """
    chosen, settled = [first], 0
    while len(chosen) < k:
        if len(chosen) - settled > SETTLE:
            rows = _settle(rows, index, vector, size, np.array([z for _, z in chosen[settled:]]), metric)
            settled = len(chosen)
        found = _ends(rows, index, vector, size, np.array([z for _, z in chosen[settled:]]).reshape(-1, size), metric, True, CANDIDATES)
        d, ids, z = (np.array(x) for x in zip(*found))
        beyond = d[-1] if len(found) == CANDIDATES else -1.0
        at = 0
        while True:
            chosen.append((ids[at].item(), z[at]))
            d = np.minimum(d, DISTANCE[metric](z, z[at]))
            at = int(np.lexsort([ids, -d])[0])
            if len(chosen) >= k or d[at] <= beyond:
                break
    return chosen


def _start(rows: DataFrame, index: str, vector: str, at: int) -> tuple[int, np.ndarray]:
    r = rows.where(F.col(index) == at).select(F.col(index).alias("i"), F.col(vector).alias("z")).first()
    return r["i"], np.array(r["z"])


def farthest_first(rows: DataFrame, k: int, *, init: str = "medoid", seed: int | None = None, index: str = "video_idx", vector: str = "z") -> list[tuple[int, np.ndarray]]:
    """Ordered prototypes (index, vector): the row nearest the mean (or a seeded random one), then always the farthest row.

    ``k`` is clamped to the number of rows; ``index`` counts them from 0.  One pass over the rows gives several prototypes; what is
    more than MAX_PROTOTYPES after that is a ValueError.
    """
    if init not in INITS:
        raise ValueError(f"unknown init {init!r}; one of {', '.join(INITS)}")
    n = rows.count()
    k = min(k, n)
    if k > MAX_PROTOTYPES:
        raise ValueError(f"more than {MAX_PROTOTYPES} prototypes")
    if k < 1:
        return []
    size = vector_size(rows, vector)
    if init == "medoid":
        first = _ends(rows.select(index, vector), index, vector, size, centroid(rows, vector)[None, :], "euclidean", False)[0][1:]
    else:
        first = _start(rows, index, vector, int(np.random.RandomState(seed).randint(n)))
    return _traverse(rows.select(index, vector), index, vector, size, first, k, "euclidean")


def kcenter_greedy(rows: DataFrame, k: int, *, metric: str = "euclidean", seed: int = 1234, start: int | None = None, index: str = "video_idx", vector: str = "z") -> list[tuple[int, np.ndarray]]:
    """Centres (index, vector) from a seeded random start (or a given one), then always the row farthest from all centres.

    With ``k`` of at least the number of rows all rows in index order.  ``k`` below 1 is a ValueError.
    """
    if metric not in METRICS:
        raise ValueError(f"unknown metric {metric!r}; one of {', '.join(METRICS)}")
    if k < 1:
        raise ValueError("k must be at least 1")
    n = rows.count()
    if k >= n:
        return [(r["i"], np.array(r["z"])) for r in rows.select(F.col(index).alias("i"), F.col(vector).alias("z")).orderBy("i").collect()]
    size = vector_size(rows, vector)
    at = int(np.random.RandomState(seed).randint(n)) if start is None else start
    return _traverse(rows.select(index, vector), index, vector, size, _start(rows, index, vector, at), k, metric)


def prototype_table(spark, prototypes: list[tuple[int, np.ndarray]]) -> DataFrame:
    """``prototype_id`` (pick order) and ``video_idx``."""
    return spark.createDataFrame([(i, int(v)) for i, (v, _) in enumerate(prototypes)], "prototype_id int, video_idx long")


def prototype_distances(rows: DataFrame, prototypes: list[tuple[int, np.ndarray]], *, index: str = "video_idx", vector: str = "z", metric: str = "euclidean") -> DataFrame:
    """``index`` and ``d``, the distances to all prototypes in pick order.  Prototypes are bounded, rows aren't shuffled."""
    points = np.array([z for _, z in prototypes])
    shared = rows.sparkSession.sparkContext.broadcast(points)
    size = points.shape[1]
    schema = T.StructType([rows.schema[index], T.StructField("d", T.ArrayType(T.DoubleType()))])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = linalg.matrix_of(batch.column(1), size)
            d = np.stack([DISTANCE[metric](x, p) for p in shared.value], axis=1) if len(x) else np.zeros((0, len(shared.value)))
            yield pa.RecordBatch.from_arrays([batch.column(0), linalg.list_of(d)], names=[index, "d"])

    return rows.select(index, vector).mapInArrow(run, schema)


def assign_strata(rows: DataFrame, prototypes: list[tuple[int, np.ndarray]], *, index: str = "video_idx", vector: str = "z") -> DataFrame:
    """``index, stratum_id, is_prototype, dist_to_prototype``: the nearest prototype, the lowest on a tie."""
    d = prototype_distances(rows, prototypes, index=index, vector=vector)
    least = F.array_min("d")
    heads = [int(v) for v, _ in prototypes]
    return d.select(index, (F.array_position("d", least) - 1).cast("int").alias("stratum_id"), F.col(index).isin(heads).cast("int").alias("is_prototype"), least.alias("dist_to_prototype"))


COVERAGE = ("mean_dist", "max_dist", "p95_dist", "min_size", "singleton_frac", "n_strata")


def coverage_metrics(strata: DataFrame, *groups: str) -> DataFrame:
    """``mean_dist, max_dist, p95_dist, min_size, singleton_frac, n_strata`` over the observed strata (of each group).

    The singleton fraction is that of strata with one member.
    """
    sizes = strata.groupBy(*groups, "stratum_id").agg(F.count("*").alias("size"))
    by_size = sizes.groupBy(*groups).agg(F.min("size").alias("min_size"), F.avg(F.when(F.col("size") == 1, 1.0).otherwise(0.0)).alias("singleton_frac"), F.count("*").alias("n_strata"))
    d = "dist_to_prototype"
    by_dist = strata.groupBy(*groups).agg(F.avg(d).alias("mean_dist"), F.max(d).alias("max_dist"))
    # an aggregate without groups, or with few, would gather all distances in as many tasks
    p95 = pooling.spread_percentile(strata, groups, d, 0.95).withColumnRenamed("score", "p95_dist")
    if groups:
        return by_dist.join(p95, list(groups)).join(by_size, list(groups)).select(*groups, *COVERAGE)
    return by_dist.join(p95, how="left").crossJoin(by_size).select(*COVERAGE)  # of one row each


def stratum_sizes(strata: DataFrame) -> DataFrame:
    return strata.groupBy("stratum_id").agg(F.count("*").alias("n_videos"))


def size_histogram(strata: DataFrame) -> DataFrame:
    """One row with ``stratum_sizes``, a map from stratum to size."""
    return stratum_sizes(strata).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("stratum_id", "n_videos")))).alias("stratum_sizes"))


def k_sweep(rows: DataFrame, prototypes: list[tuple[int, np.ndarray]], *, index: str = "video_idx", vector: str = "z") -> DataFrame:
    """Coverage of the first K prototypes for every K, from one pass over the rows: running minima of one distance array."""
    points = np.array([z for _, z in prototypes])
    shared = rows.sparkSession.sparkContext.broadcast(points)
    size = points.shape[1]
    schema = T.StructType([T.StructField("d", T.ArrayType(T.DoubleType())), T.StructField("s", T.ArrayType(T.IntegerType()))])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = linalg.matrix_of(batch.column(0), size)
            d = np.stack([euclidean(x, p) for p in shared.value], axis=1) if len(x) else np.zeros((0, len(shared.value)))
            least = np.minimum.accumulate(d, axis=1)
            fresh = np.ones(d.shape, dtype=bool)
            fresh[:, 1:] = d[:, 1:] < least[:, :-1]  # on a tie the earlier prototype stays
            nearest = np.maximum.accumulate(np.where(fresh, np.arange(d.shape[1]), 0), axis=1)
            offsets = pa.array(np.arange(len(x) + 1, dtype=np.int32) * d.shape[1])
            yield pa.RecordBatch.from_arrays([linalg.list_of(least), pa.ListArray.from_arrays(offsets, pa.array(nearest.ravel().astype(np.int32)))], names=schema.names)

    both = cut(rows.select(vector).mapInArrow(run, schema))
    every = both.select(F.posexplode(F.arrays_zip("d", "s")).alias("k", "x"))
    labelled = every.select((F.col("k") + 1).cast("int").alias("K"), F.col("x.s").alias("stratum_id"), F.col("x.d").alias("dist_to_prototype"))
    return coverage_metrics(labelled, "K").drop("n_strata")


def choose_k(sweep: DataFrame, n: int, *, min_stratum_size: int = 3, target_max_dist: float = 0.35) -> int:
    """Smallest feasible K within the target; else the feasible K with the least maximum; else 1.

    Feasible means that every stratum has ``min_stratum_size`` members.  The sweep has one row per K.
    """
    feasible = sweep.where(F.col("min_size") >= min_stratum_size)
    order = feasible.orderBy(F.when(F.col("max_dist") <= target_max_dist, 0).otherwise(1), F.when(F.col("max_dist") <= target_max_dist, F.lit(0.0)).otherwise(F.col("max_dist")), "K")
    row = order.select("K").first()
    return int(row["K"]) if row else 1


@dataclass(frozen=True)
class Strata:
    prototypes: list[tuple[int, np.ndarray]]
    strata: DataFrame
    sweep: DataFrame | None
    n_strata: int


def make_strata(rows: DataFrame, *, n_strata: int | str = "auto", init: str = "medoid", min_stratum_size: int = 3, target_max_dist: float = 0.35, cap: int | None = None, seed: int | None = None, index: str = "video_idx", vector: str = "z") -> Strata:
    """Strata of an embedding, their number given (clamped to the rows) or chosen by the sweep up to ``cap`` (20).

    More than MAX_PROTOTYPES are a ValueError.
    """
    n = rows.count()
    limit = min(n, 20) if cap is None else min(n, cap)
    if n_strata != "auto":
        k = max(1, min(int(n_strata), n))
        prototypes = farthest_first(rows, max(limit, k), init=init, seed=seed, index=index, vector=vector)
        return Strata(prototypes[:k], assign_strata(rows, prototypes[:k], index=index, vector=vector), None, k)
    prototypes = farthest_first(rows, limit, init=init, seed=seed, index=index, vector=vector)
    sweep = cut(k_sweep(rows, prototypes, index=index, vector=vector))
    k = choose_k(sweep, n, min_stratum_size=min_stratum_size, target_max_dist=target_max_dist)
    return Strata(prototypes[:k], assign_strata(rows, prototypes[:k], index=index, vector=vector), sweep, k)


def prototype_coverage(rows: DataFrame, strata: DataFrame, prototypes: list[tuple[int, np.ndarray]], *, index: str = "video_idx", vector: str = "z") -> DataFrame:
    """Per stratum: ``n_videos`` and mean, max and min cosine distance of its members to its own prototype."""
    d = prototype_distances(rows, prototypes, index=index, vector=vector, metric="cosine")
    own = strata.select(index, "stratum_id").join(d, index).select("stratum_id", F.element_at("d", F.col("stratum_id") + 1).alias("c"))
    return own.groupBy("stratum_id").agg(F.count("*").alias("n_videos"), F.avg("c").alias("mean_dist"), F.max("c").alias("max_dist"), F.min("c").alias("min_dist"))


def stratum_centroids(rows: DataFrame, strata: DataFrame, *, index: str = "video_idx", vector: str = "z") -> DataFrame:
    """Per stratum: its size and the length of its mean vector."""
    cells = rows.join(strata.select(index, "stratum_id"), index).select("stratum_id", F.posexplode(vector).alias("j", "v"))
    means = cells.groupBy("stratum_id", "j").agg(F.avg("v").alias("v"), F.count("*").alias("n"))
    return means.groupBy("stratum_id").agg(F.max("n").alias("n_videos"), F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("centroid_norm"))
