"""Compilations: greedy, duration-bounded, balanced selection around spread-out anchors.

The algorithm is sequential: every pick depends on all picks before it.  What is parallel is a pick: scoring all
candidates.  Up to ``local_rows`` videos the rows (a few numbers each) are scored in numpy on the driver; beyond, every
pick is one distributed aggregate over the cached rows.  Both ways share one loop and give the same picks.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelquilt.operators import linalg
from reelquilt.operators.strata import cosine, kcenter_greedy, vector_size
from reelquilt.plans.materialize import cut

LOCAL_ROWS = 200_000
EPS = 1e-6


def zscore_columns(rows: DataFrame, *, index: str = "video_idx", vector: str = "z") -> DataFrame:
    """Vectors less their columns' means, over population standard deviation plus 1e-8."""
    size = vector_size(rows, vector)
    got = linalg.moments(rows, vector, size)
    mean, scale = got.mean, np.sqrt(np.maximum(np.diag(got.covariance), 0)) + 1e-8
    shift, factor = F.array(*(F.lit(float(m)) for m in mean)), F.array(*(F.lit(float(s)) for s in scale))
    return rows.withColumn(vector, F.zip_with(F.zip_with(F.col(vector), shift, lambda x, m: x - m), factor, lambda x, s: x / s))


@dataclass
class State:
    anchor: np.ndarray
    anchor_reach: float
    usage: dict[int, int]
    picked: list[int] = field(default_factory=list)
    vectors: list[np.ndarray] = field(default_factory=list)
    counts: dict[int, int] = field(default_factory=dict)
    total: float = 0.0


def scores_of(x: np.ndarray, ids: np.ndarray, strata: np.ndarray, state: State, coherence: float, diversity: float) -> np.ndarray:
    """Score of each candidate: nearness to the anchor, distance from what is picked, rarely used videos and strata.

    Logarithms at nine digits: once the anchor is picked, nearness and distance often cancel out but for rounding errors,
    and such ties must not depend on how sums were ordered.
    """
    q = 1.0 / (cosine(x, state.anchor) + EPS)
    gain = np.min([cosine(x, v) for v in state.vectors], axis=0) if state.vectors else np.full(len(x), state.anchor_reach)
    used = np.array([state.usage.get(int(i), 0) for i in ids], dtype=float)
    taken = np.array([state.counts.get(int(s), 0) for s in strata], dtype=float)
    return np.round(coherence * np.log(q) + diversity * np.log(gain + EPS) - np.log1p(used) - np.log1p(taken), 9) + 0.0


class _Local:
    def __init__(self, rows: DataFrame, size: int):
        held = rows.orderBy("video_idx").toArrow()
        self.ids, self.strata = held.column("video_idx").to_numpy(), held.column("stratum_id").to_numpy()
        self.secs, self.x = held.column("secs").to_numpy(), linalg.matrix_of(held.column("z").combine_chunks(), size)

    def reach(self, anchor: np.ndarray) -> float:
        return float(cosine(self.x, anchor).max())

    def best(self, state: State, room: float, stratum: int | None, powers: tuple[float, float]):
        open_ = (self.secs > 0) & (state.total + self.secs <= room) & ~np.isin(self.ids, state.picked)
        if stratum is not None:
            open_ &= self.strata == stratum
        at = np.flatnonzero(open_)
        if not len(at):
            return None
        i = at[int(scores_of(self.x[at], self.ids[at], self.strata[at], state, *powers).argmax())]
        return int(self.ids[i]), int(self.strata[i]), float(self.secs[i]), self.x[i]


class _Distributed:
    def __init__(self, rows: DataFrame, size: int):
        self.rows, self.size = rows.select("video_idx", "stratum_id", "secs", "z"), size

    def reach(self, anchor: np.ndarray) -> float:
        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield pa.RecordBatch.from_arrays([pa.array([float(cosine(linalg.matrix_of(b.column(3), self_size), anchor).max(initial=0))])], names=["d"])

        self_size = self.size
        return self.rows.mapInArrow(run, "d double").agg(F.max("d")).first()[0]

    def best(self, state: State, room: float, stratum: int | None, powers: tuple[float, float]):
        size = self.size

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if not b.num_rows:
                    continue
                ids = b.column(0).to_numpy(zero_copy_only=False)
                s = scores_of(linalg.matrix_of(b.column(3), size), ids, b.column(1).to_numpy(zero_copy_only=False), state, *powers)
                at = np.flatnonzero(s == s.max())
                pick = pa.array([int(at[ids[at].argmin()])])
                yield pa.RecordBatch.from_arrays([pa.array([float(s.max())]), *(b.column(i).take(pick) for i in range(4))], names=["score", "i", "s", "secs", "z"])

        rows = self.rows.where((F.col("secs") > 0) & (F.lit(state.total) + F.col("secs") <= room))
        if state.picked:
            rows = rows.where(~F.col("video_idx").isin(state.picked))
        if stratum is not None:
            rows = rows.where(F.col("stratum_id") == stratum)
        found = rows.mapInArrow(run, "score double, i long, s int, secs double, z array<double>")
        s = found.agg(F.max_by(F.struct("i", "s", "secs", "z"), F.struct("score", (-F.col("i")).alias("o"))).alias("x")).first()["x"]
        return None if s is None else (int(s["i"]), int(s["s"]), float(s["secs"]), np.array(s["z"]))


def select_compilations(
    videos: DataFrame,
    *,
    n_compilations: int = 10,
    min_seconds: float = 55.0,
    max_seconds: float = 65.0,
    anchor_metric: str = "euclidean",
    coherence_power: float = 1.0,
    diversity_power: float = 1.0,
    seed: int | None = None,
    local_rows: int = LOCAL_ROWS,
) -> DataFrame:
    """``comp_id, anchor_idx, pick_order, video_idx, stratum_id, secs`` of every member.

    ``videos`` has ``video_idx`` (counted from 0), ``z``, ``stratum_id`` and ``duration_s`` (null counts as 0, and 0 is never
    picked).  Per compilation the strata are visited once in a seeded order, each giving its best candidate that fits
    under the maximum; while the minimum isn't met the best of all candidates is added.  A compilation may stay below the
    minimum if nothing fits.  Ties (scores that agree to nine digits) go to the lowest index.
    """
    if n_compilations < 1:
        raise ValueError("n_compilations must be at least 1")
    seed = seed or 1234
    spark = videos.sparkSession
    rows = zscore_columns(videos.select("video_idx", "z", "stratum_id", F.coalesce("duration_s", F.lit(0.0)).alias("secs")))
    rows = cut(rows.select(F.col("video_idx").cast("long").alias("video_idx"), "z", F.col("stratum_id").cast("int").alias("stratum_id"), "secs"))
    schema = "comp_id int, anchor_idx long, pick_order int, video_idx long, stratum_id int, secs double"
    n = rows.count()
    if not n:
        return spark.createDataFrame([], schema)
    size = vector_size(rows, "z")
    n_strata = rows.select("stratum_id").distinct().count()
    anchors = kcenter_greedy(rows, n_compilations, metric=anchor_metric, seed=seed)
    engine = _Local(rows, size) if n <= local_rows else _Distributed(rows, size)
    powers, usage, out = (coherence_power, diversity_power), {}, []
    for c, (anchor_idx, anchor) in enumerate(anchors):
        state = State(anchor, engine.reach(anchor), usage)
        order = list(range(n_strata))
        np.random.default_rng(seed + c).shuffle(order)

        def take(found) -> None:
            i, stratum, secs, z = found
            out.append((c, int(anchor_idx), len(state.picked), i, stratum, secs))
            state.picked.append(i), state.vectors.append(z)
            state.counts[stratum] = state.counts.get(stratum, 0) + 1
            state.total += secs

        for stratum in order:
            if state.total >= max_seconds:
                break
            if (found := engine.best(state, max_seconds, stratum, powers)) is not None:
                take(found)
        while state.total < min_seconds and len(state.picked) < n:
            if (found := engine.best(state, max_seconds, None, powers)) is None:
                break
            take(found)
        for i in state.picked:
            usage[i] = usage.get(i, 0) + 1
    return spark.createDataFrame(out, schema)


def compilation_headers(members: DataFrame) -> DataFrame:
    """``comp_id, anchor_idx, n_members, total_seconds, n_strata_covered``."""
    return members.groupBy("comp_id", "anchor_idx").agg(F.count("*").alias("n_members"), F.sum("secs").alias("total_seconds"), F.countDistinct("stratum_id").alias("n_strata_covered"))


def nested_compilations(members: DataFrame) -> DataFrame:
    """``comp_id, anchor_idx, total_seconds, members``, the members (idx, secs) in the order they were picked."""
    packed = F.sort_array(F.collect_list(F.struct("pick_order", F.col("video_idx").alias("idx"), "secs")))
    grouped = members.groupBy("comp_id", "anchor_idx").agg(F.sum("secs").alias("total_seconds"), packed.alias("m"))
    return grouped.select("comp_id", "anchor_idx", "total_seconds", F.transform("m", lambda x: F.struct(x["idx"].alias("idx"), x["secs"].alias("secs"))).alias("members"))


def usage_counts(members: DataFrame) -> DataFrame:
    return members.groupBy("video_idx").agg(F.count("*").alias("usage"))


def duration_summary(members: DataFrame) -> DataFrame:
    totals = members.groupBy("comp_id").agg(F.sum("secs").alias("t"))
    return totals.agg(F.count("*").alias("n_compilations"), F.avg("t").alias("mean_seconds"), F.min("t").alias("min_seconds"), F.max("t").alias("max_seconds"))
