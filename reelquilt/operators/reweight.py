"""Centring and variance-based statement weights."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window as W
from pyspark.sql import functions as F

from reelquilt.config import CENTERING
from reelquilt.operators import linalg
from reelquilt.schemas import SPECTRUM, STATEMENT_WEIGHTS

EPS = 1e-8


def center_scores(scores: DataFrame, mode: str = "col", *, row: str = "video_idx", column: str = "statement_index", value: str = "score") -> DataFrame:
    """Scores less their column's mean (``col``), their row's (``row``), both plus the grand mean (``both``) or as they are.

    Column means and the grand mean are aggregated before they are joined (the statements are a small dimension), so no
    window gathers a whole column in one task; row means are a window over a row's own statements.
    """
    if mode not in CENTERING:
        raise ValueError(f"unknown centering {mode!r}; one of {', '.join(CENTERING)}")
    if mode == "none":
        return scores
    out = scores
    if mode in ("row", "both"):
        out = out.withColumn("row_mean", F.avg(value).over(W.partitionBy(row)))
    shift = F.col("row_mean") if mode == "row" else F.col("col_mean")
    if mode in ("col", "both"):
        out = out.join(scores.groupBy(column).agg(F.avg(value).alias("col_mean")), column)
    if mode == "both":
        out = out.crossJoin(scores.agg(F.avg(value).alias("grand_mean")))  # one row
        shift = F.col("row_mean") + F.col("col_mean") - F.col("grand_mean")
    return out.withColumn(value, F.col(value) - shift).select(*scores.columns)


@dataclass(frozen=True)
class Weights:
    statements: list
    weight: np.ndarray
    communality: np.ndarray
    evr: np.ndarray
    k95: int
    k_selected: int
    max_components: int
    n_videos: int

    def table(self, spark) -> DataFrame:
        """``statement_index, weight, communality``."""
        return spark.createDataFrame([(int(s), float(w), float(c)) for s, w, c in zip(self.statements, self.weight, self.communality)], STATEMENT_WEIGHTS)

    def spectrum(self, spark) -> DataFrame:
        """``component`` (from 1), ``evr, cum_evr``."""
        return spark.createDataFrame([(i + 1, float(e), float(c)) for i, (e, c) in enumerate(zip(self.evr, np.cumsum(self.evr)))], SPECTRUM)


def statement_weights(scores: DataFrame, *, variance_threshold: float = 0.95, component_cap: int = 32, beta: float = 0.5, row: str = "video_idx", column: str = "statement_index", value: str = "score") -> Weights:
    """Weights from the communality of each statement in the leading components of the (centred) scores.

    Components come from the uncentred Gram matrix; the variance a component explains is that of the projected rows about
    their mean.  k95 is the first component at which the explained share reaches the threshold, within 1 and the limit.
    Weight is (communality + eps)^(beta / 2), divided by its mean plus eps.  Without variance: one component, share 0,
    equal weights.
    """
    vectors, statements = linalg.packed(scores, row=row, column=column, value=value)
    m = len(statements)
    got = linalg.moments(vectors, "x", m)
    limit = linalg.component_limit(got.n, m)
    total = float(np.trace(got.covariance))
    v = linalg.right_vectors(got.gram, limit)
    explained = np.maximum(np.einsum("ij,ik,kj->j", v, got.covariance, v), 0)
    if total <= 1e-300:
        evr, k95 = np.zeros(limit), 1
        explained = np.zeros(limit)
    else:
        evr = explained / total
        reached = np.flatnonzero(np.cumsum(evr) >= variance_threshold)
        k95 = int(np.clip((reached[0] + 1) if len(reached) else limit, 1, limit))
    k = min(k95, component_cap, limit)
    communality = (v[:, :k] ** 2) @ explained[:k]
    w = np.sqrt(communality + EPS) ** beta
    return Weights(statements, w / (w.mean() + EPS), communality, evr, k95, k, limit, got.n)


def apply_weights(scores: DataFrame, weights: DataFrame, *, column: str = "statement_index", value: str = "score") -> DataFrame:
    """Scores times the weight of their statement (a dimension with one row per statement)."""
    return scores.join(weights.select(column, "weight"), column).withColumn(value, F.col(value) * F.col("weight")).select(*scores.columns)


def reweight_report(weights: Weights, spark, *, centering: str, variance_threshold: float, component_cap: int, beta: float) -> DataFrame:
    return spark.createDataFrame(
        [(centering, variance_threshold, weights.k95, weights.k_selected, component_cap, weights.max_components, beta, weights.n_videos, len(weights.statements))],
        "centering string, variance_threshold double, k95 int, k_selected int, k_cap int, max_components int, beta double, n_videos long, n_statements int",
    )
