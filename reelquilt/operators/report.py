"""Reports of every step as tables."""

from __future__ import annotations

import warnings
from collections.abc import Mapping

from pyspark.sql import DataFrame, Window as W
from pyspark.sql import functions as F

from reelquilt.operators import pooling, selection, strata

# The names under which a step's report can be asked for.
ALIASES = {
    "import": "import", "normalize": "import", "step1": "import", "step1a": "import",
    "frames": "frames", "frame_extraction": "frames", "step1b": "frames",
    "encoding": "encoding", "clip": "encoding", "step2": "encoding",
    "aggregate": "aggregate", "aggregation": "aggregate", "step3": "aggregate",
    "svd": "svd", "reduce": "svd", "reweight": "svd", "step4": "svd",
    "strata": "strata", "step5": "strata",
    "compilations": "compilations", "compile": "compilations", "compilation_selection": "compilations", "step6": "compilations",
}


def import_report(manifest: DataFrame) -> dict[str, DataFrame]:
    """Settings and the number of videos imported."""
    return {"settings": manifest.groupBy("settings").agg(F.count("*").alias("n_videos"))}


def frames_report(frames: DataFrame) -> dict[str, DataFrame]:
    return {"frames": pooling.frames_per_video(frames)}


def encoding_report(scores: DataFrame, statements: DataFrame | None = None, top_n: int = 5) -> dict[str, DataFrame]:
    return {"statistics": pooling.score_statistics(scores), "top_frames": pooling.top_frames(scores, top_n), "top_statements": pooling.top_statements(scores, top_n, statements)}


def aggregate_report(video_scores: DataFrame, top_n: int = 5) -> dict[str, DataFrame]:
    return {"statistics": pooling.score_statistics(video_scores), "top_videos": pooling.top_videos(video_scores, top_n), "preference": pooling.statement_preference(video_scores, top_n)}


def components(embedding: DataFrame, vector: str = "z") -> DataFrame:
    """Long form of an embedding: its other columns, ``component`` and ``value``."""
    return embedding.select(*(c for c in embedding.columns if c != vector), F.posexplode(vector).alias("component", "value"))


def component_statistics(embedding: DataFrame, first: int | None = 5) -> DataFrame:
    """Mean and population standard deviation of each of the first components (all, if None)."""
    rows = components(embedding)
    rows = rows if first is None else rows.where(F.col("component") < first)
    return rows.groupBy("component").agg(F.avg("value").alias("mean_value"), F.stddev_pop("value").alias("std_value"))


def svd_report(embedding: DataFrame) -> dict[str, DataFrame]:
    return {"statistics": pooling.score_statistics(components(embedding), "value"), "components": component_statistics(embedding)}


def strata_report(labels: DataFrame) -> dict[str, DataFrame]:
    return {"sizes": strata.stratum_sizes(labels)}


def compilations_report(members: DataFrame) -> dict[str, DataFrame]:
    return {"durations": selection.duration_summary(members), "compilations": selection.compilation_headers(members)}


def component_correlation(scores: DataFrame, embedding: DataFrame, *, row: str = "video_idx", column: str = "statement_index", value: str = "score") -> DataFrame:
    """``statement_index, component, correlation`` (Pearson) of scores and components; null where either is constant."""
    joined = scores.select(row, column, F.col(value).alias("s")).join(components(embedding.select(row, "z")), row)
    spread = F.stddev_pop("s") * F.stddev_pop("value")
    return joined.groupBy(column, "component").agg((F.covar_pop("s", "value") / F.nullif(spread, F.lit(0.0))).alias("correlation"))


def top_loadings(correlations: DataFrame, n: int = 5, column: str = "statement_index") -> DataFrame:
    """The ``n`` statements with the greatest absolute correlation per component, with ``rank`` and ``sign``."""
    order = W.partitionBy("component").orderBy(F.desc(F.abs("correlation")), column)
    ranked = correlations.where("correlation is not null").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)
    return ranked.withColumn("sign", F.when(F.col("correlation") >= 0, "+").otherwise("-"))


def coverage_report(coverage: DataFrame) -> DataFrame:
    """One row over strata: the mean of their mean distances and the greatest of their greatest."""
    return coverage.agg(F.avg("mean_dist").alias("mean_of_means"), F.max("max_dist").alias("max_of_max"), F.count("*").alias("n_strata"))


def summary(context: Mapping[str, DataFrame], step: str, top_n: int = 5) -> dict[str, DataFrame]:
    """Report of a step from the tables of a run; an unknown step, or one whose table isn't there, warns and is empty."""
    name = ALIASES.get(step.lower())
    if name is None:
        warnings.warn(f"unknown step {step!r}", stacklevel=2)
        return {}
    needs = {"import": "manifest", "frames": "frames", "encoding": "frame_scores", "aggregate": "video_scores", "svd": "embedding", "strata": "strata", "compilations": "compilation_members"}[name]
    if context.get(needs) is None:
        warnings.warn(f"no {needs} yet: the step before {name} hasn't run", stacklevel=2)
        return {}
    rows = context[needs]
    if name == "encoding":
        return encoding_report(rows, context.get("statements"), top_n)
    if name == "aggregate":
        return aggregate_report(rows, top_n)
    return {"import": import_report, "frames": frames_report, "svd": svd_report, "strata": strata_report, "compilations": compilations_report}[name](rows)
