"""From frame scores to video scores."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from reelquilt.config import POOLING
from reelquilt.plans.materialize import cut
from reelquilt.plans.ranking import number_from_zero
from reelquilt.schemas import require_columns


def pooled(score: Column, method: str = "percentile", percentile: float = 95) -> Column:
    """Aggregate expression of a pooling method; percentiles interpolate linearly.  Unknown methods are a ValueError."""
    if method not in POOLING:
        raise ValueError(f"unknown aggregation {method!r}; one of {', '.join(POOLING)}")
    if method == "percentile":
        return F.percentile(score, F.lit(percentile / 100.0))
    return {"mean": F.avg, "median": F.median, "max": F.max, "min": F.min}[method](score)


#: Groups with more rows than this are pooled by ranks: an exact percentile otherwise holds a group's values in one task.
HOT_ROWS = 5_000_000
_BINS = 4096


def hot_percentiles(rows: DataFrame, p: float, hot: DataFrame, *, most: int = HOT_ROWS) -> DataFrame:
    """Exact percentiles of very large groups: ``key, score`` for the groups of ``hot`` (``key, n, low, high``).

    Each pass counts a group's values in equal bins (pre-aggregated before the shuffle) and keeps the stretch of bins that
    holds the two ranks the percentile lies between, until what is left of a group is small or has one value only.
    """
    rank = F.col("n") - 1
    hot = cut(hot.select("key", "low", "high", F.floor(rank * p).cast("long").alias("r0"), F.ceil(rank * p).cast("long").alias("r1"), (rank * p - F.floor(rank * p)).alias("w"), F.lit(0).cast("long").alias("below")))
    rows = rows.join(F.broadcast(hot.select("key")), "key", "left_semi")
    same = F.col("low") == F.col("high")
    inside = F.col("v").between(F.col("low"), F.col("high"))
    for _ in range(12):
        placed = rows.join(F.broadcast(hot), "key").where(inside)
        step = (F.col("high") - F.col("low")) / _BINS
        place = F.when(same, F.lit(0)).otherwise(F.least(F.floor((F.col("v") - F.col("low")) / F.nullif(step, F.lit(0.0))).cast("int"), F.lit(_BINS - 1)))
        bins = placed.groupBy("key", place.alias("bin")).agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
        ahead = F.sum("n").over(W.partitionBy("key").orderBy("bin").rowsBetween(W.unboundedPreceding, 0))
        at = bins.withColumn("upto", ahead).join(F.broadcast(hot.select("key", "r0", "r1", "w", "below")), "key")
        held = at.where((F.col("below") + F.col("upto") > F.col("r0")) & (F.col("below") + F.col("upto") - F.col("n") <= F.col("r1")))
        narrowed = held.groupBy("key", "r0", "r1", "w").agg(F.min("lo").alias("low"), F.max("hi").alias("high"), F.min(F.col("below") + F.col("upto") - F.col("n")).alias("below"), F.sum("n").alias("left"))
        narrowed = cut(narrowed)
        hot = narrowed.select("key", "low", "high", "r0", "r1", "w", "below")
        if narrowed.where((F.col("left") > most) & (F.col("low") < F.col("high"))).isEmpty():
            break
    ranked = rows.join(F.broadcast(hot), "key").where(inside).groupBy("key", "v", "r0", "r1", "w", "below").agg(F.count("*").alias("n"))
    upto = F.col("below") + F.sum("n").over(W.partitionBy("key").orderBy("v").rowsBetween(W.unboundedPreceding, 0))
    ranked = ranked.withColumn("upto", upto)
    value = lambda r: F.min(F.when(F.col("upto") > F.col(r), F.col("v")))
    ends = ranked.groupBy("key", "w").agg(value("r0").alias("v0"), value("r1").alias("v1"))
    return ends.select("key", (F.col("v0") + (F.col("v1") - F.col("v0")) * F.col("w")).alias("score"))


def spread_percentile(rows: DataFrame, groups: Sequence[str], value: str, p: float) -> DataFrame:
    """The columns ``groups`` and ``score``, the exact percentile of each group, for few groups (or none) of any size.

    Unlike the aggregate function it never gathers a group's values in one task (:func:`hot_percentiles`).
    """
    keyed = rows.select(F.struct(*(F.col(g) for g in groups), F.lit(0).alias("__one")).alias("key"), F.col(value).cast("double").alias("v")).where("v is not null")
    spans = keyed.groupBy("key").agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
    return hot_percentiles(keyed, p, spans).select(*(F.col(f"key.{g}").alias(g) for g in groups), "score")


def pool_scores(
    scores: DataFrame,
    method: str = "percentile",
    percentile: float = 95,
    *,
    group: str = "video_id",
    feature: str = "statement_index",
    value: str = "score",
    keys: DataFrame | None = None,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """One row per group and feature: both keys and ``score``.

    Zero scores of undecodable frames take part like any others; null scores don't, a group with nothing else has a null
    score.  NaN is an error of the data and is refused.  Percentiles and medians are exact however large a group is:
    groups of more than ``hot_rows`` rows go through :func:`hot_percentiles`.  They are looked for in the two columns of
    ``keys``, a table that has at least the groups' rows (such as the stored one that ``scores`` are the distinct rows of,
    which is cheaper to count); by default ``scores`` themselves.
    """
    require_columns(scores, [group, feature, value], "scores")
    checked = F.when(F.isnan(F.col(value).cast("double")), F.raise_error(F.lit("NaN score"))).otherwise(F.col(value).cast("double"))
    expression = pooled(checked, method, percentile)
    if method in ("percentile", "median"):
        # Both keys as one struct, which is never null itself, so that null keys are groups here too.
        rows = scores.select(F.struct(F.col(group).alias("g"), F.col(feature).alias("f")).alias("key"), checked.alias("v"))
        counted = rows if keys is None else keys.select(F.struct(F.col(group).alias("g"), F.col(feature).alias("f")).alias("key"))
        # a stored table's rows are counted by its metadata: where there are few in all, no group has more
        large = [] if keys is not None and keys.count() <= hot_rows else counted.select("key").groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > hot_rows).select("key").collect()
        if large:
            names = F.broadcast(scores.sparkSession.createDataFrame([(r["key"],) for r in large], rows.select("key").schema))
            crowded = rows.where("v is not null").join(names, "key", "left_semi")
            spans = crowded.groupBy("key").agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
            hot = hot_percentiles(crowded, 0.5 if method == "median" else percentile / 100.0, spans, most=hot_rows)
            cool = rows.join(names, "key", "left_anti").groupBy("key").agg(pooled(F.col("v"), method, percentile).alias("score"))
            valueless = rows.join(names, "key", "left_semi").groupBy("key").agg(F.count("v").alias("n")).where("n = 0").select("key", F.lit(None).cast("double").alias("score"))
            return cool.unionByName(hot).unionByName(valueless).select(F.col("key.g").alias(group), F.col("key.f").alias(feature), "score")
    return scores.groupBy(group, feature).agg(expression.alias("score"))


def video_index(rows: DataFrame, key: str = "video_id") -> DataFrame:
    """``video_id, video_idx``: distinct ids counted from 0 in the order of their code points."""
    ids = rows.select(F.col(key).alias("video_id")).where("video_id is not null").distinct()
    return number_from_zero(ids, "video_id", "video_idx").withColumn("video_idx", F.col("video_idx").cast("int"))


def frames_per_video(frames: DataFrame) -> DataFrame:
    """Frames, videos and the distribution of frames per video, as one row."""
    sizes = frames.groupBy("video_id").agg(F.count("*").alias("n"))
    return sizes.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_frames"),
        F.count("*").alias("n_videos"),
        F.avg("n").alias("mean_frames"),
        F.median("n").alias("median_frames"),
        F.min("n").alias("min_frames"),
        F.max("n").alias("max_frames"),
        F.percentile("n", F.lit(0.25)).alias("p25_frames"),
        F.percentile("n", F.lit(0.5)).alias("p50_frames"),
        F.percentile("n", F.lit(0.75)).alias("p75_frames"),
    )


def score_statistics(scores: DataFrame, value: str = "score") -> DataFrame:
    v = F.col(value)
    return scores.agg(F.avg(v).alias("mean_score"), F.stddev_pop(v).alias("std_score"), F.min(v).alias("min_score"), F.max(v).alias("max_score"))


def _top(rows: DataFrame, n: int, by: str, *ties: str) -> DataFrame:
    return rows.orderBy(F.desc(by), *ties).limit(n)


def top_frames(scores: DataFrame, n: int = 5) -> DataFrame:
    """Frames with the greatest score for any statement; ties by video and frame."""
    return _top(scores.groupBy("video_id", "frame_idx").agg(F.max("score").alias("max_score")), n, "max_score", "video_id", "frame_idx")


def top_statements(scores: DataFrame, n: int = 5, statements: DataFrame | None = None) -> DataFrame:
    """Statements with the greatest mean score; with a dimension of statements also their first 50 characters.

    ``statements`` is joined after the top rows are known; a statement it doesn't have is called ``Scene <index>``.
    """
    top = _top(scores.groupBy("statement_index").agg(F.avg("score").alias("mean_score")), n, "mean_score", "statement_index")
    if statements is None:
        return top
    fallback = F.concat(F.lit("Scene "), F.col("statement_index").cast("string"))
    text = F.substring(F.coalesce("statement", fallback), 1, 50)
    return top.join(statements.select("statement_index", "statement"), "statement_index", "left").select("statement_index", text.alias("statement"), "mean_score")


def best_statements(scores: DataFrame, key: str = "video_id") -> DataFrame:
    """``best_statement`` (the first on a tie) and ``max_score`` of each video."""
    best = F.max_by("statement_index", F.struct(F.col("score"), -F.col("statement_index"))).alias("best_statement")
    return scores.where("score is not null").groupBy(key).agg(F.max("score").alias("max_score"), best)


def top_videos(scores: DataFrame, n: int = 5, key: str = "video_id") -> DataFrame:
    return _top(best_statements(scores, key), n, "max_score", key)


def statement_preference(scores: DataFrame, n: int | None = 5, key: str = "video_id") -> DataFrame:
    """How many videos have each statement as their best; the ``n`` most frequent, or all."""
    counted = best_statements(scores, key).groupBy("best_statement").agg(F.count("*").alias("n_videos"))
    return counted if n is None else _top(counted, n, "n_videos", "best_statement")
