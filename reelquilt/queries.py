"""Queries of the engine's own operators over the project's tables, with their SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from reelquilt import pipeline_queries
from reelquilt.operators import compaction
from reelquilt.plans.materialize import ensure_checkpoint_dir
from reelquilt.sources.tables import table


def p6_plan(spark: SparkSession, d: str) -> DataFrame:
    """Every image file with its status and, if it is kept, the container it goes to."""
    return compaction.plan_containers(table(spark, d, "frames"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return p6_plan(spark, d).where("status = 'repeat'").select("file_id")


def p6_compacted(spark: SparkSession, d: str) -> DataFrame:
    """Rewrites all files of ``frame_scores`` as well-sized ones, verified row by row; what that came to, as one row.

    The copy goes to the folder that all executors share and is deleted again.
    """
    target = f"{ensure_checkpoint_dir(spark)}/compacted-{uuid.uuid4().hex}"
    try:
        done = compaction.compact(spark, f"{d}/frame_scores.parquet", target)
    finally:
        compaction.remove_folder(spark, target)
    names = ("rows", "files_before", "files_after")
    return spark.createDataFrame([tuple(done[n] for n in names)], ", ".join(f"{n} long" for n in names))


def p6_frames(spark: SparkSession, d: str) -> DataFrame:
    """The frames to be kept, written as many small files, consolidated and verified: files, rows, bytes and frames before and after.

    Each record stands for its image: the copy that :func:`p6_plan` keeps of it.  They are written in as many files as
    there are buckets of frames (256), then rewritten by :func:`compaction.compact`, and read once more.
    """
    folder = f"{ensure_checkpoint_dir(spark)}/frames-{uuid.uuid4().hex}"
    counts = lambda rows: rows.agg(F.count("*").alias("n"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("b"), F.countDistinct("video", "number").alias("f")).first()
    try:
        kept = p6_plan(spark, d).where(F.col("container").isNotNull())
        kept.repartition(256, "video", "number").write.parquet(f"{folder}/small")
        before = counts(spark.read.parquet(f"{folder}/small"))
        done = compaction.compact(spark, f"{folder}/small", f"{folder}/large")
        after = counts(spark.read.parquet(f"{folder}/large"))
    finally:
        compaction.remove_folder(spark, folder)
    fewer = done["files_after"] < done["files_before"] or done["files_before"] <= 1
    return spark.createDataFrame([(after["n"], after["b"], after["f"], tuple(before) == tuple(after) and done["rows"] == after["n"], fewer)], "rows long, bytes long, frames long, whole boolean, fewer_files boolean")


def p6_combined(spark: SparkSession, d: str) -> DataFrame:
    """:func:`p6_compacted` of ``frame_scores`` as 256 small files (fewer where it has fewer rows), so that files are combined."""
    folder = f"{ensure_checkpoint_dir(spark)}/small-{uuid.uuid4().hex}"
    try:
        table(spark, d, "frame_scores").repartition(256).write.parquet(f"{folder}/frame_scores.parquet")
        return p6_compacted(spark, folder)
    finally:
        compaction.remove_folder(spark, folder)


QUERIES = {"p6_found": p6_found, "p6_plan": p6_plan, "p6_compacted": p6_compacted, "p6_combined": p6_combined, "p6_frames": p6_frames}

ORACLE = {
    "p6_frames": r"""
        WITH f AS (SELECT DISTINCT file_id, frame_path, n_bytes, lower(regexp_replace(regexp_replace(regexp_extract(frame_path, '([^/\\]*)$', 1), '\.[A-Za-z0-9]+\s*$', ''), '\s*\(\d+\)$', '')) AS stem FROM frames WHERE n_bytes > 0),
        g AS (SELECT *, regexp_matches(stem, '^.+_\d+$') AS named, regexp_extract(stem, '^(.+)_(\d+)$', 1) AS video, CAST(nullif(regexp_extract(stem, '^(.+)_(\d+)$', 2), '') AS BIGINT) AS number FROM f),
        k AS (SELECT *, row_number() OVER (PARTITION BY CASE WHEN named THEN video ELSE stem || file_id || frame_path || n_bytes END, number ORDER BY file_id NULLS LAST, frame_path, n_bytes) AS r FROM g)
        SELECT count(*) AS rows, CAST(sum(n_bytes) AS BIGINT) AS bytes, count(DISTINCT (video, number)) FILTER (named) AS frames, true AS whole, true AS fewer_files FROM k WHERE r = 1""",
    "p6_found": r"""
        WITH f AS (SELECT DISTINCT file_id, lower(regexp_replace(regexp_replace(regexp_extract(frame_path, '([^/\\]*)$', 1), '\.[A-Za-z0-9]+\s*$', ''), '\s*\(\d+\)$', '')) AS stem FROM frames WHERE n_bytes > 0),
        g AS (SELECT file_id, regexp_extract(stem, '^(.+)_(\d+)$', 1) AS video, CAST(regexp_extract(stem, '^(.+)_(\d+)$', 2) AS BIGINT) AS number FROM f WHERE regexp_matches(stem, '^.+_\d+$'))
        SELECT file_id FROM (SELECT file_id, min(file_id) OVER (PARTITION BY video, number) AS first FROM g) WHERE file_id <> first""",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {**pipeline_queries.QUERIES, **QUERIES}


def oracle_sql() -> dict[str, str]:
    return {**pipeline_queries.ORACLE, **ORACLE}


def entry(spark: SparkSession, d: str) -> DataFrame:
    """Frames pooled to videos, each video with its best statement."""
    return pipeline_queries.pooled_best(spark, d)
