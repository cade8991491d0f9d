"""Cutting lineage where a result is used more than once, in storage that all executors share."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder; one of our own only where the session and its context name none.

    On a cluster a folder of our own would not be shared by the executors, so there a missing setting is a RuntimeError.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        if not spark.sparkContext.getCheckpointDir():
            spark.sparkContext.setCheckpointDir(named)
        return named
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="reelquilt-checkpoint-")
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """The same rows without their lineage: written once to the checkpoint folder, read from there by whatever follows."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
