"""Where a run's tables go: parquet for what is read again, CSV and JSON for what people read."""

from __future__ import annotations

import os
import shutil

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Artifacts of a run and their format.
ARTIFACTS = {
    "frames": "csv",
    "video_index": "csv",
    "frame_scores": "parquet",
    "frame_features": "parquet",
    "statement_features": "parquet",
    "video_scores_raw": "parquet",
    "video_scores_centered": "parquet",
    "video_scores": "parquet",
    "statement_weights": "csv",
    "spectrum": "parquet",
    "reweight_report": "json",
    "embedding": "parquet",
    "prototypes": "csv",
    "strata": "csv",
    "k_sweep": "csv",
    "strata_report": "json",
    "compilations": "json",
    "compilation_members": "parquet",
    "selection_metrics": "json",
    "interchangeability": "json",
}


def write(df: DataFrame, folder: str, name: str, *, single: bool = False) -> str:
    """Write an artifact in its format, replacing an earlier one; ``single`` gives one file (for bounded tables only)."""
    kind = ARTIFACTS.get(name, "parquet")
    path = f"{folder.rstrip('/')}/{name}.{kind}"
    rows = df.coalesce(1) if single else df
    writer = rows.write.mode("overwrite")
    writer = writer.option("header", True) if kind == "csv" else writer
    getattr(writer, kind)(path)
    return path


def read(spark: SparkSession, folder: str, name: str, schema=None) -> DataFrame:
    kind = ARTIFACTS.get(name, "parquet")
    reader = spark.read.schema(schema) if schema is not None else spark.read
    if kind == "csv":
        reader = reader.option("header", True)
        reader = reader if schema is not None else reader.option("inferSchema", True)
    return getattr(reader, kind)(f"{folder.rstrip('/')}/{name}.{kind}")


def as_float(df: DataFrame, *columns: str) -> DataFrame:
    """Columns narrowed to single precision, as exports have them."""
    return df.select(*(F.col(c).cast("array<float>" if df.schema[c].dataType.typeName() == "array" else "float").alias(c) if c in columns else F.col(c) for c in df.columns))


def safe_path(root: str, path: str) -> str:
    """A path that may be deleted: inside the root, and not the root itself; otherwise a ValueError."""
    whole, base = os.path.realpath(path), os.path.realpath(root)
    if whole == base or os.path.commonpath([whole, base]) != base or base == os.sep and whole == os.sep:
        raise ValueError(f"{path} isn't inside {root}")
    return whole


def output_root(videos_folder: str) -> str:
    """Where a run writes: ``output`` beside the folder of videos."""
    return os.path.join(os.path.dirname(os.path.abspath(videos_folder)), "output")


def delete_folder(root: str, path: str) -> bool:
    """Delete a folder inside the root (:func:`safe_path`); False if there is none."""
    folder = safe_path(root, path)
    if not os.path.isdir(folder):
        return False
    shutil.rmtree(folder)
    return True
