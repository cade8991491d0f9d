"""Column contracts of the pipeline's tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import types as T

# Types by the names used below; schemas are put together without a session.
_TYPES = {"string": T.StringType(), "int": T.IntegerType(), "long": T.LongType(), "double": T.DoubleType(), "boolean": T.BooleanType(), "array<double>": T.ArrayType(T.DoubleType())}


def _struct(fields: str) -> T.StructType:
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in (f.split() for f in fields.split(","))])


STATEMENTS = _struct("statement_index int, category string, statement string")
VIDEOS = _struct("video_id string, video_idx int, path string, width int, height int, duration_s double")
FRAMES = _struct("video_id string, frame_idx int, frame_path string")
FRAME_FEATURES = _struct("video_id string, frame_idx int, feature array<double>, ok boolean")
STATEMENT_FEATURES = _struct("statement_index int, feature array<double>")
FRAME_SCORES = _struct("video_id string, frame_idx int, statement_index int, score double")
VIDEO_SCORES = _struct("video_id string, video_idx int, statement_index int, score double")
STATEMENT_WEIGHTS = _struct("statement_index int, weight double, communality double")
SPECTRUM = _struct("component int, evr double, cum_evr double")
EMBEDDING = _struct("video_id string, video_idx int, z array<double>")
PROTOTYPES = _struct("prototype_id int, video_idx long")
STRATA = _struct("video_id string, stratum_id int, is_prototype int, dist_to_prototype double")
K_SWEEP = _struct("K int, mean_dist double, max_dist double, p95_dist double, min_size long, singleton_frac double")
CLUSTERS = _struct("video_id string, cluster int")
MEDIA_PROBE = _struct("path string, width int, height int, duration_s double")


def require_columns(df: DataFrame, columns: Sequence[str], name: str = "table") -> DataFrame:
    """The table itself; ValueError that names the missing columns if there are any."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"{name} lacks columns: {', '.join(missing)}")
    return df


def require_frames(df: DataFrame) -> DataFrame:
    return require_columns(df, FRAMES.names, "frames")


def require_video_index(df: DataFrame) -> DataFrame:
    return require_columns(df, ["video_id"], "video index")


def require_clusters(df: DataFrame) -> DataFrame:
    return require_columns(df, CLUSTERS.names, "clusters")
