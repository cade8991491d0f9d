"""File names: sanitising, stems, labels and frame numbering."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


@F.pandas_udf(T.StringType())
def _compatible(names: pd.Series) -> pd.Series:
    return names.map(lambda s: unicodedata.normalize("NFKD", s), na_action="ignore")


def sanitize_name(name: Column) -> Column:
    """ASCII file name: decompose, drop what isn't ASCII, delete quotes and commas, everything else unusual to ``_``.

    Only the Unicode decomposition needs Python (one Arrow batch at a time); the rest is native.  Null stays null.
    """
    ascii_only = F.regexp_replace(_compatible(name), r"[^\x00-\x7f]", "")
    unquoted = F.regexp_replace(ascii_only, "['\"`,]", "")
    return F.regexp_replace(F.regexp_replace(unquoted, r"[^A-Za-z0-9._-]", "_"), "_+", "_")


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/\\]*)$", 1)


def stem(path: Column) -> Column:
    """Last component without its last suffix; a name that only starts with a dot has no suffix."""
    return F.regexp_replace(file_name(path), r"(?<=.)\.[^.]*$", "")


def destination(folder: str, path: Column, sanitize: bool = True) -> Column:
    bare = stem(path)
    return F.concat(F.lit(folder.rstrip("/") + "/"), sanitize_name(bare) if sanitize else bare, F.lit(".mp4"))


def resolution_label(height: Column) -> Column:
    """``720p``, or ``original`` for a null or zero height."""
    return F.when(F.coalesce(height, F.lit(0)) != 0, F.concat(height.cast("string"), F.lit("p"))).otherwise(F.lit("original"))


def frame_name(video: Column, number: Column) -> Column:
    """File name of a frame, counted from 1."""
    return F.format_string("%s_%06d.jpg", video, number)
