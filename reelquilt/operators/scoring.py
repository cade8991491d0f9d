"""Features of frames and statements, and their similarity scores."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelquilt.functions.vectors import dot, l2_normalize
from reelquilt.schemas import FRAME_SCORES, require_columns, require_frames

#: Image features are divided by their length plus this, so that a blank feature stays zero.
FEATURE_EPS = 1e-12


class FeatureProvider(Protocol):
    """An encoder; built once per Python worker by a factory that is pickled to the executors."""

    def encode_images(self, paths: list[str]) -> list[np.ndarray | None]:
        """A feature per path, None for an image that can't be read."""

    def encode_texts(self, texts: list[str]) -> np.ndarray: ...


def encode_frames(frames: DataFrame, factory, *, batch: int = 64) -> DataFrame:
    """``video_id, frame_idx, feature, ok``: unit features; an undecodable frame has a null feature and ``ok`` false."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        provider = factory()
        for pdf in parts:
            for at in range(0, len(pdf), batch):
                some = pdf.iloc[at : at + batch]
                found = provider.encode_images(some["frame_path"].tolist())
                unit = [None if f is None else (np.asarray(f, dtype=float) / (np.linalg.norm(f) + FEATURE_EPS)).tolist() for f in found]
                yield pd.DataFrame({"video_id": some["video_id"].values, "frame_idx": some["frame_idx"].values, "feature": unit, "ok": [f is not None for f in found]})

    return require_frames(frames).select("video_id", "frame_idx", "frame_path").mapInPandas(run, "video_id string, frame_idx int, feature array<double>, ok boolean")


def encode_statements(statements: DataFrame, factory) -> DataFrame:
    """``statement_index, feature``: unit features of the statements' texts."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        provider = factory()
        for pdf in parts:
            found = np.asarray(provider.encode_texts(pdf["statement"].tolist()), dtype=float)
            found = found / np.maximum(np.linalg.norm(found, axis=1, keepdims=True), np.finfo(float).tiny)
            yield pd.DataFrame({"statement_index": pdf["statement_index"].values, "feature": found.tolist()})

    return statements.select("statement_index", "statement").mapInPandas(run, "statement_index int, feature array<double>")


def score_frames(frame_features: DataFrame, statement_features: DataFrame, *, max_statements: int = 100_000, native: bool = False) -> DataFrame:
    """``video_id, frame_idx, statement_index, score``: cosine of unit features; 0 for frames without a feature.

    Statements are a dimension; at most ``max_statements`` are sent to the executors, more are a ValueError.  Frames
    aren't shuffled: each Arrow batch is one matrix product.  ``native`` keeps the arithmetic in the JVM (a broadcast
    nested loop), which is slower for long features but needs no Python.
    """
    require_columns(frame_features, ["video_id", "frame_idx", "feature"], "frame features")
    rows = statement_features.select("statement_index", "feature").orderBy("statement_index").limit(max_statements + 1)
    held = rows.toArrow()
    if held.num_rows > max_statements:
        raise ValueError(f"more than {max_statements} statements")
    if not held.num_rows:
        return frame_features.sparkSession.createDataFrame([], FRAME_SCORES)
    if native:
        small = F.broadcast(statement_features.select("statement_index", F.col("feature").alias("s")))
        zero = F.lit(0.0)
        return frame_features.crossJoin(small).select("video_id", "frame_idx", "statement_index", F.coalesce(dot(F.col("feature"), F.col("s")), zero).alias("score"))
    texts = np.array(held.column("feature").to_pylist(), dtype=float)
    shared = frame_features.sparkSession.sparkContext.broadcast((held.column("statement_index").to_numpy(), texts.T.copy()))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, right = shared.value
        m = len(index)
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                there = np.flatnonzero(pc.is_valid(part.column(2)).to_numpy(zero_copy_only=False))
                scores = np.zeros((part.num_rows, m))
                if len(there):
                    scores[there] = pc.list_flatten(part.column(2)).to_numpy(zero_copy_only=False).astype(float).reshape(len(there), -1) @ right
                take = pa.array(np.repeat(np.arange(part.num_rows), m))
                yield pa.RecordBatch.from_arrays([part.column(0).take(take), part.column(1).take(take), pa.array(np.tile(index, part.num_rows).astype(np.int32)), pa.array(scores.ravel())], names=FRAME_SCORES.names)

    return frame_features.select("video_id", F.col("frame_idx").cast("int").alias("frame_idx"), "feature").mapInArrow(run, FRAME_SCORES)


def normalized_features(features: DataFrame, column: str = "feature", eps: float = FEATURE_EPS) -> DataFrame:
    return features.withColumn(column, l2_normalize(F.col(column), eps))
