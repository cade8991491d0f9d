"""Queries over the project's tables leave no video out."""

import numpy as np
import pytest

from oracle import DATA, connect
from reelquilt import pipeline_queries
from reelquilt.operators import reweight

D = f"{DATA}/sf0.001"
NEWEST = f"WITH {pipeline_queries.CTE['vs']} SELECT video_idx, statement_index, score FROM vs"


@pytest.fixture(scope="module")
def con():
    return connect(D)


@pytest.fixture(scope="module")
def scores(con):
    """Newest scores, a row per video and a column per statement; NaN where there is none."""
    return con.execute(NEWEST).df().pivot(index="video_idx", columns="statement_index", values="score")


def test_incomplete_videos_count(spark, scores):
    x = scores.to_numpy()
    assert np.isnan(x).any()
    centred = np.nan_to_num(x - np.nanmean(x, axis=0))
    _, vectors = np.linalg.eigh(centred.T @ centred)
    v = vectors[:, ::-1][:, : x.shape[1] - 1]
    explained = np.einsum("ij,ik,kj->j", v, np.cov(centred.T, bias=True), v)
    evr = explained / np.trace(np.cov(centred.T, bias=True))
    got = pipeline_queries.spectrum(spark, D).orderBy("component").toPandas()["evr"]
    assert got.to_numpy() == pytest.approx(evr, abs=2e-6)
    k = min(int(np.flatnonzero(np.cumsum(evr) >= 0.95)[0]) + 1, 32)
    communality = (v[:, :k] ** 2) @ explained[:k]
    told = pipeline_queries.weights_default(spark, D).orderBy("statement_index").toPandas()
    assert told["communality"].to_numpy() == pytest.approx(communality, abs=2e-6)
    assert {r["video_idx"] for r in pipeline_queries.built_embedding(spark, D).select("video_idx").distinct().collect()} == set(scores.index)


def test_full_rank_weights_of_all_videos(spark, scores):
    x = scores.to_numpy()
    both = x - np.nanmean(x, axis=1, keepdims=True) - np.nanmean(x, axis=0) + np.nanmean(x)
    dense = np.nan_to_num(both)
    cov = np.cov(dense.T, bias=True)
    _, vectors = np.linalg.eigh(dense.T @ dense)
    v = vectors[:, ::-1][:, : x.shape[1] - 1]
    communality = (v**2) @ np.einsum("ij,ik,kj->j", v, cov, v)
    w = np.sqrt(np.sqrt(communality + reweight.EPS))
    w = w / (w.mean() + reweight.EPS)
    told = pipeline_queries.QUERIES["weights_full_rank_all"](spark, D).orderBy("statement_index").toPandas()
    assert told["communality"].to_numpy() == pytest.approx(communality, abs=2e-6)
    assert told["weight"].to_numpy() == pytest.approx(w, abs=2e-6)
    got = pipeline_queries.QUERIES["weighted_scores_all"](spark, D).toPandas().pivot(index="video_idx", columns="statement_index", values="score")
    assert got.to_numpy() == pytest.approx(both * w, abs=1e-5, nan_ok=True)


STEM = r"regexp_replace(regexp_extract(path, '([^/\\]*)$', 1), '\.[^.]*$', '')"


def test_durations_of_rows_without_an_id(spark, con):
    valid = f"SELECT video_id IS NULL AS bare, coalesce(video_id, {STEM}) AS video_id, duration_s, probed_at FROM media_probe WHERE duration_s > 0 AND isfinite(duration_s)"
    want = dict(con.execute(f"SELECT video_id, arg_max(duration_s, (probed_at, duration_s)) FROM ({valid}) GROUP BY 1").fetchall())
    only_bare = {v for (v,) in con.execute(f"SELECT video_id FROM ({valid}) GROUP BY 1 HAVING bool_and(bare)").fetchall()}
    got = {r["video_id"]: r["duration_s"] for r in pipeline_queries.durations(spark, D).collect()}
    assert only_bare and only_bare <= set(got) and got == want
    rows = pipeline_queries.embedding(spark, D)
    timed = pipeline_queries.numbered_videos(spark, D, rows).where("duration_s is not null")
    assert only_bare & {r["video_id"] for r in timed.select("video_id").collect()}


def test_frames_without_an_id(spark, con):
    lost = {p for (p,) in con.execute("SELECT frame_path FROM frames GROUP BY 1 HAVING count(video_id) = 0").fetchall()}
    assert lost and lost <= {r["frame_path"] for r in pipeline_queries.QUERIES["frame_index_all"](spark, D).collect()}
