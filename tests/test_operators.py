import sys

import numpy as np
import pandas as pd
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from reelquilt.config import PipelineConfig
from reelquilt.operators import interchange, linalg, pooling, report, reweight, scoring, selection, strata
from reelquilt.plans import pipeline
from reelquilt.plans.ranking import number_from_zero, number_within

cloudpickle.register_pickle_by_value(sys.modules[__name__])
RNG = np.random.default_rng(7)


def long(spark, x, row="video_idx", column="statement_index"):
    data = [(i, j, float(x[i, j])) for i in range(x.shape[0]) for j in range(x.shape[1])]
    return spark.createDataFrame(data, f"{row} int, {column} int, score double")


def wide(df, row="video_idx", column="statement_index", value="score"):
    return df.toPandas().pivot(index=row, columns=column, values=value).to_numpy()


def vectors(spark, x):
    return spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "video_idx long, z array<double>")


# --- pooling ---


def frames(spark, rows):
    return spark.createDataFrame(rows, "video_id string, frame_idx int, statement_index int, score double")


@pytest.mark.parametrize("method, fn", [("percentile", lambda x: np.percentile(x, 95)), ("mean", np.mean), ("median", np.median), ("max", np.max), ("min", np.min)])
def test_pooling(spark, method, fn):
    values = {(v, s): RNG.normal(size=n) for (v, n) in (("a", 1), ("b", 2), ("c", 9)) for s in (0, 1)}
    df = frames(spark, [(v, i, s, float(x)) for (v, s), xs in values.items() for i, x in enumerate(xs)])
    got = {(r["video_id"], r["statement_index"]): r["score"] for r in pooling.pool_scores(df, method).collect()}
    assert got == pytest.approx({k: fn(x) for k, x in values.items()})


def test_hot_groups_are_pooled_exactly(spark):
    values = {("a", 0): RNG.normal(size=20_000), ("a", 1): np.round(RNG.normal(size=9_000), 1), ("b", 0): np.full(3_000, 0.7), (None, 2): RNG.exponential(size=5_000) ** 8, ("c", None): RNG.normal(size=50), ("d", 3): np.r_[np.zeros(2_500), 1e9]}
    df = frames(spark, [(v, i, s, float(x)) for (v, s), xs in values.items() for i, x in enumerate(xs)] + [("n", i, 1, None) for i in range(2_500)]).repartition(4)
    for method, p in (("percentile", 95), ("percentile", 0), ("percentile", 100), ("median", 50)):
        got = {(r["video_id"], r["statement_index"]): r["score"] for r in pooling.pool_scores(df, method, p, hot_rows=2_000).collect()}
        assert got == pytest.approx({**{k: np.percentile(x, p) for k, x in values.items()}, ("n", 1): None})


def test_failed_frames_count_and_nan_is_refused(spark):
    df = frames(spark, [("a", 0, 0, 0.0), ("a", 1, 0, 1.0), ("a", 2, 0, None)])
    assert pooling.pool_scores(df, "mean").first()["score"] == 0.5
    with pytest.raises(Exception, match="NaN"):
        pooling.pool_scores(frames(spark, [("a", 0, 0, float("nan"))]), "max").collect()
    with pytest.raises(ValueError):
        pooling.pooled(F.col("score"), "sum")
    with pytest.raises(ValueError, match="score"):
        pooling.pool_scores(spark.range(1))


def test_ties_go_to_the_first(spark):
    df = frames(spark, [("b", 0, 2, 0.5), ("b", 0, 1, 0.5), ("a", 0, 3, 0.5), ("a", 1, 3, 0.4)])
    assert [tuple(r) for r in pooling.best_statements(df).orderBy("video_id").collect()] == [("a", 0.5, 3), ("b", 0.5, 1)]
    assert [r["video_id"] for r in pooling.top_videos(df, 1).collect()] == ["a"]
    assert [tuple(r)[:2] for r in pooling.top_frames(df, 2).collect()] == [("a", 0), ("b", 0)]
    assert pooling.top_statements(df, 1, spark.createDataFrame([(1, "x" * 60)], "statement_index int, statement string")).first()["statement"] == "x" * 50
    assert pooling.top_statements(df, 3, spark.createDataFrame([], "statement_index int, statement string")).orderBy("statement_index").first()["statement"] == "Scene 1"


def test_index_and_numbers(spark):
    ids = [f"v{i:03d}" for i in RNG.permutation(300)] + ["é", "Z", None]
    df = spark.createDataFrame([(i,) for i in ids], "video_id string").repartition(7)
    got = {r["video_id"]: r["video_idx"] for r in pooling.video_index(df).collect()}
    assert got == {v: i for i, v in enumerate(sorted(x for x in ids if x))}
    assert number_from_zero(df.limit(0), "video_id", "n").count() == 0


def test_large_groups_are_numbered_in_ranges(spark):
    rows = [(g, f"{int(i):05d}") for g, n in (("a", 3000), ("b", 40), (None, 30), ("c", 1500)) for i in RNG.permutation(n)]
    got = number_within(spark.createDataFrame(rows, "g string, p string").repartition(5), "g", "p", "n", hot_rows=1000).collect()
    assert len(got) == len(rows) and all(int(r["p"]) == r["n"] for r in got)


# --- scoring ---


class Encoder:
    def encode_images(self, paths):
        return [None if "bad" in p else np.array([3.0, 4.0]) for p in paths]

    def encode_texts(self, texts):
        return np.array([[len(t), 1.0] for t in texts])


def test_scoring(spark):
    f = spark.createDataFrame([("a", 0, "x.jpg"), ("a", 1, "bad.jpg")], "video_id string, frame_idx int, frame_path string")
    s = spark.createDataFrame([(0, "c", "ab"), (1, "c", "")], "statement_index int, category string, statement string")
    features = scoring.encode_frames(f, Encoder)
    texts = scoring.encode_statements(s, Encoder)
    for native in (False, True):
        got = {(r["frame_idx"], r["statement_index"]): r["score"] for r in scoring.score_frames(features, texts, native=native).collect()}
        assert got == pytest.approx({(0, 0): (0.6 * 2 + 0.8) / 5**0.5, (0, 1): 0.8, (1, 0): 0.0, (1, 1): 0.0})
    assert features.where("not ok").first()["feature"] is None
    assert scoring.score_frames(features, texts.limit(0)).count() == 0
    with pytest.raises(ValueError):
        scoring.score_frames(features, texts, max_statements=1)


# --- reweighting ---


@pytest.mark.parametrize("mode", ["none", "col", "row", "both"])
def test_centering(spark, mode):
    x = RNG.normal(size=(6, 4))
    want = x - {"none": 0, "col": x.mean(0), "row": x.mean(1, keepdims=True), "both": x.mean(0) + x.mean(1, keepdims=True) - x.mean()}[mode]
    assert wide(reweight.center_scores(long(spark, x), mode)) == pytest.approx(want)


def test_unknown_centering(spark):
    with pytest.raises(ValueError):
        reweight.center_scores(long(spark, np.zeros((1, 1))), "all")


def reference_weights(x, threshold, cap, beta):
    n, m = x.shape
    limit = max(1, min(n - 1, m - 1, 128))
    _, _, vt = np.linalg.svd(x, full_matrices=False)
    v = vt[:limit].T
    ev = (x @ v).var(axis=0)
    evr = ev / x.var(axis=0).sum()
    hit = np.flatnonzero(np.cumsum(evr) >= threshold)
    k95 = min(max(hit[0] + 1 if len(hit) else limit, 1), limit)
    k = min(k95, cap, limit)
    c = (v[:, :k] ** 2) @ ev[:k]
    w = np.sqrt(c + 1e-8) ** beta
    return w / (w.mean() + 1e-8), c, evr, k95


@pytest.mark.parametrize("mode, threshold, cap", [("col", 0.95, 32), ("both", 0.8, 2), ("none", 0.95, 32), ("row", 0.9, 32), ("both", 2.0, 99)])
def test_weights(spark, mode, threshold, cap):
    x = RNG.normal(size=(40, 6)) * np.array([5, 3, 2, 1, 0.7, 0.3]) + 0.5
    centered = reweight.center_scores(long(spark, x), mode)
    got = reweight.statement_weights(centered, variance_threshold=threshold, component_cap=cap)
    w, c, evr, k95 = reference_weights(wide(centered), threshold, cap, 0.5)
    assert got.weight == pytest.approx(w, rel=1e-6) and got.communality == pytest.approx(c, rel=1e-6)
    assert got.evr == pytest.approx(evr, abs=1e-9) and got.k95 == k95
    if mode == "both" and threshold > 1:
        assert got.communality == pytest.approx(wide(centered).var(axis=0))
    spectrum = got.spectrum(spark).orderBy("component").collect()
    assert [r["component"] for r in spectrum] == list(range(1, len(evr) + 1))
    assert spectrum[-1]["cum_evr"] == pytest.approx(evr.sum())
    report_row = reweight.reweight_report(got, spark, centering=mode, variance_threshold=threshold, component_cap=cap, beta=0.5).first()
    assert report_row["n_videos"] == 40 and report_row["n_statements"] == 6


def test_no_variance(spark):
    got = reweight.statement_weights(reweight.center_scores(long(spark, np.ones((5, 3))), "col"))
    assert (got.k95, got.k_selected) == (1, 1) and got.evr.tolist() == [0, 0]
    assert got.weight == pytest.approx(np.full(3, got.weight[0]))
    single = reweight.statement_weights(long(spark, np.ones((1, 1))))
    assert single.max_components == 1 and len(single.weight) == 1


# --- strata ---


def reference_order(z, k):
    first = int(np.linalg.norm(z - z.mean(0), axis=1).argmin())
    order, d = [first], np.linalg.norm(z - z[first], axis=1)
    while len(order) < k:
        order.append(int(d.argmax()))
        d = np.minimum(d, np.linalg.norm(z - z[order[-1]], axis=1))
    return order


def test_strata(spark):
    z = RNG.normal(size=(60, 5))
    z[7] = z[3]
    df = vectors(spark, z).repartition(5)
    got = strata.farthest_first(df, 12)
    assert [i for i, _ in got] == reference_order(z, 12)
    d = np.stack([np.linalg.norm(z - z[i], axis=1) for i, _ in got], axis=1)
    rows = strata.assign_strata(df, got[:5]).orderBy("video_idx").toPandas()
    assert rows["stratum_id"].tolist() == d[:, :5].argmin(1).tolist()
    assert rows["dist_to_prototype"].to_numpy() == pytest.approx(d[:, :5].min(1))
    assert set(rows.loc[rows["is_prototype"] == 1, "video_idx"]) == {i for i, _ in got[:5]}
    sweep = strata.k_sweep(df, got).orderBy("K").toPandas()
    assert sweep["K"].tolist() == list(range(1, 13))
    assert sweep["max_dist"].to_numpy() == pytest.approx([d[:, :k].min(1).max() for k in range(1, 13)])
    assert (np.diff(sweep["max_dist"]) <= 1e-12).all()
    sizes = [np.unique(d[:, :k].argmin(1), return_counts=True)[1] for k in range(1, 13)]
    assert sweep["min_size"].tolist() == [s.min() for s in sizes]
    assert sweep["singleton_frac"].to_numpy() == pytest.approx([(s == 1).mean() for s in sizes])
    feasible = [k for k in range(1, 13) if sizes[k - 1].min() >= 3]
    best = min(feasible, key=lambda k: (d[:, :k].min(1).max(), k))
    assert strata.choose_k(strata.k_sweep(df, got), 60) == best
    target = d[:, : feasible[0]].min(1).max() + 1e-9
    assert strata.choose_k(strata.k_sweep(df, got), 60, target_max_dist=float(target)) == feasible[0]


@pytest.mark.parametrize("candidates, settle", [(1, 1), (4, 3), (256, 2)])
def test_traversal_in_few_passes(spark, monkeypatch, candidates, settle):
    """However many candidates a pass brings, the order is that of one choice after the other, ties included."""
    monkeypatch.setattr(strata, "CANDIDATES", candidates)
    monkeypatch.setattr(strata, "SETTLE", settle)
    z = np.concatenate([RNG.normal(size=(80, 3)), np.eye(3) * 4, -np.eye(3) * 4, np.eye(3) * 4])
    assert [i for i, _ in strata.farthest_first(vectors(spark, z).repartition(3), 25)] == reference_order(z, 25)


def test_spread_percentiles(spark):
    x = [(g, float(v)) for g, n in (("a", 1), ("b", 2), ("c", 3000)) for v in np.round(RNG.normal(size=n), 2)] + [("d", None), ("e", 2.0), ("e", 2.0)]
    df = spark.createDataFrame(x, "g string, v double")
    for p in (0.0, 0.5, 0.95, 1.0):
        got = {r["g"]: r["score"] for r in pooling.spread_percentile(df, ["g"], "v", p).collect()}
        assert got == {g: pytest.approx(np.percentile([v for h, v in x if h == g], 100 * p)) for g in "abce"}
        whole = pooling.spread_percentile(df, [], "v", p).collect()
        assert [r["score"] for r in whole] == [pytest.approx(np.percentile([v for _, v in x if v is not None], 100 * p))]
    assert pooling.spread_percentile(df.limit(0), [], "v", 0.5).count() == 0


def test_coverage_without_rows(spark):
    none = spark.createDataFrame([], "video_idx long, stratum_id int, dist_to_prototype double")
    (got,) = strata.coverage_metrics(none).collect()
    assert got["n_strata"] == 0 and got["p95_dist"] is None and got["mean_dist"] is None


def test_no_step_gathers_all_rows(spark):
    """Distances are never sent to one task to be ranked."""
    df = vectors(spark, RNG.normal(size=(50, 3)))
    heads = strata.farthest_first(df, 4)
    plan = strata.coverage_metrics(strata.assign_strata(df, heads))._jdf.queryExecution().executedPlan().toString()
    assert "percentile(" not in plan


def test_strata_edges(spark):
    two = vectors(spark, np.array([[0.0, 1.0], [0.0, 1.0]]))
    made = strata.make_strata(two)  # fewer rows than a stratum needs
    assert made.n_strata == 1 and made.strata.count() == 2
    same = strata.make_strata(two, n_strata=2)  # equal vectors: the second stratum stays empty
    assert same.strata.select("stratum_id").distinct().count() == 1
    many = vectors(spark, RNG.normal(size=(30, 3)))
    assert len(strata.make_strata(many, n_strata=25, cap=20).prototypes) == 25
    assert len(strata.farthest_first(many, 99)) == 30
    assert strata.farthest_first(many, 3, init="random", seed=5)[0][0] == np.random.RandomState(5).randint(30)
    with pytest.raises(ValueError):
        strata.farthest_first(many, 3, init="first")
    assert strata.farthest_first(many.limit(0), 3) == []


def test_too_many_strata_are_refused(spark, monkeypatch):
    monkeypatch.setattr(strata, "MAX_PROTOTYPES", 6)
    rows = vectors(spark, RNG.normal(size=(9, 2)))
    assert strata.make_strata(rows, n_strata=6, cap=5).strata.select("stratum_id").distinct().count() == 6
    with pytest.raises(ValueError, match="more than 6 prototypes"):
        strata.make_strata(rows, n_strata=7, cap=5)


def test_kcenter(spark):
    z = RNG.normal(size=(50, 4))
    df = vectors(spark, z)
    for metric, far in (("euclidean", lambda a, b: np.linalg.norm(a - b, axis=1)), ("cosine", lambda a, b: 1 - a @ b / np.linalg.norm(a, axis=1) / np.linalg.norm(b))):
        order = [int(np.random.RandomState(1234).randint(50))]
        while len(order) < 6:
            order.append(int(np.min([far(z, z[i]) for i in order], axis=0).argmax()))
        assert [i for i, _ in strata.kcenter_greedy(df, 6, metric=metric)] == order
    assert [i for i, _ in strata.kcenter_greedy(df, 99)] == list(range(50))
    for bad in ({"metric": "l1"}, {"k": 0}):
        with pytest.raises(ValueError):
            strata.kcenter_greedy(df, **{"k": 3, **bad})


def test_embedding_keeps_geometry(spark):
    x = RNG.normal(size=(30, 6))
    z, k = strata.build_embedding(long(spark, x), 4, normalize=False)
    got = np.array([r["z"] for r in z.orderBy("video_idx").collect()])
    u, s, _ = np.linalg.svd(x, full_matrices=False)
    want = u[:, :4] * s[:4]
    assert k == 4 and got @ got.T == pytest.approx(want @ want.T, abs=1e-9)
    unit, _ = strata.build_embedding(long(spark, x), 99)
    assert len(unit.first()["z"]) == 5 and np.linalg.norm(unit.first()["z"]) == pytest.approx(1)


# --- selection ---


def reference_selection(z, labels, secs, n, low, high, seed):
    zn = (z - z.mean(0)) / (z.std(0) + 1e-8)
    unit = zn / np.linalg.norm(zn, axis=1, keepdims=True)
    d = np.clip(1 - unit @ unit.T, 0, 2)
    np.fill_diagonal(d, 0)
    anchors = [int(np.random.RandomState(seed).randint(len(z)))]
    while len(anchors) < min(n, len(z)):
        anchors.append(int(np.min([np.linalg.norm(zn - zn[a], axis=1) for a in anchors], axis=0).argmax()))
    used, out = np.zeros(len(z)), []
    for c, a in enumerate(anchors):
        order = list(range(len(set(labels))))
        np.random.default_rng(seed + c).shuffle(order)
        picked, total, counts = [], 0.0, dict.fromkeys(order, 0)

        def step(pool):
            nonlocal total
            ok = [i for i in pool if i not in picked and secs[i] > 0 and total + secs[i] <= high]
            if not ok:
                return False
            gain = lambda i: min(d[i, j] for j in picked) if picked else d[a].max()
            score = [1 / (d[a, i] + 1e-6) * (gain(i) + 1e-6) / (1 + used[i]) / (1 + counts[labels[i]]) for i in ok]
            best = ok[int(np.argmax(np.round(np.log(score), 9)))]
            picked.append(best)
            counts[labels[best]] += 1
            total += secs[best]
            return True

        for s in order:
            step([i for i in range(len(z)) if labels[i] == s])
            if total >= high:
                break
        while total < low and step(range(len(z))):
            pass
        used[picked] += 1
        out.append((a, picked))
    return out


@pytest.mark.parametrize("low, high, strata_n", [(55.0, 65.0, 5), (60.0, 65.0, 2)])
def test_selection(spark, low, high, strata_n):
    n = 40
    z, labels = RNG.normal(size=(n, 6)), RNG.integers(strata_n, size=n)
    labels[:strata_n] = range(strata_n)
    secs = np.round(RNG.uniform(2, 30, size=n), 1)
    secs[3], secs[4] = 0, 100
    rows = [(i, [float(v) for v in z[i]], int(labels[i]), None if i == 5 else float(secs[i])) for i in range(n)]
    secs[5] = 0
    df = spark.createDataFrame(rows, "video_idx int, z array<double>, stratum_id int, duration_s double").repartition(3)
    want = reference_selection(z, labels, secs, 4, low, high, 1234)
    local = selection.select_compilations(df, n_compilations=4, min_seconds=low, max_seconds=high, seed=0)
    spread = selection.select_compilations(df, n_compilations=4, min_seconds=low, max_seconds=high, local_rows=0)
    for got in (local, spread):
        rows = got.orderBy("comp_id", "pick_order").collect()
        assert [(c, r["video_idx"]) for c, (_, p) in enumerate(want) for r in rows if r["comp_id"] == c] == [(c, i) for c, (_, p) in enumerate(want) for i in p]
    heads = selection.compilation_headers(local).orderBy("comp_id").collect()
    assert [h["anchor_idx"] for h in heads] == [a for a, _ in want]
    assert all(h["total_seconds"] <= high + 1e-9 for h in heads)
    assert local.groupBy("comp_id", "video_idx").count().where("count > 1").isEmpty()
    nested = selection.nested_compilations(local).orderBy("comp_id").first()
    assert [m["idx"] for m in nested["members"]] == want[0][1]
    assert selection.duration_summary(local).first()["n_compilations"] == 4
    assert selection.usage_counts(local).agg(F.sum("usage")).first()[0] == sum(len(p) for _, p in want)


def test_selection_edges(spark):
    df = spark.createDataFrame([(i, [float(i), 1.0], 0, 70.0) for i in range(3)], "video_idx int, z array<double>, stratum_id int, duration_s double")
    assert selection.select_compilations(df).count() == 0  # nothing fits
    with pytest.raises(ValueError):
        selection.select_compilations(df, n_compilations=0)
    assert selection.select_compilations(df.limit(0)).count() == 0


# --- interchangeability ---


def test_metrics_and_test(spark):
    z = RNG.normal(size=(30, 4))
    sets = {0: [1, 2, 3], 1: [4, 5, 6, 7], 2: [9]}
    members = spark.createDataFrame([(c, i) for c, s in sets.items() for i in s], "comp_id int, video_idx long")
    df = vectors(spark, z)
    pool = interchange.member_pool(members, df)
    x = z[sorted(i for s in sets.values() for i in s)]
    ref = interchange.pool_reference(pool).first()
    assert ref["var_global"] == pytest.approx(((x - x.mean(0)) ** 2).sum(1).mean()) and ref["mu"] == pytest.approx(x.mean(0).tolist())
    numbers = interchange.PoolNumbers(pool, 1.3)
    slots = members.select(F.col("comp_id").cast("long").alias("slot"), F.lit(0).alias("rep"), F.col("video_idx").alias("idx"))
    got = {r["slot"]: r for r in interchange.set_metrics(slots, numbers).collect()}
    k = lambda a, b: np.exp(-((a[:, None] - b[None]) ** 2).sum(-1) / (2 * 1.3**2))
    for c, s in sets.items():
        y = z[s]
        pairs = [np.linalg.norm(y[i] - y[j]) for i in range(len(y)) for j in range(i)]
        assert got[c]["mean_pairwise_distance"] == pytest.approx(np.mean(pairs) if pairs else 0.0)
        assert got[c]["variance_capture"] == pytest.approx(((y - x.mean(0)) ** 2).sum(1).mean() / ref["var_global"])
        assert got[c]["centroid_shift"] == pytest.approx(np.linalg.norm(y.mean(0) - x.mean(0)))
        assert got[c]["mmd"] == pytest.approx(np.sqrt(max(0, k(y, y).mean() - 2 * k(y, x).mean() + k(x, x).mean())), abs=1e-7)
    runs = [interchange.interchangeability(m, df, null_draws=50, permutations=40).orderBy("metric").collect() for m in (members.repartition(1), members.repartition(4))]
    assert [r["metric"] for r in runs[0]] == sorted(interchange.METRICS)
    for a, b in zip(*runs):
        assert 0 < a["p_max"] <= 1 and 0 < a["p_rms"] <= 1 and len(a["z_obs"]) == 3
        assert a["T_max_obs"] == pytest.approx(max(map(abs, a["z_obs"])), abs=1e-8) and a["verdict"] == ("fail to reject" if a["p_max"] >= 0.05 else "reject")
        assert (a["p_max"], a["p_rms"]) == (b["p_max"], b["p_rms"]) and a["z_obs"] == pytest.approx(b["z_obs"])
    drawn = interchange.sampled(numbers, [(0, 3), (1, 99)], 5, 1)
    assert drawn.groupBy("slot", "rep").agg(F.countDistinct("idx").alias("n")).select("slot", "n").distinct().orderBy("slot").collect() == [(0, 3), (1, 8)]
    sizes = [(0, 3), (1, 5), (2, 1), (3, 2)]
    wide_pool = interchange.PoolNumbers(interchange.member_pool(members, df, "library"), 1.3)
    ways = [sorted(interchange.drawn_metrics(wide_pool, sizes, 30, 5, local_bytes=b).select("slot", "rep", "size", *interchange.METRICS).collect()) for b in (0, 1 << 20)]
    assert len(ways[0]) == 120 and np.allclose(np.array(ways[0], dtype=float), np.array(ways[1], dtype=float), atol=1e-6)
    picks = interchange.draw(np.random.default_rng(1), 10, 2, 20_000)
    assert (picks[:, 0] != picks[:, 1]).all() and np.abs(np.bincount(picks.ravel(), minlength=10) / 4000 - 1).max() < 0.1
    assert interchange.member_pool(members, df, "library").count() == 30
    with pytest.raises(ValueError):
        interchange.member_pool(members, df, "all")
    assert interchange.median_sigma(pool.limit(1), 1) == 1.0


def test_kernel_means_by_features(spark):
    x = RNG.normal(size=(400, 4))
    pool = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "idx long, z array<double>")
    exact, near = (interchange.PoolNumbers(pool, 1.5, n) for n in (None, 4096))
    a, b = ({r["idx"]: r["r"] for r in p.rows.collect()} for p in (exact, near))
    assert max(abs(a[i] - b[i]) for i in a) < 3 / (2 * 4096) ** 0.5 and near.kernel_mean == pytest.approx(exact.kernel_mean, abs=0.02)
    members = spark.createDataFrame([(c, int(i)) for c in range(4) for i in RNG.choice(400, 6, replace=False)], "comp_id int, video_idx long")
    df = vectors(spark, x)
    one, two = ({r["metric"]: r for r in interchange.interchangeability(members, df, null_draws=200, permutations=100, pool="library", sigma=1.5, kernel_features=n).collect()} for n in (None, 4096))
    assert [two[m]["z_obs"] for m in ("variance_capture", "mean_pairwise_distance")] == [one[m]["z_obs"] for m in ("variance_capture", "mean_pairwise_distance")]
    assert np.abs(np.array(two["mmd"]["z_obs"]) - one["mmd"]["z_obs"]).max() < 0.5


# --- reports and the whole ---


def test_correlation_of_a_constant_is_null(spark):
    x = np.array([[1.0, 2.0], [1.0, 5.0], [1.0, 3.0]])
    got = report.component_correlation(long(spark, x), vectors(spark, np.array([[0.1], [0.5], [0.2]]))).orderBy("statement_index").collect()
    assert got[0]["correlation"] is None and got[1]["correlation"] == pytest.approx(np.corrcoef(x[:, 1], [0.1, 0.5, 0.2])[0, 1])


def test_pipeline(spark, tmp_path):
    rows = [(f"v{v:02d}", f, s, float(abs(np.sin(v * 7 + s * 3 + f * 0.1)))) for v in range(24) for f in range(4) for s in range(6)]
    scores = frames(spark, rows)
    videos = spark.createDataFrame([(f"v{v:02d}", float(5 + v)) for v in range(23)], "video_id string, duration_s double")
    run = pipeline.from_frame_scores(spark, scores, videos, PipelineConfig(n_compilations=3, null_draws=20, permutations=20))
    pipeline.test_step(run)
    assert run.tables["interchangeability"].count() == 4
    names = run.tables["compilation_members"].join(run.tables["video_index"], "video_idx")
    assert names.where("video_id = 'v23'").isEmpty()  # it has no duration
    (told,) = run.tables["strata_report"].collect()
    assert (told["n_videos"], told["n_statements"], told["mode"], told["init_mode"], told["min_stratum_size"], told["seed"], told["k_cap"]) == (24, 6, "auto", "medoid", 3, None, 20)
    assert told["selected_k_metrics"]["K"] == told["n_strata_asked"] and told["selected_k_metrics"]["max_dist"] == pytest.approx(told["max_dist"]) and told["target_max_dist"] == 0.35
    saved = run.save(str(tmp_path))
    assert {"strata", "k_sweep", "compilations", "statement_weights"} <= set(saved)
    for step in ("encoding", "aggregation", "svd", "reduce", "strata", "compile", "compilation_selection", "COMPILATIONS"):
        assert all(df.count() for df in run.summary(step).values())
    with pytest.warns(UserWarning):
        assert run.summary("import") == {}
    with pytest.warns(UserWarning):
        assert run.summary("nothing") == {}
    with pytest.raises(ValueError, match="frame_scores"):
        pipeline.aggregate(pipeline.Run(spark))
    manual = pipeline.from_frame_scores(spark, scores, videos, PipelineConfig(n_strata=4, n_compilations=1))
    assert "k_sweep" not in manual.tables and manual.numbers["n_strata"] == 4
    assert report.coverage_report(strata.prototype_coverage(manual.tables["embedding"], manual.tables["strata"], strata.farthest_first(manual.tables["embedding"], 4))).first()["n_strata"] == 4


def test_moments(spark):
    x = RNG.normal(size=(25, 3))
    got = linalg.moments(vectors(spark, x).repartition(4), "z", 3)
    assert got.n == 25 and got.covariance == pytest.approx(np.cov(x.T, bias=True)) and got.gram == pytest.approx(x.T @ x)
    assert isinstance(linalg.long_matrix(spark, got.gram, range(3), range(3), ("i", "j", "value")).toPandas(), pd.DataFrame)
