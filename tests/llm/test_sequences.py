import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from reelquilt.llm import packing, quantiles, queries, runs

NAN, INF = float("nan"), float("inf")

# --- percentiles ---


def scores(spark, rows):
    return spark.createDataFrame([(*r, 7, "c") for r in rows], "g string, s int, v double, n int, cells string")


def exact(values, p):
    return np.percentile(values, 100 * p)


def test_percentiles_within_the_stated_error(spark):
    rng = np.random.default_rng(1)
    groups = {("a", 1): rng.normal(0.2, 0.1, 20_000), ("a", 2): rng.beta(2, 9, 50), ("b", 1): np.full(30, 0.1234), ("b", 2): rng.uniform(-1, 1, 1), (None, 3): rng.uniform(0, 0.5, 200)}
    df = scores(spark, [(g, s, float(v)) for (g, s), x in groups.items() for v in x]).repartition(6)
    shape = quantiles.DyadicSketch()
    cell = 2 / shape.width
    got = {(r["g"], r["s"]): r for r in quantiles.quantiles(quantiles.sketch(df, ["g", "s"], "v"), ["g", "s"], [0, 0.5, 0.95, 1]).collect()}
    assert {k: r["n"] for k, r in got.items()} == {k: len(x) for k, x in groups.items()}
    for k, x in groups.items():
        assert np.abs(np.array(got[k]["quantiles"]) - [exact(np.clip(x, -1, 1), p) for p in (0, 0.5, 0.95, 1)]).max() <= cell
    for k in (("a", 2), ("b", 1), (None, 3)):  # small groups: no collisions worth mentioning
        assert np.abs(np.array(got[k]["quantiles"]) - [exact(groups[k], p) for p in (0, 0.5, 0.95, 1)]).max() <= 2.1 / 2**shape.bits


@pytest.mark.parametrize("width, depth", [(64, 5), (256, 5)])
def test_narrow_sketches(spark, width, depth):
    rng = np.random.default_rng(2)
    x = rng.normal(0, 0.3, 30_000)
    shape = quantiles.DyadicSketch(width=width, depth=depth)
    df = scores(spark, [("a", 1, float(v)) for v in x])
    got = quantiles.quantiles(quantiles.sketch(df, ["g"], "v", shape=shape), ["g"], [0.1, 0.5, 0.9], shape=shape).first()["quantiles"]
    assert np.abs(np.array(got) - [exact(x, p) for p in (0.1, 0.5, 0.9)]).max() <= 2 / width


def test_merging_and_deleting(spark):
    rng = np.random.default_rng(3)
    x, y = rng.uniform(0, 1, 500), rng.uniform(-1, 0, 300)
    one, two = scores(spark, [("a", 1, float(v)) for v in x]), scores(spark, [("a", 1, float(v)) for v in y])
    keys = ["g", "s"]
    days = [quantiles.combine(quantiles.sketch(d, keys, "v"), keys) for d in (one, two)]
    assert [d.count() for d in days] == [1, 1]
    both = quantiles.combine(days[0].unionByName(days[1]), keys).first()
    at_once = quantiles.combine(quantiles.sketch(one.unionByName(two).repartition(5), keys, "v"), keys).first()
    assert both == at_once and both["n"] == 800
    taken_back = quantiles.sketch(two.withColumn("w", F.lit(-1)), keys, "v", weight="w")
    rest = quantiles.combine(days[0].unionByName(days[1]).unionByName(taken_back), keys).first()
    assert rest == days[0].first()


def test_sketches_on_every_resolution(spark):
    """From 64 cells on all counts are signed sketches; errors of ranks are measured against the exact percentiles."""
    rng = np.random.default_rng(4)
    groups = {"normal": rng.normal(0.2, 0.1, 30_000), "skewed": rng.beta(2, 9, 30_000), "wide": rng.uniform(-1, 1, 30_000), "few": rng.choice([0.1, 0.2, 0.7], 30_000)}
    shape = quantiles.DyadicSketch(bits=16, top=64, width=1024, depth=5, raw=50)
    assert list(shape.levels) == list(range(7, 17))
    df = scores(spark, [(g, 1, float(v)) for g, x in groups.items() for v in x]).repartition(4)
    asked = [0.05, 0.25, 0.5, 0.75, 0.95]
    kept = quantiles.combine(quantiles.sketch(df, ["g"], "v", shape=shape), ["g"], shape=shape)
    assert kept.select(F.min(F.array_min("cells"))).first()[0] >= shape.values  # counters only
    for r in quantiles.quantiles(kept, ["g"], asked, shape=shape).collect():
        x = np.sort(groups[r["g"]])
        for p, v in zip(asked, r["quantiles"]):
            low, high = np.searchsorted(x, v - 1e-4) / len(x), np.searchsorted(x, v + 1e-4, side="right") / len(x)
            assert low - 0.005 <= p <= high + 0.005


@pytest.mark.parametrize("raw, error", [(10_000, 2e-5), (30, 2e-3)])
def test_sequences_against_distinct_rows(spark, raw, error):
    rng = random.Random(5)
    rows = [(v, rng.choice([None, *range(3000)]) if v == "long" else rng.randrange(40), f, round(rng.betavariate(2, 6), 3)) for v in ("long", "a", "b", None) for f in (1, 2, None) for _ in range(1500 if v == "long" else 60)]
    rows += rng.choices(rows, k=400) + [("a", 3, 1, None), ("a", 4, 1, NAN), ("nulls", 1, 1, None), ("a", 5, 1, 7.0), ("b", 5, 1, INF)]
    rng.shuffle(rows)
    shape = quantiles.DyadicSketch(bits=16, top=64, width=1024, depth=5, raw=raw)
    df = spark.createDataFrame([(*r, 1, "x", "y") for r in rows], "v string, frame int, f int, s double, n int, k string, part string").repartition(3)
    want = {}
    for v, _, f, s in {r for r in rows if r[3] is None or r[3] == r[3]}:
        want.setdefault((v, f), []).append(s) if s is not None else want.setdefault((v, f), [])
    for stretch in (16, 1024):
        parts = quantiles.sketch_sequences(df, sequence="v", position="frame", feature="f", value="s", shape=shape, stretch=stretch)
        got = {(r["v"], r["f"]): r for r in quantiles.quantiles(parts, ["v", "f"], [0.1, 0.5, 0.95], shape=shape).collect()}
        assert set(got) == set(want)
        for key, x in want.items():
            assert got[key]["n"] == len(x)
            assert x or got[key]["quantiles"] is None
            if x:
                assert np.abs(np.array(got[key]["quantiles"]) - [exact(np.clip(x, -1, 1), p) for p in (0.1, 0.5, 0.95)]).max() <= error
    assert quantiles.sketch_sequences(df.limit(0), sequence="v", position="frame", feature="f", value="s", shape=shape).count() == 0


def test_percentile_edges(spark):
    df = scores(spark, [("a", 1, None), ("a", 1, NAN), ("b", 1, 5.0), ("b", 1, -5.0), ("b", 1, INF), (None, None, 0.5)])
    got = {(r["g"], r["s"]): (r["n"], r["quantiles"]) for r in quantiles.quantiles(quantiles.sketch(df, ["g", "s"], "v"), ["g", "s"], [0.0, 1.0]).collect()}
    assert got[("a", 1)] == (0, None) and got[("b", 1)][0] == 3
    assert got[("b", 1)][1] == pytest.approx([-1, 1], abs=3e-4) and got[(None, None)][1] == pytest.approx([0.5, 0.5], abs=3e-4)
    assert quantiles.quantiles(quantiles.sketch(df.limit(0), ["g"], "v"), ["g"], [0.5]).count() == 0
    for bad in ({"width": 100}, {"width": 8192}, {"bits": 30}):
        with pytest.raises(ValueError):
            quantiles.DyadicSketch(**bad)
    with pytest.raises(ValueError):
        quantiles.quantiles(df, [], [1.5])


# --- runs ---


def events(spark, rows):
    return spark.createDataFrame([(*r, 1, "c") for r in rows], "video_id string, frame_idx int, statement_index int, score double, n int, first string")


def brute_runs(rows, tolerance=0.005, max_gap=3):
    frames = {}
    for v, p, s, x in rows:
        if v is None or p is None or s is None:
            continue
        cell = frames.setdefault(v, {}).setdefault(p, {})
        if x is not None and (cell.get(s) is None or x < cell[s]):
            cell[s] = x
        else:
            cell.setdefault(s, None)
    out = set()
    for v, by in frames.items():
        run = []
        for p in sorted(by):
            if run:
                a, b = by[run[-1]], by[p]
                ok = p - run[-1] <= max_gap and all(a[s] is None or b[s] is None or abs(a[s] - b[s]) <= tolerance + 1e-9 for s in set(a) & set(b))
                if not ok:
                    out.add((v, run[0], run[-1], len(run)))
                    run = []
            run.append(p)
        out.add((v, run[0], run[-1], len(run)))
    return out


@pytest.mark.parametrize("block", [4, 7, 64, 2048])
def test_runs(spark, block):
    rng = random.Random(9)
    rows = []
    for v, n in (("a", 120), ("b", 5), ("cam", 400), ("one", 1)):
        p, base = rng.randint(0, 5), [0.1, 0.2, 0.3]
        for _ in range(n):
            if rng.random() < 0.25:
                base = [round(rng.random(), 3) for _ in base]
            for s, x in enumerate(base):
                if rng.random() < 0.9:
                    rows.append((v, p, s, None if rng.random() < 0.1 else round(x + rng.choice([0, 0.001, 0.005]), 4)))
            p += rng.choice([1, 1, 1, 2, 3, 4, 9])
    rows += rows[::5] + [(None, 1, 1, 0.5), ("a", None, 1, 0.5), ("a", 1, None, 0.5)]
    got = runs.collapse_runs(events(spark, rows).repartition(5), block=block).collect()
    assert {(r["video_id"], r["first_frame_idx"], r["last_frame_idx"], r["n_events"]) for r in got} == brute_runs(rows)
    assert len(got) == len(brute_runs(rows))
    assert all(r["duration_s"] == pytest.approx((r["last_frame_idx"] - r["first_frame_idx"] + 1) / 3) for r in got)


def test_run_edges(spark):
    assert runs.collapse_runs(events(spark, [])).count() == 0
    limits = [("a", 0, 0, 0.27), ("a", 3, 0, 0.265), ("a", 6, 0, 0.2701), ("a", 10, 0, 0.2701), ("a", 11, 1, 0.9), ("a", 12, 0, NAN), ("a", -5, 0, 0.1), ("a", -4, 0, 0.1)]
    got = sorted((r["first_frame_idx"], r["last_frame_idx"]) for r in runs.collapse_runs(events(spark, limits)).collect())
    assert got == [(-5, -4), (0, 3), (6, 6), (10, 12)]
    with pytest.raises(ValueError):
        runs.collapse_runs(events(spark, []), max_gap=9, block=4)


# --- packing ---


def test_best_fit_against_plain_search():
    rng = random.Random(4)
    for _ in range(40):
        n = rng.randint(0, 60)
        sizes = [rng.randint(1, 50) for _ in range(n)]
        source, cluster = [rng.choice([None, "x", "y", "z"]) for _ in range(n)], [rng.choice([None, *range(20)]) for _ in range(n)]
        got = packing.best_fit(sizes, 50, source, cluster)
        bins = []
        want = [0] * n
        for i in sorted(range(n), key=lambda i: -sizes[i]):
            clash = lambda b: any((source[j] is not None and source[j] == source[i]) or (cluster[j] is not None and cluster[j] == cluster[i]) for j in b)
            room = [(50 - sum(sizes[j] for j in b), k) for k, b in enumerate(bins) if 50 - sum(sizes[j] for j in b) >= sizes[i] and not clash(b)]
            k = min(room)[1] if room else len(bins)
            if k == len(bins):
                bins.append([])
            bins[k].append(i)
            want[i] = k
        assert got == want


def videos(spark, rows):
    return spark.createDataFrame([(*r, "c", 1) for r in rows], "video_id string, duration_s double, site string, item string, units int")


def test_packing(spark):
    rng = random.Random(6)
    rows = [(f"v{i}", round(rng.uniform(1, 64), 1), None) for i in range(900)] + [("long", 200.0, None), ("even", 130.0, None), ("edge", 65.0, None), ("over", 65.01, None), ("v1", None, None), ("bad", NAN, None), ("inf", INF, None), ("zero", 0.0, None), ("neg", -1.0, None), (None, 5.0, None)]
    df = videos(spark, rows + rows[:50])
    got = packing.pack(df, 65.0, item="video_id", size="duration_s", shard_items=200).toPandas()
    bins = got.groupby("bin_id")["secs"].sum()
    assert bins.max() <= 65 + 1e-6
    assert np.allclose(got.groupby("bin_id")["bin_total"].first(), bins)
    pieces = got.groupby("video_id", dropna=False)["secs"].agg(["sum", "count"])
    want = {r[0]: r[1] for r in rows if r[1] is not None and 0 < r[1] < INF}
    assert len(pieces) == len(want) and all(abs(pieces.loc[v, "sum"] - d) < 1e-6 for v, d in want.items() if v)
    assert {v: int(n) for v, n in pieces["count"].items() if n > 1} == {"long": 4, "even": 2, "over": 2}
    assert (got.groupby(["video_id", "piece"]).size() == 1).all()
    assert bins.sum() / (65 * len(bins)) > 0.97
    again = packing.pack(df.repartition(7), 65.0, item="video_id", size="duration_s", shard_items=200).toPandas()
    assert sorted(map(str, again.to_records(index=False))) == sorted(map(str, got.to_records(index=False)))


def test_wide_ids_and_null_ids(spark):
    ids = [(1 << 62) + 1, (1 << 62) + 3, None]
    df = spark.createDataFrame([(i, 10.0) for i in ids], "id long, secs double")
    got = packing.pack(df, 65.0, item="id", size="secs").collect()
    assert {r["id"] for r in got} == set(ids) and len({r["bin_id"] for r in got}) == 1


def test_conflicts(spark):
    rows = [(f"v{i}", 10.0, "abc"[i % 3]) for i in range(90)]
    got = packing.pack(videos(spark, rows), 65.0, item="video_id", size="duration_s", source="site").toPandas()
    site = {r[0]: r[2] for r in rows}
    assert all(len({site[v] for v in g}) == len(g) for _, g in got.groupby("bin_id")["video_id"])
    assert got["bin_id"].nunique() == 30
    assert packing.pack(videos(spark, []), 65.0, item="video_id", size="duration_s").count() == 0
    with pytest.raises(ValueError):
        packing.pack(videos(spark, []), 0, item="video_id", size="duration_s")


def test_sources_and_near_copies_stay_apart(spark):
    """On the project's videos, whose sources and near copies do meet where nothing keeps them apart."""
    d = "/root/testdata/sf0.01"
    got = queries.p7_apart(spark, d).toPandas()
    kept = {(r["video_id"], r["piece"]): r for r in queries.p7_packed(spark, d).collect()}
    assert len(got) == len(kept) == len(got.drop_duplicates(["video_id", "piece"]))
    assert (got.groupby("bin_id").secs.sum() <= 65 + 1e-6).all()
    loose = got[got.groupby("bin_id").secs.transform("size") > 1]
    assert not loose.duplicated(["bin_id", "source"]).any()
    assert not loose[loose.duplicate_of.notna()].duplicated(["bin_id", "duplicate_of"]).any()
    free = got.assign(bin_id=[kept[v, p]["bin_id"] for v, p in zip(got.video_id, got.piece)])
    assert free.duplicated(["bin_id", "source"]).any() and free[free.duplicate_of.notna()].duplicated(["bin_id", "duplicate_of"]).any()
    assert got.bin_id.nunique() <= 1.02 * np.ceil(got.secs.sum() / 65)
