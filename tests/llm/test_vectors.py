import numpy as np
import pytest
from pyspark.sql import functions as F

from reelquilt.llm import clusters, kmeans, neighbors, queries, subset
from reelquilt.llm.components import components

NAN, INF = float("nan"), float("inf")


def table(spark, rows):
    """Vectors beside columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, z, 1, 2.0, "x") for i, z in rows], "video_idx int, z array<double>, id int, cosine double, u string")


def brute(x, ids, k):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    c = np.round(u @ u.T, 12)
    out = {}
    for i in range(len(x)):
        order = sorted((j for j in range(len(x)) if j != i), key=lambda j: (-c[i, j], ids[j]))[:k]
        out[ids[i]] = [(ids[j], c[i, j]) for j in order]
    return out


def clustered(seed, n, d, centres=12, spread=0.1):
    rng = np.random.default_rng(seed)
    c = rng.normal(size=(centres, d))
    return c[rng.integers(centres, size=n)] + spread * rng.normal(size=(n, d))


def test_exact_at_factor_one(spark):
    x = clustered(1, 600, 6)
    ids = list(range(10, 610))
    df = table(spark, [(i, v.tolist()) for i, v in zip(ids, x)]).repartition(5)
    want = brute(x, ids, 4)
    for options in ({}, {"chunk_rows": 80, "sample_rows": 300}):
        got = {}
        for r in neighbors.nearest(df, 4, item="video_idx", vector="z", factor=1.0, **options).orderBy("video_idx_a", "rank").collect():
            got.setdefault(r["video_idx_a"], []).append((r["video_idx_b"], r["cosine"]))
        assert {a: [b for b, _ in v] for a, v in got.items()} == {a: [b for b, _ in v] for a, v in want.items()}
        assert got[10][0][1] == pytest.approx(want[10][0][1])
    few = neighbors.nearest(df, 4, item="video_idx", vector="z", factor=1.0, queries=F.col("id") % 20 == 0, chunk_rows=80)
    assert {r["video_idx_a"] for r in few.collect()} == {i for i in ids if i % 20 == 0}


def test_router_in_two_levels(spark, monkeypatch):
    """Where a sample's leaves are too few, each is divided further; a search at factor one stays exact."""
    x = clustered(16, 3000, 5, centres=30, spread=0.3)
    ids = list(range(3000))
    df = table(spark, [(i, v.tolist()) for i, v in zip(ids, x)]).repartition(4)
    made = []
    fit = neighbors.fit_router
    monkeypatch.setattr(neighbors, "fit_router", lambda *a, **k: made.append(fit(*a, **k)) or made[-1])
    options = {"chunk_rows": 50, "sample_rows": 400}
    got = {}
    for r in neighbors.nearest(df, 3, item="video_idx", vector="z", factor=1.0, queries=F.col("id") % 20 == 0, **options).orderBy("video_idx_a", "rank").collect():
        got.setdefault(r["video_idx_a"], []).append(r["video_idx_b"])
    assert made[0].leaves > 2 * 400 // 64
    want = brute(x, ids, 3)
    assert got == {i: [b for b, _ in want[i]] for i in ids if i % 20 == 0}
    found = neighbors.nearest(df, 3, item="video_idx", vector="z", factor=0.6, queries=F.col("id") % 20 == 0, **options).collect()
    assert sum(r["video_idx_b"] in got[r["video_idx_a"]] for r in found) / (3 * 150) >= 0.9


def test_recall_when_relaxed(spark):
    x = clustered(2, 2000, 16, centres=40, spread=0.3)
    ids = list(range(2000))
    got = neighbors.nearest(table(spark, [(i, v.tolist()) for i, v in zip(ids, x)]), 5, item="video_idx", vector="z", factor=0.6, chunk_rows=500)
    want = brute(x, ids, 5)
    hits = sum(r["video_idx_b"] in {b for b, _ in want[r["video_idx_a"]]} for r in got.collect())
    assert hits / (5 * 2000) >= 0.9


def test_recall_on_the_project_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/embedding.parquet")
    got = neighbors.nearest(df, 5, item="video_idx", vector="z", size=32, queries=F.col("id") % 20 == 0, factor=0.6, chunk_rows=200)
    ok = df.where((F.size("z") == 32) & F.exists("z", lambda v: v != 0)).select("video_idx", "z").distinct().toPandas()
    want = brute(np.array(ok["z"].tolist()), ok["video_idx"].tolist(), 5)
    rows = got.collect()
    assert sum(r["video_idx_b"] in {b for b, _ in want[r["video_idx_a"]]} for r in rows) / (5 * sum(i % 20 == 0 for i in want)) >= 0.9


def test_copies_and_dirt(spark):
    rows = [(i, [1.0, 2.0, 3.0]) for i in range(40)] + [(100, [2.0, 4.0, 6.0]), (101, [1.0, 2.0, 3.1]), (102, [-1.0, 0.5, 0.0])]
    rows += [(5, [1.0, 2.0, 3.0])] * 3 + [(200, None), (201, [0.0, 0.0, 0.0]), (202, [1.0]), (203, [NAN, 1.0, 1.0]), (204, [1.0, None, 1.0]), (205, [INF, 1.0, 1.0]), (None, [1.0, 2.0, 3.0]), (206, [])]
    df = table(spark, rows)
    got = {}
    for r in neighbors.nearest(df, 3, item="video_idx", vector="z", factor=1.0).orderBy("video_idx_a", "rank").collect():
        got.setdefault(r["video_idx_a"], []).append(r["video_idx_b"])
    assert set(got) == {*range(40), 100, 101, 102}
    assert got[0] == [1, 2, 3] and got[2] == [0, 1, 3] and got[39] == [0, 1, 2] and got[100] == [0, 1, 2]
    assert got[101] == [0, 1, 2] and len(got[102]) == 3
    pairs = {tuple(r) for r in neighbors.mutual_pairs(df, 3, item="video_idx", vector="z", min_cosine=0.99, factor=1.0).collect()}
    assert pairs == {(a, b) for a in range(4) for b in range(a + 1, 4)}
    empty = table(spark, [])
    assert neighbors.nearest(empty, 3, item="video_idx", vector="z").count() == 0
    assert neighbors.nearest(table(spark, [(1, None)]), 3, item="video_idx", vector="z").count() == 0
    assert neighbors.nearest(table(spark, [(1, [1.0, 1.0])]), 3, item="video_idx", vector="z").count() == 0


def test_bounded_pairs_equal_brute_force(spark):
    x = clustered(3, 900, 8, centres=150, spread=0.08)
    ids = list(range(900))
    want = brute(x, ids, 5)
    near = {(a, b) for a, v in want.items() for b, c in v if c >= 0.97}
    df = table(spark, [(i, v.tolist()) for i, v in zip(ids, x)])
    got = {tuple(r) for r in neighbors.mutual_pairs(df, 5, item="video_idx", vector="z", min_cosine=0.97, factor=1.0, chunk_rows=100).collect()}
    assert got == {(a, b) for a, b in near if a < b and (b, a) in near}


# --- components and clusters ---


def test_components(spark):
    rng = np.random.default_rng(4)
    edges = [(int(a), int(b)) for a, b in rng.integers(300, size=(170, 2))] + [(1000 + i, 1001 + i) for i in range(60)] + [(2000, 2001 + i) for i in range(50)] + [(7777, 7777), (None, 3), (4, None)]
    root = {}

    def find(a):
        while root.setdefault(a, a) != a:
            a = root[a]
        return a

    for a, b in edges:
        if a is not None and b is not None:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {a: find(a) for a in root}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("spread, radius", [(0.02, 0.06), (0.2, 0.3), (0.001, 0.06), (0.05, 0.06)])
def test_local_groups(spread, radius):
    x = clustered(5, 700, 6, centres=15, spread=spread)
    x[:40] = x[0]
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    label = np.arange(len(x))
    while True:
        new = np.where(d <= radius, label[None, :], len(x)).min(axis=1)
        if (new == label).all():
            break
        label = new
    got = clusters.local_groups(x, radius)
    assert len(set(zip(label, got))) == len(set(label)) == len(set(got))


def test_linked_groups(spark):
    x = clustered(6, 500, 8, centres=40, spread=0.02)
    x[100:130] = x[100]
    df = spark.createDataFrame([(i, v.tolist(), "c") for i, v in enumerate(x)], "id int, x array<double>, h string").repartition(4)
    for size, cells in ((64, 10), (4, 10), (64, 1000)):  # also with many collisions, and with one cell
        got = {r["id"]: (r["group_id"], r["group_size"]) for r in clusters.linked_groups(df, 8, 0.1, hashing=clusters.FeatureHash(list(range(8)), size=size), cell_rows=cells).collect()}
        label = clusters.local_groups(x, 0.1)
        members = {}
        for i, g in enumerate(label):
            members.setdefault(g, []).append(i)
        assert got == {i: (min(members[g]), len(members[g])) for i, g in enumerate(label)}
    assert clusters.linked_groups(df.limit(0), 8, 0.1, hashing=clusters.FeatureHash(list(range(8)))).count() == 0


@pytest.mark.parametrize("spread", [0.004, 0.012, 0.03])
def test_crowds_are_divided(spark, spread):
    rng = np.random.default_rng(12)
    crowd = 0.5 + spread * rng.normal(size=(900, 8)) / 8**0.5
    ring = 0.5 + 0.08 * (lambda v: v / np.linalg.norm(v, axis=1, keepdims=True))(rng.normal(size=(150, 8)))
    x = np.concatenate([crowd, ring, rng.uniform(size=(300, 8)), 0.5 + rng.uniform(-0.06, 0.06, size=(250, 8))])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id int, x array<double>").repartition(4)
    label = clusters.local_groups(x, 0.06)
    first = {g: int(np.flatnonzero(label == g)[0]) for g in set(label)}
    for max_rows in (60, 200, 5000):
        got = {r["id"]: r["group_id"] for r in clusters.linked_groups(df, 8, 0.06, hashing=clusters.FeatureHash(list(range(8))), cell_rows=700, max_rows=max_rows).collect()}
        assert got == {i: first[g] for i, g in enumerate(label)}


def test_many_large_cells(spark):
    """Every one of some 400 cells is larger than ``max_rows``."""
    x = clustered(15, 5000, 6, centres=400, spread=0.02)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id int, x array<double>").repartition(4)
    label = clusters.local_groups(x, 0.05)
    first, size = {}, {}
    for i, g in enumerate(label):
        first.setdefault(g, i)
        size[g] = size.get(g, 0) + 1
    weighted = lambda rows: clusters.FeatureHash(list(range(6)), clusters.inverse_deviations(rows, 6))
    got = {r["id"]: (r["group_id"], r["group_size"]) for r in clusters.linked_groups(df, 6, 0.05, hashing=weighted, cell_rows=12, max_rows=5).collect()}
    assert got == {i: (first[g], size[g]) for i, g in enumerate(label)}


def test_feature_vectors(spark):
    rows = [(1, 0, 0.5, 1), (1, 1, 0.25, 1), (1, 0, 0.7, 2), (1, 0, 0.7, 2), (2, 0, 0.1, 1), (3, 0, 0.1, 1), (3, 1, 0.2, 1), (3, 1, None, 2), (4, 0, NAN, 1), (4, 1, 1.0, 1), (None, 0, 1.0, 1), (5, None, 1.0, 1), (5, 9, 1.0, 1)]
    df = spark.createDataFrame([(*r, "c") for r in rows], "v int, s int, score double, t int, id string")
    got = [tuple(r) for r in clusters.feature_vectors(df, [0, 1], record="v", feature="s", value="score", version="t").collect()]
    assert got == [(1, [0.7, 0.25])]


def test_newest_scores_of_records_that_are_repeated_often(spark):
    rng = np.random.default_rng(17)
    rows = [(int(v), int(f), float(x), int(t)) for v, f, x, t in zip(np.where(rng.random(30_000) < 0.4, 7, rng.integers(200, size=30_000)), rng.integers(5, size=30_000), rng.random(30_000).round(3), rng.integers(50, size=30_000))]
    rows += [(7, 1, None, 60), (8, 1, None, 60), (8, 1, 0.5, 60), (900, 0, 0.5, None), (900, 1, None, None), (901, 0, 0.1, None), (901, 0, 0.2, 1)]
    best = {}
    for v, f, x, t in rows:
        key = (t is not None, t or 0, x is not None, x or 0.0)
        if (v, f) not in best or key > best[v, f][0]:
            best[v, f] = (key, x)
    held = {}
    for (v, f), (_, x) in best.items():
        if x is not None:
            held.setdefault(v, {})[f] = x
    df = spark.createDataFrame(rows, "v int, f int, s double, t int").repartition(5)
    timed = df.select("v", "f", "s", F.timestamp_seconds("t").alias("t"))
    for table_of in (df, timed):
        got = {r["id"]: r["x"] for r in clusters.feature_vectors(table_of, [4, 0, 1, 2, 3], record="v", feature="f", value="s", version="t").collect()}
        assert got == {v: [x[f] for f in (4, 0, 1, 2, 3)] for v, x in held.items() if len(x) == 5} and 7 not in got
    means = {f: np.mean([x[f] for x in held.values() if f in x]) for f in range(5)}
    loose = {r["id"]: r["x"] for r in clusters.feature_vectors(df, [0, 1, 2, 3, 4, 9], record="v", feature="f", value="s", version="t", complete=False).collect()}
    assert set(loose) == set(held) and all(loose[v] == pytest.approx([*(held[v].get(f, means[f]) for f in range(5)), 0.0]) for v in held)
    assert clusters.feature_vectors(df.limit(0), [0], record="v", feature="f", value="s").count() == 0


def test_hashing_bound():
    rng = np.random.default_rng(7)
    h = clusters.FeatureHash(list(range(24)), weights=rng.uniform(0.5, 2, size=24).tolist(), size=16)
    a, b = rng.normal(size=(2, 100, 24))
    assert (np.linalg.norm((a - b) @ h.matrix, axis=1) <= h.norm * np.linalg.norm(a - b, axis=1) + 1e-9).all()


def test_incomplete_records_have_vectors(spark):
    df = spark.createDataFrame([(1, 0, 0.2), (1, 1, 0.5), (2, 0, 0.4), (2, 1, None), (3, 1, 0.7), (4, 0, NAN), (None, 0, 9.0), (3, 9, 1.0)], "v int, s int, score double")
    got = {r["id"]: r["x"] for r in clusters.feature_vectors(df, [1, 0, 5], record="v", feature="s", value="score", complete=False).collect()}
    assert set(got) == {1, 2, 3}
    assert [got[i] for i in (1, 2, 3)] == [pytest.approx(x) for x in ([0.5, 0.2, 0.0], [0.6, 0.4, 0.0], [0.7, 0.3, 0.0])]


def test_every_video_is_in_a_cluster(spark):
    d = "/root/testdata/sf0.001"
    videos = spark.read.parquet(f"{d}/video_scores.parquet").where("score is not null").select("video_idx").distinct().count()
    assert queries.p3_clusters(spark, d).agg(F.sum("n_members")).first()[0] == videos


def test_clusters_are_described(spark):
    x = clustered(8, 300, 5, centres=4, spread=0.01)
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id int, x array<double>")
    labels = spark.createDataFrame([(i, int(i % 2)) for i in range(300)] + [(0, None)], "id int, label int")
    got = clusters.labelled_clusters(vectors, clusters.FeatureHash(list(range(5))), labels, k=4).collect()
    assert sum(r["n_members"] for r in got) == 300 and len(got) == 4
    assert all(len(r["typical"]) == 5 and r["radius"] < 0.2 and 0.4 < r["top_share"] <= 1 for r in got)
    for r in got:
        own = x[r["typical"]]
        assert np.linalg.norm(own - own.mean(0), axis=1).max() < 0.05
    none = clusters.labelled_clusters(vectors.limit(0), clusters.FeatureHash(list(range(5))), labels, k=4)
    assert none.count() == 0


def test_features_in_one_bucket_count_apart(spark):
    hashing = clusters.FeatureHash(list(range(24)))
    at = np.abs(hashing.matrix).argmax(axis=1)
    a, b = next((i, j) for i in range(24) for j in range(i) if at[i] == at[j] and (hashing.matrix[i] == -hashing.matrix[j]).all())
    x = np.zeros((4, 24))
    x[0, [a, b]] = 1.0  # the two cancel out in the hashed vector
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id int, x array<double>")
    labels = spark.createDataFrame([(0, 1)], "id int, label int")
    (got,) = clusters.labelled_clusters(vectors, hashing, labels, k=1).collect()
    assert got["radius"] == pytest.approx(0.75 * 2**0.5) and got["typical"] == [1, 2, 3, 0]


def test_weights_are_inverse_deviations(spark):
    x = np.random.default_rng(14).normal(size=(200, 3)) * [0.01, 1.0, 0.0]
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id int, x array<double>")
    assert clusters.inverse_deviations(vectors, 3) == pytest.approx([1 / x[:, 0].std(), 1 / x[:, 1].std(), 1.0])


def test_seeding_finds_far_groups(spark):
    x = np.concatenate([clustered(9, 3000, 4, centres=1, spread=0.01), clustered(10, 6, 4, centres=1, spread=0.01) + 50])
    df = spark.createDataFrame([(v.tolist(),) for v in x], "h array<double>")
    centres = kmeans.refine(df, "h", 4, kmeans.seeds(df, "h", 4, 2), 3)
    assert len(centres) == 2 and np.abs(centres.max()) > 40


# --- subset ---


@pytest.mark.parametrize("rule", ["sqrt", "equal"])
def test_quotas(rule):
    assert subset.quotas([], 5, rule) == [] and subset.quotas([3, 0], 0, rule) == [0, 0]
    assert subset.quotas([5, 1, 100], 500, rule) == [5, 1, 100]
    for sizes, wanted in (([1000, 10, 10, 1], 30), ([7, 7, 7], 8), ([1, 1, 1, 1000], 10)):
        got = subset.quotas(sizes, wanted, rule)
        assert sum(got) == wanted and all(0 <= q <= s for q, s in zip(got, sizes))
    if rule == "sqrt":
        assert subset.quotas([10_000, 100], 110, rule) == [100, 10]
    with pytest.raises(ValueError):
        subset.quotas([1], 1, "all")


def test_subset_spreads(spark):
    rng = np.random.default_rng(11)
    kinds = np.concatenate([np.zeros(3000, dtype=int), np.repeat(np.arange(1, 11), 30)])
    centre = rng.normal(size=(11, 8)) * 3
    x = centre[kinds] + 0.05 * rng.normal(size=(len(kinds), 8))
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(0, x[0].tolist())] * 5 + [(9000, None), (9001, [0.0] * 8), (9002, [1.0]), (None, [1.0] * 8)]
    df = table(spark, rows)
    got = subset.varied_subset(df, 110, item="video_idx", vector="z", clusters=11).collect()
    picked = [r["video_idx"] for r in got]
    assert len(picked) == len(set(picked)) == 110 and max(picked) < 9000
    crowd = sum(kinds[i] == 0 for i in picked)
    assert crowd < 80 and {int(kinds[i]) for i in picked} == set(range(11))  # a random draw would take 100 of the crowd
    again = subset.varied_subset(df.repartition(7), 110, item="video_idx", vector="z", clusters=11).collect()
    assert sorted(r["video_idx"] for r in again) == sorted(picked)
    assert subset.varied_subset(df, 10_000, item="video_idx", vector="z").count() == len(kinds)
    assert subset.varied_subset(df, 0, item="video_idx", vector="z").count() == 0
    assert subset.varied_subset(table(spark, []), 5, item="video_idx", vector="z").count() == 0
    assert subset.varied_subset(table(spark, [(1, None)]), 5, item="video_idx", vector="z").count() == 0


def test_draws_are_the_smallest_hashes(spark):
    """The histogram takes the same members as a sort of whole clusters, also where one bin holds more than its places."""
    sizes = {0: 5000, 1: 40, 2: 1}
    placed = spark.createDataFrame([(c * 10_000 + i, c) for c, n in sizes.items() for i in range(n)], "id int, cluster int")
    for quota in ({0: 1, 1: 39, 2: 1}, {0: 4999, 1: 40, 2: 0}, {0: 2500, 1: 7, 2: 1}):
        plan = spark.createDataFrame([(c, n, quota[c]) for c, n in sizes.items()], "cluster int, cluster_size long, quota long")
        got = sorted((r["cluster"], r["id"]) for r in subset.drawn(placed, plan, 5).collect())
        ranked = placed.select("cluster", "id", F.xxhash64(F.lit(5), "id").alias("h")).toPandas().sort_values(["cluster", "h", "id"])
        assert got == sorted((c, i) for c in sizes for i in ranked[ranked.cluster == c].id.head(quota[c]))
