import os

import pytest
from pyspark.sql import functions as F

from reelquilt import queries
from reelquilt.operators import compaction

SCHEMA = "file_id long, frame_path string, n_bytes long, status string"


def files(spark, rows):
    """With a column whose name clashes with one of the operator's own."""
    return spark.createDataFrame([(*r, "mine") for r in rows], SCHEMA)


def test_frames_however_written(spark):
    paths = ["frames/a_b_1/a_b_1_000007.jpg", "/x/A_B_1_7.JPEG", r"frames\a_b_1\a_b_1_07.jpg", "a/_retry2/a_b_1_000007 (2).jpg", "a_b_1_000007.jpg (1)", "readme.txt", "7.jpg", "", None, "a/b_3/", "x_99999999999999999999.jpg"]
    df = spark.createDataFrame([(p,) for p in paths], "p string")
    video, number = compaction.frame_of_path(F.col("p"))
    got = [tuple(r) for r in df.select(video, number).collect()]
    assert got[:5] == [("a_b_1", 7)] * 5
    assert [g[1] for g in got[5:]] == [None] * 6


def test_status(spark):
    rows = [(3, "v_1.jpg", 10), (2, "v_1.jpg", 0), (5, "V_01.jpg", 10), (5, "V_01.jpg", 10), (4, "v_1 (1).jpg", None), (3, "v_1.jpg", 12), (None, "v_1.jpg", 9), (7, "x", 5), (8, None, 5), (9, "w_1.jpg", -1)]
    status = {(r["file_id"], r["bytes"]): r["status"] for r in compaction.classify_files(files(spark, rows)).collect()}
    assert status == {(3, 10): "kept", (3, 12): "same", (2, 0): "empty", (5, 10): "repeat", (4, None): "empty", (None, 9): "repeat", (7, 5): "unnamed", (8, 5): "unnamed", (9, -1): "empty"}


def test_containers(spark):
    rows = [(i, f"v{i % 7}_{i}.jpg", 40) for i in range(500)] + [(1000 + i, f"v{i % 7}_{i}.jpg", 40) for i in range(500)] + [(2000, "big_1.jpg", 10_000)]
    plan = compaction.plan_containers(files(spark, rows), target_bytes=1000, open_cost=10)
    kept = plan.where("status = 'kept'")
    assert kept.count() == 501 and kept.select("video", "number").distinct().count() == 501
    assert plan.where("status = 'repeat' and container is null").count() == 500
    sizes = [r["s"] for r in kept.where("bytes < 1000").groupBy("container").agg(F.sum(F.col("bytes") + 10).alias("s")).collect()]
    assert max(sizes) <= 1050 and len(sizes) < 500 * 50 / 1000 * 1.5
    assert compaction.plan_containers(files(spark, []), target_bytes=1000).count() == 0


def test_compact(spark, tmp_path):
    source, target = str(tmp_path / "small"), str(tmp_path / "large")
    df = spark.range(2000).select("id", F.concat(F.lit("x"), F.col("id") % 3).alias("s"), F.when(F.col("id") % 5 == 0, None).otherwise(F.col("id") / 7).alias("v"))
    df.unionByName(df.limit(10)).repartition(60).write.parquet(source)
    done = compaction.compact(spark, source, target, target_bytes=1 << 20, open_cost=1 << 12)
    assert done["rows"] == 2010 and done["files_before"] > 50 and done["files_after"] <= 3
    assert spark.read.parquet(target).exceptAll(spark.read.parquet(source)).isEmpty()
    assert spark.read.parquet(source).exceptAll(spark.read.parquet(target)).isEmpty()
    with pytest.raises(FileExistsError):
        compaction.compact(spark, source, target)
    assert not [f for f in os.listdir(tmp_path) if "staging" in f]


def test_failed_verification_leaves_everything(spark, tmp_path, monkeypatch):
    source, target = str(tmp_path / "small"), str(tmp_path / "large")
    spark.range(10).write.parquet(source)
    answers = iter([(10, 1, 1), (9, 1, 1)])
    monkeypatch.setattr(compaction, "_fingerprint", lambda df: next(answers))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes", None)
    with pytest.raises(RuntimeError, match="other rows"):
        compaction.compact(spark, source, target)
    assert sorted(os.listdir(tmp_path)) == ["small"] and spark.conf.get("spark.sql.files.maxPartitionBytes", None) == before


def test_registered_query_combines_files(spark):
    d = "/root/testdata/sf0.001"
    (got,) = queries.queries()["p6_combined"](spark, d).collect()
    assert got["rows"] == spark.read.parquet(f"{d}/frame_scores.parquet").count()
    assert got["files_before"] > 100 and got["files_after"] == 1


def test_a_value_in_another_column_is_noticed(spark):
    kind = "a int, b int, c string, d array<int>, e struct<x: int, y: int>"
    one = spark.createDataFrame([(1, None, "a", [1, None], (None, 1))], kind)
    for other in ((None, 1, "a", [1, None], (None, 1)), (1, None, "a", [None, 1], (None, 1)), (1, None, "a", [1, None], (1, None)), (1, None, "a", [1], (None, 1))):
        assert compaction._fingerprint(one) != compaction._fingerprint(spark.createDataFrame([other], kind))
    assert compaction._fingerprint(one) == compaction._fingerprint(one.repartition(3))


def test_a_cluster_needs_a_shared_folder():
    from types import SimpleNamespace

    from reelquilt.plans.materialize import ensure_checkpoint_dir

    session = lambda master: SimpleNamespace(conf=SimpleNamespace(get=lambda k, d: d), sparkContext=SimpleNamespace(getCheckpointDir=lambda: None, setCheckpointDir=lambda x: None, master=master))
    for master in ("yarn", "spark://host:7077", "local-cluster[2,1,1024]"):
        with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
            ensure_checkpoint_dir(session(master))
    for master in ("local", "local[4]", "local[*]"):
        assert ensure_checkpoint_dir(session(master))
