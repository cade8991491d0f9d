import unicodedata

from pyspark.sql import functions as F

from reelquilt.functions import names

CASES = {
    "Crème brûlée": "Creme_brulee",
    "it's, \"fine\" `ok`": "its_fine_ok",
    "a´b": "a_b",
    "ﬁsh  and   chips": "fish_and_chips",
    "x__y--z..": "x_y--z..",
    "日本 7": "_7",
    "": "",
    None: None,
}


def test_sanitize(spark):
    df = spark.createDataFrame([(k,) for k in CASES], "s string")
    got = {r["s"]: r["n"] for r in df.select("s", names.sanitize_name(F.col("s")).alias("n")).collect()}
    assert got == CASES


def test_acute_becomes_space_before_deletion():
    assert unicodedata.normalize("NFKD", "´")[0] == " "


def test_stem_and_destination(spark):
    df = spark.createDataFrame([("/a/b.side.MP4",), (r"in\x.mov",), ("plain",), (".hidden",)], "p string")
    got = [tuple(r) for r in df.select(names.stem(F.col("p")), names.destination("out/", F.col("p"))).collect()]
    assert got == [("b.side", "out/b.side.mp4"), ("x", "out/x.mp4"), ("plain", "out/plain.mp4"), (".hidden", "out/.hidden.mp4")]


def test_labels(spark):
    df = spark.createDataFrame([(720,), (0,), (None,)], "h int")
    assert [r[0] for r in df.select(names.resolution_label(F.col("h"))).collect()] == ["720p", "original", "original"]
    assert spark.range(1).select(names.frame_name(F.lit("v"), F.lit(7))).first()[0] == "v_000007.jpg"
