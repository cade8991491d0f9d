import json
import os
import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from reelquilt import config, schemas
from reelquilt.config import PipelineConfig
from reelquilt.plans import pipeline, sinks
from reelquilt.sources import encoders, media, statements

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers can't import test modules


def test_statements_from_csv(spark, tmp_path):
    path = tmp_path / "s.csv"
    path.write_text('category,statement\nsea,"waves, foam"\nsky,clouds\nsea,boats\n')
    got = [tuple(r) for r in statements.get_statements(spark, str(path)).orderBy("statement_index").collect()]
    assert got == [(0, "sea", "waves, foam"), (1, "sea", "boats"), (2, "sky", "clouds")]
    assert [r["statement"] for r in statements.get_statements(spark, str(path), "sky").collect()] == ["clouds"]
    assert statements.as_dict(statements.get_statements(spark, str(path))) == {"sea": ["waves, foam", "boats"], "sky": ["clouds"]}


def test_statement_errors(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        statements.get_statements(spark, str(tmp_path / "no.csv"))
    (tmp_path / "bad.csv").write_text("category,text\na,b\n")
    with pytest.raises(ValueError, match="statement"):
        statements.get_statements(spark, str(tmp_path / "bad.csv"))
    for source in (None, 7, ("a",)):
        with pytest.raises(ValueError):
            statements.get_statements(spark, source)
    with pytest.raises(ValueError, match="available: custom"):
        statements.get_statements(spark, ["a"], "nope")
    with pytest.raises(ValueError):
        statements.from_list(spark, "text")


def test_statement_list_and_dict(spark):
    assert [tuple(r) for r in statements.get_statements(spark, ["x", "y"]).collect()] == [(0, "custom", "x"), (1, "custom", "y")]
    assert [tuple(r) for r in statements.get_statements(spark, {"b": ["x"], "a": ["y", "z"]}).collect()] == [(0, "b", "x"), (1, "a", "y"), (2, "a", "z")]


def test_require_columns(spark):
    df = spark.range(1)
    with pytest.raises(ValueError, match="video_id"):
        schemas.require_frames(df)
    for check in (schemas.require_clusters, schemas.require_video_index):
        with pytest.raises(ValueError):
            check(df)


def test_config():
    assert config.PipelineConfig(seed=0).effective_seed == 1234
    for bad in ({"aggregation": "sum"}, {"centering": "x"}, {"init": "x"}, {"n_strata": 0}, {"n_compilations": 0}, {"anchor_metric": "l1"}, {"percentile": 101}):
        with pytest.raises(ValueError):
            config.PipelineConfig(**bad)


class Fake:
    """Knows a few files; writes empty ones."""

    def probe(self, path):
        if "broken" in path:
            raise RuntimeError("no")
        height = 1080 if "tall" in path else 480
        return json.dumps({"format": {"duration": "12.5"}, "streams": [{"width": 640, "height": height}]})

    def normalize(self, source, target, height):
        if "broken" in source:
            raise RuntimeError("cannot decode")
        with open(target.replace("file:", ""), "w") as f:
            f.write(str(height))

    def extract_frames(self, path, folder, fps):
        if "short" in path:
            raise RuntimeError("no frames")
        return [f"{folder}/f_{i:06d}.jpg" for i in (2, 1, 3)]


@pytest.fixture
def videos(tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    for name in ("tall.mp4", "small one.mov", "broken.avi", "skip.MP4", "note.txt"):
        (folder / name).write_bytes(b"x")
    (folder / "deeper").mkdir()
    (folder / "deeper" / "no.mp4").write_bytes(b"x")
    return str(folder)


def test_scan_and_probe(spark, videos):
    found = media.scan_videos(spark, videos)
    assert [os.path.basename(r["path"]) for r in found.collect()] == ["broken.avi", "small%20one.mov" if "%20" in found.collect()[1]["path"] else "small one.mov", "tall.mp4"]
    got = {os.path.basename(r["path"])[:5]: r for r in media.probe_media(found, Fake()).collect()}
    assert got["broke"]["duration_s"] is None and got["broke"]["height"] is None
    assert (got["tall."]["width"], got["tall."]["height"], got["tall."]["duration_s"]) == (640, 1080, 12.5)


def test_import_and_reuse(spark, videos, tmp_path):
    out = str(tmp_path / "out")
    done, told = media.import_videos(spark, videos, out, Fake(), target_resolution=720)
    rows = {os.path.basename(r["dst"]): r for r in done.collect()}
    assert not told["reused"]
    assert rows["broken.mp4"]["error"] == "cannot decode" and rows["tall.mp4"]["error"] is None
    assert rows["tall.mp4"]["resolution"] == "720p" and open(f"{out}/tall.mp4").read() == "720"
    again, told = media.import_videos(spark, videos, out, Fake())
    assert told == {"reused": True} and again.count() == 2


def test_copies_where_nothing_is_normalised(spark, videos, tmp_path):
    out = str(tmp_path / "out")
    done, told = media.import_videos(spark, videos, out, media.FfmpegProvider(), normalize=False)
    rows = {os.path.basename(r["dst"]): r for r in done.collect()}
    assert set(rows) == {"tall.mp4", "small_one.mp4", "broken.mp4"} and {r["resolution"] for r in rows.values()} == {"original"}
    assert all(r["error"] is None and open(f"{out}/{name}", "rb").read() == b"x" for name, r in rows.items())
    assert told == {"reused": False, "normalize": False}


def test_forced_import_and_missing_folders(spark, videos, tmp_path):
    out = tmp_path / "out"
    out.mkdir()
    (out / "old.mp4").write_bytes(b"x")
    media.import_videos(spark, videos, str(out), Fake(), force=True)[0].collect()
    assert sorted(f for f in os.listdir(out) if f.endswith(".mp4")) == ["small_one.mp4", "tall.mp4"]
    (tmp_path / "empty").mkdir()
    with pytest.raises(FileNotFoundError, match="no videos"):
        media.import_videos(spark, str(tmp_path / "empty"), str(tmp_path / "o"), Fake())
    with pytest.raises(FileNotFoundError):
        media.import_videos(spark, str(tmp_path / "missing"), str(tmp_path / "o"), Fake())
    for holder in (videos, str(tmp_path)):
        with pytest.raises(ValueError, match="to be imported"):
            media.import_videos(spark, videos, holder, Fake(), force=True)
    assert os.path.exists(f"{videos}/tall.mp4")


def test_encoder_options(monkeypatch):
    asked = []
    monkeypatch.setattr(media.FfmpegProvider, "_run", lambda self, args: asked.append(args))
    media.FfmpegProvider().normalize("a.mov", "b.mp4", 720)
    (args,) = asked
    assert args.index("-fflags") < args.index("-i") and args[args.index("-preset") + 1] == "fast" and args[args.index("-vf") + 1] == "scale=-2:720" and args[-1] == "b.mp4"


def test_steps_follow_the_configuration(spark, videos, tmp_path):
    run = pipeline.Run(spark, PipelineConfig(normalize=True, target_resolution=720, fps=2))
    pipeline.import_step(run, videos, str(tmp_path / "out"), Fake())
    assert {r["resolution"] for r in run.tables["manifest"].where("error is null").collect()} == {"720p", "480p"}
    assert json.loads(run.tables["manifest"].first()["settings"])["target_resolution"] == 720
    pipeline.frames_step(run, str(tmp_path / "frames"), Fake())
    assert run.tables["frames"].groupBy("video_id").count().collect() and run.tables["frames"].count() == 6
    assert run.summary("step1")["settings"].first()["n_videos"] == 3
    kept = tmp_path / "frames" / "tall"
    kept.mkdir(parents=True)
    (kept / "tall_000001.jpg").write_bytes(b"x")
    again = pipeline.frames_step(pipeline.Run(spark, PipelineConfig(overwrite_frames=False), {"imported": run.tables["imported"]}), str(tmp_path / "frames"), Fake())
    assert {r["video_id"]: r["n"] for r in again.tables["frames"].groupBy("video_id").agg(F.count("*").alias("n")).collect()} == {"tall": 1, "small_one": 3}


def test_encoder_of_model_files(tmp_path, monkeypatch):
    from types import SimpleNamespace

    import numpy as np
    from tokenizers import Tokenizer, models, pre_tokenizers

    tool = tmp_path / "ffmpeg"  # writes a picture of one colour, but not for a broken file
    tool.write_text("#!/bin/sh\ncase \"$*\" in *broken*) echo no >&2; exit 1;; esac\nhead -c 48 /dev/zero | tr '\\0' '\\377'\n")
    tool.chmod(0o755)
    monkeypatch.setenv("PATH", str(tmp_path), prepend=os.pathsep)
    vocabulary = Tokenizer(models.WordLevel({"a": 1, "b": 2, "?": 3}, unk_token="?"))
    vocabulary.pre_tokenizer = pre_tokenizers.Whitespace()
    vocabulary.save(str(tmp_path / "tokenizer.json"))
    encoder = encoders.from_folder(str(tmp_path), size=4, context=3)()
    session = lambda fn: SimpleNamespace(get_inputs=lambda: [SimpleNamespace(name="x")], run=lambda _, given: [fn(given["x"])])
    encoder.sessions = {"image": session(lambda x: x.mean(axis=(2, 3))), "text": session(lambda x: x.sum(axis=1, keepdims=True))}
    first, none, third = encoder.encode_images(["p/one.jpg", "p/broken.jpg", "file:/p/two%20.jpg"])
    want = [(1 - m) / d for m, d in zip(encoders.CHANNEL_MEAN, encoders.CHANNEL_STD)]
    assert none is None and first == pytest.approx(want) and third == pytest.approx(want)
    assert encoder.tokens(["a b", "", "a a b z b"]).tolist() == [[1, 2, 0], [0, 0, 0], [1, 1, 2]]
    assert encoder.encode_texts(["a b", "b"]).tolist() == [[3.0], [2.0]] and encoder.encode_images(["broken"]) == [None]


HEIGHTS = [(None,), (480,), (720,), (1080,)]


@pytest.mark.parametrize(
    "options, heights, scale",
    [
        ({}, [None, 480, 720, 1080], [False, False, False, False]),
        ({"target_resolution": 720}, [720, 480, 720, 720], [True, False, False, True]),
        ({"target_resolution": 720, "uniform_resolution": True}, [720] * 4, [True, True, False, True]),
        ({"uniform_resolution": True}, [1080] * 4, [True, True, True, False]),
    ],
)
def test_encode_height(spark, options, heights, scale):
    df = spark.createDataFrame([(f"v{i}.mp4", h) for i, (h,) in enumerate(HEIGHTS)], "path string, height int")
    got = media.normalization_plan(df, "out", **options).orderBy("path").collect()
    assert [r["encode_height"] for r in got] == heights
    assert [r["scale"] for r in got] == scale


def test_collisions(spark):
    df = spark.createDataFrame([("a b.mp4", 1), ("a_b.mov", 1), ("c.mp4", 1)], "path string, height int")
    plan = media.normalization_plan(df, "out")
    assert {r["path"]: r["collides"] for r in plan.collect()} == {"a b.mp4": True, "a_b.mov": True, "c.mp4": False}
    with pytest.raises(ValueError, match="a_b"):
        media.check_collisions(plan)


def test_frames(spark):
    rows = [("x/a.mp4", 4.0), ("x/short.mp4", 4.0), ("x/none.mp4", None), ("x/zero.mp4", 0.0), ("x/nan.mp4", float("nan"))]
    plan = media.extraction_plan(spark.createDataFrame(rows, "path string, duration_s double"), "frames")
    assert {r["video_id"] for r in plan.collect()} == {"a", "short"}
    got = [tuple(r) for r in media.extract_frames(plan, Fake()).orderBy("frame_idx").collect()]
    assert got == [("a", i, f"frames/a/f_{i + 1:06d}.jpg") for i in range(3)]
    with pytest.raises(ValueError, match="video_id"):
        media.require_some_frames(media.frame_index(spark.createDataFrame([], "video_id string, frame_path string")))
    names = [r["frame_name"] for r in media.expected_frames(spark.createDataFrame([("a", 1.0), ("b", 0.1), ("c", None)], "video_id string, duration_s double")).orderBy("video_id", "number").collect()]
    assert names == ["a_000001.jpg", "a_000002.jpg", "a_000003.jpg", "b_000001.jpg"]


def test_manifest_and_images(spark, tmp_path):
    done = spark.createDataFrame([("in/a.mov", "out/a.mp4", "720p")], "path string, dst string, resolution string")
    media.write_manifest(spark, str(tmp_path / "m"), {"normalize": True}, done)
    row = media.read_manifest(spark, str(tmp_path / "m")).first()
    assert json.loads(row["settings"]) == {"normalize": True} and row["output"] == "out/a.mp4"
    (tmp_path / "f").mkdir()
    (tmp_path / "f" / "a.jpg").write_bytes(b"abc")
    assert bytes(media.read_images(spark, str(tmp_path / "f")).first()["content"]) == b"abc"


def test_ffmpeg_error(tmp_path):
    tool = tmp_path / "tool"
    tool.write_text("#!/bin/sh\nfor i in 1 2 3 4 5 6 7; do echo line $i >&2; done\nexit 3\n")
    tool.chmod(0o755)
    with pytest.raises(RuntimeError) as e:
        media.FfmpegProvider()._run([str(tool)])
    assert str(e.value).splitlines() == [f"line {i}" for i in range(3, 8)]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, 0.5, 0.25)], schemas.STATEMENT_WEIGHTS)
    assert sinks.write(df, str(tmp_path), "statement_weights", single=True).endswith("statement_weights.csv")
    assert [tuple(r) for r in sinks.read(spark, str(tmp_path), "statement_weights", schemas.STATEMENT_WEIGHTS).collect()] == [(1, 0.5, 0.25)]
    assert sinks.as_float(df, "weight").dtypes[1] == ("weight", "float")
    assert sinks.safe_path(str(tmp_path), str(tmp_path / "x")) == os.path.realpath(tmp_path / "x")
    for bad in (tmp_path, tmp_path.parent, str(tmp_path) + "-other", tmp_path / ".." / "x"):
        with pytest.raises(ValueError):
            sinks.safe_path(str(tmp_path), str(bad))
    (tmp_path / "old").mkdir()
    assert sinks.delete_folder(str(tmp_path), str(tmp_path / "old")) and not (tmp_path / "old").exists()
    assert not sinks.delete_folder(str(tmp_path), str(tmp_path / "old"))
    assert sinks.output_root("/a/b/videos") == "/a/b/output"
