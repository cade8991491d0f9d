"""Media files: listing, probing, planning and running normalisation, frames.

Decoding and encoding aren't Spark's: they sit behind providers, small objects with one method that are pickled to the
executors and called once per file inside ``mapInPandas``.  Plans are tables, so a run can be inspected, and resumed,
before anything is executed.
"""

from __future__ import annotations

import json
import os
import shutil
import subprocess
from collections.abc import Iterator
from typing import Protocol
from urllib.parse import unquote, urlparse

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window as W
from pyspark.sql import functions as F

from reelquilt.functions.names import destination, frame_name, resolution_label, stem
from reelquilt.plans.ranking import number_within
from reelquilt.schemas import FRAMES, require_frames

# Suffixes of media files (lower case only), and the height that an unknown source counts as.
SUFFIXES = ("mp4", "mov", "avi", "mkv", "webm")
UNKNOWN_HEIGHT = 99999
# How normalised videos are encoded, what is probed, how frames are named.
INPUT_OPTIONS = ("-fflags", "+genpts")
VIDEO_OPTIONS = ("-c:v", "libx264", "-pix_fmt", "yuv420p", "-preset", "fast", "-crf", "18")
AUDIO_OPTIONS = ("-c:a", "aac", "-b:a", "192k", "-ar", "48000", "-ac", "2")
CONTAINER_OPTIONS = ("-movflags", "+faststart")
PROBE_OPTIONS = ("-v", "error", "-select_streams", "v:0", "-show_entries", "format=duration:stream=width,height", "-of", "json")
FRAME_SUFFIX = "_%06d.jpg"


class MediaProvider(Protocol):
    """Runs on executors; raises on failure."""

    def probe(self, path: str) -> str:
        """JSON with ``format.duration`` and ``streams[0].width`` and ``height``."""

    def normalize(self, source: str, target: str, height: int | None) -> None: ...

    def copy(self, source: str, target: str) -> None:
        """Takes a file over as it is; only asked for where nothing is normalised."""

    def extract_frames(self, path: str, folder: str, fps: int) -> list[str]:
        """Paths of the frames written."""


class FfmpegProvider:
    """Calls ffprobe and ffmpeg as child processes."""

    def _run(self, args: list[str]) -> str:
        done = subprocess.run(args, capture_output=True, text=True)
        if done.returncode:
            raise RuntimeError("\n".join(done.stderr.strip().splitlines()[-5:]) or f"{args[0]} failed")
        return done.stdout

    def probe(self, path: str) -> str:
        return self._run(["ffprobe", *PROBE_OPTIONS, path])

    def normalize(self, source: str, target: str, height: int | None) -> None:
        scale = ["-vf", f"scale=-2:{height}"] if height else []
        self._run(["ffmpeg", "-y", *INPUT_OPTIONS, "-i", source, *scale, *VIDEO_OPTIONS, *AUDIO_OPTIONS, *CONTAINER_OPTIONS, target])

    def copy(self, source: str, target: str) -> None:
        shutil.copy2(local_path(source), local_path(target))

    def extract_frames(self, path: str, folder: str, fps: int) -> list[str]:
        os.makedirs(folder, exist_ok=True)
        name = os.path.splitext(os.path.basename(path))[0]
        self._run(["ffmpeg", "-y", "-i", path, "-vf", f"fps={fps}", f"{folder}/{name}{FRAME_SUFFIX}"])
        return sorted(f"{folder}/{f}" for f in os.listdir(folder) if f.startswith(name + "_") and f.endswith(".jpg"))


def local_path(path: str) -> str:
    """A path of a folder that all executors mount, without the scheme that listings put before it."""
    return unquote(urlparse(path).path) if path.startswith("file:") else path


def scan_videos(spark: SparkSession, folder: str) -> DataFrame:
    """Regular media files right in a folder, ordered by path; contents aren't read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{" + ",".join(SUFFIXES) + "}").load(folder)
    return files.select("path", "length", "modificationTime").orderBy("path")


_PROBE = "struct<format:struct<duration:string>,streams:array<struct<width:int,height:int>>>"


def parse_probe(answer):
    """(width, height, duration) columns of a probe's JSON; null where it doesn't have them."""
    told = F.from_json(answer, _PROBE)
    first = F.get(told["streams"], 0)
    return first["width"], first["height"], told["format"]["duration"].try_cast("double")


def probe_media(files: DataFrame, provider: MediaProvider) -> DataFrame:
    """``path, width, height, duration_s``; everything but the path is null where probing fails.  One probe per file."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def ask(path: str) -> str | None:
            try:
                return provider.probe(path)
            except Exception:
                return None

        for pdf in parts:
            yield pd.DataFrame({"path": pdf["path"], "answer": [ask(p) for p in pdf["path"]]})

    said = files.select("path").mapInPandas(run, "path string, answer string")
    width, height, duration = parse_probe(F.col("answer"))
    return said.select("path", width.alias("width"), height.alias("height"), duration.alias("duration_s"))


def normalization_plan(probes: DataFrame, folder: str, *, sanitize: bool = True, target_resolution: int | None = None, uniform_resolution: bool = False) -> DataFrame:
    """What is to be done with each file: ``path, dst, encode_height, scale, resolution, collides``.

    Uniform: all files get the target, or else the greatest known height.  Otherwise the target applies to files above it
    (an unknown height counts as above) and the rest keep their own.  ``scale`` says whether the height changes at all,
    ``collides`` whether another file has the same destination.
    """
    rows = probes.select("path", F.nullif(F.col("height"), F.lit(0)).alias("source_height"))
    target = F.lit(target_resolution).cast("int")
    if uniform_resolution:
        if not target_resolution:
            rows = rows.crossJoin(F.broadcast(rows.agg(F.max("source_height").alias("tallest"))))  # one row
        height = target if target_resolution else F.col("tallest")
    elif target_resolution:
        height = F.when(target < F.coalesce("source_height", F.lit(UNKNOWN_HEIGHT)), target).otherwise(F.col("source_height"))
    else:
        height = F.col("source_height")
    rows = rows.withColumn("encode_height", height.cast("int")).withColumn("dst", destination(folder, F.col("path"), sanitize))
    return rows.select(
        "path",
        "dst",
        "encode_height",
        (F.col("encode_height").isNotNull() & ~F.col("encode_height").eqNullSafe(F.col("source_height"))).alias("scale"),
        resolution_label(F.col("encode_height")).alias("resolution"),
        (F.count("*").over(W.partitionBy("dst")) > 1).alias("collides"),
    )


def check_collisions(plan: DataFrame) -> DataFrame:
    clashes = [r["dst"] for r in plan.where("collides").select("dst").distinct().limit(5).collect()]
    if clashes:
        raise ValueError(f"several files would be written to {', '.join(clashes)}")
    return plan


def copy_plan(plan: DataFrame) -> DataFrame:
    """The plan with every file taken over as it is."""
    return plan.withColumn("encode_height", F.lit(None).cast("int")).withColumn("scale", F.lit(False)).withColumn("resolution", resolution_label(F.lit(None).cast("int")))


def run_normalization(plan: DataFrame, provider: MediaProvider, *, normalize: bool = True) -> DataFrame:
    """Runs the plan on the executors: ``path, dst, resolution, error`` (null where it went well); copies, if told so."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def do(path: str, dst: str, height: float, scale: bool) -> str | None:
            try:
                provider.normalize(path, dst, int(height) if scale else None) if normalize else provider.copy(path, dst)
            except Exception as e:
                return str(e)[:500] or type(e).__name__

        for pdf in parts:
            errors = [do(*row) for row in zip(pdf["path"], pdf["dst"], pdf["encode_height"], pdf["scale"])]
            yield pdf[["path", "dst", "resolution"]].assign(error=errors)

    return check_collisions(plan).mapInPandas(run, "path string, dst string, resolution string, error string")


def import_videos(spark: SparkSession, folder: str, out: str, provider: MediaProvider, *, force: bool = False, normalize: bool = True, **options) -> tuple[DataFrame, dict]:
    """Normalise (or copy) a folder's videos into another one, or take over what is there already unless forced.

    A missing folder and one without videos are a FileNotFoundError.  ``force`` deletes what the other folder holds first;
    it must neither be the source nor lie above it (ValueError).
    """
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    source, where = jvm.org.apache.hadoop.fs.Path(folder), jvm.org.apache.hadoop.fs.Path(out)
    fs = where.getFileSystem(conf)
    source_fs = source.getFileSystem(conf)
    if not source_fs.exists(source):
        raise FileNotFoundError(folder)
    if force and fs.exists(where):
        inside, outer = (f.makeQualified(p).toString().rstrip("/") + "/" for f, p in ((source_fs, source), (fs, where)))
        if inside.startswith(outer):
            raise ValueError(f"{out} holds the videos to be imported")
        fs.delete(where, True)
    elif fs.exists(where):
        there = scan_videos(spark, out)
        if not there.isEmpty():
            return there.select(F.col("path").alias("dst")), {"reused": True}
    files = scan_videos(spark, folder)
    if files.isEmpty():
        raise FileNotFoundError(f"no videos in {folder}")
    fs.mkdirs(where)
    if normalize:
        plan = normalization_plan(probe_media(files, provider), out, **options)
    else:  # nothing has to be known of files that stay as they are
        plan = copy_plan(normalization_plan(files.select("path", F.lit(None).cast("int").alias("height")), out, sanitize=options.get("sanitize", True)))
    return run_normalization(plan, provider, normalize=normalize), {"reused": False, "normalize": normalize, **options}


def frames_in(folder: str) -> list[str]:
    """Frames in a folder, in the order of their names; none where there is no such folder."""
    where = local_path(folder)
    return sorted(f"{folder}/{f}" for f in os.listdir(where) if f.endswith(".jpg")) if os.path.isdir(where) else []


def extraction_plan(videos: DataFrame, folder: str) -> DataFrame:
    """Videos with a known, positive duration and the folder their frames go to."""
    usable = videos.where(F.coalesce((F.col("duration_s") > 0) & ~F.isnan("duration_s"), F.lit(False)))
    return usable.select(stem(F.col("path")).alias("video_id"), "path", F.concat(F.lit(folder.rstrip("/") + "/"), stem(F.col("path"))).alias("folder"))


def extract_frames(plan: DataFrame, provider: MediaProvider, fps: int = 3, *, overwrite: bool = True) -> DataFrame:
    """Frame index of the plan's videos; one whose extraction fails has no frames.

    Without ``overwrite`` the frames that a video's folder holds already are taken as they are.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            for video, path, folder in zip(pdf["video_id"], pdf["path"], pdf["folder"]):
                paths = [] if overwrite else frames_in(folder)
                try:
                    paths = paths or provider.extract_frames(path, folder, fps)
                except Exception:
                    paths = []
                if paths:
                    yield pd.DataFrame({"video_id": [video] * len(paths), "frame_path": list(paths)})

    return frame_index(plan.select("video_id", "path", "folder").mapInPandas(run, "video_id string, frame_path string"))


def frame_index(frames: DataFrame) -> DataFrame:
    """``video_id, frame_idx, frame_path``: frames counted from 0 in the order of their paths."""
    numbered = number_within(frames.select("video_id", "frame_path"), "video_id", "frame_path", "frame_idx")
    return require_frames(numbered.select("video_id", F.col("frame_idx").cast("int").alias("frame_idx"), "frame_path"))


def require_some_frames(frames: DataFrame) -> DataFrame:
    if frames.isEmpty():
        raise ValueError(f"frames lacks columns: {', '.join(FRAMES.names)} (no frame was extracted)")
    return frames


def expected_frames(videos: DataFrame, fps: int = 3) -> DataFrame:
    """Names of the frames a full extraction would write, from durations alone."""
    n = F.floor(F.col("duration_s") * fps).cast("long")
    rows = videos.where(F.col("duration_s") > 0).select("video_id", F.explode(F.sequence(F.lit(1).cast("long"), F.greatest(n, F.lit(1)))).alias("number"))
    return rows.select("video_id", "number", frame_name(F.col("video_id"), F.col("number")).alias("frame_name"))


def read_images(spark: SparkSession, folder: str, suffix: str = "jpg") -> DataFrame:
    """``path`` and ``content`` of images below a folder."""
    return spark.read.format("binaryFile").option("pathGlobFilter", f"*.{suffix}").option("recursiveFileLookup", True).load(folder).select("path", "content")


def write_manifest(spark: SparkSession, path: str, settings: dict, done: DataFrame) -> None:
    """Settings and one entry per video (source, output, resolution), as one JSON document per row of videos."""
    text = json.dumps(settings, sort_keys=True)
    rows = done.select(F.lit(text).alias("settings"), F.col("path").alias("source"), F.col("dst").alias("output"), "resolution")
    rows.write.mode("overwrite").json(path)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("settings string, source string, output string, resolution string").json(path)
