"""Far too many small files: packing them into few well-sized ones, each record kept exactly once.

Two operators share one arithmetic, the engine's own split packing (a file costs its bytes plus an opening cost, a split
holds up to a maximum).  :func:`plan_containers` assigns a listing of files to containers; :func:`compact` rewrites a
folder: combined splits, no shuffle, staged output that is verified before it takes the folder's place.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from reelquilt.plans.materialize import cut

OPEN_COST = 4 << 20
TARGET_BYTES = 128 << 20


def last_component(path: Column) -> Column:
    """What follows the last slash or backslash."""
    return F.regexp_extract(path, r"([^/\\]*)$", 1)


#: Video and number before a suffix, with marks of a copy "(n)" on either side of it.
FRAME_PATTERN = r"(?:^|[/\\])([^/\\]+)_(\d+)(?:\s*\(\d+\))*\s*(?:\.[A-Za-z0-9]+)?(?:\s*\(\d+\))*\s*$"


def frame_of_path(path: Column) -> tuple[Column, Column]:
    """Video and number that a frame's file name gives, however written: in any case, as a copy "(n)", with any suffix."""
    video, number = (F.regexp_extract(path, FRAME_PATTERN, i) for i in (1, 2))
    return F.when(number != "", F.lower(F.trim(video))), F.when(number != "", number.try_cast("bigint"))


def classify_files(files: DataFrame, *, file: str = "file_id", path: str = "frame_path", n_bytes: str = "n_bytes") -> DataFrame:
    """One row per distinct row: the id, ``path``, ``video``, ``number``, ``bytes``, ``status``.

    ``status`` is ``empty`` (null, zero or negative size), ``unnamed`` (a path that names no frame), ``kept`` (of the files
    with content the one with the frame's smallest id), ``repeat`` (another file of the frame) or ``same`` (another row of
    the kept file, with another path or size).  Exact repeats of a row count once.  A null id comes after all others.
    """
    own = files.select(F.col(file).alias("file"), F.col(path).alias("path"), F.col(n_bytes).cast("long").alias("bytes")).distinct()
    video, number = frame_of_path(F.col("path"))
    named = cut(own.select("file", "path", "bytes", video.alias("video"), number.alias("number")))  # read twice below
    filled = F.coalesce(F.col("bytes") > 0, F.lit(False))
    rivals, others = named.where(filled & F.col("number").isNotNull()), named.where(~filled | F.col("number").isNull())
    # The smallest id is aggregated before the shuffle, so that a frame filed very often is no hot spot; only the rows of
    # that one file meet in a window.
    first = rivals.groupBy("video", "number").agg(F.min("file").alias("first"))
    met = rivals.join(first, ["video", "number"])
    frame = W.partitionBy("video", "number").orderBy("path", "bytes")
    own = met.where(F.col("file").eqNullSafe(F.col("first"))).withColumn("status", F.when(F.row_number().over(frame) == 1, "kept").otherwise("same"))
    repeats = met.where(~F.col("file").eqNullSafe(F.col("first"))).withColumn("status", F.lit("repeat"))
    out = own.unionByName(repeats).drop("first").unionByName(others.withColumn("status", F.when(~filled, "empty").otherwise("unnamed")))
    return out.select(F.col("file").alias(file), "path", "video", "number", "bytes", "status")


def plan_containers(
    files: DataFrame,
    *,
    file: str = "file_id",
    path: str = "frame_path",
    n_bytes: str = "n_bytes",
    target_bytes: int = TARGET_BYTES,
    open_cost: int = OPEN_COST,
    stretch: int = 4096,
) -> DataFrame:
    """:func:`classify_files` with ``container``, null for what isn't kept (``empty``, ``repeat`` and ``same``).

    Files are packed in the order of their frames, within hash buckets of stretches of frames, so that no bucket depends
    on the length of a video.  A container is closed when the bytes and opening costs of its files pass ``target_bytes``;
    a bucket holds up to 64 of them or so and leaves at most one that isn't full.
    """
    cost = lambda size: F.least(F.coalesce(size, F.lit(0)), F.lit(target_bytes)).cast("long") + F.lit(open_cost)
    total = files.agg(F.sum(cost(F.col(n_bytes)))).first()[0] or 0  # repeats included: a bucket may hold fewer than planned
    named = classify_files(files, file=file, path=path, n_bytes=n_bytes)
    keep = F.col("status").isin("kept", "unnamed")
    buckets = max(1, -(-total // (64 * target_bytes)))
    place = F.pmod(F.xxhash64("video", F.floor(F.col("number") / stretch)), F.lit(buckets))
    place = F.when(F.col("number").isNull(), F.pmod(F.xxhash64(file, "path"), F.lit(buckets))).otherwise(place)
    kept = named.where(keep).withColumn("bucket", place).withColumn("cost", cost(F.col("bytes")))
    ahead = W.partitionBy("bucket").orderBy("video", "number", file, "path").rowsBetween(W.unboundedPreceding, -1)
    at = F.floor(F.coalesce(F.sum("cost").over(ahead), F.lit(0)) / F.lit(target_bytes))
    packed = kept.withColumn("container", F.concat_ws("-", F.col("bucket").cast("string"), at.cast("string"))).drop("bucket", "cost")
    return packed.unionByName(named.where(~keep).withColumn("container", F.lit(None).cast("string")))


def _folder(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where, jvm.org.apache.hadoop.fs.Path


def _fingerprint(df: DataFrame) -> tuple:
    """Rows and two order-free sums of their hashes: equal for equal multisets of rows.

    Hashes skip nulls, so every column goes in with a flag that says whether it is null, and nested ones as JSON with nulls.
    """
    whole = lambda c: F.to_json(F.struct(F.col(f"`{c}`").alias("x")), {"ignoreNullFields": "false"})
    values = [whole(c) if t.startswith(("map", "array", "struct")) else F.col(f"`{c}`") for c, t in df.dtypes]
    cols = [x for c, v in zip(df.columns, values) for x in (v, F.col(f"`{c}`").isNull())]
    one, two = F.xxhash64(F.lit(1), *cols), F.xxhash64(F.lit(2), *cols)
    wide = lambda h: F.sum(h.cast("decimal(38,0)"))
    row = df.agg(F.count(F.lit(1)), wide(one), wide(two)).first()
    return tuple(row)


def compact(spark: SparkSession, source: str, target: str, *, kind: str = "parquet", target_bytes: int = TARGET_BYTES, open_cost: int = OPEN_COST, options: dict | None = None, columns: Sequence[str] | None = None) -> dict:
    """Rewrite a folder of small files as few files of about ``target_bytes``; the rows stay as they are, repeats included.

    Small files are read in combined splits of about ``target_bytes`` (the engine's own packing of files by size and
    opening cost), which are coalesced without a shuffle into as many parts as the folder's bytes ask for, written to a
    staging folder beside the target, read back and compared with the source by row count and order-free hash sums.  How
    the rows compress when they are written again isn't foreseen, so files may come out smaller or larger than that.  Only
    then is the staging folder renamed to the target, which must not exist.  A failed comparison raises and leaves source
    and target as they were.  The split sizes are set in a session of its own, so that other queries keep theirs.  Returns
    files and bytes before and after.
    """
    spark = spark.newSession()
    fs, where, new_path = _folder(spark, source)
    out_fs, out_path, _ = _folder(spark, target)
    if out_fs.exists(out_path):
        raise FileExistsError(target)
    staging = f"{target.rstrip('/')}.staging-{uuid.uuid4().hex[:8]}"
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(target_bytes + open_cost))
        spark.conf.set("spark.sql.files.openCostInBytes", str(open_cost))
        spark.conf.set("spark.sql.files.minPartitionNum", "1")
        reader = spark.read.format(kind).options(**(options or {}))
        rows = reader.load(source)
        rows = rows.select(*columns) if columns else rows
        summary = fs.getContentSummary(where)
        files, size = summary.getFileCount(), summary.getLength()
        want = max(1, round(size / target_bytes))
        writer_rows = rows.coalesce(min(want, max(1, rows.rdd.getNumPartitions())))
        writer = writer_rows.write.format(kind).options(**{k: v for k, v in (options or {}).items() if k != "recursiveFileLookup"})
        writer.save(staging)
        said = _fingerprint(rows)
        back = _fingerprint(spark.read.format(kind).options(**(options or {})).schema(rows.schema).load(staging))
        if said != back:
            raise RuntimeError(f"{staging} holds other rows than {source}: {back} against {said}")
        if not out_fs.rename(new_path(staging), out_path):
            raise RuntimeError(f"{staging} could not be renamed to {target}")
        after = out_fs.getContentSummary(out_path)
        return {"rows": said[0], "files_before": files, "bytes_before": size, "files_after": sum(1 for s in out_fs.listStatus(out_path) if not s.getPath().getName().startswith(("_", "."))), "bytes_after": after.getLength()}
    except BaseException:
        if out_fs.exists(new_path(staging)):
            out_fs.delete(new_path(staging), True)
        raise


def remove_folder(spark: SparkSession, path: str) -> None:
    fs, where, _ = _folder(spark, path)
    fs.delete(where, True)
