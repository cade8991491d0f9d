"""Filling containers of fixed capacity: best fit, with conflicts.

Items are packed in shards of bounded size, largest first.  A shard keeps its bins ordered by what room is left; each bin
carries a bitmap of the sources and one of the duplicate clusters it holds.  An item goes to the tightest bin that has
room and none of its source or cluster, found by searching on from the successor of its size.  Bins that a shard leaves
badly filled are opened again and packed together with those of the other shards, in shards of the same bounded size.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from reelquilt.plans.materialize import cut

#: Sizes are packed as whole millionths.
UNIT = 1_000_000


def best_fit(sizes: Sequence[int], capacity: int, sources: Sequence | None = None, clusters: Sequence | None = None) -> list[int]:
    """Bin of each item, largest items first; of equal bins the first opened.  Null sources and clusters never conflict."""
    # only what occurs more than once can conflict and needs a bit
    codes = [{x: i for i, x in enumerate(x for x, n in Counter(c or ()).items() if n > 1 and x is not None)} for c in (sources, clusters)]
    order = sorted(range(len(sizes)), key=lambda i: -sizes[i])
    room: list[tuple[int, int]] = []
    held: list[tuple[int, int]] = []
    out = [0] * len(sizes)
    for i in order:
        bits = [0, 0]
        for j, column in enumerate((sources, clusters)):
            if column is not None and column[i] in codes[j]:
                bits[j] = 1 << codes[j][column[i]]
        at = bisect_left(room, (sizes[i], -1))
        while at < len(room) and (held[room[at][1]][0] & bits[0] or held[room[at][1]][1] & bits[1]):
            at += 1
        if at < len(room):
            left, k = room.pop(at)
        else:
            left, k = capacity, len(held)
            held.append((0, 0))
        held[k] = (held[k][0] | bits[0], held[k][1] | bits[1])
        if left > sizes[i]:
            insort(room, (left - sizes[i], k))
        out[i] = k
    return out


def _pack_round(pieces: DataFrame, capacity: int, shard_items: int, seed: int) -> DataFrame:
    """Adds ``bin`` (unique over shards) and ``filled`` (its total) to pieces; ``shard`` is the round's own."""
    n = pieces.count()
    shards = max(1, -(-n // shard_items))
    own = pieces.withColumn("shard", F.pmod(F.xxhash64(F.lit(seed), "item", "piece", "units"), F.lit(shards)).cast("long"))
    schema = T.StructType([*own.schema.fields, T.StructField("bin", T.LongType()), T.StructField("filled", T.LongType())])

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("units", "descending"), ("item", "ascending"), ("piece", "ascending")])
        units = table.column("units").to_pylist()
        bins = best_fit(units, capacity, table.column("source").to_pylist(), table.column("cluster").to_pylist())
        filled = Counter()
        for b, u in zip(bins, units):
            filled[b] += u
        shard = table.column("shard")[0].as_py()
        columns = [*table.columns, pa.array([b * shards + shard for b in bins], pa.int64()), pa.array([filled[b] for b in bins], pa.int64())]
        return pa.table(columns, names=schema.names)

    return own.groupBy("shard").applyInArrow(run, schema).drop("shard")


def pack(
    items: DataFrame,
    capacity: float,
    *,
    item: str,
    size: str,
    source: str | None = None,
    cluster: str | None = None,
    shard_items: int = 20_000,
    well_filled: float = 0.98,
    seed: int = 1234,
) -> DataFrame:
    """One row per piece: the item, ``piece``, ``n_pieces``, ``secs`` (its size), ``bin_id``, ``bin_total``.

    No bin holds more than ``capacity``.  Only an item larger than that is divided, into as few pieces as possible: all but
    the last fill a bin of their own.  Items of one ``source`` or one ``cluster`` never share a bin.  Items with a null,
    NaN, infinite, zero or negative size can't be packed and are left out.  Exact repeats of a row count once; rows that
    differ in anything are items of their own, and a null id is an id like any other.  Sizes count in millionths, rounded.
    Other columns are ignored.
    """
    cap = round(capacity * UNIT)
    if cap <= 0:
        raise ValueError("capacity must be positive")
    valid = items.select(
        F.col(item).alias("item"),
        F.col(size).cast("double").alias("size"),
        (F.col(source).cast("string") if source else F.lit(None).cast("string")).alias("source"),
        (F.col(cluster).cast("string") if cluster else F.lit(None).cast("string")).alias("cluster"),
    ).where((F.col("size") > 0) & (F.col("size") < float("inf"))).distinct()
    units = F.greatest(F.round(F.col("size") * UNIT).cast("long"), F.lit(1))
    sized = valid.withColumn("n_pieces", F.when(F.col("size") > capacity, F.ceil(F.col("size") / F.lit(float(capacity)))).otherwise(1).cast("long")).withColumn("units", units)
    rest = F.greatest(F.col("units") - (F.col("n_pieces") - 1) * cap, F.lit(1))
    sized = sized.withColumn("tail", F.least(rest, F.lit(cap)))
    full = sized.where("n_pieces > 1").select(
        "item", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_pieces") - 2)).alias("piece"), "n_pieces", F.lit(cap).cast("long").alias("units"), F.concat(F.lit("w-"), F.hex(F.xxhash64("item", "size", "source", "cluster"))).alias("stem")
    )
    full = full.select("item", "piece", "n_pieces", "units", F.concat("stem", F.lit("-"), F.col("piece").cast("string")).alias("bin_id"), F.col("units").alias("filled"))
    loose = cut(sized.select("item", (F.col("n_pieces") - 1).alias("piece"), "n_pieces", F.col("tail").alias("units"), "source", "cluster"))
    first = cut(_pack_round(loose, cap, shard_items, seed))
    enough = int(well_filled * cap)
    again = _pack_round(first.where(F.col("filled") < enough).drop("bin", "filled"), cap, shard_items, seed + 1)
    named = lambda df, mark: df.select("item", "piece", "n_pieces", "units", F.concat(F.lit(mark), F.col("bin").cast("string")).alias("bin_id"), "filled")
    done = named(first.where(F.col("filled") >= enough), "a-").unionByName(named(again, "b-")).unionByName(full)
    return done.select(
        F.col("item").alias(item), F.col("piece").cast("int").alias("piece"), F.col("n_pieces").cast("int").alias("n_pieces"), (F.col("units") / UNIT).alias("secs"), "bin_id", (F.col("filled") / UNIT).alias("bin_total")
    )
