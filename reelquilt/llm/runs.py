"""Runs of nearly equal consecutive events, found from their boundaries alone.

Only events that differ from their predecessor are kept; ``lead`` over those starts gives each run's end, positions give
its count and the previous event of the next start gives its last event.  A sequence is cut into blocks of positions, so
that one that never ends is spread over tasks; each block also sees the last few events before it, which settles every
link, and the runs at block edges are put together afterwards.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window as W, functions as F, types as T

from reelquilt.llm.batches import codes, distinct, glued, groups
from reelquilt.plans.materialize import cut

#: Differences of decimal fractions are compared with this slack: 0.27 - 0.265 counts as 0.005.
SLACK = 1e-9


def _pack(rows: DataFrame, block: int, max_gap: int) -> DataFrame:
    """``k``, ``b`` and the lists ``p``, ``f``, ``v`` of a block's rows that were read together, repeats dropped.

    A block also has the rows of the last ``max_gap`` positions before it.
    """
    schema = T.StructType([rows.schema["k"], T.StructField("b", T.LongType()), *(T.StructField(c, T.ArrayType(rows.schema[c].dataType)) for c in ("p", "f", "v"))])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            p = batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
            v = pc.fill_null(batch.column(3), np.nan).to_numpy(zero_copy_only=False) + 0.0
            own, ahead = p // block, (p + max_gap) // block
            more = np.flatnonzero(own != ahead)
            index = np.concatenate([np.arange(len(p)), more])
            part = np.concatenate([own, own[more] + 1])
            k = codes(batch.column(0))[index]
            order, fresh = distinct([k, part, codes(batch.column(2))[index], p[index], v.view(np.int64)[index]])
            order = order[fresh]
            k, part = k[order], part[order]
            heads = np.flatnonzero(np.concatenate([[True], (k[1:] != k[:-1]) | (part[1:] != part[:-1])]))
            offsets, take = pa.array(np.append(heads, len(order)).astype(np.int32)), pa.array(index[order])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(take.take(pa.array(heads))), pa.array(part[heads]), *(pa.ListArray.from_arrays(offsets, batch.column(i).take(take)) for i in (1, 2, 3))], names=schema.names
            )

    return rows.mapInArrow(run, schema)


def _starts(part: pa.RecordBatch, block: int, tolerance: float, max_gap: int) -> pa.RecordBatch:
    """The boundary events of whole blocks: those that don't continue their predecessor, and each block's own first.

    With an event go its predecessor's position, its rank in the block, the block's last position and rank, whether it is
    linked to its predecessor, and whether it opens the block.
    """
    block_heads, group = groups(part, 2)
    owner = group[np.repeat(np.arange(part.num_rows), pc.list_value_length(part.column(2)).to_numpy(zero_copy_only=False))]
    p = pc.list_flatten(part.column(2)).to_numpy(zero_copy_only=False).astype(np.int64)
    feature = codes(pc.list_flatten(part.column(3)))
    value = pc.fill_null(pc.list_flatten(part.column(4)), np.nan).to_numpy(zero_copy_only=False)
    order, fresh = distinct([owner, p])
    event = np.empty(len(p), dtype=np.int64)
    event[order] = np.cumsum(fresh) - 1
    first = order[fresh]
    at, inside = p[first], owner[first]
    # values of one feature one below the other, event by event, the smallest of several first
    there = np.flatnonzero(~np.isnan(value))
    there = there[np.lexsort([value[there], event[there], feature[there]])]
    f, e, v = feature[there], event[there], value[there]
    single = np.ones(len(there), dtype=bool)
    single[1:] = (f[1:] != f[:-1]) | (e[1:] != e[:-1])
    f, e, v = f[single], e[single], v[single]
    follows = (f[1:] == f[:-1]) & (e[1:] == e[:-1] + 1)
    far = np.zeros(len(at), dtype=bool)
    far[e[1:][follows & (np.abs(v[1:] - v[:-1]) > tolerance + SLACK)]] = True
    has_previous = np.zeros(len(at), dtype=bool)
    has_previous[1:] = inside[1:] == inside[:-1]
    previous = np.concatenate([[0], at[:-1]])
    linked = has_previous & (at - previous <= max_gap) & ~far
    b = part.column(1).to_numpy(zero_copy_only=False)[block_heads][inside]
    opens = ~(has_previous & (previous // block == b))
    heads = np.flatnonzero(~has_previous)
    size = np.diff(np.append(heads, len(at)))
    rank = np.arange(len(at)) - np.repeat(heads, size) + 1
    end = np.repeat(heads + size - 1, size)
    some = np.flatnonzero((at // block == b) & (~linked | opens))
    return pa.RecordBatch.from_arrays(
        [
            part.column(0).take(pa.array(block_heads[inside[some]])),
            pa.array(b[some]),
            pa.array(at[some]),
            pa.array(previous[some], mask=~has_previous[some]),
            pa.array(rank[some]),
            pa.array(at[end[some]]),
            pa.array(rank[end[some]]),
            pa.array(linked[some]),
            pa.array(opens[some]),
        ],
        names=["k", "b", "p", "previous", "r", "end_p", "end_r", "linked", "opens"],
    )


def collapse_runs(
    events: DataFrame,
    *,
    key: str = "video_id",
    position: str = "frame_idx",
    feature: str = "statement_index",
    value: str = "score",
    tolerance: float = 0.005,
    max_gap: int = 3,
    rate: float = 3.0,
    block: int = 2048,
) -> DataFrame:
    """One row per maximal run: the key, ``first_<position>``, ``last_<position>``, ``n_events``, ``duration_s``.

    Events (all rows of a key and a position) follow each other in a run if their positions differ by at most ``max_gap``
    and no feature that has a value in both differs by more than ``tolerance`` (a feature that is null, NaN or absent in
    either is ignored).  An event that belongs to no longer run is a run of one.  Exact repeats of a row count once; of
    several values of one feature in one event the smallest counts.  Rows with a null key, position or feature have no
    place in a sequence and are left out.  Duration is (last - first + 1) / ``rate``.  Other columns are ignored.
    """
    if not 0 < max_gap < block:
        raise ValueError("max_gap must be positive and below block")
    place = events.schema[position].dataType
    rows = events.select(F.col(key).alias("k"), F.col(position).alias("p"), F.col(feature).alias("f"), F.nanvl(F.col(value).cast("double"), F.lit(None)).alias("v"))
    rows = rows.where("k is not null and p is not null and f is not null")
    packed = _pack(rows, block, max_gap).repartition("k", "b").sortWithinPartitions("k", "b")
    whole = lambda c: T.StructField(c, T.LongType())
    schema = T.StructType([rows.schema["k"], *map(whole, ("b", "p", "previous", "r", "end_p", "end_r")), T.StructField("linked", T.BooleanType()), T.StructField("opens", T.BooleanType())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: pa.RecordBatch | None = None  # the last block, which may go on
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                both = batch.slice(at, 1024) if waiting is None else glued(waiting, batch.slice(at, 1024))
                last = int(groups(both, 2)[0][-1])
                if last:
                    yield _starts(both.slice(0, last), block, tolerance, max_gap)
                waiting = both.slice(last)
        if waiting is not None:
            yield _starts(waiting, block, tolerance, max_gap)

    starts = packed.mapInArrow(run, schema)
    line = W.partitionBy("k", "b").orderBy("p")
    parts = cut(starts.select(
        "k",
        "b",
        F.col("p").alias("first"),
        F.coalesce(F.lead("previous").over(line), "end_p").alias("last"),
        (F.coalesce(F.lead("r").over(line), F.col("end_r") + 1) - F.col("r")).cast("long").alias("n"),
        "linked",
        (F.col("opens") | F.lead("p").over(line).isNull()).alias("edge"),
    ))
    inner = parts.where("not edge").select("k", "first", "last", "n")
    chain = W.partitionBy("k").orderBy("first")
    joined = (
        parts.where("edge")
        .withColumn("run", F.sum(F.when(F.col("linked"), 0).otherwise(1)).over(chain))
        .groupBy("k", "run")
        .agg(F.min("first").alias("first"), F.max("last").alias("last"), F.sum("n").alias("n"))
        .select("k", "first", "last", "n")
    )
    return inner.unionByName(joined).select(
        F.col("k").alias(key),
        F.col("first").cast(place).alias(f"first_{position}"),
        F.col("last").cast(place).alias(f"last_{position}"),
        F.col("n").alias("n_events"),
        ((F.col("last") - F.col("first") + 1) / F.lit(float(rate))).alias("duration_s"),
    )
