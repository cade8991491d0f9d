"""A varied subset: quotas per cluster of mini-batch k-means, sampled within, unused places given to other clusters."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, Window as W, functions as F, types as T

from reelquilt.llm import kmeans
from reelquilt.llm.neighbors import prepare
from reelquilt.llm.vectors import matrix
from reelquilt.plans.materialize import cut


def quotas(sizes: Sequence[int], wanted: int, rule: str = "sqrt") -> list[int]:
    """Places per cluster: proportional to the square root of its size, or equal; none gets more than it has.

    What a small cluster can't use goes to the others by the same rule until all places or all members are used;
    remainders go to the largest fractions, then to the earlier cluster.
    """
    if rule not in ("sqrt", "equal"):
        raise ValueError("rule must be sqrt or equal")
    size = np.asarray(sizes, dtype=np.int64)
    weight = np.sqrt(size) if rule == "sqrt" else (size > 0).astype(float)
    out = np.zeros(len(size), dtype=np.int64)
    left = int(min(max(wanted, 0), size.sum()))
    while left:
        open_ = np.flatnonzero(out < size)
        share = left * weight[open_] / weight[open_].sum()
        whole = np.minimum(np.floor(share).astype(np.int64), size[open_] - out[open_])
        if whole.sum() == 0:
            order = np.lexsort((open_, -share))[:left]
            out[open_[order]] += 1
            left -= len(order)
            continue
        out[open_] += whole
        left -= int(whole.sum())
    return out.tolist()


def varied_subset(
    df: DataFrame,
    wanted: int,
    *,
    item: str,
    vector: str,
    size: int | None = None,
    clusters: int = 64,
    rule: str = "sqrt",
    sample_rows: int = 50_000,
    seed: int = 1234,
) -> DataFrame:
    """``wanted`` items (all, if there are fewer): the item, ``cluster``, ``cluster_size``, ``quota``.

    Null items and vectors that are null, of another size (by default the most frequent), all zero or hold a null, NaN or
    infinite value can't be placed and are never chosen.  An item counts once however often it is repeated.  Centres are
    fitted on at most ``2 * sample_rows`` rows drawn by hash; every row is placed and may be drawn.  Which members are
    drawn depends on the seed and their ids alone.
    """
    spark = df.sparkSession
    key = df.schema[item].dataType
    ready = prepare(df, item=item, vector=vector, size=size)
    empty = T.StructType([T.StructField(item, key), T.StructField("cluster", T.IntegerType()), T.StructField("cluster_size", T.LongType()), T.StructField("quota", T.LongType())])
    if ready.size is None:
        return spark.createDataFrame([], empty)
    rows = cut(ready.rows.select("id", "u"))
    n = rows.count()
    scale = 1 << 30
    picked = rows.where(F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(scale)) < int(min(1.0, sample_rows / max(n, 1)) * scale)).limit(2 * sample_rows).toArrow().sort_by("id")
    centres = kmeans.mini_batch(matrix(picked.column("u"), ready.size), clusters, seed=seed)
    if not len(centres):
        return spark.createDataFrame([], empty)
    placed = cut(kmeans.assign(rows, "u", ready.size, centres).select("id", "cluster"))
    held = sorted((r["cluster"], r["n"]) for r in placed.groupBy("cluster").agg(F.count("*").alias("n")).collect())
    share = quotas([m for _, m in held], wanted, rule)
    plan = spark.createDataFrame([(c, m, q) for (c, m), q in zip(held, share)], "cluster int, cluster_size long, quota long")
    return drawn(placed, plan, seed).select(F.col("id").alias(item), "cluster", "cluster_size", "quota")


def drawn(placed: DataFrame, plan: DataFrame, seed: int) -> DataFrame:
    """The ``quota`` members of each cluster with the smallest hashes (then ids), with the columns of ``plan``.

    A histogram of each cluster's hashes tells up to which bin all members are taken; only the members of the bin at the
    border are ranked, so that no task ever sorts a whole cluster.
    """
    h = F.xxhash64(F.lit(seed), "id")
    rows = placed.select("id", "cluster", h.alias("h"), F.shiftright(h, 52).cast("int").alias("bin"))
    bins = rows.groupBy("cluster", "bin").agg(F.count("*").alias("n"))
    ahead = W.partitionBy("cluster").orderBy("bin").rowsBetween(W.unboundedPreceding, -1)
    bins = bins.withColumn("before", F.coalesce(F.sum("n").over(ahead), F.lit(0))).join(F.broadcast(plan), "cluster").where(F.col("before") < F.col("quota"))
    # at most 4096 bins for each of the clusters that the centres were fitted for
    bins = F.broadcast(cut(bins.select(*plan.columns, "bin", (F.col("quota") - F.col("before")).alias("places"), (F.col("n") <= F.col("quota") - F.col("before")).alias("whole"))))
    met = rows.join(bins, ["cluster", "bin"])
    place = F.row_number().over(W.partitionBy("cluster", "bin").orderBy("h", "id"))
    border = met.where("not whole").withColumn("r", place).where(F.col("r") <= F.col("places"))
    return met.where("whole").select("id", *plan.columns).unionByName(border.select("id", *plan.columns))
