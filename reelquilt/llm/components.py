"""Connected components of a distributed graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from reelquilt.plans.materialize import cut


def components(edges: DataFrame, a: str = "a", b: str = "b", *, max_rounds: int = 200) -> DataFrame:
    """``node`` and ``root``, the smallest node of its component, for every node of the edges (self-loops are nodes too).

    Every round each node takes the smallest label among its own and its neighbours' (pre-aggregated before the shuffle,
    so a node with very many edges is no hot spot) and then its label's label, which halves the distance to the root.
    Labels stay in the cluster; only the number of changes comes to the driver.  Edges with a null end are left out.
    """
    pairs = edges.select(F.col(a).alias("x"), F.col(b).alias("y")).where("x is not null and y is not null")
    both = cut(pairs.unionByName(pairs.select(F.col("y").alias("x"), F.col("x").alias("y"))).where("x != y").distinct())
    nodes = pairs.select(F.explode(F.array("x", "y")).alias("node")).distinct()
    labels = cut(nodes.join(both.groupBy("x").agg(F.min("y").alias("m")), F.col("node") == F.col("x"), "left").select("node", F.least("node", F.coalesce("m", "node")).alias("root")))
    for _ in range(max_rounds):
        seen = both.join(labels.withColumnRenamed("node", "y"), "y").groupBy("x").agg(F.min("root").alias("m"))
        lower = labels.join(seen, F.col("node") == F.col("x"), "left").select("node", F.col("root").alias("old"), F.least("root", F.coalesce("m", "root")).alias("root"))
        # The old root hears of the new one too, so that whole trees move at once.
        moved = lower.where("root < old").groupBy(F.col("old").alias("t")).agg(F.min("root").alias("u"))
        hooked = lower.join(moved, F.col("node") == F.col("t"), "left").select("node", "old", F.least("root", F.coalesce("u", "root")).alias("root"))
        hooked = cut(hooked)
        jump = hooked.select(F.col("node").alias("t"), F.col("root").alias("u"))
        after = cut(hooked.join(jump, F.col("root") == F.col("t"), "left").select("node", "old", F.least("root", F.coalesce("u", "root")).alias("root")))
        if after.where("root != old").isEmpty():
            return after.select("node", "root")
        labels = after.select("node", "root")
    raise RuntimeError(f"components: not settled after {max_rounds} rounds")
