"""Global row numbers without gathering the rows in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W
from pyspark.sql import functions as F

from reelquilt.plans.materialize import cut


def number_from_zero(rows: DataFrame, key: str, out: str) -> DataFrame:
    """The rows (with distinct keys) and ``out``, their place in the order of the key, counted from 0.

    Rows are divided into ranges that are sorted apart; only the ranges' sizes reach the driver.  The ranges are written
    once, as partition numbers must not change between counting and numbering.
    """
    ranged = cut(rows.repartitionByRange(key).withColumn("__part", F.spark_partition_id()))
    start, offsets = 0, []
    for part, n in sorted((r["__part"], r["n"]) for r in ranged.groupBy("__part").agg(F.count("*").alias("n")).collect()):
        offsets.append((part, start))
        start += n
    if not offsets:
        return rows.withColumn(out, F.lit(0).cast("long"))
    shift = rows.sparkSession.createDataFrame(offsets, "__part int, __start long")
    place = F.row_number().over(W.partitionBy("__part").orderBy(key)) - 1
    return ranged.withColumn("__place", place).join(F.broadcast(shift), "__part").select(*rows.columns, (F.col("__place") + F.col("__start")).alias(out))


#: Groups with more rows than this are numbered in ranges instead of one window partition.
HOT_ROWS = 5_000_000


def number_within(rows: DataFrame, group: str, order: str, out: str, *, hot_rows: int = HOT_ROWS) -> DataFrame:
    """The rows and ``out``, their place within their group in the order of a column (distinct in a group), from 0.

    Groups of up to ``hot_rows`` rows are windows.  Larger ones are divided into ranges of the column that are numbered
    apart and shifted by what the ranges before them hold.
    """
    plain = (F.row_number().over(W.partitionBy(group).orderBy(order)) - 1).cast("long")
    large = [r[0] for r in rows.groupBy(group).agg(F.count("*").alias("n")).where((F.col("n") > hot_rows) & F.col(group).isNotNull()).select(group).collect()]
    if not large:
        return rows.withColumn(out, plain)
    names = F.broadcast(rows.sparkSession.createDataFrame([(g,) for g in large], rows.select(group).schema))
    ranged = cut(rows.join(names, group, "left_semi").repartitionByRange(group, order).withColumn("__part", F.spark_partition_id()))
    sizes = ranged.groupBy(group, "__part").agg(F.count("*").alias("__n"))
    before = F.sum("__n").over(W.partitionBy(group).orderBy("__part").rowsBetween(W.unboundedPreceding, 0)) - F.col("__n")
    shift = F.broadcast(sizes.select(group, "__part", before.alias("__shift")))  # one row per range and large group
    place = F.row_number().over(W.partitionBy(group, "__part").orderBy(order)) - 1
    spread = ranged.withColumn("__place", place).join(shift, [group, "__part"]).select(*rows.columns, (F.col("__place") + F.col("__shift")).alias(out))
    return rows.join(names, group, "left_anti").withColumn(out, plain).unionByName(spread)
