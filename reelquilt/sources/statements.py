"""Text statements from CSV files, lists and dicts, as one table with a stable index."""

from __future__ import annotations

import os
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession, Window as W
from pyspark.sql import functions as F

from reelquilt.schemas import STATEMENTS, require_columns


def _ranked(rows: DataFrame, position: str) -> DataFrame:
    """Categories in the order in which they were first seen, statements in theirs; the index counts from 0."""
    first = rows.withColumn("seen", F.min(position).over(W.partitionBy("category")))
    order = W.orderBy("seen", position)
    return first.select((F.row_number().over(order) - 1).cast("int").alias("statement_index"), "category", "statement")


def _table(spark: SparkSession, rows: list[tuple[str, str]]) -> DataFrame:
    return spark.createDataFrame([(i, c, s) for i, (c, s) in enumerate(rows)], STATEMENTS)


def from_csv(spark: SparkSession, path: str) -> DataFrame:
    """Statements of a CSV file with a header that names ``category`` and ``statement``.

    A category's statements stand together, however the file has them.  The file is a small dimension; its rows are
    numbered in one task.
    """
    if "://" not in path and not os.path.exists(path):
        raise FileNotFoundError(path)
    raw = spark.read.option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"').csv(path)
    require_columns(raw, ["category", "statement"], "statement file")
    numbered = raw.coalesce(1).select("category", "statement", F.monotonically_increasing_id().alias("at"))
    return _ranked(numbered, "at")


def from_list(spark: SparkSession, statements: Sequence[str], default_category: str = "custom") -> DataFrame:
    if not isinstance(statements, list):
        raise ValueError("statements must be a list")
    return _table(spark, [(default_category, s) for s in statements])


def from_dict(spark: SparkSession, scenes: Mapping[str, Sequence[str]]) -> DataFrame:
    return _table(spark, [(c, s) for c, group in scenes.items() for s in group])


def from_table(statements: DataFrame) -> DataFrame:
    """Renumbered statements of a table that has an index already."""
    return _ranked(require_columns(statements, STATEMENTS.names, "statements"), "statement_index")


def in_category(statements: DataFrame, category: str) -> DataFrame:
    """The statements of one category, numbered anew; ValueError with the known ones for an unknown category."""
    known = [r[0] for r in statements.select("category").distinct().orderBy("category").collect()]
    if category not in known:
        raise ValueError(f"unknown category {category!r}; available: {', '.join(map(str, known))}")
    return _ranked(statements.where(F.col("category") == category), "statement_index")


def get_statements(spark: SparkSession, source, category: str | None = None) -> DataFrame:
    """Statements of a path, list, dict or table; anything else, and None, is a ValueError."""
    if isinstance(source, DataFrame):
        out = from_table(source)
    elif isinstance(source, str | os.PathLike):
        out = from_csv(spark, os.fspath(source))
    elif isinstance(source, Mapping):
        out = from_dict(spark, source)
    elif isinstance(source, list):
        out = from_list(spark, source)
    else:
        raise ValueError(f"no statements can be read from {type(source).__name__}")
    return out if category is None else in_category(out, category)


def as_dict(statements: DataFrame) -> dict[str, list[str]]:
    """Category to statements, in the order of the index; a dimension of bounded size."""
    out: dict[str, list[str]] = {}
    for r in statements.orderBy("statement_index").collect():
        out.setdefault(r["category"], []).append(r["statement"])
    return out
