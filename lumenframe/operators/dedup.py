"""First-of-its-kind selection and duplicate weights over exact keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_of(rows: DataFrame, keys: list[str | Column], order: list[str | Column]) -> DataFrame:
    """The first row of each key. min_by over a struct is a partial aggregate: a hot key never meets in one sort."""
    named = {f"__k{i}": (F.col(k) if isinstance(k, str) else k) for i, k in enumerate(keys)}
    by = {f"__o{i}": (F.col(o) if isinstance(o, str) else o) for i, o in enumerate(order)}
    whole = F.struct(*(F.col(f"`{c}`") for c in rows.columns))
    picked = rows.select(whole.alias("__row"), *(c.alias(n) for n, c in {**named, **by}.items())).groupBy(*named).agg(F.min_by("__row", F.struct(*by)).alias("__row"))
    return picked.select("__row.*")


def group_sizes(rows: DataFrame, keys: list[str], name: str = "group_size") -> DataFrame:
    """rows with the number of rows of their key; counts are made first and joined, so a hot key is split."""
    return rows.join(rows.groupBy(*keys).agg(F.count("*").alias(name)), keys)


def duplicate_weights(rows: DataFrame, keys: list[str]) -> DataFrame:
    """rows with weight 1 / size of their duplicate group."""
    return group_sizes(rows, keys).withColumn("weight", 1 / F.col("group_size"))


def first_humans(rows: DataFrame, keys: list[str], position: str, n: int = 2) -> DataFrame:
    """The first n rows of each key by position."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(position))
    return rows.withColumn("__r", rank).where(F.col("__r") <= n).drop("__r")


def fused_spans(spans: DataFrame, doc: str, start: str, end: str) -> DataFrame:
    """Spans of a document joined where one starts at most a row after the furthest end so far."""
    equal = spans.groupBy(doc, start, end).agg(F.count("*").alias("__n"))  # so that the order has no ties
    order = Window.partitionBy(doc).orderBy(start, end)
    reach = F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1))
    new = (reach.isNull() | (F.col(start) > reach + 1)).cast("int")
    island = F.sum("__new").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return equal.withColumn("__new", new).withColumn("__i", island).groupBy(doc, "__i").agg(F.min(start).alias(start), F.max(end).alias(end), F.sum("__n").alias("n_parts")).drop("__i")
