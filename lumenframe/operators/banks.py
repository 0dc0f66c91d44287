"""Maintenance of reference banks as set operations over long tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenframe.operators.dedup import first_of


def union_all(*frames: DataFrame) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def shared_keys(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    return a.select(*keys).intersect(b.select(*keys))


def collect_references(rows: DataFrame, keys: list[str], text: str, kind: str, kinds: list[str], least: int, most: int) -> DataFrame:
    """References of whitelisted kinds, one for each kind, equal texts kept once in the order of the kinds; clusters out of bounds are dropped whole."""
    place = F.array_position(F.array(*(F.lit(k) for k in kinds)), F.col(kind))
    named = rows.withColumn("kind_place", place).where((F.col("kind_place") > 0) & (F.trim(F.coalesce(text, F.lit(""))) != ""))
    one = first_of(named, [*keys, kind], [text])
    distinct = first_of(one, [*keys, text], ["kind_place"])
    sizes = distinct.groupBy(*keys).agg(F.count("*").alias("__n")).where(F.col("__n").between(least, most)).drop("__n")
    kept = distinct.join(sizes, keys, "left_semi")
    return kept.withColumn("vector_id", F.row_number().over(Window.partitionBy(*keys).orderBy("kind_place")) - 1)


def swap(bank: DataFrame, incoming: DataFrame, keys: list[str], text: str, leaving: Column) -> DataFrame:
    """The bank without the leaving references, with incoming ones whose text its cluster doesn't have yet."""
    kept = bank.where(~leaving)
    new = incoming.join(kept.select(*keys, text).distinct(), [*keys, text], "left_anti")
    return kept.unionByName(first_of(new, [*keys, text], [text]))


def add_new(bank: DataFrame, incoming: DataFrame, keys: list[str], text: str) -> DataFrame:
    return swap(bank, incoming, keys, text, F.lit(False))


def rebuild_changed(bank: DataFrame, changes: DataFrame, keys: list[str], id_col: str, value: str) -> DataFrame:
    """The bank with new values for changed rows; untouched clusters pass by."""
    touched = changes.select(*keys).distinct()
    same = bank.join(touched, keys, "left_anti")
    again = bank.join(touched, keys, "left_semi").join(changes.select(*keys, id_col, F.col(value).alias("__new")), [*keys, id_col], "left")
    return same.unionByName(again.withColumn(value, F.coalesce("__new", value)).drop("__new").select(*bank.columns))
