"""Sinks. Spark's committers make each write whole or nothing."""

from __future__ import annotations

import posixpath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def save_bank(bank: DataFrame, path: str) -> None:
    bank.write.mode("overwrite").partitionBy("language").parquet(path)


def replace_clusters(changed: DataFrame, path: str, partitions: list[str]) -> None:
    """Overwrites only the partitions that `changed` has rows of."""
    changed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partitions).parquet(path)


def jsonl(df: DataFrame, path: str, split_by: str | None = None) -> None:
    """One object a line, keys in order."""
    out = df.select(*sorted(df.columns)).write.mode("overwrite")
    (out.partitionBy(split_by) if split_by else out).json(path)


def summary_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def blocks(df: DataFrame, path: str, head: list[str], body: str, rule: str = "=" * 60) -> None:
    """Delimited text blocks: KEY: value lines, a blank line, the body."""
    lines = F.concat_ws("\n", F.lit(rule), *(F.concat(F.lit(f"{h.upper()}: "), F.coalesce(F.col(h).cast("string"), F.lit(""))) for h in head), F.lit(""), F.col(body))
    df.select(lines.alias("value")).write.mode("overwrite").text(path)


def append_cache(vectors: DataFrame, path: str) -> None:
    vectors.write.mode("append").parquet(path)


def upserted(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """old with the rows of new in place of those with their key."""
    return old.join(new.select(key), key, "left_anti").unionByName(new.select(*old.columns))


def relabelled(old: DataFrame, new: DataFrame, key: str, label: str) -> tuple[DataFrame, DataFrame]:
    """(labels, audit rows old_label -> new_label); an error if a record isn't labelled yet."""
    if not new.join(old.select(key), key, "left_anti").isEmpty():
        raise LookupError("a record has no label to change")
    audit = old.select(key, F.col(label).alias("old_label")).join(new.select(key, F.col(label).alias("new_label")), key)
    return upserted(old, new, key), audit


def backup(spark: SparkSession, path: str, to: str) -> None:
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    a, b = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(to)
    jvm.org.apache.hadoop.fs.FileUtil.copy(a.getFileSystem(conf), a, b.getFileSystem(conf), b, False, conf)


def reject_identity_columns(df: DataFrame, denied: list[str]) -> DataFrame:
    found = sorted(set(df.columns) & set(denied))
    if found:
        raise ValueError(f"identity columns in an output: {found}")
    return df


def inside(path: str, root: str) -> str:
    """path, if it is root or below it once dots are resolved; else an error."""
    a, b = posixpath.normpath(path), posixpath.normpath(root)
    if a != b and not a.startswith(b.rstrip("/") + "/"):
        raise ValueError(f"{path} is outside of {root}")
    return path
