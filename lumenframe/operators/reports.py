"""Coverage, leakage, cross-tabulation and rate reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def percent(a: Column, b: Column) -> Column:
    return F.when(b == 0, F.lit(0.0)).otherwise(100.0 * a / b)


def coverage(rows: DataFrame, dims: list[str], distinct: str) -> DataFrame:
    """n and distinct count for all rows, each dimension, and all of them together, in one pass over grouping sets."""
    spark = rows.sparkSession
    name = "__coverage_rows"
    rows.createOrReplaceTempView(name)
    sets = ", ".join(["()", *(f"({d})" for d in dims), "(" + ", ".join(dims) + ")"])
    return spark.sql(f"SELECT {', '.join(dims)}, grouping_id() AS level, count(*) AS n, count(DISTINCT {distinct}) AS n_distinct FROM {name} GROUP BY GROUPING SETS ({sets})")


def counts_by(rows: DataFrame, keys: list[str], name: str = "n") -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias(name))


def zero_filled(rows: DataFrame, key: str, values: list[str]) -> DataFrame:
    """Counts of a fixed list of values; those that don't occur have 0."""
    every = rows.sparkSession.createDataFrame([(v,) for v in values], f"{key} string")
    return every.join(counts_by(rows, [key]), key, "left").select(key, F.coalesce("n", F.lit(0)).alias("n"))


def breakdown(rows: DataFrame, field: str, eligible: Column) -> DataFrame:
    """field (unknown for null or blank), total, eligible, excluded, eligible_percent."""
    key = F.coalesce(F.when(F.trim(F.col(field)) != "", F.col(field)), F.lit("unknown"))
    out = rows.groupBy(key.alias(field)).agg(F.count("*").alias("total"), F.count_if(eligible).alias("eligible"))
    return out.withColumn("excluded", F.col("total") - F.col("eligible")).withColumn("eligible_percent", percent(F.col("eligible"), F.col("total")))


def crosstab(rows: DataFrame, row: str, column: str, values: list) -> DataFrame:
    """Counts of row by the given values of column."""
    return rows.groupBy(row).agg(*(F.count_if(F.col(column) == v).alias(f"{column}_{v}") for v in values))


def straddling(rows: DataFrame, member: str, split: str) -> DataFrame:
    """Members that stand in more than one split."""
    return rows.where(F.col(member).isNotNull()).groupBy(member).agg(F.count_distinct(split).alias("n_splits")).where("n_splits > 1")


def leakage(rows: DataFrame, key: str, split: str) -> DataFrame:
    """n_keys, n_straddling, n_rows_straddling over the keys of all splits."""
    each = rows.groupBy(key).agg(F.count_distinct(split).alias("s"), F.count("*").alias("n"))
    return each.agg(F.count("*").alias("n_keys"), F.count_if(F.col("s") > 1).alias("n_straddling"), F.coalesce(F.sum(F.when(F.col("s") > 1, F.col("n"))), F.lit(0)).alias("n_rows_straddling"))


def excluded_pairs(pairs: DataFrame, present: DataFrame, keys: list[str], by: str) -> DataFrame:
    """by, n: planned keys without a row; values of `by` without any have 0."""
    lost = pairs.join(present.select(*keys).distinct(), keys, "left_anti").groupBy(by).agg(F.count("*").alias("n"))
    return pairs.select(by).distinct().join(lost, by, "left").select(by, F.coalesce("n", F.lit(0)).alias("n"))


def routing_rates(rows: DataFrame, status: str, statuses: list[str]) -> DataFrame:
    """status, n, rate (4 digits, halves to even) for a fixed list of statuses."""
    counts = zero_filled(rows, status, statuses)
    total = rows.count()
    return counts.withColumn("rate", F.bround(F.col("n") / F.lit(max(total, 1)).cast("double"), 4))


def reject_reasons(rows: DataFrame, reason: str) -> DataFrame:
    """What stands before the first colon of each reason, counted."""
    return rows.where(F.col(reason).isNotNull()).groupBy(F.substring_index(reason, ":", 1).alias("reason")).agg(F.count("*").alias("n"))


def cluster_size_histogram(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("size")).groupBy("size").agg(F.count("*").alias("n_clusters"))


def signal_rates(rows: DataFrame, by: str, signals: str) -> DataFrame:
    """by, name, n_fired, rate of an array<struct(name, fired)>."""
    each = rows.select(by, F.explode(signals).alias("s"))
    return each.groupBy(by, F.col("s.name").alias("name")).agg(F.count_if("s.fired").alias("n_fired"), F.avg(F.col("s.fired").cast("double")).alias("rate"))


def projected_cost(units: DataFrame, rates: DataFrame, model: str, tokens: str, default_rate: float) -> DataFrame:
    """model, tokens, cost at its rate for a million tokens."""
    summed = units.groupBy(model).agg(F.sum(tokens).alias("tokens"))
    return summed.join(F.broadcast(rates), model, "left").select(model, "tokens", (F.col("tokens") / 1e6 * F.coalesce("rate", F.lit(default_rate))).alias("cost"))


def flattened(counts: dict[str, DataFrame]) -> DataFrame:
    """section, name, n of grouped counts (name, n) by section."""
    out = None
    for section, df in counts.items():
        part = df.select(F.lit(section).alias("section"), F.col(df.columns[0]).cast("string").alias("name"), F.col(df.columns[1]).cast("long").alias("n"))
        out = part if out is None else out.unionByName(part)
    return out


def latency(outcomes: DataFrame, model: str, seconds: str) -> DataFrame:
    """model, n, mean (two places), min and max of the seconds of its outcomes."""
    return outcomes.groupBy(model).agg(F.count(seconds).alias("n"), F.round(F.avg(seconds), 2).alias("mean"), F.min(seconds).alias("min"), F.max(seconds).alias("max"))


def ids_of(labelled: DataFrame, id_col: str, label: str, value: str | int) -> DataFrame:
    """The ids of a label, as text."""
    return labelled.where(F.col(label) == value).select(F.col(id_col).cast("string").alias(id_col))
