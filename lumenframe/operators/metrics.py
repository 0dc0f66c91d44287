"""Statistics and ROC-type metrics.

Ranks and quantiles over all rows come from running sums over distinct values, dealt to
ranges of the value: each range is summed for itself and starts from the sum of the ranges
before it, so no window holds the table. Rows with equal values are pre-aggregated.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RANGES = 4096


def running(df: DataFrame, value: str, sums: list[str], by: list[str] = [], descending: bool = False, ranges: int = RANGES) -> DataFrame:  # noqa: B006
    """df (a row for each value within `by`) with `<sum>_upto`: sums over values up to and with this one, and `<sum>_all`."""
    low, high = df.agg(F.min(value), F.max(value)).first()
    span = float(high - low) if low is not None and high > low else 1.0
    place = F.least(F.floor((F.col(value) - F.lit(float(low or 0))) / F.lit(span) * ranges), F.lit(ranges - 1)).cast("int")
    dealt = df.withColumn("__range", place)
    order = F.desc if descending else F.asc
    totals = dealt.groupBy(*by, "__range").agg(*(F.sum(s).alias(f"__{s}") for s in sums))
    before = Window.partitionBy(*by).orderBy(order("__range")).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*by)
    starts = totals.select(*by, "__range", *(F.coalesce(F.sum(f"__{s}").over(before), F.lit(0)).alias(f"__{s}_before") for s in sums), *(F.sum(f"__{s}").over(whole).alias(f"{s}_all") for s in sums))  # ranges rows a group
    within = Window.partitionBy(*by, "__range").orderBy(order(value)).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inner = dealt.withColumns({f"__{s}_in": F.sum(s).over(within) for s in sums})
    # null groups are groups, as in groupBy
    joined = inner.alias("i").join(starts.alias("s"), [F.col(f"i.{c}").eqNullSafe(F.col(f"s.{c}")) for c in [*by, "__range"]])
    return joined.select(*(F.col(f"i.{c}") for c in df.columns), *((F.col(f"__{s}_in") + F.col(f"__{s}_before")).alias(f"{s}_upto") for s in sums), *(F.col(f"{s}_all") for s in sums))


def _counts(df: DataFrame, score: str, label: str, by: list[str]) -> DataFrame:
    return df.where(F.col(score).isNotNull() & F.col(label).isNotNull()).groupBy(*by, score).agg(F.sum(F.when(F.col(label) == 1, 1).otherwise(0)).alias("pos"), F.sum(F.when(F.col(label) == 0, 1).otherwise(0)).alias("neg"))


def auroc(df: DataFrame, score: str, label: str, by: list[str] = []) -> DataFrame:  # noqa: B006
    """by, auroc: the share of (positive, negative) pairs in order, ties half; null without both classes."""
    return auroc_of_counts(_counts(df, score, label, by), score, by)


def auroc_of_counts(counts: DataFrame, score: str, by: list[str] = []) -> DataFrame:  # noqa: B006
    """auroc from a row (by, score, pos, neg) for each score."""
    run = running(counts, score, ["pos", "neg"], by)
    won = F.sum(F.col("pos") * (F.col("neg_upto") - F.col("neg") + F.col("neg") / 2))
    out = run.groupBy(*by).agg(won.alias("__w"), F.max("pos_all").alias("n_pos"), F.max("neg_all").alias("n_neg"))
    pairs = F.col("n_pos").cast("double") * F.col("n_neg")
    return out.select(*by, "n_pos", "n_neg", F.when(pairs > 0, F.col("__w") / pairs).alias("auroc"))


def macro_auroc(df: DataFrame, score: str, label: str, group: str) -> DataFrame:
    """Mean AUROC of the groups that have both classes, and how many they are."""
    each = auroc(df, score, label, [group]).where(F.col("auroc").isNotNull())
    return each.agg(F.avg("auroc").alias("macro_auroc"), F.count("*").alias("n_groups"))


def linear_quantiles(df: DataFrame, value: str, probs: dict[str, float], by: list[str] = []) -> DataFrame:  # noqa: B006
    """by, and a column for each named probability: quantiles between the two nearest ranks."""
    return linear_quantiles_of_counts(df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("n")), value, probs, by)


def linear_quantiles_of_counts(counts: DataFrame, value: str, probs: dict[str, float], by: list[str] = []) -> DataFrame:  # noqa: B006
    """linear_quantiles from a row (by, value, n) for each value."""
    run = running(counts, value, ["n"], by)
    aggs = []
    for name, p in probs.items():
        at = (F.col("n_all") - 1) * F.lit(float(p))
        has = lambda rank: (F.col("n_upto") > rank) & (F.col("n_upto") - F.col("n") <= rank)
        low = F.max(F.when(has(F.floor(at)), F.col(value).cast("double")))
        high = F.max(F.when(has(F.ceil(at)), F.col(value).cast("double")))
        aggs.append((low + (high - low) * F.max(at - F.floor(at))).alias(name))
    return run.groupBy(*by).agg(*aggs)


def nearest_rank(df: DataFrame, value: str, probs: dict[str, float], by: list[str] = []) -> DataFrame:  # noqa: B006
    """Quantiles that are values of the data: index p * (n - 1), rounded half to even."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("n"))
    run = running(counts, value, ["n"], by)
    rank = lambda p: F.rint((F.col("n_all") - 1) * F.lit(float(p)))
    return run.groupBy(*by).agg(*(F.max(F.when((F.col("n_upto") > rank(p)) & (F.col("n_upto") - F.col("n") <= rank(p)), F.col(value))).alias(k) for k, p in probs.items()))


def score_statistics(df: DataFrame, value: str, by: list[str] = []) -> DataFrame:  # noqa: B006
    """n, mean, population deviation, and the 10, 25, 50, 75, 90 % quantiles."""
    quantiles = linear_quantiles(df, value, {f"p{q}": q / 100 for q in (10, 25, 50, 75, 90)}, by)
    base = df.groupBy(*by).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"))
    return base.join(quantiles, by) if by else base.crossJoin(quantiles)  # one row each


def describe_values(df: DataFrame, value: str, by: list[str] = []) -> DataFrame:  # noqa: B006
    """n, mean, sample deviation (0 for a single value), least, greatest and nine quantiles."""
    names = {f"p{q:02d}": q / 100 for q in (1, 5, 10, 25, 50, 75, 90, 95, 99)}
    base = df.groupBy(*by).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("s"), F.min(value).alias("min"), F.max(value).alias("max"))
    base = base.withColumn("std", F.when(F.col("n") == 1, F.lit(0.0)).otherwise(F.col("s"))).drop("s")
    quantiles = linear_quantiles(df, value, names, by)
    return base.join(quantiles, by) if by else base.crossJoin(quantiles)  # one row each


def histogram(df: DataFrame, value: str, bins: int = 10) -> DataFrame:
    """bin (1..bins), low, high, count over equal widths, the last one closed; a single value fills the middle of a unit range."""
    low, high = df.agg(F.min(F.col(value).cast("double")), F.max(F.col(value).cast("double"))).first()
    if low is None:
        return df.sparkSession.createDataFrame([], "bin int, low double, high double, count long")
    if low == high:
        low, high = low - 0.5, high + 0.5
    width = (high - low) / bins
    at = F.least(F.floor((F.col(value) - low) / width), F.lit(bins - 1)).cast("int")
    counts = df.where(F.col(value).isNotNull()).groupBy(at.alias("b")).agg(F.count("*").alias("count"))
    every = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("b"))
    out = every.join(F.broadcast(counts), "b", "left")  # bins rows
    return out.select((F.col("b") + 1).alias("bin"), (F.lit(low) + F.col("b") * width).alias("low"), (F.lit(low) + (F.col("b") + 1) * width).alias("high"), F.coalesce("count", F.lit(0)).alias("count"))


def conservative_threshold(negatives: DataFrame, score: str, target: float, by: list[str] = []) -> DataFrame:  # noqa: B006
    """by, threshold: the least score seen that at most `target` of the negatives reach; just above all if none does."""
    return conservative_of_counts(negatives.where(F.col(score).isNotNull()).groupBy(*by, score).agg(F.count("*").alias("n")), score, target, by)


def conservative_of_counts(counts: DataFrame, score: str, target: float, by: list[str] = []) -> DataFrame:  # noqa: B006
    """conservative_threshold from a row (by, score, n) for each score."""
    run = running(counts, score, ["n"], by, descending=True)
    least = F.min(F.when(F.col("n_upto") / F.col("n_all") <= F.lit(float(target)), F.col(score)))
    above = F.expr(f"java_method('java.lang.Math', 'nextUp', max(cast({score} as double)))").cast("double")
    return run.groupBy(*by).agg(F.coalesce(least.cast("double"), above).alias("threshold"))


def quantile_threshold(negatives: DataFrame, score: str, target: float, by: list[str] = []) -> DataFrame:  # noqa: B006
    """by, threshold: the linear 1 - target quantile of the negatives."""
    return linear_quantiles(negatives, score, {"threshold": 1 - target}, by)


def operating_point(rows: DataFrame, thresholds: DataFrame, score: str, label: str, by: list[str], keep: list[str] = []) -> DataFrame:  # noqa: B006
    """keep, recall, fpr: shares of both classes that reach the threshold of their `by`; rows without one are left out."""
    joined = rows.join(F.broadcast(thresholds), by) if by else rows.crossJoin(F.broadcast(thresholds))  # a row for each group
    share = lambda y: F.avg(F.when(F.col(label) == y, (F.col(score) >= F.col("threshold")).cast("double")))
    return joined.groupBy(*keep).agg(share(1).alias("recall"), share(0).alias("fpr"))


def folds(groups: DataFrame, group: str, seed: int, n: int = 5) -> DataFrame:
    """group, fold (0..n-1): groups in the order of a seeded hash, dealt to n runs whose sizes differ by one at most, longer ones first.

    The number of groups is that of questions or sources; their ranks come from ranges of
    the hash, like all ranks here."""
    hashed = groups.select(group).distinct().withColumn("__h", F.sha2(F.concat(F.lit(f"{seed}:"), F.col(group)), 256))
    spread = F.conv(F.substring("__h", 1, 3), 16, 10).cast("int")
    sizes = hashed.groupBy(spread.alias("__c")).agg(F.count("*").alias("__n"))
    before = Window.orderBy("__c").rowsBetween(Window.unboundedPreceding, -1)  # 4096 rows at most
    starts = sizes.select("__c", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__b"), F.sum("__n").over(Window.partitionBy()).alias("__all"))
    rank = F.row_number().over(Window.partitionBy("__c").orderBy("__h")) - 1
    ranked = hashed.withColumn("__c", spread).withColumn("__r", rank).join(F.broadcast(starts), "__c").withColumn("__r", F.col("__r") + F.col("__b"))
    size, longer = F.floor(F.col("__all") / n), F.col("__all") % n
    cut = longer * (size + 1)
    fold = F.when(F.col("__r") < cut, F.floor(F.col("__r") / (size + 1))).otherwise(longer + F.floor((F.col("__r") - cut) / F.greatest(size, F.lit(1))))
    return ranked.select(group, fold.cast("int").alias("fold"))


def out_of_fold_thresholds(rows: DataFrame, score: str, label: str, target: float, n: int = 5, by: list[str] = []) -> DataFrame:  # noqa: B006
    """fold, by, threshold: from the negatives of all other folds. Each negative is sent to the n - 1 folds that it trains."""
    train = rows.where(F.col(label) == 0).withColumnRenamed("fold", "__own")
    every = train.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).where(F.col("fold") != F.col("__own"))
    return conservative_threshold(every, score, target, ["fold", *by])


def bootstrap(rows: DataFrame, group: str, replicates: int, seed: int, metric: Column, name: str = "value") -> DataFrame:
    """replicate, value: metric over groups drawn with replacement, as many as there are.

    A metric that is a sum over rows (or a ratio of sums) is enough here: rows are first
    summed by group outside, so a replicate costs a row for each group drawn."""
    spark = rows.sparkSession
    numbered = rows.withColumn("__g", F.row_number().over(Window.orderBy(group)) - 1)  # a row for each group
    total = numbered.count()
    slots = spark.range(replicates).select(F.col("id").alias("replicate")).withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(total - 1))))
    draw = F.conv(F.substring(F.sha2(F.concat_ws(":", F.lit(str(seed)), "replicate", "slot"), 256), 1, 8), 16, 10).cast("long") % total
    return slots.withColumn("__g", draw).join(F.broadcast(numbered), "__g").groupBy("replicate").agg(metric.alias(name))


def interval(values: DataFrame, value: str, count: str = "") -> DataFrame:
    """mean and the 2.5 and 97.5 % quantiles of values that are numbers, and how many they are in a column `count`, if named."""
    finite = values.where(F.col(value).isNotNull() & ~F.isnan(value))
    sums = [F.avg(value).alias("mean"), *([F.count(value).alias(count)] if count else [])]
    return finite.agg(*sums).crossJoin(linear_quantiles(finite, value, {"low": 0.025, "high": 0.975}))  # one row each
