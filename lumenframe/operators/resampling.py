"""Clustered bootstrap: metrics over groups drawn with replacement.

A draw is a row (replicate, fold, group, times), so a group that is drawn twice counts
twice and its rows aren't repeated. Rows are counted by group, label and score before they
meet the draws. The slots of a replicate are dealt to folds, as each drawn copy is a group
of its own.

Defined results: rows without a score, label or group are left out; a replicate that lacks
a class has null; an empty table has no draws and intervals of null.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenframe.operators import metrics

FOLDS = 5
TARGETS = {"r1": 0.01, "r5": 0.05}


def numbered(groups: DataFrame, group: str, seed: int) -> DataFrame:
    """group, k: 0, 1, ... in the order of a seeded hash; ranks come from ranges of the hash."""
    hashed = groups.where(F.col(group).isNotNull()).select(group).distinct().withColumn("__h", F.sha2(F.concat(F.lit(f"{seed}:"), F.col(group).cast("string")), 256))
    hashed = hashed.withColumn("__c", F.conv(F.substring("__h", 1, 3), 16, 10).cast("int"))
    before = Window.orderBy("__c").rowsBetween(Window.unboundedPreceding, -1)  # 4096 rows at most
    starts = hashed.groupBy("__c").agg(F.count("*").alias("__n")).select("__c", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__b"))
    rank = F.row_number().over(Window.partitionBy("__c").orderBy("__h")) - 1
    return hashed.withColumn("__r", rank).join(F.broadcast(starts), "__c").select(group, (F.col("__r") + F.col("__b")).cast("long").alias("k"))


def draws(groups: DataFrame, group: str, replicates: int, seed: int) -> DataFrame:
    """replicate, fold, group, times: as many draws a replicate as there are groups; folds are runs of slots whose sizes differ by one at most."""
    ranked = numbered(groups, group, seed)
    total = ranked.count()
    slots = groups.sparkSession.range(replicates * total)
    replicate, slot = F.expr(f"id div {max(total, 1)}"), F.col("id") % max(total, 1)
    drawn = F.conv(F.substring(F.sha2(F.concat_ws(":", F.lit(str(seed)), replicate, slot), 256), 1, 8), 16, 10).cast("long") % max(total, 1)
    size, longer = divmod(total, FOLDS)
    cut = longer * (size + 1)
    fold = F.when(slot < cut, F.floor(slot / (size + 1))).otherwise(longer + F.floor((slot - cut) / max(size, 1)))
    counted = slots.select(replicate.alias("replicate"), fold.cast("int").alias("fold"), drawn.alias("k")).groupBy("replicate", "fold", "k").agg(F.count("*").alias("times"))
    return counted.join(ranked, "k").drop("k")


def _counts(rows: DataFrame, group: str, score: str, label: str, by: list[str]) -> DataFrame:
    whole = rows.where(F.col(score).isNotNull() & F.col(label).isNotNull() & F.col(group).isNotNull())
    return whole.groupBy(group, *by, score).agg(F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) == 0).alias("neg"))


def _drawn(rows: DataFrame, drawn: DataFrame, group: str, score: str, label: str, by: list[str]) -> DataFrame:
    """by (with replicate), score, pos, neg over the rows of the groups drawn."""
    own = [c for c in by if c in rows.columns]
    each = _counts(rows, group, score, label, own).join(drawn, group)
    return each.groupBy(*by, score).agg(F.sum(F.col("pos") * F.col("times")).alias("pos"), F.sum(F.col("neg") * F.col("times")).alias("neg"))


def pooled(rows: DataFrame, drawn: DataFrame, group: str, score: str, label: str) -> DataFrame:
    """replicate, value: AUROC of all rows drawn."""
    counts = _drawn(rows, drawn, group, score, label, ["replicate"])
    return metrics.auroc_of_counts(counts, score, ["replicate"]).select("replicate", F.col("auroc").alias("value"))


def macro(rows: DataFrame, drawn: DataFrame, group: str, score: str, label: str) -> DataFrame:
    """replicate, value: mean AUROC of the copies drawn that have both classes."""
    each = metrics.auroc_of_counts(_counts(rows, group, score, label, []), score, [group])
    met = drawn.join(each.select(group, "auroc"), group)
    n = F.sum(F.when(F.col("auroc").isNotNull(), F.col("times")))
    return met.groupBy("replicate").agg((F.sum(F.col("auroc") * F.col("times")) / n).alias("value"))


def recall_in_sample(rows: DataFrame, drawn: DataFrame, group: str, score: str, label: str, target: float) -> DataFrame:
    """replicate, value: recall at the linear quantile of the same rows' negatives."""
    counts = _drawn(rows, drawn, group, score, label, ["replicate"])
    cut = metrics.linear_quantiles_of_counts(counts.where("neg > 0").withColumnRenamed("neg", "n"), score, {"threshold": 1 - target}, ["replicate"])
    return _recall(counts, cut, score, ["replicate"])


def recall_out_of_fold(rows: DataFrame, drawn: DataFrame, group: str, score: str, label: str, target: float, by: list[str] = []) -> DataFrame:  # noqa: B006
    """replicate, value: recall at conservative thresholds of the other folds' negatives, within `by` each."""
    counts = _drawn(rows, drawn, group, score, label, ["replicate", "fold", *by])
    train = counts.where("neg > 0").withColumnRenamed("fold", "__own").withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(FOLDS - 1)))).where("fold != __own")
    merged = train.groupBy("replicate", "fold", *by, score).agg(F.sum("neg").alias("n"))
    cut = metrics.conservative_of_counts(merged, score, target, ["replicate", "fold", *by])
    return _recall(counts, cut, score, ["replicate", "fold", *by])


def recall_at(rows: DataFrame, drawn: DataFrame, group: str, score: str, label: str, thresholds: DataFrame, by: list[str]) -> DataFrame:
    """replicate, value: recall at given thresholds (by, threshold), a row for each `by`."""
    hit = (F.col(score) >= F.col("threshold")).cast("long")
    met = rows.where((F.col(label) == 1) & F.col(score).isNotNull()).join(F.broadcast(thresholds), by)  # a row for each language
    each = met.groupBy(group).agg(F.sum(hit).alias("hits"), F.count("*").alias("n")).join(drawn, group)
    return each.groupBy("replicate").agg((F.sum(F.col("hits") * F.col("times")) / F.sum(F.col("n") * F.col("times"))).alias("value"))


def _recall(counts: DataFrame, cut: DataFrame, score: str, by: list[str]) -> DataFrame:
    """Rows without a threshold of their `by` are left out."""
    met = counts.where("pos > 0").join(cut, by)
    return met.groupBy("replicate").agg((F.sum(F.when(F.col(score) >= F.col("threshold"), F.col("pos")).otherwise(0)) / F.sum("pos")).alias("value"))


def metric(kind: str, rows: DataFrame, drawn: DataFrame, group: str, score: str, label: str, language: str) -> DataFrame:
    """replicate, value of a kind: pooled, macro, r1, r5, oof_r1, oof_r5, calibrated_oof_r1, calibrated_oof_r5."""
    args = (rows, drawn, group, score, label)
    if kind in ("pooled", "macro"):
        return (pooled if kind == "pooled" else macro)(*args)
    target = TARGETS[kind.rsplit("_", 1)[-1]]
    if kind in TARGETS:
        return recall_in_sample(*args, target)
    return recall_out_of_fold(*args, target, [language] if kind.startswith("calibrated_") else [])


KINDS = ["pooled", "macro", *TARGETS, *(f"{p}_{t}" for p in ("oof", "calibrated_oof") for t in TARGETS)]


def deltas(rows: DataFrame, group: str, score: str, other: str, label: str, language: str, replicates: int, seed: int, kinds: list[str] = KINDS) -> DataFrame:
    """kind, mean, low, high of metric(score) - metric(other) over replicates that have both."""
    drawn = draws(rows, group, replicates, seed)
    each = None
    for kind in kinds:
        a, b = (metric(kind, rows, drawn, group, s, label, language).withColumnRenamed("value", n) for s, n in ((score, "a"), (other, "b")))
        one = a.join(b, "replicate").select(F.lit(kind).alias("kind"), (F.col("a") - F.col("b")).alias("value"))
        each = one if each is None else each.unionByName(one)
    ends = F.percentile("value", F.array(F.lit(0.025), F.lit(0.975)))  # of a value for each replicate
    found = each.where(F.col("value").isNotNull() & ~F.isnan("value")).groupBy("kind").agg(F.avg("value").alias("mean"), ends.alias("e"))
    every = rows.sparkSession.createDataFrame([(k,) for k in kinds], "kind string")
    return every.join(F.broadcast(found), "kind", "left").select("kind", "mean", F.get("e", F.lit(0)).alias("low"), F.get("e", F.lit(1)).alias("high"))  # a row for each kind
