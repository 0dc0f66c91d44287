"""Strict routing, gates and the joins around them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenframe import params


def _by_language(language: Column, values: dict) -> Column:  # noqa: ANN001
    out = None
    for k, v in values.items():
        out = F.when(language == k, F.lit(v)) if out is None else out.when(language == k, F.lit(v))
    return out


def token_floor(language: Column, floors: dict[str, int] = params.TOKEN_FLOOR) -> Column:
    return _by_language(language, floors)


def eligibility(language: Column, valid: Column, has_cluster: Column, tokens: Column, floors: dict[str, int] = params.TOKEN_FLOOR) -> Column:
    """struct(eligible, reason): the first gate that holds decides."""
    floor = token_floor(language, floors)
    reason = F.when(floor.isNull(), "unsupported_language").when(~F.coalesce(valid, F.lit(False)), "invalid_submission").when(~F.coalesce(has_cluster, F.lit(False)), "missing_cluster").when(tokens.isNull() | (tokens < floor), "insufficient_tokens")
    return F.struct(reason.isNull().alias("eligible"), reason.alias("reason"))


def confidence(tokens: Column, language: Column, diversity: Column, floors: dict[str, int] = params.TOKEN_FLOOR, ceilings: dict[str, int] = params.SHORT_CEILING, low: float = params.LOW_DIVERSITY) -> Column:
    """struct(status, reason, short, tight); both flags are told whatever decides."""
    floor, ceiling = _by_language(language, floors), _by_language(language, ceilings)
    tight, short = diversity < low, tokens <= ceiling
    status = F.when(tokens < floor, "insufficient_evidence").when(tight, "low_confidence").when(short, "low_confidence_short").otherwise("scored")
    reason = F.when(tokens < floor, "insufficient_tokens").when(tight, "low_cluster_diversity").when(short, "short_code_low_confidence")
    return F.struct(status.alias("status"), reason.alias("reason"), short.alias("short"), tight.alias("tight"))


def missing_clusters(queries: DataFrame, bank: DataFrame, keys: list[str]) -> DataFrame:
    """Queries that no cluster has the key of; strict routing wants none."""
    return queries.join(bank.select(*keys).distinct(), keys, "left_anti")


def require_routed(queries: DataFrame, bank: DataFrame, keys: list[str]) -> DataFrame:
    """queries, or an error if one can't be routed."""
    lost = missing_clusters(queries, bank, keys).limit(1).collect()
    if lost:
        raise LookupError(f"no cluster for {[lost[0][k] for k in keys]}")
    return queries


def with_exact_match(rows: DataFrame, hashes: DataFrame, keys: list[str], hash_col: str, name: str = "exact_match") -> DataFrame:
    """rows with a boolean: its hash stands among the hashes of its key."""
    known = hashes.select(*keys, hash_col).distinct().withColumn("__hit", F.lit(True))
    return rows.join(known, [*keys, hash_col], "left").withColumn(name, F.coalesce("__hit", F.lit(False))).drop("__hit")


def contaminated(rows: DataFrame, hashes: DataFrame, hash_col: str) -> DataFrame:
    """Rows whose hash stands anywhere."""
    return rows.join(hashes.select(hash_col).distinct(), hash_col, "left_semi")


def pending(plan: DataFrame, outputs: DataFrame, keys: list[str], keep: Column | None = None) -> DataFrame:
    """Units of the plan without an output; with keep, outputs for which it holds don't count as done."""
    done = outputs if keep is None else outputs.where(~keep)
    return plan.join(done.select(*keys).distinct(), keys, "left_anti")


def positional(rows: DataFrame, groups: DataFrame, keys: list[str], position: str, value: str, absent: str) -> DataFrame:
    """rows with the value at their position of their group; `absent` where there is none or it is blank."""
    found = groups.select(*keys, position, F.col(value).alias("__v"))
    blank = F.trim(F.coalesce("__v", F.lit(""))) == ""
    return rows.join(found, [*keys, position], "left").withColumn(value, F.when(blank, F.lit(absent)).otherwise(F.col("__v"))).drop("__v")


def one_to_one(left: DataFrame, right: DataFrame, keys: list[str], value: str, tolerance: float, left_id: str, right_id: str) -> DataFrame:
    """Pairs of equal keys whose values differ by at most the tolerance, each row in one pair at most.

    In order of left_id, each left row takes the least right_id that is free and near. Values
    of a key fall into runs at gaps over the tolerance. Where a whole run lies within the
    tolerance, its k-th left row takes its k-th right row, by ranks; only runs that are wider
    are walked row by row, each for itself."""
    side = lambda df, i, n: df.select(*keys, F.col(value).cast("double").alias("__v"), F.col(i).alias("__id"), F.lit(n).alias("__side"))
    both = side(left, left_id, 0).unionByName(side(right, right_id, 1)).where(F.col("__v").isNotNull())
    order = Window.partitionBy(*keys).orderBy("__v")
    gap = F.col("__v") - F.lag("__v").over(order) > tolerance
    runs = both.withColumn("__new", F.coalesce(gap, F.lit(False)).cast("int")).withColumn("__run", F.sum("__new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    run = [*keys, "__run"]
    spread = runs.groupBy(*run).agg((F.max("__v") - F.min("__v") > tolerance).alias("__wide"), F.min("__side").alias("__lo"), F.max("__side").alias("__hi")).where("__lo < __hi")
    met = runs.join(spread.select(*run, "__wide"), run)
    ranked = met.where("not __wide").withColumn("__k", F.row_number().over(Window.partitionBy(*run, "__side").orderBy("__id")))
    a = ranked.where("__side = 0").select(*run, "__k", F.col("__id").alias("__a"), F.col("__v").alias("__value"))
    b = ranked.where("__side = 1").select(*run, "__k", F.col("__id").alias("__b"))
    narrow = a.join(b, [*run, "__k"]).select(*keys, "__a", "__b", "__value")

    def walk(rows):  # noqa: ANN001, ANN202
        import numpy as np
        import pandas as pd

        ours, theirs = (rows[rows["__side"] == n].sort_values("__id", kind="stable") for n in (0, 1))
        values, free, found = theirs["__v"].to_numpy(), np.ones(len(theirs), bool), []
        for own, v in zip(ours["__id"], ours["__v"]):
            near = np.flatnonzero(free & (np.abs(values - v) <= tolerance))
            if len(near):
                free[near[0]] = False
                found.append((own, theirs["__id"].iloc[near[0]], v))
        out = pd.DataFrame(found, columns=["__a", "__b", "__value"])
        for k in reversed(keys):
            out.insert(0, k, rows[k].iloc[0])
        return out

    types = {f.name: f.dataType.simpleString() for f in both.schema}
    schema = ", ".join([*(f"`{k}` {types[k]}" for k in keys), f"__a {types['__id']}", f"__b {types['__id']}", "__value double"])
    wide = met.where("__wide").select(*run, "__v", "__id", "__side").groupBy(*run).applyInPandas(walk, schema)
    return narrow.unionByName(wide).select(*keys, F.col("__a").alias(left_id), F.col("__b").alias(right_id), F.col("__value").alias(value))


def with_unique_fallback(rows: DataFrame, items: DataFrame, id_col: str, keys: list[str], value: str) -> DataFrame:
    """rows with the value of the item of their id, else of the only item of their keys, else null."""
    by_id = items.select(id_col, F.col(value).alias("__i"))
    alone = items.groupBy(*keys).agg(F.count("*").alias("__n"), F.first(value).alias("__k")).where("__n = 1").drop("__n")
    return rows.join(by_id, id_col, "left").join(alone, keys, "left").withColumn(value, F.coalesce("__i", "__k")).drop("__i", "__k")


def candidate_disposition(rows: DataFrame, keys: list[str], order: list[str], stages: list[tuple[str, Column]], eligible: str = "eligible", duplicate: str = "duplicate") -> DataFrame:
    """rows with a disposition: the first stage that holds, else eligible for the first of its keys and duplicate for later ones.

    order tells rows of a key apart. The first of a key is a partial aggregate, so a key that
    holds much of the table is a row for each task before it is shuffled."""
    chain = None
    for name, holds in stages:
        chain = F.when(holds, name) if chain is None else chain.when(holds, name)
    marked = rows.withColumn("disposition", chain)
    place = F.struct(*order)
    first = marked.where(F.col("disposition").isNull()).groupBy(*(F.col(k).alias(f"__{k}") for k in keys)).agg(F.min(place).alias("__first"))
    same = F.col("__first").eqNullSafe(place)
    for k in keys:
        same = same & F.col(f"__{k}").eqNullSafe(F.col(k))
    firsts = first.withColumn("__survives", F.lit(True))
    met = marked.join(firsts, same, "left")
    survivor = F.when(F.col("__survives"), eligible).otherwise(duplicate)
    return met.withColumn("disposition", F.coalesce("disposition", survivor)).drop("__first", "__survives", *(f"__{k}" for k in keys))


def plan_units(*frames: DataFrame) -> DataFrame:
    """Every combination of the rows of small, bounded tables (questions, languages, variants)."""
    out = frames[0]
    for f in frames[1:]:
        out = out.crossJoin(F.broadcast(f))
    return out


def seeded_zip(left: DataFrame, right: DataFrame, keys: list[str], left_id: str, right_id: str, seed: int) -> DataFrame:
    """Rows of both sides paired at random within their keys, the same way for the same seed."""

    def ranked(df: DataFrame, col: str, side: str) -> DataFrame:
        draw = F.sha2(F.concat_ws(":", F.lit(f"{seed}{side}"), *keys, col), 256)
        return df.withColumn("__rank", F.row_number().over(Window.partitionBy(*keys).orderBy(draw, col)))

    return ranked(left, left_id, "l").join(ranked(right, right_id, "r"), [*keys, "__rank"]).drop("__rank")
