"""Seeded, stable and stratified selection. Draws are SHA-256 ranks, so a seed repeats exactly."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenframe.operators.metrics import running


def stable_rank(seed: int | str, col: str | Column) -> Column:
    c = F.col(col) if isinstance(col, str) else col
    return F.sha2(F.concat(F.lit(f"{seed}:"), c.cast("string")), 256)


def assignment_seed(*parts: Column) -> Column:
    """The first 16 hex digits of a hash, as an unsigned number."""
    return F.conv(F.substring(F.sha2(F.concat_ws(":", *parts), 256), 1, 16), 16, 10).cast("decimal(20,0)")


def coverage_rank(bucket: Column) -> Column:
    return F.when(bucket == "6+", 0).when(bucket == "3-5", 1).otherwise(2)


def stratum_quotas(strata: DataFrame, key: str, size: str, wanted: int) -> DataFrame:
    """key, size, quota by largest remainders; ties go to the greater key, none above its size. A row for each stratum."""
    total = strata.agg(F.sum(size)).first()[0] or 0
    wanted = min(wanted, total)
    exact = F.col(size) * F.lit(wanted)
    base = strata.select(key, size, F.floor(exact / F.lit(max(total, 1))).cast("long").alias("base"), (exact % F.lit(max(total, 1))).alias("rest"))
    left = wanted - (base.agg(F.sum("base")).first()[0] or 0)
    order = Window.orderBy((F.col("base") < F.col(size)).desc(), F.desc("rest"), F.desc(key))  # a row for each stratum
    extra = (F.row_number().over(order) <= left) & (F.col("base") < F.col(size))
    return base.select(key, size, (F.col("base") + extra.cast("long")).alias("quota"))


def pick_by_quotas(rows: DataFrame, quotas: DataFrame, key: str, order: list[Column | str]) -> DataFrame:
    """The first quota rows of each stratum in the order."""
    ranked = rows.withColumn("__r", F.row_number().over(Window.partitionBy(key).orderBy(*order)))
    return ranked.join(F.broadcast(quotas.select(key, "quota")), key).where(F.col("__r") <= F.col("quota")).drop("__r", "quota")


def replace_lowest(selected: DataFrame, pool: DataFrame, id_col: str, wanted: Column, least: int, order: list[Column], donors_last: list[Column]) -> DataFrame:
    """selected, with rows of the pool for which `wanted` holds swapped in for its last others, until there are `least` of them."""
    have = selected.where(wanted).count()
    need = max(0, least - have)
    if not need:
        return selected
    incoming = pool.where(wanted).join(selected.select(id_col), id_col, "left_anti").orderBy(*order).limit(need).cache()
    n = incoming.count()
    donors = selected.where(~wanted).orderBy(*donors_last).limit(n).select(id_col)
    return selected.join(F.broadcast(donors), id_col, "left_anti").unionByName(incoming.select(*selected.columns))


def stratified(rows: DataFrame, id_col: str, strata: list[str], wanted: int, seed: int, bucket: Column, coverage: str) -> DataFrame:
    """Quotas by stratum, then ranks by coverage bucket, coverage, seeded hash, id."""
    keyed = rows.withColumn("__stratum", F.concat_ws("|", *strata))
    quotas = stratum_quotas(keyed.groupBy("__stratum").agg(F.count("*").alias("size")), "__stratum", "size", wanted)
    order = [coverage_rank(bucket), F.desc(coverage), stable_rank(seed, id_col), F.col(id_col)]
    return pick_by_quotas(keyed, quotas, "__stratum", order).drop("__stratum")


def tertile_bands(rows: DataFrame, by: str, score: str, id_col: str) -> DataFrame:
    """rows with band low, mid or high: cuts at n // 3 and 2 n // 3 of each language, so later bands get the remainder.

    Ranks come from counts of scores; only rows of one score are ordered among themselves."""
    counts = running(rows.groupBy(by, score).agg(F.count("*").alias("__n")), score, ["__n"], [by])
    tied = F.row_number().over(Window.partitionBy(by, score).orderBy(id_col)) - 1
    ranked = rows.withColumn("__t", tied).join(counts, [by, score])
    r, n = F.col("__n_upto") - F.col("__n") + F.col("__t"), F.col("__n_all")
    return ranked.withColumn("band", F.when(r < F.floor(n / 3), "low").when(r < F.floor(2 * n / 3), "mid").otherwise("high")).drop("__t", "__n", "__n_upto", "__n_all")


def fill_floors(rows: DataFrame, cells: list[str], least: int, seed: int, id_col: str) -> DataFrame:
    """At least `least` rows of each cell (or all it has), by seeded hash."""
    order = Window.partitionBy(*cells).orderBy(stable_rank(seed, id_col), id_col)
    return rows.withColumn("__r", F.row_number().over(order)).where(F.col("__r") <= least).drop("__r")


def extremes(rows: DataFrame, by: str, score: str, id_col: str, n: int = 5) -> DataFrame:
    """The n lowest of each language, and the n highest of the rest; ties by fingerprint."""
    print_ = F.substring(F.sha2(F.col(id_col).cast("string"), 256), 1, 12)
    low = F.row_number().over(Window.partitionBy(by).orderBy(score, print_))
    ranked = rows.withColumn("__low", low)
    high = F.row_number().over(Window.partitionBy(by, F.col("__low") <= n).orderBy(F.desc(score), print_))
    ranked = ranked.withColumn("__high", high)
    kind = F.when(F.col("__low") <= n, "lowest").when(F.col("__high") <= n, "highest")
    return ranked.withColumn("extreme", kind).where(F.col("extreme").isNotNull()).withColumn("rank", F.when(F.col("extreme") == "lowest", F.col("__low")).otherwise(F.col("__high"))).drop("__low", "__high")


def in_given_order(rows: DataFrame, id_col: str, ids: list) -> DataFrame:
    """The rows of a short list of ids with their place in it; an error if one is absent."""
    wanted = rows.sparkSession.createDataFrame([(i, x) for i, x in enumerate(ids)], f"place int, {id_col} {dict(rows.dtypes)[id_col]}")
    found = rows.join(F.broadcast(wanted), id_col)
    if found.select("place").distinct().count() != len(ids):
        raise LookupError("an id of the list has no row")
    return found


def capped_batch(rows: DataFrame, id_col: str, seed: int, size: int, cap_col: str, cap_value: str, cap: int, cells: list[str], cell_floor: int, band: str, band_floor: int) -> DataFrame:
    """A review batch: floors by cell, then by score band, then by hash, within a size and a cap for one language.

    Each row gets its phase and its rank in it; the cut is taken on (phase, hash) by language."""
    h = stable_rank(seed, id_col)
    cell_rank = F.row_number().over(Window.partitionBy(*cells).orderBy(h))
    band_rank = F.row_number().over(Window.partitionBy(cap_col, band).orderBy(h))
    phase = F.when(cell_rank <= cell_floor, 0).when(band_rank <= band_floor, 1).otherwise(2)
    phased = rows.withColumn("phase", phase).withColumn("__h", h)
    capped = phased.where(F.col(cap_col) == cap_value).orderBy("phase", "__h").limit(cap)
    others = phased.where(F.col(cap_col) != cap_value).orderBy("phase", "__h").limit(size)
    taken = capped.unionByName(others).orderBy("phase", "__h").limit(size)
    return taken.drop("__h")


def top_up_tags(selected: DataFrame, pool: DataFrame, id_col: str, tags: str, least: int, order: list[Column], donors_last: list[Column]) -> DataFrame:
    """selected with at least `least` members of each tag that the pool has as many of, tag after tag in order.

    Each swap sees the one before, so this loops on the driver over the tags, dozens at most."""
    common = pool.select(F.explode(tags).alias("t")).groupBy("t").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    for r in sorted(common.select("t").collect()):
        selected = replace_lowest(selected, pool, id_col, F.array_contains(tags, r["t"]), least, order, donors_last)
    return selected


def review_records(rows: DataFrame, id_col: str, cells: list[str], exact: Column, least: int, size: int, seed: int) -> DataFrame:
    """All exact matches, then floors of each cell, then the rest, by seeded hash, cut to size."""
    h = stable_rank(seed, id_col)
    cell = F.row_number().over(Window.partitionBy(*cells).orderBy(h))
    phase = F.when(exact, 0).when(cell <= least, 1).otherwise(2)
    return rows.withColumn("phase", phase).orderBy("phase", h).limit(size)


def language_mix(rows: DataFrame, by: str, first: str, size: int, order: list[Column | str]) -> DataFrame:
    """size // 2 rows of the first language, then others up to size."""
    a = rows.where(F.col(by) == first).orderBy(*order).limit(size // 2)
    n = a.count()
    return a.unionByName(rows.where(F.col(by) != first).orderBy(*order).limit(size - n))


def distinct_samples(rows: DataFrame, by: str, question: str, n: int, order: list[Column | str]) -> DataFrame:
    """The first n rows of each language, no question twice."""
    one = rows.withColumn("__q", F.row_number().over(Window.partitionBy(question).orderBy(*order))).where("__q = 1").drop("__q")
    return one.withColumn("__r", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("__r") <= n).drop("__r")


def model_slots(models: list[str], slots: int, spark, salt: str = "") -> DataFrame:  # noqa: ANN001
    """slot, model: models repeated evenly, what is left over given by seeded hash; sizes are those of a plan."""
    base, rest = divmod(slots, len(models))
    given = spark.createDataFrame([(m,) for m in models], "model string").withColumn("__r", F.row_number().over(Window.orderBy(stable_rank(salt or "slots", "model"))))
    times = given.withColumn("__k", F.lit(base) + (F.col("__r") <= rest).cast("int")).where("__k > 0")
    return times.select("model", F.explode(F.sequence(F.lit(1), F.col("__k"))).alias("__i")).withColumn("slot", F.row_number().over(Window.orderBy("__i", "model")) - 1).select("slot", "model")
