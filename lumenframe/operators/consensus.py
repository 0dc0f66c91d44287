"""Decisions from the votes of external detectors."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenframe import params


def parse_probability(value: Column) -> Column:
    """A number of 0..100; null for blanks; an error for anything else."""
    text = F.trim(value)
    number = text.try_cast("double")
    bad = (text != "") & (number.isNull() | ~number.between(0, 100))
    return F.when(F.coalesce(bad, F.lit(False)), F.raise_error(F.concat(F.lit("not a probability: "), text)).cast("double")).otherwise(number)


def decide(records: DataFrame, votes: DataFrame, id_col: str, has_raw: Column, tokens: Column, least_tokens: int = params.CONSENSUS_TOKENS, sure: float = params.CONSENSUS_CONFIDENCE, least_votes: int = params.CONSENSUS_VOTES) -> DataFrame:
    """records with label (human, ai, unsure, skipped) and reason.

    A vote responds if its verdict isn't an error and it has a probability (of a human, in
    percent). All responders must be sure of the same side. Votes are summed by record, in
    a partial aggregate, and met once."""
    responds = (F.col("verdict") != "error") & F.col("human_probability").isNotNull()
    p = F.col("human_probability")
    human = F.bool_and(F.when(responds, (F.col("verdict") == "human") & (p >= sure)))
    ai = F.bool_and(F.when(responds, (F.col("verdict") == "ai") & (100 - p >= sure)))
    summed = votes.groupBy(id_col).agg(F.count_if(responds).alias("n_responding"), F.count_if(F.col("verdict") == "error").alias("n_errors"), human.alias("__human"), ai.alias("__ai"))
    joined = records.join(summed, id_col, "left")
    n, errors = F.coalesce("n_responding", F.lit(0)), F.coalesce("n_errors", F.lit(0))
    reason = F.when(~has_raw, "raw_missing").when(tokens < least_tokens, "too_short").when((n == 0) & (errors > 0), "detector_error").when(n == 0, "no_votes").when(n < least_votes, "too_few_votes")
    label = F.when(reason.isin("raw_missing", "too_short", "detector_error", "no_votes"), "skipped").when(reason.isNotNull(), "unsure").when(F.col("__human"), "human").when(F.col("__ai"), "ai").otherwise("unsure")
    return joined.select(*records.columns, n.alias("n_responding"), errors.alias("n_errors"), label.alias("label"), reason.alias("reason"))


def configured(settings: Mapping[str, str | None], needed: Mapping[str, Sequence[str]]) -> dict[str, bool]:
    """For each detector, if every setting that it needs holds more than blanks."""
    return {name: all((settings.get(k) or "").strip() for k in keys) for name, keys in needed.items()}
