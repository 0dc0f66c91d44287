"""The scoring of submissions as one plan: gates, routing, nearest reference, discount, display, card."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenframe import params
from lumenframe.functions import code as C
from lumenframe.functions import text as T
from lumenframe.operators import explain, routing, scoring, vectors

KEYS = ["question_id", "language"]


def integrity(requests: DataFrame) -> DataFrame:
    """requests (raw_code, boilerplate, question_id, language) with stripped, tokens and the first integrity reason."""
    s = requests.withColumn("__s", C.strip_udf("raw_code", "boilerplate", "language"))
    s = s.withColumn("stripped", F.col("__s.stripped")).withColumn("tokens", C.token_count_udf("stripped", "language"))
    reason = F.when(~F.col("language").isin(*params.LANGUAGES), "unsupported_language").when(F.trim(F.coalesce("raw_code", F.lit(""))) == "", "raw_missing").when(F.col("__s.error").isNotNull(), F.concat(F.lit("strip_"), F.col("__s.error"))).when(F.col("tokens").isNull(), "tokens_missing")
    return s.withColumn("integrity", reason).drop("__s")


def score_submissions(requests: DataFrame, bank: DataFrame, cache: DataFrame, model: str, anchors: params.Anchors = params.Anchors(), texts: DataFrame | None = None) -> DataFrame:
    """One row for each request (request_id): status, reason, score, percent, exact_match, nearest vector_id and card.

    bank: long-form (question_id, language, vector_id, embedding, stripped_hash); cache:
    vectors by cache key; texts: (question_id, language, vector_id, text) of references, for
    the lines that a card names. Gates come before vectors: a row that fails one has none
    looked up and a null score."""
    checked = integrity(requests)
    diverse = vectors.diversity(bank, KEYS, "vector_id", "embedding").select(*KEYS, "diversity")
    routed = checked.join(diverse, KEYS, "left")
    gate = routing.eligibility(F.col("language"), F.col("integrity").isNull(), F.col("diversity").isNotNull(), F.col("tokens"))
    gated = routed.withColumn("gate", gate).withColumn("stripped_hash", T.text_hash(F.col("stripped")))
    open_ = gated.where(F.col("gate.eligible") & (F.col("diversity") >= params.LOW_DIVERSITY))
    queried = open_.select("request_id", *KEYS, T.cache_key(F.lit(model), F.col("stripped")).alias("cache_key")).join(cache.select("cache_key", F.col("embedding").alias("q")), "cache_key")
    met = vectors.pairs(queried, bank.select(*KEYS, "vector_id", F.col("embedding").alias("r")), KEYS, "q", "r")
    best = vectors.nearest_reference(met, ["request_id"], "vector_id")
    exact = routing.with_exact_match(gated, bank, KEYS, "stripped_hash")
    out = exact.join(best, "request_id", "left")
    flagged = C.style_udf("stripped", "language")
    out = out.withColumn("signals", F.when(F.col("nn_score").isNotNull(), flagged)).withColumn("naming", C.naming_udf("stripped", "language"))
    out = out.withColumn("commented", F.exists(F.coalesce("signals", F.array().cast("array<struct<name:string,fired:boolean,direction:string,experimental:boolean>>")), lambda s: (s["name"] == "commented_out_code") & s["fired"]))
    out = out.withColumns({"line_start": F.lit(None).cast("int"), "line_end": F.lit(None).cast("int")}) if texts is None else with_matching_span(out, texts).drop("lines")
    c = scoring.canonicality(F.col("nn_score"), F.col("tokens"), F.col("language"), F.col("diversity"), F.col("commented"), F.col("naming.descriptive"))
    out = out.withColumn("c", c)
    scored = F.col("nn_score").isNotNull()
    status = F.when(scored, F.col("c.status")).when(F.col("gate.reason") == "insufficient_tokens", "insufficient_evidence").when(F.col("gate.reason").isNotNull(), "not_scored").when(F.col("diversity") < params.LOW_DIVERSITY, "low_confidence").otherwise("vector_missing")
    reason = F.when(scored, F.col("c.reason")).when(F.col("integrity").isNotNull(), F.col("integrity")).otherwise(F.coalesce(F.col("gate.reason"), F.when(F.col("diversity") < params.LOW_DIVERSITY, F.lit("low_cluster_diversity")).otherwise("vector_missing")))
    percent = F.when(scored, scoring.display_percent_by_language(F.when(scored, vectors.display_similarity(F.col("c.score"))), F.when(scored, F.col("language")).otherwise(params.LANGUAGES[0]), anchors))
    out = out.select("request_id", *KEYS, status.alias("status"), reason.alias("reason"), "tokens", "diversity", F.col("c.score").alias("score"), percent.alias("percent"), "exact_match", F.when(F.col("exact_match"), "exact reference match - review").alias("decision"), F.when(scored, F.col("vector_id")).alias("vector_id"), "signals", "naming", "commented", "line_start", "line_end")
    card: Column = F.when(F.col("score").isNotNull(), explain.scored_card(F.col("percent"), F.col("vector_id").isNotNull(), F.col("line_start"), F.col("line_end"), F.col("diversity"), F.col("status"), F.col("naming.descriptive") >= params.DESCRIPTIVE_FLOOR, F.col("commented"))).otherwise(explain.unscored_card(F.col("status"), F.col("reason")))
    return out.withColumn("card", explain.formatted(card)).drop("naming", "commented", "line_start", "line_end")


def tokenised(rows: DataFrame, code: str = "code", language: str = "language") -> DataFrame:
    """rows with `tokens`, without those whose code has no count."""
    return rows.withColumn("tokens", C.token_count_udf(code, language)).where(F.col("tokens").isNotNull())


def with_matching_span(nearest: DataFrame, texts: DataFrame, code: str = "stripped") -> DataFrame:
    """nearest (KEYS, vector_id, code) with line_start, line_end and lines of the reference's longest shared block."""
    joined = nearest.join(texts.select(*KEYS, "vector_id", F.col("text").alias("__ref")), [*KEYS, "vector_id"], "left")
    return joined.withColumn("__m", C.matching_span_udf("__ref", code)).select(*nearest.columns, "__m.*")


def restripped(solutions: DataFrame) -> DataFrame:
    """Solutions whose stored strip differs from one made now: the change set of a rebuild."""
    now = solutions.withColumn("new_stripped", C.strip_udf("raw_code", "boilerplate", "language")["stripped"])
    return now.where(F.col("new_stripped").isNotNull() & ~F.col("new_stripped").eqNullSafe(F.col("stripped_code")))


def strip_status(rows: DataFrame) -> DataFrame:
    """rows with strip_status: exact_match, mismatch or cannot_verify."""
    again = C.strip_udf("raw_code", "boilerplate", "language")
    s = rows.withColumn("__s", again["stripped"])
    return s.withColumn("strip_status", F.when(F.col("__s").isNull(), "cannot_verify").when(T.text_hash(F.col("__s")) == F.col("stripped_hash"), "exact_match").otherwise("mismatch")).drop("__s")


def folder_digest(files: DataFrame) -> DataFrame:
    """A digest of (path, content) files: each file's hash first, then the hashes in order of path (a row for each file)."""
    each = files.select("path", F.sha2("content", 256).alias("h"))
    return each.agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("path", "h"))), lambda x: F.concat_ws(":", x["path"], x["h"])), "\n"), 256).alias("digest"))
