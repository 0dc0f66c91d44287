"""Queries of this subpackage and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lumenframe.llm import dedup, fingerprints, langid, packing, pieces, pii, quotes, rules, secret_scan, toxicity


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_minhash_dedup": dedup.op1,
        "op2_quotation_linking": quotes.op2,
        "op3_quality_rules": rules.op3,
        "op4_sentencepiece": pieces.op4,
        "op5_secret_scan": secret_scan.op5,
        "op6_language_id": langid.op6,
        "op7_best_fit_packing": packing.op7,
        "op8_pii_surrogates": pii.op8,
        "op9_fingerprints": fingerprints.op9,
        "op10_toxicity": toxicity.op10,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_minhash_dedup": dedup.SQL, "op2_quotation_linking": quotes.SQL, "op5_secret_scan": secret_scan.SQL, "op9_fingerprints": fingerprints.SQL}
