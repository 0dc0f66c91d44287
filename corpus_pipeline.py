"""The corpus pipeline: quality rules, language ID, near-dedup, PII, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; what it returns is written
as Parquet and read again as the next one's docs. All but the last keep the columns of
documents. ids repeat only where whole rows do; then near-dedup keeps one of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe.llm import dedup, langid, packing, pii, rules
from lumenframe.llm.common import drop_scratch, table, write_scratch


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base and the learned decision list."""
    return rules.keep(docs, table(spark, sf_dir, "labels"))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the models accept."""
    return langid.keep(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return dedup.keep_one(docs)


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with surrogates for personal data."""
    out = pii.replace(docs, entities_col="__entities").drop("__entities")
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns) if "n_chars" in docs.columns else out


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents with their sequences and places."""
    return packing.pack(docs)


STAGES = [("quality rules", quality), ("language ID", language), ("MinHash near-dedup", near_dedup), ("PII", private), ("best-fit packing", packed)]

#: Learned rules, language models and token ids are beyond SQL; tests/llm checks operators by themselves, and of run() only that rows come out.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, last = table(spark, sf_dir, "documents"), None
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs, path = write_scratch(docs, name.replace(" ", "-"))
            if last:
                drop_scratch(spark, last)
            last = path
    return docs
