"""Scoring of a stream of submissions against a static bank."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenframe.operators.vectors import dot


def score_stream(submissions: DataFrame, bank: DataFrame, keys: list[str], query_vec: str, ref_vec: str, id_col: str, time_col: str, delay: str = "10 minutes") -> DataFrame:
    """The nearest similarity of each submission, once the watermark has passed it.

    A stream-static join on the routing key; a submission's rows meet in one watermarked
    aggregate, so state is dropped with the watermark."""
    timed = submissions.withColumn(time_col, F.col(time_col).cast("timestamp"))
    met = timed.withWatermark(time_col, delay).join(bank, keys).withColumn("similarity", dot(F.col(query_vec), F.col(ref_vec)))
    return met.groupBy(F.window(time_col, "1 minute"), id_col, *keys).agg(F.max("similarity").alias("nn_score")).drop("window")


def counts_stream(events: DataFrame, time_col: str, by: list[str], window: str = "5 minutes", delay: str = "10 minutes") -> DataFrame:
    """Decisions by window and kind, late rows up to the delay included."""
    return events.withColumn(time_col, F.col(time_col).cast("timestamp")).withWatermark(time_col, delay).groupBy(F.window(time_col, window), *by).agg(F.count("*").alias("n"))
