"""Streams give what the batch gives."""

from pyspark.sql import functions as F

from lumenframe.operators import vectors
from lumenframe.streaming.scoring import counts_stream, score_stream
from tests.conftest import DATA


def _drain(df, name, mode="complete"):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return df.sparkSession.table(name)


def test_scores(spark, tmp_path):
    e = spark.read.parquet(f"{DATA}/embeddings.parquet").withColumn("ts", F.timestamp_seconds(F.col("vec_id")))
    e.where("vec_id % 5 = 0").write.parquet(f"{tmp_path}/q")
    bank = e.where("vec_id % 5 <> 0").select("vec_id", "label", F.col("embedding").alias("r"))
    queries = spark.read.parquet(f"{tmp_path}/q").select(F.col("vec_id").alias("id"), "label", F.col("embedding").alias("q"), "ts")
    stream = spark.readStream.schema(spark.read.parquet(f"{tmp_path}/q").schema).parquet(f"{tmp_path}/q").select(F.col("vec_id").alias("id"), "label", F.col("embedding").alias("q"), "ts")
    got = {r["id"]: r["nn_score"] for r in _drain(score_stream(stream, bank, ["label"], "q", "r", "id", "ts"), "scores").collect()}
    want = {r["id"]: r["nn_score"] for r in vectors.nearest_similarity(vectors.pairs(queries.drop("ts"), bank, ["label"], "q", "r"), ["id"]).collect()}
    assert got == want


def test_counts(spark, tmp_path):
    spark.read.parquet(f"{DATA}/events.parquet").write.parquet(f"{tmp_path}/e")
    events = spark.readStream.schema(spark.read.parquet(f"{tmp_path}/e").schema).parquet(f"{tmp_path}/e")
    assert _drain(counts_stream(events, "ts", ["event_type"]), "counts").agg(F.sum("n")).first()[0] == 1000
