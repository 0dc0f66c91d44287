"""Queries over the driver's tables, each with the SQL that gives the same rows.

Stand-ins: `embeddings.label` is the routing key and every fifth vector a query;
`documents` gives languages, sources, token counts (n_chars) and texts; `labels` the
classes; `events` the votes; `conversations` positional groups.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe.functions import text as T
from lumenframe.operators import banks, consensus, dedup, explain, metrics, reports, resampling, routing, sampling, scoring, vectors
from lumenframe.sources.readers import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str = "") -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def _vectors(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    e = table(spark, d, "embeddings")
    queries = e.where("vec_id % 5 = 0").select(F.col("vec_id").alias("query_id"), "label", F.col("embedding").alias("q"))
    return queries, e.where("vec_id % 5 <> 0").select("vec_id", "label", F.col("embedding").alias("r"))


def _matched(spark: SparkSession, d: str) -> DataFrame:
    queries, bank = _vectors(spark, d)
    return vectors.pairs(queries, bank, ["label"], "q", "r")


_MATCHED = "WITH m AS (SELECT q.vec_id AS query_id, q.label, r.vec_id, list_dot_product(q.embedding::DOUBLE[], r.embedding::DOUBLE[]) AS s FROM embeddings q JOIN embeddings r ON q.label = r.label WHERE q.vec_id % 5 = 0 AND r.vec_id % 5 <> 0)"
LOW, MID = 0.1, 0.4


@query(f"""{_MATCHED}, b AS (SELECT query_id, label, max(s) AS s FROM m GROUP BY ALL)
SELECT query_id, label, round(s, 6) AS nn_score,
  CAST(CASE WHEN s >= {MID} THEN greatest(50, least(100, round_even(50 + 50 * least(greatest((s - {MID}) / (1 - {MID}), 0), 1), 0)))
       ELSE greatest(0, least(49, round_even(50 * least(greatest((s - {LOW}) / ({MID} - {LOW}), 0), 1), 0))) END AS INTEGER) AS percent FROM b""")
def nn_display_percent(spark: SparkSession, d: str) -> DataFrame:
    """The flagship: strict routing, nearest neighbour, display percentage."""
    best = vectors.nearest_similarity(_matched(spark, d), ["query_id", "label"])
    return best.select("query_id", "label", F.round("nn_score", 6).alias("nn_score"), scoring.display_percent(F.col("nn_score"), LOW, MID).alias("percent"))


@query(_MATCHED + " SELECT query_id, label, vec_id, round(s, 6) AS similarity, CAST(k AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, vec_id) AS k FROM m) WHERE k <= 3")
def vector_top_k(spark: SparkSession, d: str) -> DataFrame:
    out = vectors.top_k(_matched(spark, d), ["query_id"], "vec_id", 3)
    return out.select("query_id", "label", "vec_id", F.round("similarity", 6).alias("similarity"), "rank")


@query(_MATCHED + " SELECT query_id, label, vec_id, round(s, 6) AS nn_score, round(1 - s, 6) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, vec_id) AS k FROM m) WHERE k = 1")
def vector_nearest_reference(spark: SparkSession, d: str) -> DataFrame:
    out = vectors.nearest_reference(_matched(spark, d), ["query_id", "label"], "vec_id")
    return out.select("query_id", "label", "vec_id", F.round("nn_score", 6).alias("nn_score"), F.round(1 - F.col("nn_score"), 6).alias("distance"))


@query("""WITH p AS (SELECT a.label, avg(1 - list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[])) AS v FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id < b.vec_id GROUP BY 1)
SELECT e.label, count(*) AS n_vectors, round(coalesce(any_value(p.v), 1.0), 6) AS diversity, coalesce(any_value(p.v), 1.0) < 0.999 AS low_diversity FROM embeddings e LEFT JOIN p ON e.label = p.label GROUP BY e.label""")
def cluster_diversity(spark: SparkSession, d: str) -> DataFrame:
    out = vectors.diversity(table(spark, d, "embeddings"), ["label"], "vec_id", "embedding")
    return out.select("label", "n_vectors", F.round("diversity", 6).alias("diversity"), (F.col("diversity") < 0.999).alias("low_diversity"))


@query("SELECT vec_id, round(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 5) AS length, len(embedding) AS dim, round(embedding[1]::DOUBLE / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 6) AS first_part FROM embeddings")
def vector_normalise(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    return e.select("vec_id", F.round(vectors.norm(F.col("embedding")), 5).alias("length"), F.size("embedding").cast("long").alias("dim"), F.round(vectors.normalised(F.col("embedding"))[0], 6).alias("first_part"))


@query("SELECT vec_id, CASE WHEN len(embedding) <> 64 THEN 'dimension' WHEN abs(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) - 1) > 1e-3 THEN 'not_unit' END AS violation FROM embeddings WHERE len(embedding) <> 64 OR abs(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) - 1) > 1e-3")
def vector_violations(spark: SparkSession, d: str) -> DataFrame:
    return vectors.violations(table(spark, d, "embeddings"), "embedding", 64).select("vec_id", "violation")


@query("SELECT label, count(*) AS n_vectors FROM embeddings GROUP BY label HAVING count(*) NOT BETWEEN 45 AND 55")
def cluster_size_violations(spark: SparkSession, d: str) -> DataFrame:
    return vectors.size_violations(table(spark, d, "embeddings"), ["label"], 45, 55)


@query("SELECT q.doc_id, q.lang, EXISTS (SELECT 1 FROM documents r WHERE r.doc_id % 2 = 1 AND r.lang = q.lang AND sha256(r.text) = sha256(q.text)) AS exact_match FROM documents q WHERE q.doc_id % 2 = 0")
def exact_reference_match(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "lang", T.text_hash(F.col("text")).alias("hash"))
    return routing.with_exact_match(docs.where("doc_id % 2 = 0"), docs.where("doc_id % 2 = 1"), ["lang"], "hash").select("doc_id", "lang", "exact_match")


@query("SELECT doc_id FROM documents WHERE doc_id % 2 = 0 AND sha256(text) IN (SELECT sha256(text) FROM documents WHERE doc_id % 2 = 1)")
def contaminated_records(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", T.text_hash(F.col("text")).alias("hash"))
    return routing.contaminated(docs.where("doc_id % 2 = 0"), docs.where("doc_id % 2 = 1"), "hash").select("doc_id")


@query("SELECT o_orderkey, o_custkey FROM orders o WHERE NOT EXISTS (SELECT 1 FROM customer c WHERE c.c_custkey = o.o_custkey AND c.c_acctbal > 0)")
def missing_clusters(spark: SparkSession, d: str) -> DataFrame:
    known = table(spark, d, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"))
    return routing.missing_clusters(table(spark, d, "orders"), known, ["o_custkey"]).select("o_orderkey", "o_custkey")


@query("SELECT p.o_orderkey FROM orders p WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = p.o_orderkey AND l.l_returnflag <> 'R')")
def pending_units(spark: SparkSession, d: str) -> DataFrame:
    done = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_returnflag")
    return routing.pending(table(spark, d, "orders").select("o_orderkey"), done, ["o_orderkey"], F.col("l_returnflag") == "R")


@query("SELECT a.conv_id, a.turn, coalesce(nullif(trim(b.text), ''), 'raw_code_unavailable') AS text FROM (SELECT conv_id, turn + 1 AS turn FROM conversations) a LEFT JOIN conversations b ON a.conv_id = b.conv_id AND a.turn = b.turn")
def positional_lookup(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations")
    out = routing.positional(c.select("conv_id", (F.col("turn") + 1).alias("turn")), c, ["conv_id"], "turn", "text", "raw_code_unavailable")
    return out.select("conv_id", "turn", F.trim("text").alias("text"))


@query("""WITH o AS (SELECT event_type, event_id, value, event_id % 2 AS side, CASE WHEN value - lag(value) OVER w > 1e-9 THEN 1 ELSE 0 END AS new FROM events WHERE value IS NOT NULL WINDOW w AS (PARTITION BY event_type ORDER BY value)),
r AS (SELECT *, sum(new) OVER (PARTITION BY event_type ORDER BY value ROWS UNBOUNDED PRECEDING) AS run FROM o),
k AS (SELECT *, row_number() OVER (PARTITION BY event_type, run, side ORDER BY event_id) AS k FROM r)
SELECT a.event_type, a.event_id AS left_id, b.event_id AS right_id, a.value FROM k a JOIN k b USING (event_type, run, k) WHERE a.side = 0 AND b.side = 1""")
def tolerance_pairs(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("event_type", "event_id", "value")
    return routing.one_to_one(e.where("event_id % 2 = 0").withColumnRenamed("event_id", "left_id"), e.where("event_id % 2 = 1").withColumnRenamed("event_id", "right_id"), ["event_type"], "value", 1e-9, "left_id", "right_id")


@query("""WITH items AS (SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderkey % 3 = 0),
alone AS (SELECT o_custkey, any_value(o_totalprice) AS p FROM items GROUP BY 1 HAVING count(*) = 1)
SELECT o.o_orderkey, o.o_custkey, coalesce(i.o_totalprice, a.p) AS o_totalprice FROM orders o LEFT JOIN items i ON i.o_orderkey = o.o_orderkey LEFT JOIN alone a ON a.o_custkey = o.o_custkey""")
def unique_fallback(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    return routing.with_unique_fallback(o.drop("o_totalprice"), o.where("o_orderkey % 3 = 0"), "o_orderkey", ["o_custkey"], "o_totalprice").select("o_orderkey", "o_custkey", "o_totalprice")


@query("SELECT n_name, l.lang, r.r_name FROM nation CROSS JOIN (SELECT unnest(['CPP', 'PYTHON']) AS lang) l CROSS JOIN region r")
def generation_plan(spark: SparkSession, d: str) -> DataFrame:
    langs = spark.createDataFrame([("CPP",), ("PYTHON",)], "lang string")
    return routing.plan_units(table(spark, d, "nation").select("n_name"), langs, table(spark, d, "region").select("r_name"))


@query("""WITH l AS (SELECT lang, source, row_number() OVER (PARTITION BY lang ORDER BY sha256('7l:' || lang || ':' || source), source) AS k FROM (SELECT DISTINCT lang, source FROM documents)),
r AS (SELECT lang, n_name, row_number() OVER (PARTITION BY lang ORDER BY sha256('7r:' || lang || ':' || n_name), n_name) AS k FROM (SELECT DISTINCT lang FROM documents) CROSS JOIN nation)
SELECT l.lang, source, n_name FROM l JOIN r ON l.lang = r.lang AND l.k = r.k""")
def seeded_zip(spark: SparkSession, d: str) -> DataFrame:
    left = table(spark, d, "documents").select("lang", "source").distinct()
    right = left.select("lang").distinct().crossJoin(F.broadcast(table(spark, d, "nation").select("n_name")))  # languages times nations
    return routing.seeded_zip(left, right, ["lang"], "source", "n_name", 7).select("lang", "source", "n_name")


_FLOORS, _CEILINGS = {"en": 700, "de": 550}, {"en": 1100, "de": 1000}


@query("""WITH x AS (SELECT doc_id, lang, n_chars, CASE lang WHEN 'en' THEN 700 WHEN 'de' THEN 550 END AS floor, text NOT LIKE '%|%' AS valid, source <> 'src3' AS has_cluster FROM documents),
y AS (SELECT *, CASE WHEN floor IS NULL THEN 'unsupported_language' WHEN NOT valid THEN 'invalid_submission' WHEN NOT has_cluster THEN 'missing_cluster' WHEN n_chars < floor THEN 'insufficient_tokens' END AS reason FROM x)
SELECT doc_id, lang, reason IS NULL AS eligible, reason FROM y""")
def eligibility_gates(spark: SparkSession, d: str) -> DataFrame:
    e = routing.eligibility(F.col("lang"), ~F.col("text").contains("|"), F.col("source") != "src3", F.col("n_chars"), _FLOORS)
    return table(spark, d, "documents").select("doc_id", "lang", e.alias("e")).select("doc_id", "lang", "e.*")


@query("""WITH x AS (SELECT doc_id, n_chars, CASE lang WHEN 'en' THEN 700 WHEN 'de' THEN 550 END AS floor, CASE lang WHEN 'en' THEN 1100 WHEN 'de' THEN 1000 END AS ceiling, (doc_id % 100) / 1000.0 AS diversity FROM documents WHERE lang IN ('en', 'de'))
SELECT doc_id, CASE WHEN n_chars < floor THEN 'insufficient_evidence' WHEN diversity < 0.03 THEN 'low_confidence' WHEN n_chars <= ceiling THEN 'low_confidence_short' ELSE 'scored' END AS status,
  CASE WHEN n_chars < floor THEN 'insufficient_tokens' WHEN diversity < 0.03 THEN 'low_cluster_diversity' WHEN n_chars <= ceiling THEN 'short_code_low_confidence' END AS reason, n_chars <= ceiling AS short, diversity < 0.03 AS tight FROM x""")
def confidence_routing(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").where(F.col("lang").isin("en", "de"))
    c = routing.confidence(F.col("n_chars"), F.col("lang"), (F.col("doc_id") % 100) / 1000.0, _FLOORS, _CEILINGS)
    return docs.select("doc_id", c.alias("c")).select("doc_id", "c.*")


@query("""WITH x AS (SELECT vec_id, CASE WHEN vec_id % 2 = 0 THEN 'CPP' ELSE 'PYTHON' END AS language, 50 + vec_id % 80 AS tokens, (vec_id % 50) / 1000.0 AS diversity, 0.90 + (vec_id % 100) / 1000.0 AS raw, vec_id % 7 = 0 AS commented, (vec_id % 10) / 10.0 AS frac FROM embeddings),
y AS (SELECT *, CASE WHEN tokens < CASE language WHEN 'CPP' THEN 70 ELSE 55 END THEN 'insufficient_evidence' WHEN diversity < 0.03 THEN 'low_confidence' WHEN tokens <= CASE language WHEN 'CPP' THEN 110 ELSE 100 END THEN 'low_confidence_short' ELSE 'scored' END AS status, CASE WHEN commented THEN 0.12 ELSE 0 END AS discount FROM x),
z AS (SELECT *, CASE WHEN status IN ('scored', 'low_confidence_short') THEN raw * (1 - discount) END AS score FROM y)
SELECT vec_id, status, round(score, 6) AS score, frac >= 0.42 AS descriptive_naming, CASE WHEN score >= 0.98 AND frac >= 0.42 THEN 'high_confidence' ELSE 'standard' END AS naming_label,
  CASE WHEN score IS NULL THEN 'not scored' WHEN score >= 0.98 THEN 'very close' WHEN score >= 0.90 THEN 'close' ELSE 'distant' END AS band FROM z""")
def canonicality(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("vec_id")
    c = scoring.canonicality(0.90 + (i % 100) / 1000.0, 50 + i % 80, F.when(i % 2 == 0, "CPP").otherwise("PYTHON"), (i % 50) / 1000.0, i % 7 == 0, (i % 10) / 10.0)
    out = table(spark, d, "embeddings").select("vec_id", c.alias("c")).select("vec_id", "c.*")
    return out.select("vec_id", "status", F.round("score", 6).alias("score"), "descriptive_naming", "naming_label", scoring.unlocked_band(F.col("score")).alias("band"))


@query("""WITH f AS (SELECT d.doc_id, d.lang, d.source, CASE WHEN l.doc_id IS NULL THEN 'unlabelled' WHEN l.toxic = 1 THEN 'toxic' WHEN d.n_chars < 200 THEN 'too_short' END AS stage FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id)
SELECT doc_id, coalesce(stage, CASE WHEN row_number() OVER (PARTITION BY lang, source, stage IS NULL ORDER BY doc_id) = 1 THEN 'eligible' ELSE 'duplicate' END) AS disposition FROM f""")
def candidate_disposition(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left")
    stages = [("unlabelled", F.col("quality").isNull()), ("toxic", F.col("toxic") == 1), ("too_short", F.col("n_chars") < 200)]
    return routing.candidate_disposition(rows, ["lang", "source"], ["doc_id"], stages).select("doc_id", "disposition")


@query("""SELECT p_partkey, CASE WHEN p_size >= 6 THEN '6+' WHEN p_size >= 3 THEN '3-5' ELSE '1-2' END AS bucket, CASE WHEN p_size * 5 <= 80 THEN '60-80' WHEN p_size * 5 <= 150 THEN '80-150' ELSE '>150' END AS token_band,
  CASE WHEN p_size * 2 >= 50 THEN 'high' WHEN p_size * 2 >= 25 THEN 'medium' ELSE 'low' END AS level, CASE WHEN p_size * 2 < 50 THEN 'green' WHEN p_partkey % 2 = 0 THEN 'yellow' WHEN p_size * 2 >= 55 THEN 'red' ELSE 'yellow' END AS band FROM part""")
def band_projections(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("p_size")
    return table(spark, d, "part").select("p_partkey", scoring.coverage_bucket(n).alias("bucket"), scoring.token_band(n * 5).alias("token_band"), scoring.match_level(n * 2).alias("level"), scoring.display_band(n * 2, F.col("p_partkey") % 2 == 0).alias("band"))


@query("SELECT lang, count(n_chars) AS n, round(avg(n_chars), 4) AS mean, round(CASE WHEN count(*) = 1 THEN 0 ELSE stddev_samp(n_chars) END, 4) AS std, min(n_chars) AS min, max(n_chars) AS max, round(quantile_cont(n_chars::DOUBLE, 0.05), 4) AS p05, round(quantile_cont(n_chars::DOUBLE, 0.5), 4) AS p50, round(quantile_cont(n_chars::DOUBLE, 0.99), 4) AS p99 FROM documents GROUP BY lang")
def describe_values(spark: SparkSession, d: str) -> DataFrame:
    out = metrics.describe_values(table(spark, d, "documents"), "n_chars", ["lang"])
    return out.select("lang", "n", F.round("mean", 4).alias("mean"), F.round("std", 4).alias("std"), "min", "max", *(F.round(c, 4).alias(c) for c in ("p05", "p50", "p99")))


@query("SELECT l_returnflag, count(*) AS n, round(avg(l_extendedprice), 3) AS mean, round(stddev_pop(l_extendedprice), 3) AS std, round(quantile_cont(l_extendedprice, 0.1), 4) AS p10, round(quantile_cont(l_extendedprice, 0.25), 4) AS p25, round(quantile_cont(l_extendedprice, 0.5), 4) AS p50, round(quantile_cont(l_extendedprice, 0.75), 4) AS p75, round(quantile_cont(l_extendedprice, 0.9), 4) AS p90 FROM lineitem GROUP BY l_returnflag")
def score_statistics(spark: SparkSession, d: str) -> DataFrame:
    out = metrics.score_statistics(table(spark, d, "lineitem"), "l_extendedprice", ["l_returnflag"])
    return out.select("l_returnflag", "n", F.round("mean", 3).alias("mean"), F.round("std", 3).alias("std"), *(F.round(c, 4).alias(c) for c in ("p10", "p25", "p50", "p75", "p90")))


@query("""WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS k, count(*) OVER (PARTITION BY event_type) AS n FROM events)
SELECT event_type, max(CASE WHEN k = round_even(0.1 * (n - 1), 0) THEN value END) AS p10, max(CASE WHEN k = round_even(0.5 * (n - 1), 0) THEN value END) AS p50, max(CASE WHEN k = round_even(0.9 * (n - 1), 0) THEN value END) AS p90 FROM r GROUP BY event_type""")
def nearest_rank_percentiles(spark: SparkSession, d: str) -> DataFrame:
    return metrics.nearest_rank(table(spark, d, "events"), "value", {"p10": 0.1, "p50": 0.5, "p90": 0.9}, ["event_type"])


@query("""WITH r AS (SELECT min(value) AS lo, max(value) AS hi FROM events), b AS (SELECT least(floor((value - lo) / ((hi - lo) / 10)), 9) AS b, count(*) AS n FROM events, r GROUP BY 1)
SELECT CAST(i + 1 AS INTEGER) AS bin, round(lo + i * ((hi - lo) / 10), 6) AS low, round(lo + (i + 1) * ((hi - lo) / 10), 6) AS high, coalesce(n, 0) AS count FROM range(10) t(i) CROSS JOIN r LEFT JOIN b ON b.b = i""")
def histogram(spark: SparkSession, d: str) -> DataFrame:
    out = metrics.histogram(table(spark, d, "events"), "value")
    return out.select("bin", F.round("low", 6).alias("low"), F.round("high", 6).alias("high"), "count")


def _scored(spark: SparkSession, d: str) -> DataFrame:
    """Labelled documents with a deterministic score: label 1 is toxic."""
    docs = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id")
    return docs.select("doc_id", "lang", "source", F.col("toxic").alias("y"), ((F.col("n_chars") % 1000 + 150 * F.col("toxic")) / 1150.0).alias("s"))


_SCORED = "WITH x AS (SELECT d.doc_id, d.lang, d.source, l.toxic AS y, (d.n_chars % 1000 + 150 * l.toxic)::DOUBLE / 1150.0 AS s FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"


def _auc_sql(by: str) -> str:
    part = f"PARTITION BY {by}" if by else ""
    return f"r AS (SELECT *, rank() OVER ({part} ORDER BY s) + (count(*) OVER (PARTITION BY {by + ', ' if by else ''}s) - 1) / 2.0 AS k FROM x), a AS (SELECT {by + ', ' if by else ''}sum(y) AS n_pos, count(*) - sum(y) AS n_neg, CASE WHEN sum(y) > 0 AND sum(y) < count(*) THEN (sum(CASE WHEN y = 1 THEN k ELSE 0 END) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y)::DOUBLE * (count(*) - sum(y))) END AS auroc FROM r {'GROUP BY ' + by if by else ''})"


@query(f"{_SCORED}, {_auc_sql('lang')} SELECT lang, n_pos::BIGINT AS n_pos, n_neg::BIGINT AS n_neg, round(auroc, 9) AS auroc FROM a")
def auroc_by_language(spark: SparkSession, d: str) -> DataFrame:
    return metrics.auroc(_scored(spark, d), "s", "y", ["lang"]).withColumn("auroc", F.round("auroc", 9))


@query(f"{_SCORED}, {_auc_sql('')} SELECT n_pos::BIGINT AS n_pos, n_neg::BIGINT AS n_neg, round(auroc, 9) AS auroc FROM a")
def pooled_auroc(spark: SparkSession, d: str) -> DataFrame:
    return metrics.auroc(_scored(spark, d), "s", "y").withColumn("auroc", F.round("auroc", 9))


@query(f"{_SCORED}, {_auc_sql('source')} SELECT round(avg(auroc), 9) AS macro_auroc, count(auroc) AS n_groups FROM a")
def macro_auroc(spark: SparkSession, d: str) -> DataFrame:
    return metrics.macro_auroc(_scored(spark, d), "s", "y", "source").withColumn("macro_auroc", F.round("macro_auroc", 9))


@query(f"{_SCORED}, t AS (SELECT lang, quantile_cont(s, 0.95) AS t FROM x WHERE y = 0 GROUP BY lang) SELECT x.lang, round(avg(CASE WHEN y = 1 THEN (s >= t)::INTEGER END), 9) AS recall, round(avg(CASE WHEN y = 0 THEN (s >= t)::INTEGER END), 9) AS fpr FROM x JOIN t ON x.lang = t.lang GROUP BY x.lang")
def recall_at_fpr(spark: SparkSession, d: str) -> DataFrame:
    x = _scored(spark, d)
    out = metrics.operating_point(x, metrics.quantile_threshold(x.where("y = 0"), "s", 0.05, ["lang"]), "s", "y", ["lang"], ["lang"])
    return out.select("lang", F.round("recall", 9).alias("recall"), F.round("fpr", 9).alias("fpr"))


_CONSERVATIVE = "SELECT {by}coalesce(min(CASE WHEN f <= {target} THEN s END), nextafter(max(s), 'inf'::DOUBLE)) AS t FROM (SELECT {by}s, (count(*) OVER ({part}ORDER BY s DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))::DOUBLE / count(*) OVER ({whole}) AS f FROM {source}) {group}"


def _conservative_sql(by: str, target: float, source: str) -> str:
    return _CONSERVATIVE.format(by=f"{by}, " if by else "", part=f"PARTITION BY {by} " if by else "", whole=f"PARTITION BY {by}" if by else "", target=target, source=source, group=f"GROUP BY {by}" if by else "")


@query(f"{_SCORED}, n AS (SELECT * FROM x WHERE y = 0), a AS ({_conservative_sql('lang', 0.01, 'n')}), b AS ({_conservative_sql('lang', 0.05, 'n')}) SELECT lang, 0.01::DOUBLE AS target, round(t, 9) AS threshold FROM a UNION ALL SELECT lang, 0.05::DOUBLE, round(t, 9) FROM b")
def training_thresholds(spark: SparkSession, d: str) -> DataFrame:
    neg = _scored(spark, d).where("y = 0")
    parts = [metrics.conservative_threshold(neg, "s", t, ["lang"]).select("lang", F.lit(t).alias("target"), F.round("threshold", 9).alias("threshold")) for t in (0.01, 0.05)]
    return parts[0].unionByName(parts[1])


@query(f"""{_SCORED}, n AS (SELECT * FROM x WHERE y = 0), t AS ({_conservative_sql('', 0.05, 'n')})
SELECT round(t, 9) AS threshold, round(avg(CASE WHEN y = 1 THEN (s >= t)::INTEGER END), 9) AS recall, round(avg(CASE WHEN y = 0 THEN (s >= t)::INTEGER END), 9) AS fpr FROM x CROSS JOIN t GROUP BY t""")
def conservative_operating_point(spark: SparkSession, d: str) -> DataFrame:
    x = _scored(spark, d)
    out = metrics.operating_point(x, metrics.conservative_threshold(x.where("y = 0"), "s", 0.05), "s", "y", [], ["threshold"])
    return out.select(*(F.round(c, 9).alias(c) for c in ("threshold", "recall", "fpr")))


_FOLDS = "g AS (SELECT source, CAST(ntile(5) OVER (ORDER BY sha256('500:' || source)) - 1 AS INTEGER) AS fold FROM (SELECT DISTINCT source FROM documents))"


@query(f"WITH {_FOLDS} SELECT source, fold FROM g")
def question_folds(spark: SparkSession, d: str) -> DataFrame:
    return metrics.folds(table(spark, d, "documents"), "source", 500)


@query(f"""{_SCORED}, {_FOLDS}, xf AS (SELECT x.*, g.fold FROM x JOIN g ON x.source = g.source),
n AS (SELECT f.i::INTEGER AS fold, xf.s FROM xf JOIN range(5) f(i) ON f.i <> xf.fold WHERE xf.y = 0), t AS ({_conservative_sql('fold', 0.05, 'n')})
SELECT round(avg(CASE WHEN y = 1 THEN (s >= t)::INTEGER END), 9) AS recall, round(avg(CASE WHEN y = 0 THEN (s >= t)::INTEGER END), 9) AS fpr FROM xf JOIN t ON xf.fold = t.fold""")
def out_of_fold_point(spark: SparkSession, d: str) -> DataFrame:
    x = _scored(spark, d)
    x = x.join(metrics.folds(table(spark, d, "documents"), "source", 500), "source")
    out = metrics.operating_point(x, metrics.out_of_fold_thresholds(x, "s", "y", 0.05), "s", "y", ["fold"])
    return out.select(F.round("recall", 9).alias("recall"), F.round("fpr", 9).alias("fpr"))


@query(f"""{_SCORED}, {_FOLDS}, xf AS (SELECT x.*, g.fold, x.lang || ':' || g.fold AS k FROM x JOIN g ON x.source = g.source),
n AS (SELECT xf.lang || ':' || f.i AS k, xf.s FROM xf JOIN range(5) f(i) ON f.i <> xf.fold WHERE xf.y = 0), t AS ({_conservative_sql('k', 0.05, 'n')})
SELECT lang, round(avg(CASE WHEN y = 1 THEN (s >= t)::INTEGER END), 9) AS recall, round(avg(CASE WHEN y = 0 THEN (s >= t)::INTEGER END), 9) AS fpr FROM xf JOIN t ON xf.k = t.k GROUP BY lang""")
def language_calibrated_out_of_fold(spark: SparkSession, d: str) -> DataFrame:
    x = _scored(spark, d).join(metrics.folds(table(spark, d, "documents"), "source", 500), "source")
    out = metrics.operating_point(x, metrics.out_of_fold_thresholds(x, "s", "y", 0.05, by=["lang"]), "s", "y", ["fold", "lang"], ["lang"])
    return out.select("lang", F.round("recall", 9).alias("recall"), F.round("fpr", 9).alias("fpr"))


@query(f"""{_SCORED}, c AS (SELECT unnest(['all', 'en', 'even']) AS scope), z AS (SELECT scope, y, s FROM x CROSS JOIN c WHERE CASE scope WHEN 'all' THEN true WHEN 'en' THEN lang = 'en' ELSE y = 0 OR doc_id % 2 = 0 END)
SELECT scope, count(*) AS n, sum(y)::BIGINT AS n_pos, round(avg(s), 9) AS mean, round(avg(CASE WHEN y = 1 THEN s END) - avg(CASE WHEN y = 0 THEN s END), 9) AS gap FROM z GROUP BY scope""")
def scope_metrics(spark: SparkSession, d: str) -> DataFrame:
    """A language scope filters both classes; the others filter positives only."""
    x = _scored(spark, d)
    scopes = F.array_compact(F.array(F.lit("all"), F.when(F.col("lang") == "en", "en"), F.when((F.col("y") == 0) | (F.col("doc_id") % 2 == 0), "even")))
    z = x.select(F.explode(scopes).alias("scope"), "y", "s")
    gap = F.avg(F.when(F.col("y") == 1, F.col("s"))) - F.avg(F.when(F.col("y") == 0, F.col("s")))
    return z.groupBy("scope").agg(F.count("*").alias("n"), F.sum("y").alias("n_pos"), F.round(F.avg("s"), 9).alias("mean"), F.round(gap, 9).alias("gap"))


@query(f"""{_SCORED}, g AS (SELECT source, row_number() OVER (ORDER BY source) - 1 AS k, sum(s) FILTER (y = 1) AS p, sum(y) AS np, sum(s) FILTER (y = 0) AS q, sum(1 - y) AS nq FROM x GROUP BY source), m AS (SELECT count(*) AS n FROM g),
draws AS (SELECT r.i AS replicate, ('0x' || substr(sha256('500:' || r.i || ':' || t.i), 1, 8))::BIGINT % m.n AS k FROM range(200) r(i) CROSS JOIN m CROSS JOIN range(20) t(i) WHERE t.i < m.n),
v AS (SELECT replicate, sum(p) / sum(np) - sum(q) / sum(nq) AS delta FROM draws JOIN g ON draws.k = g.k GROUP BY replicate)
SELECT round(avg(delta), 6) AS mean, round(quantile_cont(delta, 0.025), 6) AS low, round(quantile_cont(delta, 0.975), 6) AS high FROM v""")
def clustered_bootstrap(spark: SparkSession, d: str) -> DataFrame:
    """Interval of the difference of class means, over sources drawn with replacement."""
    by = lambda y: (F.sum(F.when(F.col("y") == y, F.col("s"))), F.count_if(F.col("y") == y))
    (p, np_), (q, nq) = by(1), by(0)
    groups = _scored(spark, d).groupBy("source").agg(p.alias("p"), np_.alias("np"), q.alias("q"), nq.alias("nq"))
    values = metrics.bootstrap(groups, "source", 200, 500, F.sum("p") / F.sum("np") - F.sum("q") / F.sum("nq"))
    return metrics.interval(values, "value").select(*(F.round(c, 6).alias(c) for c in ("mean", "low", "high")))


@query("SELECT event_type, count(value) AS n, round(avg(value), 2) AS mean, min(value) AS min, max(value) AS max FROM events GROUP BY event_type")
def latency_by_model(spark: SparkSession, d: str) -> DataFrame:
    return reports.latency(table(spark, d, "events"), "event_type", "value")


@query("SELECT doc_id::VARCHAR AS doc_id FROM labels WHERE toxic = 1")
def ids_for_label(spark: SparkSession, d: str) -> DataFrame:
    return reports.ids_of(table(spark, d, "labels"), "doc_id", "toxic", 1)


def _two_scores(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id")
    return docs.select("source", "lang", F.col("toxic").alias("y"), ((F.col("n_chars") % 1000 + 150 * F.col("toxic")) / 1150.0).alias("s"), ((F.col("n_chars") % 700 + 200 * F.col("toxic")) / 900.0).alias("t"))


def _drawn_sql(replicates: int) -> str:
    """Scores of _two_scores, groups in the order of a seeded hash, slots of every replicate."""
    return f"""WITH x AS (SELECT d.source, d.lang, l.toxic AS y, (d.n_chars % 1000 + 150 * l.toxic)::DOUBLE / 1150.0 AS s, (d.n_chars % 700 + 200 * l.toxic)::DOUBLE / 900.0 AS t FROM documents d JOIN labels l ON d.doc_id = l.doc_id),
g AS (SELECT source, row_number() OVER (ORDER BY sha256('500:' || source)) - 1 AS k FROM (SELECT DISTINCT source FROM x WHERE source IS NOT NULL)),
n AS (SELECT count(*) AS n FROM g),
dr AS (SELECT r.i AS replicate, q.k AS slot, ('0x' || substr(sha256('500:' || r.i || ':' || q.k), 1, 8))::BIGINT % n.n AS k FROM range({replicates}) r(i) CROSS JOIN g q CROSS JOIN n),
z AS (SELECT dr.replicate, dr.slot, x.* FROM dr JOIN g ON g.k = dr.k JOIN x ON x.source = g.source)"""


def _won_sql(score: str, by: str) -> str:
    """AUROC by ranks of the rows of z."""
    return f"""SELECT {by}, CASE WHEN sum(y) > 0 AND sum(y) < count(*) THEN (sum(CASE WHEN y = 1 THEN k ELSE 0 END) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y)::DOUBLE * (count(*) - sum(y))) END AS a FROM (SELECT {by}, y, rank() OVER (PARTITION BY {by} ORDER BY {score}) + (count(*) OVER (PARTITION BY {by}, {score}) - 1) / 2.0 AS k FROM z) GROUP BY {by}"""


@query(f"""{_drawn_sql(40)}, ps AS ({_won_sql("s", "replicate")}), pt AS ({_won_sql("t", "replicate")}), ms AS (SELECT replicate, avg(a) AS a FROM ({_won_sql("s", "replicate, slot")}) GROUP BY replicate), mt AS (SELECT replicate, avg(a) AS a FROM ({_won_sql("t", "replicate, slot")}) GROUP BY replicate),
v AS (SELECT 'pooled' AS kind, ps.a - pt.a AS v FROM ps JOIN pt ON ps.replicate = pt.replicate UNION ALL SELECT 'macro', ms.a - mt.a FROM ms JOIN mt ON ms.replicate = mt.replicate)
SELECT kind, round(avg(v), 6) AS mean, round(quantile_cont(v, 0.025), 6) AS low, round(quantile_cont(v, 0.975), 6) AS high FROM v GROUP BY kind""")
def bootstrap_auroc_deltas(spark: SparkSession, d: str) -> DataFrame:
    """Intervals of the differences of pooled and macro AUROC of two scores, over sources drawn with replacement."""
    out = resampling.deltas(_two_scores(spark, d), "source", "s", "t", "y", "lang", 40, 500, ["pooled", "macro"])
    return out.select("kind", *(F.round(c, 6).alias(c) for c in ("mean", "low", "high")))


@query(f"""{_drawn_sql(100)}, th AS (SELECT lang, quantile_cont(s, 0.95) AS th FROM x WHERE y = 0 GROUP BY lang),
v AS (SELECT replicate, avg((s >= th)::INTEGER) AS v FROM z JOIN th ON z.lang = th.lang WHERE y = 1 GROUP BY replicate)
SELECT count(*) AS samples, round(avg(v), 6) AS mean, round(quantile_cont(v, 0.025), 6) AS low, round(quantile_cont(v, 0.975), 6) AS high FROM v""")
def bootstrap_recall(spark: SparkSession, d: str) -> DataFrame:
    """Interval of the recall at each language's threshold, over sources drawn with replacement."""
    x = _two_scores(spark, d)
    cut = metrics.quantile_threshold(x.where("y = 0"), "s", 0.05, ["lang"])
    values = resampling.recall_at(x, resampling.draws(x, "source", 100, 500), "source", "s", "y", cut, ["lang"])
    out = metrics.interval(values, "value", "samples")
    return out.select("samples", *(F.round(c, 6).alias(c) for c in ("mean", "low", "high")))


@query()
def bootstrap_point_deltas(spark: SparkSession, d: str) -> DataFrame:
    """Intervals of the differences of the six recalls, over sources drawn with replacement."""
    return resampling.deltas(_two_scores(spark, d), "source", "s", "t", "y", "lang", 20, 500, resampling.KINDS[2:])


@query("SELECT doc_id, round(1.0 / count(*) OVER (PARTITION BY lang, text), 9) AS weight, count(*) OVER (PARTITION BY lang, text) AS group_size FROM documents")
def duplicate_weights(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "lang", T.text_hash(F.col("text")).alias("hash"))
    return dedup.duplicate_weights(docs, ["lang", "hash"]).select("doc_id", F.round("weight", 9).alias("weight"), "group_size")


@query("SELECT doc_id, lang, source FROM (SELECT *, row_number() OVER (PARTITION BY source, lang, text ORDER BY doc_id) AS k FROM documents) WHERE k = 1")
def first_of_duplicates(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "lang", "source", T.text_hash(F.col("text")).alias("hash"))
    return dedup.first_of(docs, ["source", "lang", "hash"], ["doc_id"]).select("doc_id", "lang", "source")


@query("SELECT doc_id FROM (SELECT *, row_number() OVER (PARTITION BY source, lang, substr(text, 1, 80) ORDER BY sha256(doc_id::VARCHAR)) AS k FROM documents) WHERE k = 1")
def first_by_beginning(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "lang", "source", F.substring("text", 1, 80).alias("head"))
    return dedup.first_of(docs, ["source", "lang", "head"], [F.sha2(F.col("doc_id").cast("string"), 256)]).select("doc_id")


@query("SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS k FROM conversations) WHERE k <= 2")
def first_two_per_key(spark: SparkSession, d: str) -> DataFrame:
    return dedup.first_humans(table(spark, d, "conversations"), ["conv_id", "role"], "turn").select("conv_id", "turn", "role")


@query("""WITH s AS (SELECT o_custkey AS doc, (o_orderkey % 97)::BIGINT AS a, (o_orderkey % 97 + o_orderkey % 5)::BIGINT AS b, count(*) AS c FROM orders GROUP BY ALL),
x AS (SELECT *, CASE WHEN max(b) OVER w IS NULL OR a > max(b) OVER w + 1 THEN 1 ELSE 0 END AS n FROM s WINDOW w AS (PARTITION BY doc ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
y AS (SELECT *, sum(n) OVER (PARTITION BY doc ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS i FROM x)
SELECT doc, min(a) AS a, max(b) AS b, sum(c)::BIGINT AS n_parts FROM y GROUP BY doc, i""")
def fused_spans(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    s = table(spark, d, "orders").select(F.col("o_custkey").alias("doc"), (k % 97).alias("a"), (k % 97 + k % 5).alias("b"))
    return dedup.fused_spans(s, "doc", "a", "b")


@query("SELECT lang, source, grouping(lang) * 2 + grouping(source) AS level, count(*) AS n, count(DISTINCT text) AS n_distinct FROM documents GROUP BY GROUPING SETS ((), (lang), (source), (lang, source))")
def coverage_report(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("lang", "source", T.text_hash(F.col("text")).alias("hash"))
    return reports.coverage(docs, ["lang", "source"], "hash").withColumn("level", F.col("level").cast("long"))


@query("SELECT lang, count(*) AS total, count_if(n_chars >= 500)::BIGINT AS eligible, (count(*) - count_if(n_chars >= 500))::BIGINT AS excluded, round(100.0 * count_if(n_chars >= 500) / count(*), 6) AS eligible_percent FROM documents GROUP BY lang")
def eligibility_breakdown(spark: SparkSession, d: str) -> DataFrame:
    return reports.breakdown(table(spark, d, "documents"), "lang", F.col("n_chars") >= 500).withColumn("eligible_percent", F.round("eligible_percent", 6))


@query("SELECT o_orderpriority, count_if(o_orderstatus = 'F')::BIGINT AS o_orderstatus_F, count_if(o_orderstatus = 'O')::BIGINT AS o_orderstatus_O, count_if(o_orderstatus = 'P')::BIGINT AS o_orderstatus_P FROM orders GROUP BY o_orderpriority")
def crosstab(spark: SparkSession, d: str) -> DataFrame:
    return reports.crosstab(table(spark, d, "orders"), "o_orderpriority", "o_orderstatus", ["F", "O", "P"])


@query("SELECT user_id, count(DISTINCT event_type) AS n_splits FROM events WHERE value > 50 GROUP BY user_id HAVING count(DISTINCT event_type) > 1")
def users_across_splits(spark: SparkSession, d: str) -> DataFrame:
    return reports.straddling(table(spark, d, "events").where("value > 50"), "user_id", "event_type")


@query("WITH g AS (SELECT text, count(DISTINCT doc_id % 3) AS s, count(*) AS n FROM documents GROUP BY text) SELECT count(*) AS n_keys, count_if(s > 1)::BIGINT AS n_straddling, coalesce(sum(n) FILTER (s > 1), 0)::BIGINT AS n_rows_straddling FROM g")
def leakage_report(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select((F.col("doc_id") % 3).alias("split"), T.text_hash(F.col("text")).alias("hash"))
    return reports.leakage(docs, "hash", "split")


@query("WITH p AS (SELECT lang, source FROM (SELECT DISTINCT lang FROM documents) CROSS JOIN (SELECT DISTINCT source FROM documents)) SELECT p.lang, count_if(NOT EXISTS (SELECT 1 FROM documents d WHERE d.lang = p.lang AND d.source = p.source AND d.n_chars > 8000))::BIGINT AS n FROM p GROUP BY p.lang")
def excluded_pairs(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    plan = routing.plan_units(docs.select("lang").distinct(), docs.select("source").distinct())
    return reports.excluded_pairs(plan, docs.where("n_chars > 8000"), ["lang", "source"], "lang")


@query("WITH s(o_orderstatus) AS (VALUES ('F'), ('O'), ('P'), ('X')) SELECT s.o_orderstatus, count(o.o_orderkey) AS n, round_even(count(o.o_orderkey)::DOUBLE / (SELECT count(*) FROM orders), 4) AS rate FROM s LEFT JOIN orders o ON o.o_orderstatus = s.o_orderstatus GROUP BY 1")
def routing_rates(spark: SparkSession, d: str) -> DataFrame:
    return reports.routing_rates(table(spark, d, "orders"), "o_orderstatus", ["F", "O", "P", "X"])


@query("SELECT size, count(*) AS n_clusters FROM (SELECT count(*) AS size FROM documents GROUP BY lang, source) GROUP BY size")
def cluster_size_histogram(spark: SparkSession, d: str) -> DataFrame:
    return reports.cluster_size_histogram(table(spark, d, "documents"), ["lang", "source"])


@query("SELECT c_mktsegment, sum(o_orderkey % 1000)::BIGINT AS tokens, round(sum(o_orderkey % 1000) / 1e6 * CASE WHEN c_mktsegment = 'BUILDING' THEN 0.5 ELSE 0.18 END, 9) AS cost FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY c_mktsegment")
def projected_cost(spark: SparkSession, d: str) -> DataFrame:
    units = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("c_custkey") == F.col("o_custkey")).select("c_mktsegment", (F.col("o_orderkey") % 1000).alias("t"))
    rates = spark.createDataFrame([("BUILDING", 0.5)], "c_mktsegment string, rate double")
    return reports.projected_cost(units, rates, "c_mktsegment", "t", 0.18).withColumn("cost", F.round("cost", 9))


@query("SELECT split_part(p_type, ' ', 1) AS reason, count(*) AS n FROM part GROUP BY 1")
def reject_reasons(spark: SparkSession, d: str) -> DataFrame:
    return reports.reject_reasons(table(spark, d, "part").select(F.replace("p_type", F.lit(" "), F.lit(":")).alias("why")), "why")


def _decided(spark: SparkSession, d: str, votes: DataFrame) -> DataFrame:
    k = F.col("c_custkey")
    records = table(spark, d, "customer").select(k.alias("user_id"), (F.col("c_acctbal") >= -500).alias("raw"), F.when((k % 120 < 60) & (k % 7 == 0), 10).otherwise(100).alias("tokens"))
    return consensus.decide(records, votes, "user_id", F.col("raw"), F.col("tokens")).drop("raw", "tokens")


_VOTES = "v AS (SELECT user_id, CASE WHEN event_type NOT IN ('click', 'view', 'purchase', 'signup') OR user_id % 11 = 4 THEN 'error' WHEN user_id % 11 IN (1, 2) THEN 'human' WHEN user_id % 11 = 3 THEN 'ai' WHEN event_type IN ('click', 'view') THEN 'human' WHEN event_type = 'purchase' THEN 'ai' ELSE 'mixed' END AS verdict, CASE WHEN user_id % 11 = 5 AND event_id % 50 > 0 THEN NULL WHEN user_id % 11 IN (1, 2) THEN 85.0 + event_id % 5 WHEN user_id % 11 = 3 THEN event_id % 15 + 0.0 WHEN event_type IN ('click', 'view') THEN 84.0 + event_id % 5 WHEN event_type = 'purchase' THEN event_id % 17 + 0.0 WHEN event_type = 'signup' THEN 50.0 END AS p FROM events)"


@query(f"""WITH {_VOTES}, s AS (SELECT user_id, count_if(verdict <> 'error' AND p IS NOT NULL) AS n, count_if(verdict = 'error') AS e, bool_and(verdict = 'human' AND p >= 85) FILTER (verdict <> 'error' AND p IS NOT NULL) AS h, bool_and(verdict = 'ai' AND 100 - p >= 85) FILTER (verdict <> 'error' AND p IS NOT NULL) AS a FROM v GROUP BY user_id),
r AS (SELECT c.c_custkey AS user_id, coalesce(s.n, 0) AS n, coalesce(s.e, 0) AS e, h, a, CASE WHEN c_acctbal < -500 THEN 'raw_missing' WHEN c_custkey % 120 < 60 AND c_custkey % 7 = 0 THEN 'too_short' WHEN coalesce(s.n, 0) = 0 AND coalesce(s.e, 0) > 0 THEN 'detector_error' WHEN coalesce(s.n, 0) = 0 THEN 'no_votes' WHEN s.n < 2 THEN 'too_few_votes' END AS reason FROM customer c LEFT JOIN s ON s.user_id = c.c_custkey)
SELECT user_id, n::BIGINT AS n_responding, e::BIGINT AS n_errors, CASE WHEN reason = 'too_few_votes' THEN 'unsure' WHEN reason IS NOT NULL THEN 'skipped' WHEN h THEN 'human' WHEN a THEN 'ai' ELSE 'unsure' END AS label, reason FROM r""")
def detector_consensus(spark: SparkSession, d: str) -> DataFrame:
    """Every event is a vote; a few users' detectors agree, err or are silent."""
    kind, i, g = F.col("event_type"), F.col("event_id"), F.col("user_id") % 11
    known = F.coalesce(kind.isin("click", "view", "purchase", "signup"), F.lit(False))
    verdict = F.when(~known | (g == 4), "error").when(g.isin(1, 2), "human").when(g == 3, "ai").when(kind.isin("click", "view"), "human").when(kind == "purchase", "ai").otherwise("mixed")
    p = F.when((g == 5) & (i % 50 > 0), F.lit(None)).when(g.isin(1, 2), 85.0 + i % 5).when(g == 3, (i % 15).cast("double")).when(kind.isin("click", "view"), 84.0 + i % 5).when(kind == "purchase", (i % 17).cast("double")).when(kind == "signup", F.lit(50.0))
    return _decided(spark, d, table(spark, d, "events").select("user_id", verdict.alias("verdict"), p.alias("human_probability")))


@query("""WITH s AS (SELECT lang || '|' || source AS stratum, count(*) AS size FROM documents GROUP BY 1), t AS (SELECT sum(size)::BIGINT AS n FROM s), w AS (SELECT least(100, n) AS w FROM t),
b AS (SELECT stratum, size, (size * w.w) // t.n AS base, (size * w.w) % t.n AS rest FROM s, t, w), k AS (SELECT *, row_number() OVER (ORDER BY (base < size) DESC, rest DESC, stratum DESC) AS k, (SELECT w FROM w) - sum(base) OVER () AS l FROM b)
SELECT stratum, size, (base + CASE WHEN k <= l AND base < size THEN 1 ELSE 0 END)::BIGINT AS quota FROM k""")
def stratum_quotas(spark: SparkSession, d: str) -> DataFrame:
    strata = table(spark, d, "documents").groupBy(F.concat_ws("|", "lang", "source").alias("stratum")).agg(F.count("*").alias("size"))
    return sampling.stratum_quotas(strata, "stratum", "size", 100)


@query("""WITH s AS (SELECT lang || '|' || source AS stratum, count(*) AS size FROM documents GROUP BY 1), t AS (SELECT sum(size)::BIGINT AS n FROM s), w AS (SELECT least(100, n) AS w FROM t),
b AS (SELECT stratum, size, (size * w.w) // t.n AS base, (size * w.w) % t.n AS rest FROM s, t, w), k AS (SELECT *, row_number() OVER (ORDER BY (base < size) DESC, rest DESC, stratum DESC) AS k, (SELECT w FROM w) - sum(base) OVER () AS l FROM b),
q AS (SELECT stratum, base + CASE WHEN k <= l AND base < size THEN 1 ELSE 0 END AS quota FROM k),
r AS (SELECT doc_id, lang, source, row_number() OVER (PARTITION BY lang || '|' || source ORDER BY CASE WHEN n_chars % 9 >= 6 THEN 0 WHEN n_chars % 9 >= 3 THEN 1 ELSE 2 END, n_chars % 9 DESC, sha256('500:' || doc_id), doc_id) AS k, lang || '|' || source AS stratum FROM documents)
SELECT doc_id, lang, source FROM r JOIN q ON r.stratum = q.stratum WHERE r.k <= q.quota""")
def stratified_selection(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "lang", "source", (F.col("n_chars") % 9).alias("coverage"))
    return sampling.stratified(docs, "doc_id", ["lang", "source"], 100, 500, scoring.coverage_bucket(F.col("coverage")), "coverage").select("doc_id", "lang", "source")


@query("SELECT doc_id, lang, CASE WHEN k < n // 3 THEN 'low' WHEN k < 2 * n // 3 THEN 'mid' ELSE 'high' END AS band FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY n_chars, doc_id) - 1 AS k, count(*) OVER (PARTITION BY lang) AS n FROM documents)")
def tertile_bands(spark: SparkSession, d: str) -> DataFrame:
    return sampling.tertile_bands(table(spark, d, "documents").select("doc_id", "lang", "n_chars"), "lang", "n_chars", "doc_id").select("doc_id", "lang", "band")


@query("SELECT doc_id, lang, source FROM (SELECT *, row_number() OVER (PARTITION BY lang, source ORDER BY sha256('200:' || doc_id), doc_id) AS k FROM documents) WHERE k <= 3")
def fill_floors(spark: SparkSession, d: str) -> DataFrame:
    return sampling.fill_floors(table(spark, d, "documents").select("doc_id", "lang", "source"), ["lang", "source"], 3, 200, "doc_id")


@query("""WITH a AS (SELECT doc_id, lang, n_chars, substr(sha256(doc_id::VARCHAR), 1, 12) AS f FROM documents), b AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n_chars, f) AS lo FROM a), c AS (SELECT *, row_number() OVER (PARTITION BY lang, lo <= 5 ORDER BY n_chars DESC, f) AS hi FROM b)
SELECT doc_id, lang, CASE WHEN lo <= 5 THEN 'lowest' ELSE 'highest' END AS extreme, CAST(CASE WHEN lo <= 5 THEN lo ELSE hi END AS INTEGER) AS rank FROM c WHERE lo <= 5 OR hi <= 5""")
def extreme_samples(spark: SparkSession, d: str) -> DataFrame:
    return sampling.extremes(table(spark, d, "documents").select("doc_id", "lang", "n_chars"), "lang", "n_chars", "doc_id").select("doc_id", "lang", "extreme", "rank")


@query("SELECT c_custkey, ('0x' || substr(sha256(c_name || ':' || c_mktsegment), 1, 16))::UBIGINT::DECIMAL(20, 0)::VARCHAR AS seed, substr(sha256(c_custkey::VARCHAR), 1, 12) AS fingerprint FROM customer")
def assignment_seeds(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select("c_custkey", sampling.assignment_seed(F.col("c_name"), F.col("c_mktsegment")).cast("string").alias("seed"), T.fingerprint(F.col("c_custkey")).alias("fingerprint"))


@query("SELECT place::INTEGER AS place, doc_id, n_chars FROM documents JOIN (VALUES (0, 17), (1, 3), (2, 101)) t(place, i) ON doc_id = i")
def samples_in_order(spark: SparkSession, d: str) -> DataFrame:
    return sampling.in_given_order(table(spark, d, "documents").select("doc_id", "n_chars"), "doc_id", [17, 3, 101])


@query()
def capped_review_batch(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").where(F.col("lang").isin("en", "de")).select("doc_id", "lang", "source", "n_chars")
    banded = sampling.tertile_bands(docs, "lang", "n_chars", "doc_id")
    return sampling.capped_batch(banded, "doc_id", 15042, 150, "lang", "de", 75, ["lang", "source"], 3, "band", 12).select("doc_id", "lang", "source", "band", "phase")


@query("SELECT DISTINCT label FROM embeddings WHERE vec_id % 2 = 0 INTERSECT SELECT DISTINCT label FROM embeddings WHERE vec_id % 2 <> 0")
def bank_intersection(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    return banks.shared_keys(e.where("vec_id % 2 = 0"), e.where("vec_id % 2 <> 0"), ["label"])


@query("""WITH kept AS (SELECT doc_id, lang, text FROM documents WHERE doc_id % 2 = 0 AND source <> 'src5'), new AS (SELECT lang, text, min(doc_id) AS doc_id FROM documents WHERE doc_id % 2 = 1 GROUP BY lang, text)
SELECT doc_id, lang FROM kept UNION ALL SELECT doc_id, lang FROM new WHERE NOT EXISTS (SELECT 1 FROM kept WHERE kept.lang = new.lang AND kept.text = new.text)""")
def bank_swap(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "lang", "source", T.text_hash(F.col("text")).alias("hash"))
    incoming = dedup.first_of(docs.where("doc_id % 2 = 1"), ["lang", "hash"], ["doc_id"])
    return banks.swap(docs.where("doc_id % 2 = 0"), incoming, ["lang"], "hash", F.col("source") == "src5").select("doc_id", "lang")


@query("""WITH x AS (SELECT lang, source, text, n_chars % 7 AS place FROM documents WHERE n_chars % 7 < 4 AND trim(text) <> ''), one AS (SELECT lang, source, place, min(sha256(text)) AS text FROM x GROUP BY ALL),
d AS (SELECT lang, source, text, min(place) AS place FROM one GROUP BY ALL), c AS (SELECT *, count(*) OVER (PARTITION BY lang, source) AS n FROM d)
SELECT lang, source, text AS hash, CAST(row_number() OVER (PARTITION BY lang, source ORDER BY place) - 1 AS INTEGER) AS vector_id FROM c WHERE n BETWEEN 2 AND 10""")
def bank_build(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("lang", "source", T.text_hash(F.col("text")).alias("hash"), (F.col("n_chars") % 7).cast("string").alias("kind"))
    return banks.collect_references(docs, ["lang", "source"], "hash", "kind", ["0", "1", "2", "3"], 2, 10).select("lang", "source", "hash", "vector_id")


@query("SELECT user_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS k FROM events) WHERE k = 1")
def last_label_wins(spark: SparkSession, d: str) -> DataFrame:
    from lumenframe.sources.readers import last_labels

    return last_labels(table(spark, d, "events"), "user_id", "event_id").select("user_id", "event_type", "value")


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 0 THEN 'UNSURE' ELSE o_orderstatus END AS label FROM orders")
def label_upsert(spark: SparkSession, d: str) -> DataFrame:
    from lumenframe.sources.sinks import upserted

    old = table(spark, d, "orders").select("o_orderkey", F.col("o_orderstatus").alias("label"))
    return upserted(old, old.where("o_orderkey % 10 = 0").withColumn("label", F.lit("UNSURE")), "o_orderkey")


@query("SELECT event_id, json_extract_string(props, '$.k')::BIGINT AS k, coalesce(json_extract_string(props, '$.absent'), json_extract_string(props, '$.k')) AS first_of FROM events")
def json_fields(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"), F.coalesce(F.get_json_object("props", "$.absent"), F.get_json_object("props", "$.k")).alias("first_of"))


@query(f"""SELECT page_id, regexp_matches(html, '{T.MAIN_PATTERN}') AS has_main, regexp_matches(html, '{T.INPUT_PATTERN}') AS reads_input, regexp_matches(html, '{T.OUTPUT_PATTERN}') AS writes_output, regexp_extract(html, 'lang="([a-z]+)"', 1) AS lang FROM pages""")
def logic_flags(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", T.detect_logic(F.col("html")).alias("f"), F.regexp_extract("html", 'lang="([a-z]+)"', 1).alias("lang")).select("page_id", "f.*", "lang")


@query()
def pattern_excerpts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", T.excerpt(F.col("html"), "<title>[^<]*").alias("excerpt")).where("excerpt is not null")


@query(r"SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(text, '[ \t]+(\n|$)', '\1', 'g'), '^\n+|\n+$', '', 'g'), '\n{3,}', chr(10) || chr(10), 'g') AS text FROM documents")
def light_normalisation(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", T.normalised_lightly(F.col("text")).alias("text"))


@query()
def name_tokens(spark: SparkSession, d: str) -> DataFrame:
    named = table(spark, d, "part").select("p_partkey", F.concat(F.lit("partName_"), F.replace("p_name", F.lit(" "), F.lit("_"))).alias("name"))
    return named.select("p_partkey", F.array_join(T.name_tokens(F.col("name")), " ").alias("tokens"), T.is_descriptive(F.col("name")).alias("descriptive"))


@query("SELECT conv_id, turn, len(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '')) AS n_lines, len(regexp_extract_all(lower(text), '[a-z]+')) >= 5 AS wordy FROM conversations")
def content_lines(spark: SparkSession, d: str) -> DataFrame:
    words = F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))
    return table(spark, d, "conversations").select("conv_id", "turn", F.size(T.content_lines(F.col("text"))).cast("long").alias("n_lines"), (F.size(words) >= 5).alias("wordy"))


@query("""SELECT vec_id, 'Match with generated references: ' || CASE WHEN vec_id % 101 >= 50 THEN 'high' WHEN vec_id % 101 >= 25 THEN 'medium' ELSE 'low' END || ' (' || vec_id % 101 || '%)' ||
' Shared structure: ' || CASE WHEN vec_id % 4 = 0 THEN 'No close reference was found.' WHEN vec_id % 4 = 1 THEN 'No shared block of lines.' ELSE 'Shared block at reference lines ' || vec_id % 10 || '-' || (vec_id % 10 + 3) || '.' END ||
' Known approaches: ' || CASE WHEN vec_id % 3 = 0 THEN 'Few distinct approaches are known for this question.' ELSE 'Many distinct approaches are known for this question.' END || ' Scoring: Scored.' ||
CASE WHEN vec_id % 5 = 0 THEN ' Naming: Most local names are descriptive.' ELSE '' END || ' This is a similarity signal for review, not a verdict.' AS card FROM embeddings""")
def explanation_cards(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("vec_id")
    start = F.when(i % 4 > 1, i % 10)
    card = explain.scored_card(i % 101, i % 4 != 0, start, start + 3, F.when(i % 3 == 0, 0.01).otherwise(0.5), F.lit("scored"), i % 5 == 0)
    return table(spark, d, "embeddings").select("vec_id", explain.formatted(card).alias("card"))


@query("SELECT doc_id, lang, CASE WHEN n_chars < 300 THEN 'Not scored' ELSE 'Scored' END AS headline, CASE WHEN n_chars < 300 THEN 'too little code' WHEN n_chars < 600 THEN 'short code' END AS reason FROM documents")
def plain_status(spark: SparkSession, d: str) -> DataFrame:
    status = F.when(F.col("n_chars") < 300, "insufficient_evidence").when(F.col("n_chars") < 600, "low_confidence_short").otherwise("scored")
    return table(spark, d, "documents").select("doc_id", "lang", explain.plain_status(status).alias("s")).select("doc_id", "lang", "s.*")


@query()
def code_features(spark: SparkSession, d: str) -> DataFrame:
    """Parser-backed features; the tables hold prose, so this runs the failure path over whole texts."""
    from lumenframe.functions import code as C

    c = table(spark, d, "conversations").select("conv_id", "turn", "text", F.lit("PYTHON").alias("language"))
    return c.select("conv_id", "turn", C.parses_udf("text", "language").alias("parses"), C.token_count_udf("text", "language").alias("tokens"))
