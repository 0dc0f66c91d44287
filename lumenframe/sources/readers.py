"""Readers. Schemas are given, not inferred; positions are made explicit, as row order isn't one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenframe.functions.text import cache_key, split_group_key


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def missing_files(spark: SparkSession, folder: str, names: list[str]) -> list[str]:
    """Names that the folder doesn't have, seen by the file system that Spark reads from."""
    jvm = spark.sparkContext._jvm
    lost = []
    for name in names:
        p = jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
        if not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
            lost.append(name)
    return lost


def tag_names(tags: Column) -> Column:
    """Names of a JSON array whose items are strings or {name}; empty ones go."""
    items = F.from_json(tags, "array<string>")
    names = F.transform(items, lambda x: F.coalesce(F.get_json_object(x, "$.name"), F.when(~x.startswith("{"), x)))
    return F.filter(names, lambda x: x.isNotNull() & (x != ""))


def primary_tag(tags: Column) -> Column:
    return F.coalesce(F.get(F.filter(tags, lambda x: x.startswith("TOPIC_")), F.lit(0)), F.lit("UNTAGGED"))


def questions(spark: SparkSession, path: str) -> DataFrame:
    """A JSON object keyed by question id."""
    raw = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "map<string,string>")).alias("question_id", "body"))
    field = lambda *paths: F.coalesce(*(F.get_json_object("body", p) for p in paths))
    tags = tag_names(field("$.tags", "$.metadata.tags"))
    cpp = field("$.function_completion.CPP", "$.languages.CPP.function_completion").cast("boolean")
    py = field("$.function_completion.PYTHON39", "$.function_completion.PYTHON", "$.languages.PYTHON.function_completion").cast("boolean")
    boiler = F.map_filter(F.create_map(F.lit("CPP"), _code("$.boilerplates.CPP", "$.boilerplates.cpp"), F.lit("PYTHON"), _code("$.boilerplates.PYTHON39", "$.boilerplates.PYTHON", "$.boilerplates.python")), lambda k, v: v.isNotNull())
    return raw.select("question_id", F.upper(field("$.difficulty", "$.metadata.difficulty")).alias("difficulty"), tags.alias("tags"), primary_tag(tags).alias("primary_tag"), (F.coalesce(cpp, F.lit(False)) & F.coalesce(py, F.lit(False))).alias("is_function_completion"), field("$.statement", "$.statement_content").alias("statement_content"), boiler.alias("boilerplates"))


def _code(*paths: str) -> Column:
    """The first boilerplate that isn't blank: a string, or {code_content}."""
    values = []
    for p in paths:
        v = F.get_json_object("body", p)
        code = F.coalesce(F.get_json_object(v, "$.code_content"), F.when(~F.ltrim(v).startswith("{"), v))
        values.append(F.when(F.trim(code) != "", code))
    return F.coalesce(*values)


def submissions(spark: SparkSession, path: str) -> DataFrame:
    """A JSON object of lists keyed `question:language`, with the place of each record in its list."""
    groups = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "map<string,array<struct<raw_code:string,code:string,user_id:string>>>")).alias("key", "records"))
    each = groups.where(F.size("records") > 0).select(split_group_key(F.col("key")).alias("k"), F.posexplode("records").alias("group_index", "r"))
    return each.select("k.question_id", "k.language", "group_index", "r.*")


def submission_counts(records: DataFrame) -> DataFrame:
    return records.groupBy("question_id").agg(F.count("*").alias("n_submissions"))


SOLUTION = "question_id string, language string, raw_code string, stripped_code string, parse_ok boolean, generator string, persona string"


def solutions(spark: SparkSession, folder: str) -> DataFrame:
    """All JSON files below a folder, with their paths for order and with is_valid."""
    raw = spark.read.schema(SOLUTION).option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").json(folder)
    valid = F.coalesce("parse_ok", F.lit(False)) & (F.trim(F.coalesce("stripped_code", F.lit(""))) != "")
    return raw.select("*", F.col("_metadata.file_path").alias("path"), valid.alias("is_valid"))


def bank(spark: SparkSession, folder: str) -> DataFrame:
    """Long-form vectors (question_id, language, vector_id, embedding, stripped_hash)."""
    return spark.read.parquet(folder)


def jsonl(spark: SparkSession, path: str | list[str], schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def manual_votes(spark: SparkSession, path: str) -> DataFrame:
    """Votes of a CSV file with a header; rows whose verdict isn't one are dropped."""
    schema = "opaque_id string, record_id string, detector_name string, verdict string, human_probability string, notes string"
    return spark.read.schema(schema).option("header", True).csv(path).where(F.col("verdict").isin("human", "ai", "mixed", "error"))


def last_labels(lines: DataFrame, key: str, position: str) -> DataFrame:
    """The last line of each record."""
    whole = F.struct(*lines.columns)
    return lines.groupBy(key).agg(F.max_by(whole, position).alias("r")).select("r.*")


def review_blocks(spark: SparkSession, path: str) -> DataFrame:
    """Blocks between lines of equal signs: KEY: value lines, a blank line, code."""
    parts = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", r"(?m)^={4,}\s*$")).alias("block", "text")).where(F.trim("text") != "")
    head, code = F.regexp_extract("text", r"(?s)^\s*(.*?)(?:\n\s*\n|$)", 1), F.regexp_extract("text", r"(?s)^\s*.*?\n\s*\n(.*)$", 1)
    pairs = F.filter(F.transform(F.split(head, "\n"), lambda x: F.struct(F.trim(F.regexp_extract(x, "^([^:]+):", 1)).alias("k"), F.trim(F.regexp_extract(x, "^[^:]+:(.*)$", 1)).alias("v"))), lambda s: s["k"] != "")
    return parts.select("block", F.map_from_entries(pairs).alias("fields"), F.regexp_replace(code, r"\s+$", "").alias("code"))


def cached_vectors(texts: DataFrame, cache: DataFrame, text: str, model: str) -> DataFrame:
    """texts with the vector kept for (model, text), null if there is none."""
    addressed = texts.withColumn("cache_key", cache_key(F.lit(model), F.col(text)))
    return addressed.join(cache.select("cache_key", "embedding"), "cache_key", "left")


def require_vectors(rows: DataFrame) -> DataFrame:
    if not rows.where(F.col("embedding").isNull()).isEmpty():
        raise LookupError("a text has no vector in the cache")
    return rows


def queue_position(items: DataFrame, labels: DataFrame, key: str, position: str) -> DataFrame:
    """next: the first place without a label, else the last place."""
    open_ = items.join(labels.select(key).distinct(), key, "left_anti")
    return items.agg(F.max(position).alias("last")).crossJoin(open_.agg(F.min(position).alias("first"))).select(F.coalesce("first", "last").alias("next"))


def with_position(items: DataFrame, order: list[str | Column], name: str = "order_index") -> DataFrame:
    """A short queue numbered from 0."""
    return items.withColumn(name, F.row_number().over(Window.orderBy(*order)) - 1)
