"""Secret scans with corpus-wide ownership frequency, in Spark expressions.

Base spans come from three patterns. Further candidates come from formats of well-known
issuers and from long mixed strings; these are guesses, and how the corpus shares them
decides: a value that many repositories and owners hold is a copied example, one that a
few hold looks live. Candidates of the second kind become added spans; base spans always
stay. Hashes are counted by distinct repository and owner first, so a value that fills a
third of the corpus is a row for each owner before it is counted.

Defined results: null texts are empty and have no spans; repeated rows each come back;
null repositories and owners count as one of their own; an empty table gives no rows;
further input columns don't pass through scan(), whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe.llm.common import join_spread, table, write_scratch
from lumenframe.llm.spans import let, matches

#: A value held by at most so many owners, and repositories, looks live.
MOST_OWNERS = 2
ASSIGN = r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+"""
#: The value at the end of an ASSIGN match.
ASSIGN_VALUE = r"^[^:=]*?[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)$"
# A run is the longest there is, so the least length can stand in the pattern.
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
#: Formats of issued credentials. The first part of a token is bounded, so that many beginnings in one run cost little.
ISSUED = r"gh[pousr]_[A-Za-z0-9]{36,}|xox[abprs]-[A-Za-z0-9-]{10,}|AIza[A-Za-z0-9_-]{35}|eyJ[A-Za-z0-9_-]{8,900}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}|sk_(?:live|test)_[A-Za-z0-9]{16,}"
#: Runs of 32 or more that mix capitals, small letters and digits.
MIXED = r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z0-9+/_-]*[0-9])(?=[A-Za-z0-9+/_-]*[a-z])(?=[A-Za-z0-9+/_-]*[A-Z])[A-Za-z0-9+/_-]{32,}"
KINDS = ["assign", "access", "hex", "issued", "mixed"]
_SPAN = "array<struct<start:int,kind:int,end:int,hash:string>>"


def _kind(text: Column, number: int, pattern: str) -> Column:
    """struct(start, kind, end, hash of the value)."""
    found = matches(text, pattern)
    if number == 0:
        value = lambda m: F.regexp_extract(m["value"], ASSIGN_VALUE, 1)
        found = F.filter(found, lambda m: F.length(value(m)) >= 6)
    else:
        value = lambda m: m["value"]
    return F.transform(found, lambda m: F.struct(m["start"].alias("start"), F.lit(number).alias("kind"), m["end"].alias("end"), F.sha2(value(m).cast("binary"), 256).alias("hash"))).cast(_SPAN)


def candidates(docs: DataFrame, text_col: str = "text", repo_col: str = "source", owner_col: str = "source") -> DataFrame:
    """doc_id, repo, owner, base and extra spans of every whole text."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    one = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(repo_col).cast("string").alias("repo"), F.col(owner_col).cast("string").alias("owner"), text.alias("__t"))
    base = F.concat(_kind(F.col("__t"), 0, ASSIGN), _kind(F.col("__t"), 1, ACCESS), _kind(F.col("__t"), 2, HEX))
    extra = F.concat(_kind(F.col("__t"), 3, ISSUED), _kind(F.col("__t"), 4, MIXED))
    return one.select("doc_id", "repo", "owner", F.array_sort(base).alias("base"), F.array_sort(extra).alias("extra"))


def ownership(found: DataFrame) -> DataFrame:
    """hash, repos, owners, uses: over all candidates."""
    each = found.select("repo", "owner", F.explode(F.concat("base", "extra")).alias("s"))
    pairs = each.groupBy(F.col("s.hash").alias("hash"), F.coalesce("repo", F.lit("\x01")).alias("repo"), F.coalesce("owner", F.lit("\x01")).alias("owner")).agg(F.count("*").alias("n"))
    repos = pairs.groupBy("hash", "repo").agg(F.sum("n").alias("n")).groupBy("hash").agg(F.count("*").alias("repos"), F.sum("n").alias("uses"))
    owners = pairs.select("hash", "owner").distinct().groupBy("hash").agg(F.count("*").alias("owners"))
    return repos.join(owners, "hash")


def scan(docs: DataFrame, most_owners: int = MOST_OWNERS, **columns: str) -> DataFrame:
    """Candidates with `spans`: array of struct(start, kind, end, hash, live), base ones all, others where they look live."""
    found, _ = write_scratch(candidates(docs, **columns).withColumn("uid", F.monotonically_increasing_id()), "secrets")
    owned, _ = write_scratch(ownership(found), "owned")
    live = owned.select("hash", ((F.col("owners") <= most_owners) & (F.col("repos") <= most_owners)).alias("live"))
    each = found.select("uid", F.explode(F.concat("base", "extra")).alias("s")).select("uid", "s.*")
    judged = join_spread(each, live, ["hash"], owned, "uses", ["uid", "start"]).where((F.col("kind") < 3) | F.col("live"))
    spans = judged.groupBy("uid").agg(F.array_sort(F.collect_list(F.struct("start", "kind", "end", "hash", "live"))).alias("spans"))  # of one text
    none = F.array().cast("array<struct<start:int,kind:int,end:int,hash:string,live:boolean>>")
    return found.join(spans, "uid", "left").withColumn("spans", F.coalesce("spans", none))


def joined(spans: Column) -> Column:
    """kind:start:end of each, comma-joined."""
    names = F.array(*(F.lit(k) for k in KINDS))
    return let(names, lambda k: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(k, s["kind"]), s["start"], s["end"])), ","))


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scan(table(spark, sf_dir, "documents"))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return out.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(joined(F.col("base")).cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"),
        F.size(F.filter("spans", lambda s: s["live"])).cast("long").alias("n_live"), F.size(F.filter("spans", lambda s: ~s["live"])).cast("long").alias("n_copied"),
    )


def _sql() -> str:
    """The same spans in SQL: what look-around asks of a mixed run is asked of the whole run."""
    patterns = [ASSIGN, ACCESS, HEX, ISSUED, "[A-Za-z0-9+/_-]{32,}"]
    quoted = ["'" + p.replace("'", "''") + "'" for p in patterns]
    parts = " UNION ALL ".join(f"SELECT rid, source, {k} AS kind, regexp_extract_all(t, {q}) AS ms, string_split_regex(t, {q}) AS gaps FROM docs WHERE regexp_matches(t, {q})" for k, q in enumerate(quoted))
    value = "'^[^:=]*?[:=]\\x20*[\"'']?([A-Za-z0-9+/_.=-]+)$'"
    names = "CASE kind " + " ".join(f"WHEN {k} THEN '{n}'" for k, n in enumerate(KINDS)) + " END"
    return f"""
WITH docs AS (SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS t FROM documents),
lists AS ({parts}),
each AS (SELECT rid, source, kind, m, g + coalesce(p, 0) AS start FROM (
  SELECT rid, source, kind, unnest(ms) AS m, generate_subscripts(ms, 1) AS i,
    unnest(list_transform(range(1, len(ms) + 1), lambda i: list_sum(list_transform(gaps[1:i], lambda x: length(x))))) AS g,
    unnest(list_transform(range(1, len(ms) + 1), lambda i: list_sum(list_transform(ms[1:i - 1], lambda x: length(x))))) AS p FROM lists)),
valued AS (SELECT *, CASE kind WHEN 0 THEN regexp_extract(m, {value}, 1) ELSE m END AS v FROM each),
kept AS (SELECT rid, source, kind, start::BIGINT AS start, (start + length(m))::BIGINT AS stop, sha256(v) AS h FROM valued
  WHERE (kind <> 0 OR length(v) >= 6) AND (kind <> 4 OR (regexp_matches(m, '[0-9]') AND regexp_matches(m, '[a-z]') AND regexp_matches(m, '[A-Z]')))),
owned AS (SELECT h, count(DISTINCT coalesce(source, chr(1))) <= {MOST_OWNERS} AS live FROM kept GROUP BY h),
judged AS (SELECT kept.*, live, {names} || ':' || start || ':' || stop AS said FROM kept JOIN owned USING (h)),
summed AS (SELECT rid, count(*) FILTER (kind = 0) AS a, count(*) FILTER (kind = 1) AS c, count(*) FILTER (kind = 2) AS x,
  string_agg(said, ',' ORDER BY start, kind) FILTER (kind < 3) AS base, string_agg(said, ',' ORDER BY start, kind) FILTER (kind < 3 OR live) AS spans,
  count(*) FILTER (live) AS live, count(*) FILTER (kind < 3 AND NOT live) AS copied FROM judged GROUP BY rid)
SELECT doc_id, coalesce(a, 0)::BIGINT AS n_assign, coalesce(c, 0)::BIGINT AS n_access, coalesce(x, 0)::BIGINT AS n_hex, sha256(coalesce(base, '')) AS base_sha256,
  coalesce(spans, '') AS spans, coalesce(live, 0)::BIGINT AS n_live, coalesce(copied, 0)::BIGINT AS n_copied FROM docs LEFT JOIN summed USING (rid)"""


SQL = _sql()
