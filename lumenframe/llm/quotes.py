"""Quotation linking: conversations in reply order, without quotes, in Spark expressions.

Each line of a message has a quote level (its leading `>` marks). Level 0 lines are its
own words. Quoted lines are normalised (marks and outer spaces gone, inner space single,
A-Z lower-cased) and hashed; the original of a line is the first message of the
conversation that has it among its own lines. Of its shallowest quotes, a message answers
the original that most lines point to, then the latest. Messages that answer nothing
begin threads; a thread's messages follow its first one, in turn order, so every reply
stands after what it answers. Thread and depth come from pointer doubling, so a chain of
n replies takes log2(n) rounds.

Hot lines are reduced to their first turn by a partial aggregate before anything is
joined; no join pairs uses of a line with each other.

Defined results: null texts are empty; a quote without an original leaves its message
unlinked, and is dropped from the text all the same; a message can't answer itself or a
later turn; rows that repeat (conv_id, turn) count as one message when links are made,
and each comes back; rows without conv_id or turn come back unlinked; an empty table gives
no rows; further columns don't pass through link().
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe.llm.common import drop_scratch, table, write_scratch
from lumenframe.llm.spans import let

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Leading quote marks, each maybe with spaces before it; one class, as a repeated group would need stack for each mark.
MARKS = r"^[\x20\t>]*>"


def lines(text: Column) -> Column:
    """array<struct(level, body)> of a text's lines."""

    def one(line: Column) -> Column:
        marks = F.regexp_extract(line, MARKS, 0)
        return F.struct(F.length(F.regexp_replace(marks, "[^>]", "")).alias("level"), F.substring(line, F.length(marks) + 1, F.length(line)).alias("body"))

    return F.transform(F.split(text, "\r?\n"), one)


def normalised(body: Column) -> Column:
    return F.trim(F.regexp_replace(F.translate(body, _UPPER, _LOWER), r"[\x20\x09-\x0D]+", " "))


def passages(parsed: Column, quoted: bool) -> Column:
    """array<struct(level, hash)> of the lines with words, own or quoted ones."""
    kept = F.filter(parsed, lambda x: (x["level"] > 0) if quoted else (x["level"] == 0))
    hashed = F.transform(kept, lambda x: let(normalised(x["body"]), lambda b: F.struct(x["level"].alias("level"), F.when(b != "", F.xxhash64(b)).alias("hash"))))
    return F.filter(hashed, lambda x: x["hash"].isNotNull())


def unquoted(parsed: Column) -> Column:
    """The own lines; line breaks that only surrounded quotes go."""
    own = F.array_join(F.transform(F.filter(parsed, lambda x: x["level"] == 0), lambda x: x["body"]), "\n")
    has = F.exists(parsed, lambda x: x["level"] > 0)
    return F.when(has, F.btrim(own, F.lit("\n"))).otherwise(own)


def link(messages: DataFrame) -> DataFrame:
    """conv_id, turn, role, text (own words), parent_turn, thread_turn, depth, n_quoted of messages (conv_id, turn, role, text).

    Reply order within a conversation: thread_turn, turn."""
    spark = messages.sparkSession
    parsed = messages.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role"), F.coalesce("text", F.lit("")).alias("__t"))
    parsed = parsed.select("conv_id", "turn", "role", "__t", lines(F.col("__t")).alias("__l"))
    parts = parsed.select("conv_id", "turn", "role", "__t", unquoted(F.col("__l")).alias("own"), passages(F.col("__l"), False).alias("said"), passages(F.col("__l"), True).alias("quoted"))
    known = parts.where("conv_id is not null and turn is not null")
    quoted = known.where(F.size("quoted") > 0).select("conv_id", "turn", F.explode("quoted").alias("q")).select("conv_id", "turn", "q.level", "q.hash")
    quoted, quoted_path = write_scratch(quoted.groupBy("conv_id", "turn", "level", "hash").agg(F.count("*").alias("n")), "quoted")
    wanted = quoted.select("conv_id", "hash").distinct()
    firsts = known.select("conv_id", "turn", F.explode("said.hash").alias("hash")).groupBy("conv_id", "hash").agg(F.min("turn").alias("origin")).join(wanted, ["conv_id", "hash"], "left_semi")
    votes = quoted.join(firsts, ["conv_id", "hash"]).where("origin < turn").groupBy("conv_id", "turn", "level", "origin").agg(F.sum("n").alias("n"))
    parents = votes.groupBy("conv_id", "turn").agg(F.max(F.struct((-F.col("level")).alias("l"), "n", "origin"))["origin"].alias("parent_turn"))
    parents, parents_path = write_scratch(parents, "parents")

    # depth counts the steps to `root`; links double until every root answers nothing
    now, path = write_scratch(parents.select("conv_id", "turn", F.col("parent_turn").alias("root"), F.lit(1).cast("long").alias("depth")), "threads")
    while True:
        up = now.select("conv_id", F.col("turn").alias("root"), F.col("root").alias("__r"), F.col("depth").alias("__d"))
        moved = now.join(up, ["conv_id", "root"], "left")
        new, new_path = write_scratch(moved.select("conv_id", "turn", F.coalesce("__r", "root").alias("root"), (F.col("depth") + F.coalesce("__d", F.lit(0))).alias("depth"), F.col("__r").isNotNull().alias("moved")), "threads")
        drop_scratch(spark, path)
        now, path = new.drop("moved"), new_path
        if new.where("moved").isEmpty():
            break
    found = parents.join(now, ["conv_id", "turn"])
    out = parts.join(found, ["conv_id", "turn"], "left")
    return out.select("conv_id", "turn", "role", F.col("own").alias("text"), "parent_turn", F.coalesce("root", "turn").alias("thread_turn"), F.coalesce("depth", F.lit(0).cast("long")).alias("depth"), F.size("quoted").cast("long").alias("n_quoted"))


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link(table(spark, sf_dir, "conversations"))


SQL = r"""
WITH RECURSIVE lines AS (
  SELECT conv_id, turn, i, regexp_extract(line, '^(?:[\x20\t]*>)+') AS marks, line
  FROM (SELECT conv_id, turn, unnest(regexp_split_to_array(coalesce(text, ''), '\r?\n')) AS line, generate_subscripts(regexp_split_to_array(coalesce(text, ''), '\r?\n'), 1) AS i FROM conversations)),
parsed AS (
  SELECT conv_id, turn, i, length(regexp_replace(marks, '[^>]', '', 'g')) AS level, substr(line, length(marks) + 1) AS body,
    trim(regexp_replace(translate(substr(line, length(marks) + 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+', ' ', 'g'), ' ') AS norm
  FROM lines),
firsts AS (SELECT conv_id, norm, min(turn) AS origin FROM parsed WHERE level = 0 AND norm <> '' GROUP BY ALL),
votes AS (
  SELECT q.conv_id, q.turn, q.level, f.origin, count(*) AS n
  FROM parsed q JOIN firsts f ON q.conv_id = f.conv_id AND q.norm = f.norm
  WHERE q.level > 0 AND q.norm <> '' AND f.origin < q.turn GROUP BY ALL),
parents AS (
  SELECT conv_id, turn, origin AS parent_turn
  FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY level, n DESC, origin DESC) AS k FROM votes) WHERE k = 1),
threads AS (
  SELECT conv_id, turn, turn AS thread_turn, 0 AS depth FROM (SELECT DISTINCT conv_id, turn FROM conversations) m
  WHERE NOT EXISTS (SELECT 1 FROM parents p WHERE p.conv_id = m.conv_id AND p.turn = m.turn)
  UNION ALL
  SELECT p.conv_id, p.turn, t.thread_turn, t.depth + 1 FROM parents p JOIN threads t ON p.conv_id = t.conv_id AND p.parent_turn = t.turn),
own AS (
  SELECT conv_id, turn, coalesce(string_agg(body, chr(10) ORDER BY i) FILTER (level = 0), '') AS own, count(*) FILTER (level > 0 AND norm <> '') AS n_quoted, bool_or(level > 0) AS has
  FROM parsed GROUP BY ALL)
SELECT m.conv_id, m.turn, m.role, CASE WHEN has THEN regexp_replace(own, '^\n+|\n+$', '', 'g') ELSE own END AS text,
  p.parent_turn, t.thread_turn, CAST(t.depth AS BIGINT) AS depth, CAST(o.n_quoted AS BIGINT) AS n_quoted
FROM conversations m JOIN own o ON m.conv_id = o.conv_id AND m.turn = o.turn
JOIN threads t ON m.conv_id = t.conv_id AND m.turn = t.turn
LEFT JOIN parents p ON m.conv_id = p.conv_id AND m.turn = p.turn
"""
