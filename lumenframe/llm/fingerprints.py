"""Document fingerprints: threshold-scaled sketches of word shingles, in Spark expressions.

A shingle's hash is the first 16 hex digits of the MD5 of its five words (A-Z lower-cased,
a space between them). A sketch keeps every hash below a fixed fraction of the hash range,
1/8, whatever the length of the text, and never fewer than the FLOOR least ones, so short
texts are told apart too. The bound of a sketch is the fraction, the last hash kept, or
nothing where all are kept. Below the smaller of two bounds both sketches are complete, so
any two can be compared there, merged by union, and give containment estimates however
unequal the texts.

Defined results: null texts are empty; texts without words have an empty sketch, alike
(1) only to each other; fewer than five words make one shingle; a text is alike to itself
by 1. neighbours() takes rows in descending id, equal ids by a hash of the text, null ids
last; one row alone is its own next; an empty table gives no rows; input columns other
than the id and text don't pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenframe.llm.common import WORD_SPACE, table
from lumenframe.llm.spans import let

SHINGLE = 5
#: Hashes that begin below this digit of 0-9a-f are kept: two of sixteen.
FRACTION = "2"
FLOOR = 64
#: A bound above every hash.
EVERYTHING = "g"
#: Rows of a range of ids, on average; ranges at most (a row each on the driver and broadcast), and parts that a range is cut into at once.
RANGE_ROWS = 1000
MOST_RANGES = 1 << 17
PARTS = 1 << 12
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    return F.filter(F.split(F.translate(text, _UPPER, _LOWER), WORD_SPACE + "+"), lambda w: w != "")


def _hash(said: Column) -> Column:
    return F.substring(F.md5(said.cast("binary")), 1, 16)


def sketch(text: Column, floor: int = FLOOR) -> Column:
    """struct(bound string, hashes array<string>): hashes ascending, without repeats, all below the bound."""

    def of(ws: Column) -> Column:
        n = F.size(ws)
        shingles = F.transform(F.sequence(F.lit(0), F.greatest(n - SHINGLE, F.lit(0))), lambda i: _hash(F.concat_ws(" ", *(F.get(ws, i + j) for j in range(SHINGLE)))))
        return F.array_distinct(F.when(n >= SHINGLE, shingles).when(n > 0, F.array(_hash(F.concat_ws(" ", ws)))).otherwise(F.array().cast("array<string>")))

    def scaled(every: Column) -> Column:
        low = F.filter(every, lambda h: h < FRACTION)
        below = lambda x: F.struct(F.lit(FRACTION).alias("bound"), F.array_sort(x).alias("hashes"))
        least = lambda x: let(F.slice(F.array_sort(x), 1, floor), lambda k: F.struct(F.concat(F.element_at(k, -1), F.lit("~")).alias("bound"), k.alias("hashes")))
        whole = F.struct(F.lit(EVERYTHING).alias("bound"), F.array_sort(every).alias("hashes"))
        return let(low, lambda x: F.when(F.size(every) <= floor, whole).when(F.size(x) >= floor, below(x)).otherwise(least(every)))

    return let(let(words(text), of), scaled)


def _below(s: Column, bound: Column) -> Column:
    return F.when(s["bound"] <= bound, s["hashes"]).otherwise(F.filter(s["hashes"], lambda h: h < bound))


def _shared(a: Column, b: Column, use) -> Column:  # noqa: ANN001
    both = let(F.least(a["bound"], b["bound"]), lambda bound: F.struct(_below(a, bound).alias("a"), _below(b, bound).alias("b")))
    return let(both, lambda p: let(F.size(F.array_intersect(p["a"], p["b"])), lambda n: use(n, F.size(p["a"]), F.size(p["b"]))))


def likeness(a: Column, b: Column) -> Column:
    """Estimated resemblance of two sketches' texts, 0 to 1."""
    return _shared(a, b, lambda n, x, y: F.when(x + y > 0, n / (x + y - n)).otherwise(F.lit(1.0))).cast("double")


def containment(a: Column, b: Column) -> Column:
    """Estimated share of a's shingles that b has, 0 to 1; 0 where nothing of a is left to tell."""
    return _shared(a, b, lambda n, x, y: F.when(x > 0, n / x).otherwise(F.lit(0.0))).cast("double")


def merge(a: Column, b: Column) -> Column:
    """The sketch of both texts' shingles, up to the smaller bound."""
    return let(F.least(a["bound"], b["bound"]), lambda bound: F.struct(bound.alias("bound"), F.array_sort(F.array_union(_below(a, bound), _below(b, bound))).alias("hashes")))


def as_string(s: Column) -> Column:
    """w (whole), f (the fraction) or l (the least), and the hashes."""
    kind = F.when(s["bound"] == EVERYTHING, "w:").when(s["bound"] == FRACTION, "f:").otherwise("l:")
    return F.concat(kind, F.array_join(s["hashes"], ""))


def id_ranges(ids: DataFrame, most: int) -> tuple[DataFrame, list[tuple[int, int]]]:
    """ids (with a column __id) with __range, and (range, largest id) from the last range down.

    A range with too many rows is cut into parts of equal width between its own ends, and
    its parts again, so ids that lie far apart or close together end in ranges of like size.
    Only counts by range reach the driver, MOST_RANGES at most."""
    spark = ids.sparkSession
    low, high, n = ids.agg(F.min("__id"), F.max("__id"), F.count("*")).first()
    now = ids.withColumn("__range", F.lit(0).cast("long"))
    leaves, big, used = {0: (low, high, n)}, {0: (low, high, n)}, 1
    limit = max(most, n // (MOST_RANGES // 4))
    if not n:
        return now, []
    while big := {r: x for r, x in big.items() if x[2] > 2 * limit and x[0] < x[1]}:
        rows = []
        for r, (lo, hi, count) in big.items():
            parts = min(max(2, count // limit), PARTS, hi - lo + 1, max(2, (MOST_RANGES - used) // len(big)))
            rows.append((r, lo, -(-(hi - lo + 1) // parts), used))
            used += parts
        if 0 in big:  # the first round cuts the one range that holds all rows, so it needs no join
            _, lo, width, first = rows[0]
            now = now.withColumn("__range", F.expr(f"{first}L + (__id - ({lo}L)) div {width}L"))
        else:
            cuts = F.broadcast(spark.createDataFrame(rows, "__range long, __lo long, __width long, __first long"))  # MOST_RANGES rows at most
            cut = F.expr("__first + (__id - __lo) div __width")
            now = now.join(cuts, "__range", "left").withColumn("__range", F.coalesce(cut, F.col("__range"))).drop("__lo", "__width", "__first")
        firsts = min(r[3] for r in rows)
        found = {r["__range"]: (r["lo"], r["hi"], r["n"]) for r in now.where(F.col("__range") >= firsts).groupBy("__range").agg(F.min("__id").alias("lo"), F.max("__id").alias("hi"), F.count("*").alias("n")).collect()}
        for r in big:
            del leaves[r]
        leaves |= found
        big = found if used + 2 <= MOST_RANGES else {}
    return now, sorted(((r, x[1]) for r, x in leaves.items()), key=lambda t: -t[1])


def neighbours(docs: DataFrame, columns: list[str], range_rows: int = RANGE_ROWS) -> DataFrame:
    """docs (doc_id, columns) with next_<column> of the next row in descending doc_id; after the last comes the first.

    Rows are dealt by ranges of the id, each ordered for itself; the first row of each range
    is also sent to the range before it."""
    spark = docs.sparkSession
    low = docs.agg(F.min("doc_id")).first()[0]
    if low is None:
        low = 0
    with_id = lambda d: d.withColumn("__id", F.coalesce("doc_id", F.lit(low - 1)))  # noqa: E731  null ids stand below all
    ranked, tops = id_ranges(with_id(docs), range_rows)
    ghosts = [(top, tops[i - 1][0]) for i, (_, top) in enumerate(tops)]
    sent = F.broadcast(spark.createDataFrame(ghosts, "__id long, __to long"))  # MOST_RANGES rows at most
    here = F.struct(F.col("__range").alias("r"), F.lit(0).alias("ghost"))
    there = F.struct(F.col("__to").alias("r"), F.lit(1).alias("ghost"))
    dealt = ranked.join(sent, "__id", "left").withColumn("__place", F.explode(F.when(F.col("__to").isNull(), F.array(here)).otherwise(F.array(here, there))))
    order = Window.partitionBy("__place.r").orderBy(F.col("__place.ghost"), F.col("__id").desc(), F.col("__tie"))
    out = dealt.withColumns({f"next_{c}": F.lead(c).over(order) for c in columns})
    return out.where(F.col("__place.ghost") == 0).select("doc_id", *columns, *(f"next_{c}" for c in columns))


def edited_text(text: Column, next_text: Column) -> Column:
    """The last half of text, rounded down, replaced by as much of next_text."""
    half = F.floor(F.length(text) / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.length(text) - half), F.substring(next_text, F.lit(1), half))


def compare(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text, of its edited text, and likenesses to that and to the next document."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    own = own.withColumn("sketch", sketch(F.col("text"))).withColumn("__tie", F.xxhash64("text"))
    pairs = neighbours(own, ["text", "sketch"])
    made = pairs.withColumn("edited", edited_text(F.col("text"), F.col("next_text")))
    row = F.struct("doc_id", F.length("text").cast("long").alias("n_chars"), "sketch", "next_sketch", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), sketch(F.col("edited")).alias("edited_sketch"))
    done = made.select(F.explode(F.array(row)).alias("r")).select("r.*")  # the row is evaluated once
    return done.select(
        "doc_id", "n_chars", "edited_sha256",
        as_string(F.col("sketch")).alias("fingerprint"), as_string(F.col("edited_sketch")).alias("edited_fingerprint"),
        likeness(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"), likeness(F.col("sketch"), F.col("next_sketch")).alias("near_next"),
        containment(F.col("sketch"), F.col("edited_sketch")).alias("contained_in_edited"),
    )


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare(table(spark, sf_dir, "documents"))


def _sql() -> str:
    def of(text: str) -> str:
        """The shingle hashes of a text, sorted."""
        ws = f"list_filter(regexp_split_to_array(translate({text}, '{_UPPER}', '{_LOWER}'), '{WORD_SPACE}+'), lambda x: x <> '')"
        shingles = f"CASE WHEN len(w) >= {SHINGLE} THEN list_transform(range(1, len(w) - {SHINGLE - 2}), lambda i: left(md5(array_to_string(w[i:i + {SHINGLE - 1}], ' ')), 16)) WHEN len(w) > 0 THEN [left(md5(array_to_string(w, ' ')), 16)] ELSE [] END"
        return f"(SELECT list_sort(list_distinct({shingles})) FROM (SELECT {ws} AS w))"

    def kept(x: str) -> str:
        """Its bound and hashes, as a struct."""
        low = f"list_filter({x}, lambda h: h < '{FRACTION}')"
        return f"CASE WHEN len({x}) <= {FLOOR} THEN {{'bound': '{EVERYTHING}', 'hashes': {x}}} WHEN len({low}) >= {FLOOR} THEN {{'bound': '{FRACTION}', 'hashes': {low}}} ELSE {{'bound': {x}[{FLOOR}] || '~', 'hashes': {x}[1:{FLOOR}]}} END"

    said = lambda s: f"CASE {s}.bound WHEN '{EVERYTHING}' THEN 'w:' WHEN '{FRACTION}' THEN 'f:' ELSE 'l:' END || array_to_string({s}.hashes, '')"
    below = lambda s, t: f"list_filter({s}.hashes, lambda h: h < least({s}.bound, {t}.bound))"
    shared = lambda s, t: f"len(list_intersect({below(s, t)}, {below(t, s)}))"
    union = lambda s, t: f"(len({below(s, t)}) + len({below(t, s)}) - {shared(s, t)})"
    like = lambda s, t: f"CASE WHEN {union(s, t)} = 0 THEN 1.0::DOUBLE ELSE {shared(s, t)}::DOUBLE / {union(s, t)} END"
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
n AS (SELECT doc_id, t, coalesce(lead(t) OVER (ORDER BY doc_id DESC), first_value(t) OVER (ORDER BY doc_id DESC)) AS nt FROM d),
e AS (SELECT doc_id, t, nt, left(t, length(t) - length(t) // 2) || CASE WHEN length(t) >= 2 THEN left(nt, length(t) // 2) ELSE '' END AS et FROM n),
h AS (SELECT doc_id, t, et, {of("t")} AS x, {of("nt")} AS nx, {of("et")} AS ex FROM e),
k AS (SELECT doc_id, t, et, {kept("x")} AS s, {kept("nx")} AS ns, {kept("ex")} AS es FROM h)
SELECT doc_id, length(t)::BIGINT AS n_chars, sha256(et) AS edited_sha256, {said("s")} AS fingerprint, {said("es")} AS edited_fingerprint,
  {like("s", "es")} AS near_edited, {like("s", "ns")} AS near_next,
  CASE WHEN len({below("s", "es")}) = 0 THEN 0.0::DOUBLE ELSE {shared("s", "es")}::DOUBLE / len({below("s", "es")}) END AS contained_in_edited FROM k"""


SQL = _sql()
