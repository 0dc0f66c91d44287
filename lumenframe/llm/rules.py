"""Quality rules: ordered decision lists learned from labelled statistics.

Sequential covering: each rule is a conjunction of thresholds, grown by information gain
on two thirds of the labelled rows and pruned on the other third; a rule stays while it is
precise there, then the rows that it covers leave and the next is grown. The list becomes
one ordered Spark conditional expression over columns of statistics.

Defined results: a null or empty text has no words and fails the base; labels that are
null are ignored, an id with several labels counts as bad if most of them are; without
labels of both kinds the list is empty and the base decides; repeated rows are judged each
for itself; further input columns don't pass through statistics().
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe.llm.common import beside_text, table, write_scratch
from lumenframe.llm.textblock import mix64, word_hashes

#: Labelled rows that the list is fitted on, at most about this many, taken by a hash of the id.
FIT_ROWS = 20_000
SYMBOLS = b"#*$%&|<>"

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_digits", "n_letters", "n_marks"]
FEATURES = ["n_words", "mean_word", "symbol_share", "dup_line_share", "repeat_share", "upper_share", "digit_share", "mark_share", "line_words"]


def _repeat_words(h: np.ndarray) -> int:
    """Words that stand in three-word windows found twice or more."""
    if len(h) < 4:
        return 0
    w = mix64(h[:-2] * np.uint64(0x9E3779B97F4A7C15) + mix64(h[1:-1] + np.uint64(1)) * np.uint64(3) + mix64(h[2:] + np.uint64(2)) * np.uint64(7))
    order = np.argsort(w)
    s = w[order]
    same = s[1:] == s[:-1]
    if not same.any():
        return 0
    twice = np.zeros(len(s), bool)
    twice[1:] |= same
    twice[:-1] |= same
    cover = np.zeros(len(h), bool)
    at = order[twice]
    cover[at] = cover[at + 1] = cover[at + 2] = True
    return int(cover.sum())


def text_counts(texts: list[str | None]) -> dict[str, np.ndarray]:
    """COUNTS of each text."""
    data = [(t or "").encode() for t in texts]
    hashes, per = word_hashes(data)
    ends = np.cumsum(per)
    out = {c: np.zeros(len(texts), np.int64) for c in COUNTS}
    out["n_words"][:] = per
    for i, b in enumerate(data):
        if not b:
            continue
        hist = np.bincount(np.frombuffer(b, np.uint8), minlength=256)
        space = hist[9:14].sum() + hist[32]
        out["word_chars"][i] = hist[:128].sum() + hist[192:].sum() - space
        out["n_symbols"][i] = sum(hist[c] for c in SYMBOLS)
        out["n_upper"][i] = hist[65:91].sum()
        out["n_letters"][i] = hist[65:91].sum() + hist[97:123].sum() + hist[192:].sum()
        out["n_digits"][i] = hist[48:58].sum()
        out["n_marks"][i] = hist[33] + hist[63]
        lines = [x for x in b.split(b"\n") if x.strip()]
        out["n_lines"][i] = len(lines)
        out["n_dup_lines"][i] = len(lines) - len(set(lines))
        out["n_repeat_words"][i] = _repeat_words(hashes[ends[i] - per[i] : ends[i]])
    return out


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and COUNTS of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = text_counts(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(got[c]) for c in COUNTS)], ["doc_id", *COUNTS])

    schema = "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def features(prefix: str = "") -> dict[str, Column]:
    """FEATURES from COUNTS, whose column names begin with prefix."""
    col = lambda name: F.col(prefix + name)
    share = lambda a, b: F.when(col(b) > 0, col(a) / col(b)).otherwise(F.lit(0.0)).cast("double")
    return {
        "n_words": col("n_words").cast("double"),
        "mean_word": share("word_chars", "n_words"),
        "symbol_share": share("n_symbols", "word_chars"),
        "dup_line_share": share("n_dup_lines", "n_lines"),
        "repeat_share": share("n_repeat_words", "n_words"),
        "upper_share": share("n_upper", "n_letters"),
        "digit_share": share("n_digits", "word_chars"),
        "mark_share": share("n_marks", "word_chars"),
        "line_words": share("n_words", "n_lines"),
    }


@dataclass
class Rule:
    """feature >= value or feature < value, all of them."""

    conditions: list[tuple[str, str, float]] = field(default_factory=list)
    covered: int = 0
    precision: float = 0.0

    def mask(self, x: dict[str, np.ndarray], n: int) -> np.ndarray:
        m = np.ones(n, bool)
        for name, op, value in self.conditions:
            m &= x[name] >= value if op == ">=" else x[name] < value
        return m

    def column(self, columns: dict[str, Column]) -> Column:
        c = F.lit(True)
        for name, op, value in self.conditions:
            c = c & (columns[name] >= F.lit(value) if op == ">=" else columns[name] < F.lit(value))
        return c

    def __str__(self) -> str:
        return " and ".join(f"{n} {o} {v:.6g}" for n, o, v in self.conditions)


def _grow(x: dict[str, np.ndarray], bad: np.ndarray, cuts: int, longest: int) -> Rule:
    rule, inside = Rule(), np.ones(len(bad), bool)
    while len(rule.conditions) < longest:
        p0, n0 = (bad & inside).sum(), (~bad & inside).sum()
        if not n0 or not p0:
            break
        best, gain = None, 1e-9
        for name, v in x.items():
            mine = v[inside]
            points = np.unique(np.quantile(mine, np.linspace(0, 1, cuts + 1)[1:]))
            values = np.sort(mine[bad[inside]]), np.sort(mine[~bad[inside]])
            below = [np.searchsorted(a, points) for a in values]
            for op, p, n in (("<", below[0], below[1]), (">=", p0 - below[0], n0 - below[1])):
                with np.errstate(divide="ignore", invalid="ignore"):
                    g = np.where(p > 0, p * (np.log2(p / (p + n)) - math.log2(p0 / (p0 + n0))), -1.0)
                k = int(g.argmax())
                if g[k] > gain:
                    gain, best = g[k], (name, op, float(points[k]))
        if best is None:
            break
        rule.conditions.append(best)
        inside = rule.mask(x, len(bad))
    return rule


def learn(x: dict[str, np.ndarray], bad: np.ndarray, fold: np.ndarray, precision: float = 0.9, most: int = 12, cuts: int = 64, longest: int = 4, least: int = 5) -> list[Rule]:
    """Rules for bad rows, in order. fold: 0 and 1 grow, 2 prunes."""
    rules: list[Rule] = []
    alive = np.ones(len(bad), bool)
    while len(rules) < most:
        g, p = alive & (fold < 2), alive & (fold == 2)
        if (bad & g).sum() < least or (~bad & g).sum() < 1:
            break
        rule = _grow({k: v[g] for k, v in x.items()}, bad[g], cuts, longest)
        if not rule.conditions:
            break
        xp, bp = {k: v[p] for k, v in x.items()}, bad[p]

        def worth(k: int, rule: Rule = rule, xp: dict = xp, bp: np.ndarray = bp) -> float:
            m = Rule(rule.conditions[:k]).mask(xp, len(bp))
            return (bp[m].sum() - (~bp[m]).sum()) / max(1, m.sum())

        keep = max(range(1, len(rule.conditions) + 1), key=lambda k: (worth(k), -k))
        rule.conditions = rule.conditions[:keep]
        on_prune, on_all = rule.mask(xp, len(bp)), rule.mask(x, len(bad)) & alive
        right = bp[on_prune].sum() / max(1, on_prune.sum())
        rule.covered, rule.precision = int(on_all.sum()), float(bad[on_all].mean()) if on_all.any() else 0.0
        if on_prune.sum() < 1 or right < precision or rule.precision < precision or rule.covered < least:
            break
        rules.append(rule)
        alive &= ~on_all
    return rules


def base_failed(prefix: str = "") -> Column:
    words, repeats = F.col(prefix + "n_words"), F.col(prefix + "n_repeat_words")
    return (words < 50) | (100 * repeats > 50 * words)


def labelled(labels: DataFrame, label_col: str = "quality", fit_rows: int = FIT_ROWS) -> DataFrame:
    """(doc_id, bad, fold) of at most about fit_rows labelled ids, chosen by a hash of the id."""
    known = labels.where(F.col(label_col).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg((F.avg(label_col) < 0.5).alias("bad"))
    part = min(1.0, fit_rows / max(1, known.count()))
    spread = F.pmod(F.xxhash64(F.lit(3), "doc_id"), F.lit(1 << 20))
    return known.where(spread < int(part * (1 << 20)) + 1).withColumn("fold", F.pmod(F.xxhash64(F.lit(4), "doc_id"), F.lit(3)))


def fit(stats: DataFrame, chosen: DataFrame) -> list[Rule]:
    """The list for rows that pass the base, from the labelled ones (chosen, see labelled())."""
    columns = features()
    rows = stats.where(~base_failed()).join(F.broadcast(chosen), "doc_id").dropDuplicates(["doc_id"])
    got = rows.select("bad", "fold", *(c.alias(n) for n, c in columns.items())).toPandas()
    got = got.sort_values(list(got.columns), kind="stable")
    bad = got["bad"].to_numpy(bool)
    if not bad.any() or bad.all():
        return []
    return learn({n: got[n].to_numpy(float) for n in columns}, bad, got["fold"].to_numpy())


def verdict(rules: list[Rule], prefix: str = "") -> Column:
    """The number of the first rule that holds, from 1; 0 where none does."""
    columns = features(prefix)
    out = None
    for i, rule in enumerate(rules, 1):
        out = F.when(rule.column(columns), F.lit(i)) if out is None else out.when(rule.column(columns), F.lit(i))
    return F.lit(0) if out is None else out.otherwise(F.lit(0))


def keep(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """The rows of docs that pass the base and the list, as they are."""
    chosen = labelled(labels, fit_rows=fit_rows)
    rules = fit(statistics(docs.join(F.broadcast(chosen.select("doc_id")), "doc_id", "left_semi")), chosen)  # fit_rows ids
    fields = ", ".join(f"{c}: long" for c in COUNTS)
    marked = beside_text(docs, "__stats", fields, lambda: text_counts)
    good = ~base_failed("__stats.") & (verdict(rules, "__stats.") == 0)
    return marked.where(good).drop("__stats")


def judge(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """Statistics, base_failed, rule (0: none) and kept for each document."""
    stats, _ = write_scratch(statistics(docs), "quality")
    rules = fit(stats, labelled(labels, fit_rows=fit_rows))
    out = stats.withColumn("base_failed", base_failed()).withColumn("rule", verdict(rules))
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("rule") == 0))


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")
