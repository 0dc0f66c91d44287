"""Toxicity by weak supervision.

Many voters look at a text: fixed lexicons of insults by language, lexicons of words and
word beginnings that stand out in labelled toxic texts (each voter has its own share of
them), counts and densities of all of these, and surface patterns. Voters say toxic, clean
or nothing. A generative label model estimates, by expectation maximisation over labelled
and unlabelled rows, how each voter votes given the class, and how votes are correlated
within a class; correlated voters share their weight. The given label is a voter too, whose
errors are estimated like the others', and says nothing of unlabelled rows. A logistic model
over the lexicon entries and summary counts is then trained on the posterior labels and
scores every text.

The sample is counted, voted on and turned into features where it is: the driver gets counts
of word forms and a sparse row for each text, never texts.

Defined results: null and empty texts are scored like any text without hits; labels that
are null are ignored, several labels of an id count by majority; rows that repeat a sampled
id teach once, by their least text; without labelled rows the fixed lexicons alone vote; ids
that are null count as held out; rows with equal text get equal scores.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe.llm.common import drop_scratch, id_fold, table, write_scratch

#: Labelled texts of each class, and unlabelled ones, to fit on, at most about this many; of any length.
FIT_TEXTS = 2000
MOST_ENTRIES = 1500
#: A form becomes an entry if so many labelled toxic texts have it, with this lift and this root of the likelihood ratio.
LEAST_TEXTS, LEAST_LIFT, LEAST_Z = 4, 2.0, 5.0
#: What an unlabelled row counts against a labelled one.
UNLABELLED_WEIGHT = 0.2
SHARES = 12
#: Lengths of word beginnings that may become entries.
BEGINNINGS = (4, 5, 6, 7)
MOST_WORDS = 500_000
_LETTERS = re.compile(r"[^\W\d_]+")

# Common insults, by language.
LEXICONS = {
    "en": "idiot idiots moron morons stupid dumb loser losers trash garbage scum pathetic worthless disgusting clown clowns fool imbecile jerk bastard bitch asshole fuck fucking shit crap retard slut whore pig vermin filth hate kill ugly creep coward liar",
    "de": "idiot dumm blöd arschloch scheiße wichser hure fotze abschaum dreck schlampe trottel versager missgeburt hurensohn",
    "fr": "idiot imbécile connard connasse salope pute merde débile crétin abruti ordure déchet enculé bâtard",
    "es": "idiota imbécil estúpido estúpida mierda puta puto cabrón basura asqueroso asquerosa gilipollas pendejo zorra maricón escoria",
}


def _forms(chunk: str) -> list[str]:
    """The letter runs of a chunk and their beginnings, as entry names."""
    out = []
    for w in _LETTERS.findall(chunk):
        out.append(w + "$")
        out += [w[:k] for k in BEGINNINGS if len(w) >= k]
    return out


def _bag(text: str | None) -> Counter:
    return Counter((text or "").lower().split())


class Entries:
    """Lexicon entries; hits of each in a text."""

    def __init__(self, names: list[str]) -> None:
        self.names = names
        self.index = {n: i for i, n in enumerate(names)}
        self.known: dict[str, tuple[int, ...]] = {}

    def hits(self, bag: Counter) -> tuple[dict[int, int], int, int]:
        """Hits by entry, words with a hit, words."""
        known, index = self.known, self.index
        if len(known) > MOST_WORDS:
            known.clear()
        found: dict[int, int] = {}
        any_, words = 0, 0
        for chunk, n in bag.items():
            at = known.get(chunk)
            if at is None:
                at = known[chunk] = tuple({index[f] for f in _forms(chunk) if f in index})
            words += n
            if at:
                any_ += n
                for i in at:
                    found[i] = found.get(i, 0) + n
        return found, any_, words


def _distinct_forms(text: str | None) -> set[str]:
    forms: set[str] = set()
    for chunk in _bag(text):
        forms.update(_forms(chunk))
    return forms


def learn_entries(sample: DataFrame, toxic: int, clean: int, most: int = MOST_ENTRIES) -> list[str]:
    """Words and beginnings that stand out in toxic texts of sample (y, text), best first; toxic and clean: how many there are."""
    if not toxic or not clean:
        return []

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seen: tuple[Counter, Counter] = (Counter(), Counter())
            for y, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                seen[bool(y)].update(_distinct_forms(text))
            for side, c in enumerate(seen):
                n = pa.array(list(c.values()), pa.int64())
                none = pa.array(np.zeros(len(c), np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.string()), *((none, n) if side else (n, none))], ["form", "n", "p"])

    forms = sample.where("y is not null").select("y", "text").mapInArrow(count, "form string, n long, p long").groupBy("form").agg(F.sum("n").alias("n"), F.sum("p").alias("p"))
    p, n, share = F.col("p"), F.col("n"), toxic / (toxic + clean)
    lift = F.log((p + 0.5) / (toxic + 1)) - F.log((n + 0.5) / (clean + 1))
    told = lambda seen, part: F.when(seen > 0, seen * F.log(seen / ((p + n) * part))).otherwise(F.lit(0.0))
    found = forms.withColumn("lift", lift).withColumn("z", F.sqrt(F.greatest(2 * (told(p, share) + told(n, 1 - share)), F.lit(0.0))))
    best = found.where((F.col("p") >= LEAST_TEXTS) & (F.col("lift") > LEAST_LIFT) & (F.col("z") > LEAST_Z)).orderBy(F.col("z").desc(), "form").limit(most)
    return [r["form"] for r in best.select("form").collect()]


def _pattern_counts(text: str | None) -> tuple[float, float, float]:
    """Share of capitals among ASCII letters, exclamation marks a character, repeated marks."""
    b = np.bincount(np.frombuffer((text or " ").encode(), np.uint8), minlength=128)
    upper, lower = b[65:91].sum(), b[97:123].sum()
    return float(upper / max(1, upper + lower)), float(b[33] / max(1, b.sum())), float((text or "").count("!!"))


N_SUMMARY = 8


class Featurizer:
    """Votes and features of a text."""

    def __init__(self, learned: list[str]) -> None:
        fixed = sorted({w + "$" for words in LEXICONS.values() for w in words.split()})
        learned_names = [n for n in learned if n not in set(fixed)]
        self.n_fixed = len(fixed)
        self.entries = Entries(fixed + learned_names)
        self.lexicon = {n: j for j, words in enumerate(LEXICONS.values()) for n in (w + "$" for w in words.split())}
        self.groups = np.array([self.lexicon[n] if i < self.n_fixed else len(LEXICONS) + i % SHARES for i, n in enumerate(self.entries.names)])
        self.n_groups = len(LEXICONS) + SHARES

    def __call__(self, text: str | None, votes: bool) -> tuple[dict[int, float], np.ndarray, np.ndarray | None]:
        """Log counts of hit entries, summary features, votes in {-1, 0, 1}."""
        found, any_, words = self.entries.hits(_bag(text))
        density = any_ / max(1, words)
        groups = np.zeros(self.n_groups)
        for i, n in found.items():
            groups[self.groups[i]] += n
        spread = float((groups > 0).sum())
        summary = np.array([np.log1p(any_), any_ >= 1, any_ >= 2, any_ >= 3, np.log1p(1000 * density), density > 0.01, spread / self.n_groups, groups[: len(LEXICONS)].sum() > 0], float)
        vote = None
        if votes:
            upper, marks, repeats = _pattern_counts(text)
            own = np.where(groups >= 1, 1, 0)
            more = [1 if any_ >= k else -1 for k in (1, 2, 3, 5)]
            dense = [1 if density >= t else (-1 if density == 0 else 0) for t in (0.003, 0.01, 0.03)]
            shapes = [1 if upper > 0.7 and words > 3 else 0, 1 if marks > 0.05 else 0, 1 if repeats > 5 else 0]
            vote = np.concatenate([own, more, dense, shapes]).astype(np.int8)
        return {i: float(np.log1p(n)) for i, n in found.items()}, summary, vote


class LabelModel:
    """P(vote | class) of each voter and correlations of votes within the classes."""

    def __init__(self, votes: np.ndarray, start: np.ndarray, known: np.ndarray, prior: float, rounds: int = 25) -> None:
        """start: first posterior of each row, the label itself for known ones, where the label votes as one voter more."""
        self.prior = min(max(prior, 0.01), 0.99)
        gold = np.where(known, np.where(start >= 0.5, 1, -1), 0).astype(votes.dtype)
        every = np.column_stack([votes, gold])
        post = start.copy()
        self.trust = np.where(known, 1.0, UNLABELLED_WEIGHT) if known.any() else np.ones(len(start))
        if known.any():  # the first estimate is the labelled rows' alone
            self._estimate(every[known], post[known], np.ones(known.sum()))
            post = self.posterior(every)
        for _ in range(rounds):
            self._estimate(every, post, self.trust)
            new = self.posterior(every)
            done = np.abs(new - post).max() < 1e-4
            post = new
            if done:
                break
        self.post = post

    def _estimate(self, votes: np.ndarray, post: np.ndarray, trust: np.ndarray) -> None:
        tables = []
        sides = ((1 - post) * trust, post * trust)
        for w in sides:
            total = w.sum()
            tables.append(np.stack([((votes == v) * w[:, None]).sum(0) + 0.5 for v in (-1, 0, 1)]) / (total + 1.5))
        self.tables = np.log(np.stack(tables))
        v = votes.astype(float)
        share = np.zeros((votes.shape[1], votes.shape[1]))
        for w in sides:
            mean = (v * w[:, None]).sum(0) / max(w.sum(), 1e-9)
            d = (v - mean) * np.sqrt(w)[:, None]
            cov = d.T @ d / max(w.sum(), 1e-9)
            sd = np.sqrt(np.diag(cov)) + 1e-6
            share += 0.5 * np.abs(cov / np.outer(sd, sd))
        np.fill_diagonal(share, 0)
        share[-1] = share[:, -1] = 0  # the label is given by another hand
        self.weight = 1 / (1 + np.where(share > 0.1, share, 0).sum(1))

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        """Of rows with all voters' votes, or without the last one, the label's."""
        at, columns = votes + 1, np.arange(votes.shape[1])
        # a label that isn't there says nothing: whether a row has one doesn't depend on its class
        said = np.where(votes != 0, 1.0, 0.0) if votes.shape[1] == len(self.weight) else np.ones(votes.shape)
        said[:, : len(self.weight) - 1] = 1.0
        logit = ((self.tables[1][at, columns] - self.tables[0][at, columns]) * self.weight[: votes.shape[1]] * said).sum(1) + np.log(self.prior / (1 - self.prior))
        return 1 / (1 + np.exp(-np.clip(logit, -30, 30)))


def _logistic(x: np.ndarray, y: np.ndarray, trust: np.ndarray, l2: float = 0.5, rounds: int = 600) -> np.ndarray:
    """Weights and a bias, by accelerated gradient descent on soft labels."""
    x1 = np.column_stack([x, np.ones(len(x), np.float32)]).astype(np.float32)
    step = 4.0 / max(1e-9, float((x1.astype(float) ** 2).sum(1).max()))
    step = max(step, 1.0 / max(1e-9, float(np.linalg.norm(x1, 2) ** 2) / (4 * len(x1))) * 0.9)
    w = np.zeros(x1.shape[1], np.float32)
    ahead, last = w.copy(), w.copy()
    for k in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x1 @ ahead, -30, 30)))
        g = x1.T @ ((p - y) * trust).astype(np.float32) / len(x1)
        g[:-1] += l2 / len(x1) * ahead[:-1]
        w = ahead - step * g
        ahead = w + k / (k + 3) * (w - last)
        last = w
    return w


class Classifier:
    """A featurizer and weights, from rows (y or None, entry numbers, their values, summary, votes)."""

    def __init__(self, features: Featurizer, rows: list[tuple]) -> None:
        self.features = features
        n = len(features.entries.names)
        if not rows:
            self.weights = np.zeros(n + N_SUMMARY + 1, np.float32)
            self.weights[: features.n_fixed], self.weights[-1] = 4.0, -2.0
            return
        x = np.zeros((len(rows), n + N_SUMMARY), np.float32)
        for i, (_, at, values, summary, _) in enumerate(rows):
            x[i, at] = values
            x[i, n:] = summary
        votes = np.stack([np.asarray(r[4], np.int8) for r in rows])
        known = np.array([r[0] is not None for r in rows])
        majority = 1 / (1 + np.exp(-votes.sum(1, dtype=float)))
        start = np.where(known, np.array([float(r[0] or 0) for r in rows]), majority)
        self.labels = LabelModel(votes, start, known, float(start[known].mean()) if known.any() else 0.1)
        self.weights = _logistic(x, self.labels.post, self.labels.trust)

    def score(self, text: str | None) -> float:
        hits, summary, _ = self.features(text, False)
        n = len(self.features.entries.names)
        z = float(self.weights[-1] + summary @ self.weights[n : n + N_SUMMARY]) + sum(float(self.weights[i]) * v for i, v in hits.items())
        return float(1 / (1 + np.exp(-min(30.0, max(-30.0, z)))))


def train(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", fit_texts: int = FIT_TEXTS) -> Classifier:
    """From whole texts of docs (doc_id, text) sampled by a hash of the id: about fit_texts for each label and as many unlabelled."""
    spark = docs.sparkSession
    known = labels.where(F.col(label_col).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg((F.avg(label_col) >= 0.5).alias("y"))
    sizes = {r["y"]: r["count"] for r in known.groupBy("y").count().collect()}
    spread = F.pmod(F.xxhash64(F.lit(10), "doc_id"), F.lit(1 << 30))
    at_most = lambda n: int(min(1.0, fit_texts / max(1, n)) * (1 << 30))
    chosen = known.where(spread < F.when(F.col("y"), F.lit(at_most(sizes.get(True, 0)))).otherwise(F.lit(at_most(sizes.get(False, 0)))))
    usable = docs.where(F.col("text").isNotNull() & F.col("doc_id").isNotNull()).join(F.broadcast(chosen), "doc_id", "left")  # about 2 * fit_texts rows
    picked = usable.where(F.col("y").isNotNull() | (spread < at_most(docs.count()))).groupBy("doc_id", "y").agg(F.min("text").alias("text"))
    sample, path = write_scratch(picked, "toxic")
    have = {r["y"]: r["count"] for r in sample.groupBy("y").count().collect()}
    sent = spark.sparkContext.broadcast(Featurizer(learn_entries(sample, have.get(True, 0), have.get(False, 0))))  # MOST_ENTRIES

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = sent.value
        for b in batches:
            got = [make(t, True) for t in b.column(2).to_pylist()]
            at, values, summary, votes = ([f(g) for g in got] for f in (lambda g: list(g[0]), lambda g: list(g[0].values()), lambda g: g[1].tolist(), lambda g: g[2].tolist()))
            arrays = [pa.array(at, pa.list_(pa.int32())), pa.array(values, pa.list_(pa.float64())), pa.array(summary, pa.list_(pa.float64())), pa.array(votes, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *arrays], ["doc_id", "y", "at", "value", "summary", "votes"])

    schema = "doc_id long, y boolean, at array<int>, value array<double>, summary array<double>, votes array<int>"
    got = sample.select(F.col("doc_id").cast("long").alias("doc_id"), "y", "text").mapInArrow(rows, schema).toArrow().sort_by("doc_id")  # a sparse row for each sampled text
    drop_scratch(spark, path)
    lists = lambda c: [x.values.to_numpy(zero_copy_only=False) for x in got.column(c)]
    return Classifier(sent.value, list(zip(got.column("y").to_pylist(), lists("at"), lists("value"), lists("summary"), lists("votes"))))


def score(docs: DataFrame, model: Classifier, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score and predicted of every whole text."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # bounded by MOST_ENTRIES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for b in batches:
            s = np.array([model.score(t) for t in b.column(1).to_pylist()], float)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], ["doc_id", "score", "predicted"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, score double, predicted int")


def held_out() -> Column:
    return F.coalesce(id_fold("doc_id", 5) == 0, F.lit(True))


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs.where(~held_out()), table(spark, sf_dir, "labels").where(~held_out()))
    return score(docs, model).withColumn("held_out", held_out()).select("doc_id", "held_out", "score", "predicted")
