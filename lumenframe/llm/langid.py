"""Language identification by interpolated Kneser-Ney character models.

A text is a bag of letter runs; each run is scored with boundary marks on either side, so
a run's log-probability under every language is computed once and reused. The models of
all languages share one array of sorted n-gram hashes for each order, with a row of
interpolated log-probabilities and of back-off weights by language: a character costs one
binary search, and one more for each order that it has to fall back. The language with the
lowest cross-entropy per character wins. Discounts come from the counts of counts of each
language and order; temperature and rejection limits from labelled documents that the models
haven't seen. Runs are counted and texts scored where they are, so the driver holds counts
of the sample, never its texts.

Defined results: null texts and texts without a letter are `und` with score 0 and count as
rejected; a null id is never learned from; without any labelled rows every text is `und`,
and only texts without a letter are rejected; a length without a limit of its own takes the
nearest one of its language, then of all languages, then the entropy of even chances;
rows with equal text get equal answers; ties go to the language first in the alphabet.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenframe.llm.common import beside_text, drop_scratch, id_fold, table, write_scratch
from lumenframe.llm.textblock import mix64

#: Labelled texts for each language to fit on and to calibrate on, and of all languages together, at most; of any length.
FIT_TEXTS = 400
CALIBRATE_TEXTS = 200
MOST_TEXTS = 60_000
ORDER = 4
#: A text is rejected when its cross-entropy lies more than so many standard deviations above the mean of calibration texts of its language and length, and above all of them.
REJECT_DEVIATIONS = 6.0
#: The least standard deviation, as a share of the mean.
LEAST_DEVIATION = 0.02
#: Lengths are told apart by their log2, up to this one.
LENGTHS = 40
MOST_RUNS = 400_000
#: Runs that are scored at once.
BLOCK = 8_192
_LETTERS = re.compile(r"[^\W\d_]+")


def _grams(runs: list[str], order: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Hashes of the 1..order grams that end at each character of `^run$`, after ^; the run of each; if the context reaches ^ or less."""
    joined = "".join(["\x02" * (order - 1) + r + "\x03" for r in runs])
    codes = np.frombuffer(joined.encode("utf-32-le"), np.uint32).astype(np.uint64)
    sizes = np.array([len(r) + order for r in runs])
    owner = np.repeat(np.arange(len(runs)), sizes)
    ends = np.arange(len(codes)) - np.repeat(np.cumsum(sizes) - sizes, sizes) >= order - 1
    unit = mix64(codes + np.uint64(0x51ED27))
    out, h = [], np.zeros(len(codes), np.uint64)
    for k in range(order):
        moved = np.zeros_like(unit)
        moved[k:] = unit[: len(unit) - k]
        h = h + moved * np.uint64(0x9E3779B97F4A7C15 * pow(0xD1342543DE82EF95, k, 1 << 64) & ((1 << 64) - 1) | 1)
        out.append(mix64(h + np.uint64(k)))
    return out, owner, ends


def _discount(n: np.ndarray) -> float:
    """Kneser and Ney's estimate from how many grams were counted once and twice."""
    once, twice = float((n == 1).sum()), float((n == 2).sum())
    return min(max(once / (once + 2 * twice), 0.1), 0.95) if once else 0.5


class Models:
    """langs; for each order the sorted hashes, log-probabilities and back-off weights by language."""

    def __init__(self, counts: dict[str, Counter], order: int = ORDER) -> None:
        self.langs, self.order = sorted(counts), order
        n = len(self.langs)
        alphabet: set[str] = set()
        for c in counts.values():
            alphabet.update("".join(c))
        self.floor = -np.log(len(alphabet) + 257.0)
        raw: list[list[dict]] = []
        for lang in self.langs:
            runs = sorted(counts[lang])
            grams, owner, ends = _grams(runs, order)
            weight = np.array([counts[lang][r] for r in runs], np.float64)[owner]
            levels = []
            for k in range(order):
                g = grams[k][ends]
                ctx = np.concatenate(([np.uint64(0)], grams[k - 1][:-1]))[ends] if k else np.zeros(len(g), np.uint64)
                low = grams[k - 1][ends] if k else np.zeros(len(g), np.uint64)
                hashes, first, inverse = np.unique(g, return_index=True, return_inverse=True)
                levels.append({"h": hashes, "ctx": ctx[first], "low": low[first], "n": np.bincount(inverse, weight[ends]) if k == order - 1 else None})
            for k in range(order - 1):  # continuation counts: distinct longer grams that end so
                up = levels[k + 1]
                levels[k]["n"] = np.bincount(np.searchsorted(levels[k]["h"], up["low"]), minlength=len(levels[k]["h"])).astype(float)
            raw.append(levels)
        self.discounts = [[_discount(r[k]["n"]) for r in raw] for k in range(order)]
        self.tables: list[dict[str, np.ndarray]] = []
        self.unseen = np.zeros(n)
        for k in range(order):
            # contexts of start marks end no gram, but have back-off weights too
            every = np.unique(np.concatenate([r[k]["h"] for r in raw] + [r[k + 1]["ctx"] for r in raw if k + 1 < order]))
            ctx, low = np.zeros(len(every), np.uint64), np.zeros(len(every), np.uint64)
            for r in raw:
                at = np.searchsorted(every, r[k]["h"])
                ctx[at], low[at] = r[k]["ctx"], r[k]["low"]
            prob = np.zeros((len(every), n))
            back = np.zeros((len(every), n), np.float32)  # of this gram as a context, filled one order later
            for j, r in enumerate(raw):
                off = self.discounts[k][j]
                own = np.zeros(len(every))
                own[np.searchsorted(every, r[k]["h"])] = np.maximum(r[k]["n"] - off, 0)
                ctxs, inverse = np.unique(r[k]["ctx"], return_inverse=True)
                total, kinds = np.bincount(inverse, r[k]["n"]), np.bincount(inverse)
                at = np.minimum(np.searchsorted(ctxs, ctx), len(ctxs) - 1)
                seen = ctxs[at] == ctx
                den = np.where(seen, total[at], 1.0)
                rest = np.where(seen, off * kinds[at] / den, 1.0)
                if k == 0:
                    lower = np.full(len(every), np.exp(self.floor))
                    self_back = float(off * kinds[0] / total[0])
                    self.unseen[j] = np.log(self_back) + self.floor
                else:
                    t = self.tables[k - 1]
                    lower = np.exp(t["p"][np.searchsorted(t["h"], low), j])
                    mine = np.minimum(np.searchsorted(ctxs, t["h"]), len(ctxs) - 1)
                    t["b"][:, j] = np.where(ctxs[mine] == t["h"], np.log(off * kinds[mine] / total[mine]), 0.0)
                prob[:, j] = np.log(np.where(seen, own / den, 0.0) + rest * lower)
            self.tables.append({"h": every, "p": prob.astype(np.float32), "b": back})

    def score(self, runs: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Log-probability of each run by language, and its characters with the end mark."""
        grams, owner, ends = _grams(runs, self.order)
        g = [x[ends] for x in grams]
        ctx = [np.concatenate(([np.uint64(0)], x[:-1]))[ends] for x in grams]
        total = np.zeros((len(owner[ends]), len(self.langs)), np.float32)
        left = np.arange(len(total))
        for k in range(self.order - 1, -1, -1):
            t = self.tables[k]
            q = g[k][left]
            at = np.minimum(np.searchsorted(t["h"], q), len(t["h"]) - 1)
            hit = t["h"][at] == q
            total[left[hit]] += t["p"][at[hit]]
            left = left[~hit]
            if k and len(left):
                t = self.tables[k - 1]
                q = ctx[k - 1][left]
                at = np.minimum(np.searchsorted(t["h"], q), len(t["h"]) - 1)
                known = t["h"][at] == q
                total[left[known]] += t["b"][at[known]]
            if not len(left):
                break
        total[left] += self.unseen.astype(np.float32)
        out = np.zeros((len(runs), len(self.langs)))
        starts = np.searchsorted(owner[ends], np.arange(len(runs)))
        out[:] = np.add.reduceat(total, starts, axis=0) if len(runs) else 0
        return out, np.array([len(r) + 1 for r in runs])


class Scorer:
    """Texts to (log-probabilities by language, characters); runs that were scored are kept, within a bound."""

    def __init__(self, models: Models) -> None:
        self.models = models
        self.reset()

    def reset(self) -> None:
        self.at: dict[str, int] = {}
        self.values = np.zeros((0, len(self.models.langs) + 1))

    def __call__(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        langs = len(self.models.langs)
        if len(self.at) > MOST_RUNS:
            self.reset()
        out, n = np.zeros((len(texts), langs)), np.zeros(len(texts))
        bags = []
        fresh: dict[str, int] = {}
        at = self.at
        for text in texts:
            bag = Counter((text or "").lower().split())
            for chunk in bag:
                if chunk not in at:
                    at[chunk] = len(at)
                    fresh[chunk] = 1
            bags.append(bag)
        if fresh:
            runs, owner = [], []
            for i, chunk in enumerate(fresh):
                for r in _LETTERS.findall(chunk):
                    runs.append(r)
                    owner.append(i)
            rows = np.zeros((len(fresh), langs + 1))
            for lo in range(0, len(runs), BLOCK):
                got, chars = self.models.score(runs[lo : lo + BLOCK])
                np.add.at(rows, owner[lo : lo + BLOCK], np.column_stack([got, chars]))
            self.values = np.concatenate([self.values, rows])
        for i, bag in enumerate(bags):
            if bag:
                rows = self.values[[at[c] for c in bag]]
                total = np.fromiter(bag.values(), float, len(bag)) @ rows
                out[i], n[i] = total[:langs], total[langs]
        return out, n


def _bag(texts: list[str]) -> Counter:
    c: Counter = Counter()
    for t in texts:
        c.update(_LETTERS.findall(t.lower()))
    return c


class Classifier:
    """Models with a temperature and with rejection limits by language and length."""

    def __init__(self, fit: list[tuple[str, str]], calibrate: list[tuple[str, str]]) -> None:
        by: dict[str, list[str]] = {}
        for lang, text in fit:
            by.setdefault(lang, []).append(text)
        models = Models({k: c for k, v in by.items() if (c := _bag(v))})
        scores, n = Scorer(models)([t for _, t in calibrate])
        self._calibrate(models, scores, n, [a for a, _ in calibrate])

    @classmethod
    def of(cls, models: Models, scores: np.ndarray, n: np.ndarray, langs: list[str]) -> Classifier:
        """From calibration texts that models have scored; langs: what each is in."""
        made = cls.__new__(cls)
        made._calibrate(models, scores, n, langs)
        return made

    def _calibrate(self, models: Models, scores: np.ndarray, n: np.ndarray, langs: list[str]) -> None:
        self.models, self.langs = models, models.langs
        self.temperature = 1.0
        self.limits = np.full((len(self.langs), LENGTHS), -models.floor)
        index = {a: j for j, a in enumerate(self.langs)}
        truth = np.array([index.get(a, -1) for a in langs], np.int64)
        use = (n > 0) & (truth >= 0)
        if not use.any():
            return
        scores, n, truth = scores[use], n[use], truth[use]
        loss = {}
        for t in (1.0, 0.5, 0.25, 0.1, 0.05, 0.02):
            z = scores * t
            z = z - z.max(axis=1, keepdims=True)
            loss[t] = -(z[np.arange(len(z)), truth] - np.log(np.exp(z).sum(axis=1))).mean()
        self.temperature = min(loss, key=loss.get)
        entropy = -scores[np.arange(len(n)), truth] / np.maximum(n, 1)
        pooled = self._by_length(entropy, n) or {0: self._limit(entropy)}
        for j in range(len(self.langs)):
            own = self._by_length(entropy[truth == j], n[truth == j]) or pooled
            for b in range(LENGTHS):
                self.limits[j, b] = own[min(own, key=lambda x: (abs(x - b), x))]

    @staticmethod
    def _limit(entropy: np.ndarray) -> float:
        mean = float(entropy.mean())
        return max(mean + REJECT_DEVIATIONS * max(float(entropy.std()), LEAST_DEVIATION * mean), float(entropy.max()))

    @classmethod
    def _by_length(cls, entropy: np.ndarray, n: np.ndarray) -> dict[int, float]:
        """Limits by log2 of the length, where 8 texts or more are near."""
        near = {b: np.abs(np.log2(np.maximum(n, 1)) - b) <= 1.5 for b in range(LENGTHS)}
        return {b: cls._limit(entropy[m]) for b, m in near.items() if m.sum() >= 8}

    def __call__(self, scorer: Scorer, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
        scores, n = scorer(texts)
        pred, conf, entropy, rejected = [], np.zeros(len(texts)), np.full(len(texts), np.nan), np.ones(len(texts), bool)
        for i in range(len(texts)):
            if n[i] == 0:
                pred.append("und")
                continue
            j = int(scores[i].argmax())
            z = (scores[i] - scores[i, j]) * self.temperature
            pred.append(self.langs[j])
            conf[i] = 1 / np.exp(z).sum()
            entropy[i] = -scores[i, j] / n[i]
            rejected[i] = entropy[i] > self.limits[j, min(round(float(np.log2(n[i]))), LENGTHS - 1)]
        return pred, conf, entropy, rejected


def _sample(docs: DataFrame, fit_texts: int, calibrate_texts: int) -> DataFrame:
    """lang, text and fit (or else for calibration) of labelled rows, chosen by a hash; repeated rows count once."""
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", "text", "lang")
    sizes = known.groupBy("lang").count()
    want = max(1, min(fit_texts + calibrate_texts, MOST_TEXTS // max(1, sizes.count())))
    spread = F.pmod(F.xxhash64(F.lit(6), "doc_id", "text"), F.lit(1 << 30))
    part = F.least(F.lit(1 << 30).cast("double"), F.lit(1.3 * want * (1 << 30)) / F.col("count") + 1)
    chosen = known.withColumn("s", spread).join(F.broadcast(sizes), "lang").where(F.col("s") < part)  # a row for each language
    chosen = chosen.groupBy("lang", "s", "doc_id").agg(F.min("text").alias("text"))
    of_lang = Window.partitionBy("lang")  # of a sample of bounded size
    ranked = chosen.withColumn("r", F.row_number().over(of_lang.orderBy("s", "doc_id"))).withColumn("m", F.least(F.count("*").over(of_lang), F.lit(want)))
    cut = F.floor(F.col("m") * fit_texts / (fit_texts + calibrate_texts))
    return ranked.where(F.col("r") <= want).select("lang", "text", (F.col("r") <= F.when(cut > 0, cut).otherwise(F.col("m"))).alias("fit"))


def train(docs: DataFrame, fit_texts: int = FIT_TEXTS, calibrate_texts: int = CALIBRATE_TEXTS) -> Classifier | None:
    """From docs (doc_id, text, lang): whole texts by a hash, at most fit_texts + calibrate_texts for each language and MOST_TEXTS in all."""
    spark = docs.sparkSession
    sample, path = write_scratch(_sample(docs, fit_texts, calibrate_texts), "languages")

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            by: dict[str, list[str]] = {}
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                by.setdefault(lang, []).append(text)
            for lang, texts in by.items():
                bag = _bag(texts)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(bag), pa.string()), pa.array(list(bag), pa.string()), pa.array(list(bag.values()), pa.int64())], ["lang", "run", "n"])

    found = sample.where("fit").select("lang", "text").mapInArrow(runs, "lang string, run string, n long").groupBy("lang", "run").agg(F.sum("n").alias("n")).toArrow()
    counts: dict[str, Counter] = {}
    for lang, run, n in zip(*(found.column(c).to_numpy(zero_copy_only=False).tolist() for c in ("lang", "run", "n"))):
        counts.setdefault(lang, Counter())[run] = int(n)
    if not counts:
        drop_scratch(spark, path)
        return None
    sent = spark.sparkContext.broadcast(Models(counts))  # bounded by the sample

    def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(sent.value)
        for b in batches:
            got, n = scorer(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(list(got), pa.list_(pa.float64())), pa.array(n)], ["lang", "scores", "n"])

    held = sample.where("not fit").select("lang", "text").mapInArrow(scores, "lang string, scores array<double>, n double").collect()  # calibrate_texts a language
    drop_scratch(spark, path)
    held.sort(key=lambda r: (r["lang"], r["n"], r["scores"]))
    values = np.array([r["scores"] for r in held]).reshape(len(held), len(sent.value.langs))
    return Classifier.of(sent.value, values, np.array([r["n"] for r in held], float), [r["lang"] for r in held])


def annotate(docs: DataFrame, model: Classifier | None, text_col: str = "text", name: str = "lang_id", keep: list[str] | None = None) -> DataFrame:
    """docs with a struct `name`: lang_pred, score, entropy (nats a character), rejected."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the fitting sample

    def of():  # noqa: ANN202
        model = sent.value
        if model is None:
            return lambda texts: {"lang_pred": ["und"] * len(texts), "score": np.zeros(len(texts)), "entropy": np.full(len(texts), np.nan), "rejected": [not _LETTERS.search(t or "") for t in texts]}
        scorer = Scorer(model.models)
        return lambda texts: dict(zip(("lang_pred", "score", "entropy", "rejected"), model(scorer, texts)))

    return beside_text(docs, name, "lang_pred: string, score: double, entropy: double, rejected: boolean", of, text_col, keep=keep)


def predict(docs: DataFrame, model: Classifier | None) -> DataFrame:
    """doc_id, lang_pred, score, entropy (null without letters) and rejected."""
    out = annotate(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), model, keep=["doc_id"])
    return out.select("doc_id", "lang_id.*").withColumn("entropy", F.when(~F.isnan("entropy"), F.col("entropy")))


def keep(docs: DataFrame) -> DataFrame:
    """The rows of docs whose language is told and not rejected, as they are; learned from their own `lang`."""
    model = train(docs.where(id_fold("doc_id", 3) != 1))
    return annotate(docs, model, name="__lang_id").where("not __lang_id.rejected").drop("__lang_id")


def held_out() -> Column:
    return F.coalesce(id_fold("doc_id", 3) == 1, F.lit(True))


def identify(docs: DataFrame) -> DataFrame:
    model = train(docs.where(id_fold("doc_id", 3) != 1))
    return predict(docs, model).withColumn("held_out", held_out())


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents")).select("doc_id", "held_out", "lang_pred", "score", "entropy", "rejected")
