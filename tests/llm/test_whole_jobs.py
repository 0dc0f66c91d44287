"""Operators do the whole job on inputs that meet no bound of theirs."""

import random
import tracemalloc
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from lumenframe.llm import common, fingerprints, langid, pieces, pii


def test_gibberish_of_any_length_is_rejected():
    rng = random.Random(2)
    vocabulary = {"aa": [f"{a}{b}na" for a in "bdgklm" for b in "aeiou"], "bb": [f"{a}{b}sch" for a in "fhrtwz" for b in "aeiou"], "cc": ["qua", "quo", "quis", "quem"]}
    said = lambda lang, n: " ".join(rng.choice(vocabulary[lang]) for _ in range(n))
    fit = [(lang, said(lang, 120)) for lang in vocabulary for _ in range(60)]
    calibrate = [(lang, said(lang, 60)) for lang in ("aa", "bb") for _ in range(40)] + [("cc", said("cc", 60))] * 2
    model = langid.Classifier(fit, calibrate)
    gibberish = lambda n: " ".join("".join(rng.choice("xjvyqpwzkc") for _ in range(7)) for _ in range(n))
    real = [said(lang, n) for lang in vocabulary for n in (3, 60, 30_000)]
    odd = [gibberish(n) for n in (2, 5, 60, 4_000, 30_000)]
    scorer = langid.Scorer(model.models)
    assert np.isfinite(model.limits).all()
    assert not model(scorer, real)[3].any() and model(scorer, odd)[3].all()
    none = langid.Classifier(fit, [])
    assert np.isfinite(none.limits).all() and none(langid.Scorer(none.models), odd)[3].all()


def test_repeated_lines_keep_a_sketch(spark):
    texts = [" ".join([f"line{k}"] * 200) for k in range(60)] + [f"all rights reserved by owner {k} of this\n" * 40 for k in range(30)]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, text string").select("i", fingerprints.sketch(F.col("text")).alias("s"))
    assert all(len(r["s"]["hashes"]) > 0 for r in rows.collect())
    a, b = rows.select(F.col("i").alias("a"), F.col("s").alias("x")), rows.select(F.col("i").alias("b"), F.col("s").alias("y"))
    got = a.crossJoin(b).where("a < 60 and b < 60").select("a", "b", fingerprints.likeness(F.col("x"), F.col("y")).alias("n")).collect()
    assert all((r["n"] == 1) == (r["a"] == r["b"]) for r in got)


def test_every_rank_is_decoded(spark):
    docs = spark.createDataFrame([(1, "plain words here"), (2, "a mark \u2581 inside the words")], "doc_id long, text string")
    got = {(r["doc_id"], r["rank"]): r["round_trip"] for r in pieces.encode(docs, with_ids=False).collect()}
    texts = dict((r["doc_id"], r["text"]) for r in docs.collect())
    want = {(r["doc_id"], r["rank"]): pieces._segmenter(pieces.model_path()).decode(np.asarray(r["ids"])) == texts[r["doc_id"]] for r in pieces.encode(docs).collect()}
    assert got == want and len(got) == 6 and not any(got[2, k] for k in (1, 2, 3)) and got[1, 3]


def test_shapes_have_room_for_every_unit(spark):
    letters = "abcdefghijklmnopqrstuvwxyz"
    units = [("email", f"{a}@{b}.{e}") for a in letters for b in letters for e in ("com", "de")] + [("email", f"{a}@{b}.{e}") for a in range(10) for b in range(10) for e in ("com", "fr", "net")] + [("email", f"-@-.{a}{b}") for a in letters for b in letters[:5]]
    rows = pii.assign(spark.createDataFrame(units, "kind string, canon string"))[0].collect()
    new = {r["new"] for r in rows}
    assert len(rows) == len(new) == len(units) and not new & {u for _, u in units}


def test_next_of_far_ids_needs_no_cross_join(spark):
    ids = [*range(-500, 500), 1 << 61, 7, 7, None, None]
    rows = spark.createDataFrame([(i, f"text {k}") for k, i in enumerate(ids)], "doc_id long, text string").withColumn("__tie", F.xxhash64("text"))
    out = fingerprints.neighbours(rows, ["text"], range_rows=50)
    assert "NestedLoop" not in out._jdf.queryExecution().toString()
    order = [r["text"] for r in sorted(rows.collect(), key=lambda r: (-(r["doc_id"] if r["doc_id"] is not None else -501), r["__tie"]))]
    assert {r["text"]: r["next_text"] for r in out.collect()} == {t: order[(k + 1) % len(order)] for k, t in enumerate(order)}


def test_workers_give_memory_back(spark):
    def seen(batches):
        import os

        import pyarrow as pa

        for _ in batches:
            yield pa.RecordBatch.from_arrays([pa.array([pa.default_memory_pool().backend_name]), pa.array([os.environ.get("MALLOC_MMAP_THRESHOLD_")])], ["pool", "threshold"])

    common.bound_batches(spark)
    got = spark.range(1).mapInArrow(seen, "pool string, threshold string").first()
    assert (got["pool"], got["threshold"]) == ("system", str(1 << 20))


def test_runs_are_scored_in_small_blocks():
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefghij") for _ in range(8)) for _ in range(50_000)]
    models = langid.Models({"aa": Counter(words[:300]), "bb": Counter(words[300:600])})
    tracemalloc.start()
    scores, n = langid.Scorer(models)([" ".join(words)])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    each, chars = models.score(words)
    assert np.allclose(scores[0], each.sum(axis=0)) and n[0] == chars.sum()
    assert peak < 60e6
