"""Boundary values and empty inputs of the scoring rules; brute force for metrics."""

import math
import random

import pytest
from pyspark.sql import functions as F

from lumenframe.operators import consensus, metrics, resampling, routing, scoring, vectors
from lumenframe.sources import readers, sinks


def test_display_percent_bounds(spark):
    mid = 0.9819274
    rows = spark.createDataFrame([(mid - 1e-12,), (mid,), (0.99,), (0.5,), (1.0,), (None,)], "s double")
    got = [r[0] for r in rows.select(scoring.display_percent_by_language(F.col("s"), F.lit("CPP"))).collect()]
    assert got == [49, 50, 72, 0, 100, None]
    with pytest.raises(Exception, match="no display anchors"):
        rows.select(scoring.display_percent_by_language(F.col("s"), F.lit("JAVA"))).collect()


def test_eligibility_boundaries(spark):
    rows = spark.createDataFrame([("CPP", 69, True, True), ("CPP", 70, True, True), ("PYTHON", 54, True, True), ("PYTHON", 55, True, True), ("JAVA", 99, True, True), ("CPP", 99, False, True), ("CPP", 99, True, False), ("CPP", None, True, True)], "l string, t int, v boolean, c boolean")
    got = [r[0][1] for r in rows.select(routing.eligibility(F.col("l"), F.col("v"), F.col("c"), F.col("t"))).collect()]
    assert got == ["insufficient_tokens", None, "insufficient_tokens", None, "unsupported_language", "invalid_submission", "missing_cluster", "insufficient_tokens"]


@pytest.mark.parametrize(("tokens", "diversity", "status"), [(54, 0.5, "insufficient_evidence"), (55, 0.0299, "low_confidence"), (55, 0.03, "low_confidence_short"), (100, 0.5, "low_confidence_short"), (101, 0.5, "scored")])
def test_confidence(spark, tokens, diversity, status):
    c = routing.confidence(F.lit(tokens), F.lit("PYTHON"), F.lit(diversity))
    assert spark.range(1).select(c.alias("c")).first()["c"]["status"] == status


def test_discount_never_raises(spark):
    c = scoring.canonicality(F.lit(0.99), F.lit(200), F.lit("CPP"), F.lit(0.2), F.col("x"), F.lit(0.5))
    got = {r["x"]: r["c"]["score"] for r in spark.createDataFrame([(True,), (False,), (None,)], "x boolean").select("x", c.alias("c")).collect()}
    assert got[True] == pytest.approx(0.99 * 0.88) and got[False] == got[None] == 0.99


def test_diversity_matches_pairs(spark):
    random.seed(1)
    vs = {k: [[random.gauss(0, 1) for _ in range(5)] for _ in range(k)] for k in (1, 2, 6)}
    unit = {k: [[x / math.sqrt(sum(a * a for a in v)) for x in v] for v in group] for k, group in vs.items()}
    rows = [(k, i, v) for k, group in unit.items() for i, v in enumerate(group)]
    got = {r["k"]: r["diversity"] for r in vectors.diversity(spark.createDataFrame(rows, "k int, i int, v array<double>"), ["k"], "i", "v").collect()}
    for k, group in unit.items():
        pairs = [1 - sum(a * b for a, b in zip(x, y)) for i, x in enumerate(group) for y in group[:i]]
        assert got[k] == pytest.approx(sum(pairs) / len(pairs) if pairs else 1.0)


def test_zero_vector_stays(spark):
    df = spark.createDataFrame([([0.0, 0.0],), ([3.0, 4.0],)], "v array<double>")
    assert [r[0] for r in df.select(vectors.normalised(F.col("v"))).collect()] == [[0.0, 0.0], [0.6, 0.8]]


def test_metrics_against_brute_force(spark):
    random.seed(2)
    rows = [(random.randint(0, 12) / 10, random.randint(0, 1), random.choice("ab")) for _ in range(200)]
    df = spark.createDataFrame(rows, "s double, y int, g string")
    pos, neg = [s for s, y, _ in rows if y], [s for s, y, _ in rows if not y]
    want = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / len(pos) / len(neg)
    assert metrics.auroc(df, "s", "y").first()["auroc"] == pytest.approx(want)
    for target in (0.0, 0.05, 0.3):
        ok = [t for t in sorted(set(neg)) if sum(n >= t for n in neg) / len(neg) <= target]
        got = metrics.conservative_threshold(df.where("y = 0"), "s", target).first()["threshold"]
        assert got == (ok[0] if ok else math.nextafter(max(neg), math.inf))
    assert metrics.auroc(df.where("y = 1"), "s", "y").first()["auroc"] is None


def test_metrics_of_nothing(spark):
    empty = spark.createDataFrame([], "s double, y int")
    assert metrics.histogram(empty, "s").count() == 0
    assert metrics.describe_values(empty, "s").first()["mean"] is None


def test_single_value_histogram(spark):
    got = metrics.histogram(spark.createDataFrame([(2.0,), (2.0,)], "s double"), "s").orderBy("bin").collect()
    assert [r["count"] for r in got] == [0, 0, 0, 0, 0, 2, 0, 0, 0, 0] and got[0]["low"] == 1.5


def test_consensus_truth_table(spark):
    records = spark.createDataFrame([(k, True, 100) for k in "abcdef"] + [("g", False, 100), ("h", True, 59)], "r string, raw boolean, t int")
    votes = [("a", "human", 99.0), ("a", "human", 85.0), ("b", "ai", 1.0), ("b", "ai", 15.0), ("c", "human", 99.0), ("c", "ai", 1.0), ("d", "error", None), ("e", "human", 99.0), ("g", "human", 99.0)]
    got = {r["r"]: (r["label"], r["reason"]) for r in consensus.decide(records, spark.createDataFrame(votes, "r string, verdict string, human_probability double"), "r", F.col("raw"), F.col("t")).collect()}
    assert got == {"a": ("human", None), "b": ("ai", None), "c": ("unsure", None), "d": ("skipped", "detector_error"), "e": ("unsure", "too_few_votes"), "f": ("skipped", "no_votes"), "g": ("skipped", "raw_missing"), "h": ("skipped", "too_short")}


def test_probability_parsing(spark):
    df = spark.createDataFrame([(" ",), ("85",), (None,)], "p string")
    assert [r[0] for r in df.select(consensus.parse_probability(F.col("p"))).collect()] == [None, 85.0, None]
    with pytest.raises(Exception, match="not a probability"):
        spark.createDataFrame([("101",)], "p string").select(consensus.parse_probability(F.col("p"))).collect()


def test_strict_routing(spark):
    q, b = spark.createDataFrame([(1, "x"), (2, "y")], "i int, k string"), spark.createDataFrame([("x",)], "k string")
    with pytest.raises(LookupError):
        routing.require_routed(q, b, ["k"])
    assert routing.require_routed(q.where("k = 'x'"), b, ["k"]).count() == 1


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "q.json").write_text('{"q1": {"difficulty": "easy", "tags": ["TOPIC_A", {"name": "B"}, ""], "function_completion": {"CPP": true, "PYTHON39": true}, "boilerplates": {"CPP": "int f();", "PYTHON": {"code_content": "def f(): pass"}}}, "q2": {"metadata": {"difficulty": "HARD"}}}')
    q = {r["question_id"]: r for r in readers.questions(spark, f"file://{tmp_path}/q.json").collect()}
    assert q["q1"]["difficulty"] == "EASY" and q["q1"]["tags"] == ["TOPIC_A", "B"] and q["q1"]["primary_tag"] == "TOPIC_A" and q["q1"]["is_function_completion"]
    assert q["q1"]["boilerplates"] == {"CPP": "int f();", "PYTHON": "def f(): pass"} and q["q2"]["primary_tag"] == "UNTAGGED" and not q["q2"]["is_function_completion"]
    (tmp_path / "s.json").write_text('{"a:b:CPP": [{"raw_code": "x", "code": "y", "user_id": "u"}, {"raw_code": ""}], "c:PYTHON": []}')
    s = readers.submissions(spark, f"file://{tmp_path}/s.json").orderBy("group_index").collect()
    assert [(r["question_id"], r["language"], r["group_index"]) for r in s] == [("a:b", "CPP", 0), ("a:b", "CPP", 1)]
    (tmp_path / "r.txt").write_text("ID: 1\nURL: http://x\n\nint a;\nint b;\n=====\nID: 2\n\npass\n")
    blocks = readers.review_blocks(spark, f"file://{tmp_path}/r.txt").orderBy("block").collect()
    assert [b["fields"]["ID"] for b in blocks] == ["1", "2"] and blocks[0]["fields"]["URL"] == "http://x" and blocks[0]["code"] == "int a;\nint b;"
    assert readers.missing_files(spark, f"file://{tmp_path}", ["q.json", "none.json"]) == ["none.json"]
    df = spark.createDataFrame([("r", "CPP", 1)], "record string, language string, v int")
    sinks.save_bank(df, f"file://{tmp_path}/bank")
    sinks.replace_clusters(df.withColumn("v", F.lit(2)), f"file://{tmp_path}/bank", ["language"])
    assert readers.bank(spark, f"file://{tmp_path}/bank").first()["v"] == 2
    sinks.jsonl(df, f"file://{tmp_path}/j")
    sinks.summary_csv(df, f"file://{tmp_path}/c")
    sinks.blocks(df, f"file://{tmp_path}/b", ["record"], "language")
    assert spark.read.json(f"file://{tmp_path}/j").columns == sorted(df.columns)
    labels, audit = sinks.relabelled(df.select("record", F.col("language").alias("label")), df.select("record", F.lit("HUMAN").alias("label")), "record", "label")
    assert labels.first()["label"] == "HUMAN" and audit.first()["old_label"] == "CPP"
    with pytest.raises(LookupError):
        sinks.relabelled(labels, spark.createDataFrame([("zz", "AI")], "record string, label string"), "record", "label")
    with pytest.raises(ValueError, match="identity"):
        sinks.reject_identity_columns(df, ["record"])


def test_serving(spark):
    from lumenframe.functions.text import cache_key
    from lumenframe.operators import sampling
    from lumenframe.plans.serving import score_submissions

    body = "\n".join(f"        value_{i} = a + {i} * b - value_{i - 1 if i else 'x'}" for i in range(30))
    code, stub = f"class Solution:\n    def add(self, a, b):\n{body}\n        return value_29\n", "class Solution:\n    def add(self, a, b):\n        pass\n"
    requests = spark.createDataFrame([(1, code, stub, "q", "PYTHON"), (2, stub, stub, "q", "PYTHON"), (3, code, stub, "zz", "PYTHON"), (4, code, stub, "q", "JAVA"), (5, "", stub, "q", "PYTHON")], "request_id int, raw_code string, boilerplate string, question_id string, language string")
    bank = spark.createDataFrame([("q", "PYTHON", 0, [1.0, 0.0], "h0"), ("q", "PYTHON", 1, [0.6, 0.8], "h1")], "question_id string, language string, vector_id int, embedding array<double>, stripped_hash string")
    from lumenframe.functions.code import strip_solution

    stripped = strip_solution(code, stub, "PYTHON")[0]
    cache = spark.createDataFrame([(stripped, [0.6, 0.8])], "t string, embedding array<double>").select(cache_key(F.lit("m"), F.col("t")).alias("cache_key"), "embedding")
    got = {r["request_id"]: r for r in score_submissions(requests, bank, cache, "m").collect()}
    assert got[1]["status"] == "scored" and got[1]["vector_id"] == 1 and got[1]["score"] == pytest.approx(1.0) and got[1]["percent"] == 100 and "100%" in got[1]["card"]
    assert [got[i]["score"] for i in (2, 3, 4, 5)] == [None] * 4
    assert "No shared block" in got[1]["card"]
    texts = spark.createDataFrame([("q", "PYTHON", 1, "# a\n" + stripped), ("q", "PYTHON", 0, "pass")], "question_id string, language string, vector_id int, text string")
    lines = {r["request_id"]: r for r in score_submissions(requests, bank, cache, "m", texts=texts).collect()}
    assert "No shared block" not in lines[1]["card"] and "Human-leaning" not in lines[1]["card"]
    assert {i: (r["status"], r["reason"], r["percent"]) for i, r in lines.items()} == {i: (r["status"], r["reason"], r["percent"]) for i, r in got.items()}
    assert got[3]["reason"] == "missing_cluster" and got[4]["reason"] == "unsupported_language" and got[5]["reason"] == "raw_missing"
    assert [r["model"] for r in sampling.model_slots(["a", "b"], 5, spark).groupBy("model").count().where("count >= 2").orderBy("model").collect()] == ["a", "b"]


def test_top_ups(spark):
    from lumenframe.operators import sampling

    pool = spark.createDataFrame([(i, ["T"] if i % 4 == 0 else ["U"], "HARD" if i % 5 == 0 else "EASY") for i in range(40)], "id int, tags array<string>, d string")
    start = pool.where("id % 4 <> 0 and id < 20")
    out = sampling.top_up_tags(start, pool, "id", "tags", 4, [F.col("id")], [F.desc("id")])
    rows = out.collect()
    assert len(rows) == 15 and sum(r["tags"] == ["T"] for r in rows) == 4 and len({r["id"] for r in rows}) == 15
    assert sampling.review_records(pool, "id", ["d"], F.col("id") == 39, 2, 5, 1).where("id = 39").count() == 1
    assert sampling.language_mix(pool, "d", "HARD", 10, ["id"]).groupBy("d").count().count() == 2


def test_one_to_one_is_greedy_and_uses_each_row_once(spark):
    import random

    from lumenframe.operators.routing import one_to_one

    rng = random.Random(6)
    for tolerance, step in ((1.0, 1.0), (0.6, 0.5), (0.25, 0.5), (3.0, 0.7)):
        left, right = ([(rng.choice("ab"), i, step * rng.randint(0, 9)) for i in range(14)] for _ in "lr")
        want, used = set(), set()
        for k, i, v in sorted(left, key=lambda r: r[1]):
            j = next((j for q, j, w in sorted(right, key=lambda r: r[1]) if q == k and j not in used and abs(v - w) <= tolerance), None)
            if j is not None:
                used.add(j)
                want.add((k, i, j))
        frames = [spark.createDataFrame(rows, f"k string, {n} int, v double") for rows, n in ((left, "l"), (right, "r"))]
        got = [(r["k"], r["l"], r["r"]) for r in one_to_one(*frames, ["k"], "v", tolerance, "l", "r").collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_human_leaning_section(spark):
    from lumenframe.operators import explain

    df = spark.createDataFrame([(1, True, "scored", None), (2, False, "other", "missing_cluster"), (3, None, "insufficient_evidence", "x")], "i int, c boolean, s string, r string")
    card = explain.scored_card(F.lit(80), F.lit(True), F.lit(1), F.lit(2), F.lit(0.5), F.col("s"), F.lit(False), F.col("c"))
    got = {r["i"]: ([x["heading"] for x in r["card"]], r["st"]["body"]) for r in df.select("i", card.alias("card"), explain.status_section(F.col("s"), F.col("r")).alias("st")).collect()}
    assert "Human-leaning signals" in got[1][0] and all("Human-leaning signals" not in got[i][0] for i in (2, 3))
    assert [got[i][1] for i in (1, 2, 3)] == ["Scored.", "Not scored: missing cluster.", "Not scored: too little code."]


def _plain_auroc(rows):
    pos, neg = ([s for s, y in rows if y == k] for k in (1, 0))
    return sum((p > n) + (p == n) / 2 for p in pos for n in neg) / (len(pos) * len(neg)) if pos and neg else None


def _plain_cut(neg, target):
    reach = [s for s in set(neg) if sum(x >= s for x in neg) <= target * len(neg)]
    return min(reach) if reach else math.nextafter(max(neg), math.inf)


def _plain_quantile(values, p):
    v, at = sorted(values), p * (len(values) - 1)
    low = math.floor(at)
    return v[low] + (v[math.ceil(at)] - v[low]) * (at - low)


def test_bootstrap_metrics_by_replicate(spark):
    random.seed(11)
    data = [(f"g{random.randrange(9)}", random.choice("ab"), random.randrange(2), random.randrange(30) / 10) for _ in range(240)]
    data += [("only", "a", 1, 2.5), ("g1", "b", None, 1.0), ("g1", "b", 1, None), (None, "a", 1, 1.0)]
    rows = spark.createDataFrame(data, "g string, lang string, y int, s double")
    drawn = resampling.draws(rows, "g", 6, 3).cache()
    picks = [r.asDict() for r in drawn.collect()]
    names = {g for g, *_ in data if g}
    assert all(sum(p["times"] for p in picks if p["replicate"] == r) == len(names) for r in range(6))
    whole = [(g, lang, y, s) for g, lang, y, s in data if g and y is not None and s is not None]
    for kind in resampling.KINDS:
        got = {r["replicate"]: r["value"] for r in resampling.metric(kind, rows, drawn, "g", "s", "y", "lang").collect()}
        for r in range(6):
            copies = [(p["fold"], [x for x in whole if x[0] == p["g"]]) for p in picks if p["replicate"] == r for _ in range(p["times"])]
            flat = [(f, lang, y, s) for f, c in copies for _, lang, y, s in c]
            if kind == "pooled":
                want = _plain_auroc([(s, y) for *_, y, s in flat])
            elif kind == "macro":
                each = [a for a in (_plain_auroc([(s, y) for *_, y, s in c]) for _, c in copies) if a is not None]
                want = sum(each) / len(each)
            else:
                target = resampling.TARGETS[kind.rsplit("_", 1)[-1]]
                hits = []
                for f, lang, y, s in flat:
                    if y == 1 and kind in resampling.TARGETS:
                        hits.append(s >= _plain_quantile([x[3] for x in flat if x[2] == 0], 1 - target))
                    elif y == 1:
                        neg = [x[3] for x in flat if x[2] == 0 and x[0] != f and (x[1] == lang or not kind.startswith("calibrated"))]
                        hits += [s >= _plain_cut(neg, target)] if neg else []
                want = sum(hits) / len(hits)
            assert got[r] == pytest.approx(want), (kind, r)


def test_bootstrap_of_nothing(spark):
    rows = spark.createDataFrame([], "g string, lang string, y int, s double, t double")
    out = resampling.deltas(rows, "g", "s", "t", "y", "lang", 3, 1, ["pooled", "r5"]).collect()
    assert [(r["kind"], r["mean"], r["low"]) for r in out] == [("pooled", None, None), ("r5", None, None)]


def test_small_checks(spark):
    assert sinks.inside("/a/b/../b/c", "/a/b") and sinks.inside("s3://k/v2", "s3://k/v2/")
    for path in ("/a/bc", "/a/b/../c", "/a"):
        with pytest.raises(ValueError):
            sinks.inside(path, "/a/b")
    assert consensus.configured({"K": "x", "L": " "}, {"one": ["K"], "two": ["K", "L"], "three": ["M"], "none": []}) == {"one": True, "two": False, "three": False, "none": True}
    from lumenframe.plans.serving import tokenised

    code = spark.createDataFrame([("x = 1", "PYTHON"), ("x = (", "PYTHON"), (None, "PYTHON")], "code string, language string")
    assert [r["tokens"] for r in tokenised(code).collect()] == [3]
