"""Texts that break weak hashes, pattern engines and quadratic loops."""

import math
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenframe.llm import dedup, fingerprints, langid, pii, quotes, secret_scan, textblock


def thue_morse(n):
    s = "a"
    for _ in range(n):
        s += s.translate(str.maketrans("ab", "ba"))
    return s, s.translate(str.maketrans("ab", "ba"))


@pytest.mark.parametrize("table", [0, 1])
def test_words_of_two_letters_don_t_collide(table):
    pairs = [w for n in range(1, 14) for w in thue_morse(n)]
    hashes, per = textblock.word_hashes([w.encode() for w in pairs], table)
    assert per.tolist() == [1] * len(pairs) and len(set(hashes.tolist())) == len(pairs)
    joined, _ = textblock.word_hashes([b"x " + pairs[-1].encode() + b"\n" + pairs[-2].encode()], table)
    assert joined[1:].tolist() == [hashes[-1], hashes[-2]]


def test_dedup_tells_long_words_apart(spark):
    rows = list(enumerate(thue_morse(10)))
    got = {r["doc_id"]: r["component_id"] for r in dedup.components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {0: 0, 1: 1}


def test_lines_and_addresses_of_any_length(spark):
    said = [(1, 0, "u", "hello\n" + "\n" * 50_000 + "x"), (1, 1, "u", ">" * 100_000 + " hello"), (1, 2, "u", "> hello\n" * 20_000)]
    got = {r["turn"]: (r["parent_turn"], r["n_quoted"]) for r in quotes.link(spark.createDataFrame(said, "conv_id long, turn long, role string, text string")).collect()}
    assert got == {0: (None, 0), 1: (0, 1), 2: (0, 20_000)}
    rows = [(1, "a@" + "b." * 100_000 + "com x"), (2, "a@" + "b." * 100_000 + "1 x"), (3, " ".join(f"u{i}@x{i}.com" for i in range(3_000)))]
    out = pii.replace(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", F.size("entities").alias("n"), "text").collect()
    assert {r["doc_id"]: r["n"] for r in out} == {1: 1, 2: 0, 3: 3_000}
    new = next(r["text"] for r in out if r["doc_id"] == 3).split()
    assert len(set(new)) == 3_000 and not set(new) & set(rows[2][1].split())
    keys = [(1, "eyJ" * 50_000, "a"), (2, "token = abcdef12 " * 10_000, "b"), (3, "deadbeef" * 50_000, "c")]
    spans = {r["doc_id"]: r["spans"] for r in secret_scan.scan(spark.createDataFrame(keys, "doc_id long, text string, source string")).collect()}
    assert [len(spans[i]) for i in (1, 2, 3)] == [0, 10_000, 1]
    assert [s["start"] for s in spans[2]] == [17 * i for i in range(10_000)]


def test_a_surname_alone_is_the_same_person(spark):
    rows = [(1, "Mr. Smith met John Smith; Smith left. The Smithers stay."), (2, "Smith alone"), (3, "Dr. Koch und Koch's")]
    got = {r["doc_id"]: r["text"] for r in pii.replace(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    name = got[1].split()[1]
    assert name != "Smith" and got[1].split()[4] == f"{name};" and got[1].split()[5] == name and got[1].endswith("left. The Smithers stay.")
    assert got[2] == "Smith alone" and "Koch" not in got[3]


def test_ranges_of_ids_far_apart(spark):
    ids = spark.createDataFrame([(i,) for i in range(3_000)] + [(1 << 61,), (-(1 << 60),)], "__id long")
    now, tops = fingerprints.id_ranges(ids, 100)
    sizes = {r["__range"]: (r["n"], r["hi"]) for r in now.groupBy("__range").agg(F.count("*").alias("n"), F.max("__id").alias("hi")).collect()}
    assert max(n for n, _ in sizes.values()) <= 200 and [(r, sizes[r][1]) for r, _ in tops] == tops and [t for _, t in tops] == sorted((t for _, t in tops), reverse=True)


def kneser_ney(words, order, size):
    """Probabilities by plain dictionaries: p(c | context), interpolated down to even chances."""
    counts = [Counter() for _ in range(order)]
    for w, n in words.items():
        s = "^" * (order - 1) + w + "$"
        for i in range(order - 1, len(s)):
            counts[order - 1][s[i - order + 1 : i + 1]] += n
    for k in range(order - 2, -1, -1):
        for g in counts[k + 1]:
            counts[k][g[1:]] += 1
    off = []
    for c in counts:
        once, twice = (sum(v == x for v in c.values()) for x in (1, 2))
        off.append(min(max(once / (once + 2 * twice), 0.1), 0.95) if once else 0.5)
    total, kinds = [defaultdict(float) for _ in counts], [defaultdict(int) for _ in counts]
    for k, c in enumerate(counts):
        for g, n in c.items():
            total[k][g[:-1]] += n
            kinds[k][g[:-1]] += 1

    def p(g):
        k = len(g) - 1
        lower = p(g[1:]) if k else 1 / size
        if g[:-1] not in total[k]:
            return lower
        return (max(counts[k][g] - off[k], 0) if g in counts[k] else 0) / total[k][g[:-1]] + off[k] * kinds[k][g[:-1]] / total[k][g[:-1]] * lower

    return p


def test_language_scores_are_kneser_ney():
    bags = {"a": Counter({"abba": 3, "baba": 1, "cab": 2}), "b": Counter({"xyzzy": 2, "yx": 1})}
    models = langid.Models(bags, order=3)
    size = len(set("".join(w for b in bags.values() for w in b))) + 257
    runs = ["abba", "ab", "zzz", "q", "cabx"]
    got, n = models.score(runs)
    for j, lang in enumerate(models.langs):
        p = kneser_ney(bags[lang], 3, size)
        for i, r in enumerate(runs):
            s = "^^" + r + "$"
            assert got[i, j] == pytest.approx(sum(math.log(p(s[k - 2 : k + 1])) for k in range(2, len(s))), abs=1e-3)
    assert n.tolist() == [len(r) + 1 for r in runs] and np.isfinite(got).all()
