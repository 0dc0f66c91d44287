"""Operators against plain Python on the smallest tables."""

import collections
import hashlib
import re
import zlib

import numpy as np
import pytest

from lumenframe.llm import dedup, fingerprints, langid, packing, pieces, pii, quotes, rules, secret_scan, toxicity
from tests.conftest import DATA

SPACE = re.compile(r"[\x20\x09-\x0D]+")


@pytest.fixture(scope="session")
def texts(duck):
    return dict(duck.sql("select doc_id, text from documents").fetchall())


def words(text):
    return [w for w in SPACE.split(text) if w]


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def shingles(text):
    w = words(lower(text))
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) or (frozenset([tuple(w)]) if w else frozenset())


def least_reachable(sets):
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and 100 * min(len(x), len(y)) >= 75 * max(len(x), len(y)) and 100 * len(x & y) >= 75 * len(x | y):
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    return {d: find(d) for d in sets}


def test_dedup_components(spark, texts):
    sets = {d: shingles(t) for d, t in texts.items()}
    want = least_reachable(sets)
    for r in dedup.op1(spark, DATA).collect():
        assert (r["n_shingles"], r["component_id"], r["kept"]) == (len(sets[r["doc_id"]]), want[r["doc_id"]], want[r["doc_id"]] == r["doc_id"])


def test_dedup_of_chains_and_groups(spark):
    """Many near copies of one text, chains whose ends aren't linked, and outsiders of hot groups."""
    rng = np.random.default_rng(5)
    base = [f"w{i}" for i in rng.integers(0, 10**6, 120)]
    rows = []
    for k in range(300):
        w = list(base)
        for p in rng.choice(120, int(rng.integers(0, 8)), replace=False):
            w[p] = f"e{k}_{p}"
        rows.append((k, " ".join(w)))
    rows += [(1000 + k, " ".join(f"c{i}" for i in range(4 * k, 4 * k + 60))) for k in range(25)]
    sets = {d: shingles(t) for d, t in rows}
    want = least_reachable(sets)
    got = {r["doc_id"]: r["component_id"] for r in dedup.components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want
    assert len(set(want.values())) > 1 and want[1024] == 1000


def test_signature_is_circulant():
    first, windows = dedup._values()
    s = np.array([3, 5 << 60], np.uint64)
    cells = first[(s >> np.uint64(64 - dedup.CELL_BITS)).astype(np.int64)]
    second = windows[:, 0]
    size = len(second)
    want = [min(int(second[(c + k) % size]) for c in cells) for k in range(dedup.COORDINATES)]
    assert dedup.signature(s).tolist() == want
    assert sorted(second.tolist()) == list(range(size))


def test_quotes_sql(spark, duck):
    import random

    import pandas as pd

    random.seed(4)
    rows = []
    for c in range(20):
        said = []
        for t in range(random.randint(1, 10)):
            lines = []
            for k in range(random.randint(0, 4)):
                if said and random.random() < 0.6:
                    lines.append(random.choice(["> ", ">", "> > ", ">>> "]) + random.choice(said))
                else:
                    said.append(random.choice(["Hello", "the  same line", "", f"line {c} {t} {k}"]))
                    lines.append(said[-1])
            rows.append((c, t, "user", "\n".join(lines)))
    con = duck.cursor()
    conversations = pd.DataFrame(rows, columns=["conv_id", "turn", "role", "text"])
    con.register("conversations", conversations)
    got = [tuple(r) for r in quotes.link(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()]
    want = con.sql(f"select conv_id, turn, role, text, parent_turn, thread_turn, depth, n_quoted from ({quotes.SQL})").fetchall()
    assert sorted(map(repr, got)) == sorted(map(repr, want)) and any(r[4] is not None for r in want)


def test_rules_base(spark, texts):
    for r in rules.op3(spark, DATA).collect():
        text = texts[r["doc_id"]]
        w = words(text)
        three = collections.Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        cover = {j for i in range(len(w) - 2) if three[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
        seen, again = set(), 0
        for line in text.split("\n"):
            if words(line):
                again += line in seen
                seen.add(line)
        failed = len(w) < 50 or 100 * len(cover) > 50 * len(w)
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), again, len(cover), failed)
        assert r["kept"] == (not failed and r["rule"] == 0)


def test_rules_learn_a_threshold():
    rng = np.random.default_rng(0)
    x = {"a": rng.random(900), "b": rng.random(900)}
    bad = (x["a"] > 0.7) & (x["b"] < 0.5) | (x["a"] < 0.1)
    found = rules.learn(x, bad, np.arange(900) % 3)
    hit = np.zeros(900, bool)
    for r in found:
        hit |= r.mask(x, 900)
    assert (hit == bad).mean() > 0.97
    assert rules.learn(x, rng.random(900) < 0.5, np.arange(900) % 3) == []  # noise gives no rule


def test_n_best_pieces():
    import random

    random.seed(3)
    seg = pieces.Segmenter(pieces.model_path())
    v = seg.v

    def every(s, i=0):
        if i == len(s):
            yield 0.0, ()
            return
        single = False
        for j in range(i + 1, len(s) + 1):
            if s[i:j] in v.id:
                single |= j == i + 1
                for score, ids in every(s, j):
                    yield score + v.score[s[i:j]], (v.id[s[i:j]], *ids)
        if not single:
            own = pieces._bytes_of(s[i], v)
            for score, ids in every(s, i + 1):
                yield score + v.byte_score * len(own), own + ids

    for text in ["", " ", "hello", "a b", "  x", "日本 aé", "a\n\tb", "😀é z", *("".join(random.choice("etaon é\n") for _ in range(random.randint(1, 10))) for _ in range(60))]:
        want = sorted(every(pieces.marked(text)), key=lambda p: -p[0])[:5]
        got = seg.n_best(seg.learn([text])[0], 5)
        assert [round(s, 6) for s, _ in got] == [round(s, 6) for s, _ in want]
        assert len({ids for _, ids in got}) == len(got)
        assert all(seg.decode(np.frombuffer(ids, "<u4")) == text for _, ids in got)


def test_pieces_round_trip(spark, texts):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    encoded = pieces.encode(docs, n_best=1)
    assert {r["doc_id"]: r["text"] for r in pieces.decode(encoded).collect()} == texts
    rows = pieces.op4(spark, DATA).collect()
    assert all(r["round_trip"] for r in rows) and len(rows) >= 2 * len(texts)


ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def base_spans(text):
    found = [(m.start(), 0, m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(found)


def test_secret_spans(spark):
    odd = ["secret: token = abcdefgh", "token=token=abcdefgh é password = 'hunter22' AKIA" + "B" * 16 + " AKIAAKIA1", "x" * 10 + "0123456789abcdef" * 2 + "g", 'API_KEY: "abc"', "ToKeN:  abcdef", "", None, "apikey==abcdefgh api_key = a:b", "gh" + "p_" + "a1B2" * 10]
    docs = spark.createDataFrame([(i, t, f"s{i}") for i, t in enumerate(odd)], "doc_id long, text string, source string")
    for r in secret_scan.scan(docs).collect():
        want = base_spans(odd[r["doc_id"]] or "")
        assert [(s["start"], s["kind"], s["end"]) for s in r["base"]] == [w[:3] for w in want]
        assert {(s["start"], s["kind"], s["end"]) for s in r["spans"]} >= {w[:3] for w in want}


def test_secret_query(spark, texts):
    for r in secret_scan.op5(spark, DATA).collect():
        want = ",".join(f"{k}:{a}:{b}" for a, _, b, k in base_spans(texts[r["doc_id"]]))
        assert r["base_sha256"] == hashlib.sha256(want.encode()).hexdigest()


def test_secret_ownership(spark):
    value = "Ab1" * 12
    rows = [(i, f"see {value}", f"s{i}") for i in range(5)] + [(9, "mine " + "Zy9" * 12, "s1")]
    got = {r["doc_id"]: len(r["spans"]) for r in secret_scan.scan(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert got == {0: 0, 1: 0, 2: 0, 3: 0, 4: 0, 9: 1}


def test_language_models_are_distributions():
    m = langid.Models({"a": collections.Counter({"abba": 3, "baba": 1}), "b": collections.Counter({"xyzzy": 2})}, order=3)
    alphabet = len(set("abxyz")) + 257
    for j, lang in enumerate(m.langs):
        table = m.tables[0]
        seen = np.exp(table["p"][:, j]).sum() + (alphabet - len(table["h"])) * np.exp(m.unseen[j])
        assert seen == pytest.approx(1, abs=1e-5), lang


def test_language_held_out_accuracy(spark, duck):
    truth = dict(duck.sql("select doc_id, lang from documents").fetchall())
    rows = langid.op6(spark, DATA).collect()
    held = [r for r in rows if r["held_out"]]
    assert all((zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) == r["held_out"] for r in rows)
    assert sum(r["lang_pred"] == truth[r["doc_id"]] for r in held) / len(held) > 0.95
    assert all(0 <= r["score"] <= 1 for r in rows) and sum(r["rejected"] for r in rows) <= 0.05 * len(rows)


def test_packing(spark, texts):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(packing.tokenizer_path())
    ids = {d: whole.encode(t, add_special_tokens=False).ids + [0] for d, t in texts.items()}
    docs, places = collections.defaultdict(list), collections.defaultdict(list)
    for r in packing.op7(spark, DATA).collect():
        docs[r["doc_id"]].append(r)
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    assert docs.keys() == ids.keys()
    for d, rows in docs.items():
        at = 0
        for k, r in enumerate(sorted(rows, key=lambda r: r["piece"])):
            assert (r["piece"], r["start"]) == (k, at)
            part = ids[d][at : at + r["length"]]
            assert zlib.crc32(np.asarray(part, "<u4").tobytes()) == r["ids_crc32"] and len(part) == r["length"] <= 2048 and (k == 0 or r["length"] == 2048)
            at += r["length"]
        assert at == len(ids[d])
    for rows in places.values():
        at = 0
        for offset, length in sorted(rows):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(places) <= -(-sum(map(len, ids.values())) // 2048) * 1.05 + 1


@pytest.mark.parametrize("text", ["a  b", " a", "a ", "a\n b", "a \nb", "x y  z", "it's <|endoftext|> ok", "don't stop", "", "\t\t a", "1 2,3 !! ??"])
def test_encoder_is_the_tokenizer(text):
    e = packing.Encoder(packing.tokenizer_path())
    assert np.frombuffer(e(text), "<u4").tolist() == e.whole.encode(text, add_special_tokens=False).ids


def test_plan_holds_every_piece():
    rng = np.random.default_rng(7)
    for sizes in (rng.integers(1, 101, 500), rng.integers(30, 60, 400), [100] * 7, [51] * 9, [1] * 250, []):
        counts = collections.Counter(int(s) for s in sizes)
        used = collections.Counter()
        n = 0
        for times, content in packing.plan_classes(counts, 100, 6):
            assert sum(a * b for a, b in content) <= 100 and times > 0
            n += times
            for length, k in content:
                used[length] += times * k
        assert used == counts and n <= 1.15 * max(sum(sizes) / 100, 1) + 1 + sum(1 for s in sizes if s > 50)


def test_surrogates(spark, texts):
    found = re.compile(r"[\w.+-]+@[\w.-]+\w|\+1 \(\d{3}\) \d{3}-\d{4}|(?<![\w.])\d+\.\d+\.\d+\.\d+(?!\d)|(?<!\w)\d{16}(?!\w)")
    said = collections.defaultdict(set)
    for r in pii.op8(spark, DATA).collect():
        old = texts[r["doc_id"]]
        before, after = found.findall(old), found.findall(r["text"])
        assert len(before) == len(after) == r["n_entities"] and found.sub("", old) == found.sub("", r["text"])
        for a, b in zip(before, after):
            said[a].add(b)
            assert a not in r["text"]
    assert all(len(v) == 1 for v in said.values())
    new = [next(iter(v)) for v in said.values()]
    assert len(set(new)) == len(new) and not set(new) & set(said)


def test_surrogate_types(spark):
    rows = [(1, "Mr. Smith met John Smith; +1 (743) 555-3824 is (743) 555-3824; card 4111 1111 1111 1111"), (2, "Frau Müller und Anna Müller, 078-05-1120, Мария Петрова"), (3, "nothing here. Dr"), (4, None)]
    got = {r["doc_id"]: r["text"] for r in pii.replace(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    m = re.fullmatch(r"Mr\. (\w+) met (\w+) (\w+); \+1 \((\d{3})\) (\d{3}-\d{4}) is \((\d{3})\) (\d{3}-\d{4}); card (4[\d ]{18})", got[1])
    assert m and m[1] == m[3] and (m[4], m[5]) == (m[6], m[7]) and m[2] in pii.NEW_M.split()
    digits = [int(c) for c in m[8].replace(" ", "")][::-1]
    assert sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(digits)) % 10 == 0
    m = re.fullmatch(r"Frau (\w+) und (\w+) (\w+), 9\d\d-\d\d-\d{4}, ([а-яА-Я]+) ([а-яА-Я]+)", got[2])
    assert m and m[1] == m[3] and m[2] in pii.NEW_F.split() and "Müller" not in got[2]
    assert got[3] == "nothing here. Dr" and got[4] is None


def test_colliding_draws_are_drawn_again(spark):
    units = spark.createDataFrame([("surname", f"name{chr(97 + i % 26)}{chr(97 + i // 26)}") for i in range(200)], "kind string, canon string")
    rows = pii.assign(units)[0].collect()
    assert len({r["new"].lower() for r in rows}) == len(rows) == 200


def test_fingerprints(spark, texts):
    got = {r["doc_id"]: r for r in fingerprints.op9(spark, DATA).collect()}
    order = sorted(texts, reverse=True)
    error = []
    for i, d in enumerate(order):
        text, after = texts[d], texts[order[(i + 1) % len(order)]]
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        r = got[d]
        assert (r["n_chars"], r["edited_sha256"]) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        a, b = shingles(text), shingles(edited)
        error.append(abs(r["near_edited"] - len(a & b) / max(1, len(a | b))))
    assert np.mean(error) < 0.06
    by = collections.defaultdict(set)
    for d, t in texts.items():
        by[t].add(got[d]["fingerprint"])
    assert all(len(v) == 1 for v in by.values())


def test_sketches_merge(spark):
    from pyspark.sql import functions as F

    a, b = " ".join(f"a{i}" for i in range(3000)), " ".join(f"a{i}" for i in range(1000, 1050))
    row = spark.createDataFrame([(a, b)], "a string, b string").select(fingerprints.sketch(F.col("a")).alias("a"), fingerprints.sketch(F.col("b")).alias("b"))
    got = row.select(fingerprints.containment(F.col("b"), F.col("a")), fingerprints.containment(F.col("a"), F.col("b")), fingerprints.merge(F.col("a"), F.col("b")), F.col("a"), F.col("b")).first()
    assert got[0] == 1.0 and got[1] < 0.1 and got[2]["hashes"] == got[3]["hashes"] and got[3]["bound"] == "2" and got[4]["bound"] == "g"


def test_toxicity_held_out(spark, duck):
    truth = dict(duck.sql("select doc_id, toxic from labels").fetchall())
    rows = toxicity.op10(spark, DATA).collect()
    assert all((zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) == r["held_out"] and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows)
    known = [(r["predicted"], truth[r["doc_id"]]) for r in rows if r["doc_id"] in truth]
    assert sum(p == y for p, y in known) / len(known) > 0.9


def test_label_model_weighs_voters():
    rng = np.random.default_rng(1)
    y = rng.random(2000) < 0.3
    votes = np.stack([np.where(rng.random(2000) < p, y, ~y) * 2 - 1 for p in (0.95, 0.9, 0.5, 0.5)], axis=1).astype(np.int8)
    known = np.arange(2000) < 400
    model = toxicity.LabelModel(votes, np.where(known, y, 0.5).astype(float), known, 0.3)
    assert ((model.posterior(votes) >= 0.5) == y).mean() > 0.93
