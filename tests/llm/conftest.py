import pytest

LOREM = "the quick brown fox jumps over the lazy dog while seven wizards quietly mix old potions under a pale moon and nobody asks why"
CLASH = "component_id kept n_words spans entities score rank bands length piece lang_pred fingerprint count uid"


@pytest.fixture(scope="session")
def edge_dir(spark, tmp_path_factory):
    """Tables with nulls, empty and very long texts, ties, repeated rows, and further columns whose names clash."""
    d = tmp_path_factory.mktemp("edge")
    long = " ".join(f"w{i % 977}x{i % 31}" for i in range(60_000))
    token = 'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962"'
    texts = [None, "", "  \n\t ", "a", LOREM, LOREM, LOREM.upper(), LOREM + " extra", long, long + " tail", "x" * 50_000, f"{LOREM} {token} call +1 (743) 555-3824 or a.b@c.example.com", "日本語 テキスト", "12345 !!! ...", "don't stop now", "<|endoftext|> and <|endoftext|>", " ".join(f"word{i} stands" for i in range(60))]
    rows = [(i, t, ["en", "fr", None][i % 3], None if i % 5 == 4 else f"src{i % 3}", None if t is None else len(t)) for i, t in enumerate(texts)]
    rows += [rows[4], rows[4], (None, LOREM + " no id", "en", "src0", 5), (None, None, None, None, None)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    extra = ", ".join(f"{c} string" for c in CLASH.split())
    df = spark.createDataFrame([r + ("z",) * len(CLASH.split()) for r in rows], f"{schema}, {extra}")
    df.repartition(3).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(4, 1, 0), (4, 1, 0), (8, 0, 1), (None, 1, 1), (11, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, 0, "u", "hello there"), (1, 1, "a", "> hello  There\nyes"), (1, 2, "u", ">> hello there\n> yes\nok"), (1, 2, "u", ">> hello there\n> yes\nok"), (None, 1, "u", "> x"), (2, None, None, None)], "conv_id long, turn long, role string, text string").write.parquet(f"{d}/conversations.parquet")
    return str(d)


@pytest.fixture(scope="session")
def empty_dir(spark, edge_dir, tmp_path_factory):
    d = tmp_path_factory.mktemp("empty")
    for t in ("documents", "labels", "conversations"):
        spark.read.parquet(f"{edge_dir}/{t}.parquet").limit(0).write.parquet(f"{d}/{t}.parquet")
    return str(d)
