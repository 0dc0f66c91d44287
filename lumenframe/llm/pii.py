"""PII surrogates, in Spark expressions.

Entities are found by one pattern. Each is broken into units (the digits of a number, an
address, a first name, a surname); equal units get equal surrogates everywhere, so two
spellings of a number and two mentions of a person stay together. A surname that a text
gives after a title or a first name is an entity wherever it stands alone in that text. A
surrogate comes from a keyed hash: digits stay digits, letters stay letters of their script
and case, titles and first names decide the gender of the new first name, and the punctuation
of each mention is kept. Units are counted once over the corpus; those whose surrogates are
shared, or are themselves units of the corpus, are drawn again until none is left. Addresses
and names grow with the draw, so that every shape has room; from draw WIDE_DRAW on
social-security numbers and IP addresses take any leading digit or octet. Numbers keep their
shape, so units that are more than half of all numbers of it (ROOM) can't have surrogates: an
error says so.

Only the key makes a surrogate, so runs with one key over one corpus agree. The key comes
from the setting KEY_CONF; without it a session draws a random one.

Defined results: null texts stay null; texts without entities come back as they were;
repeated rows each come back; an empty table gives no rows; all further columns pass
through unchanged, names that begin with two underscores apart, which are taken.
"""

from __future__ import annotations

import secrets

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe.llm.common import drop_scratch, join_spread, met_by, table, write_scratch
from lumenframe.llm.spans import indexes, let, matches, running

KEY_CONF = "spark.lumenframe.pii.key"
WIDE_DRAW = 24
ROOM = {"phone": 10**10, "ssn": 10**9, "ip": 255 * 256 * 256 * 254}

# Titles and first names that tell a gender, and names to replace them with.
TITLES_M = "Mr Herr Monsieur Señor Signor"
TITLES_F = "Mrs Ms Miss Frau Madame Mme Señora Signora"
TITLES_U = "Dr Prof"
FIRST_M = "James John Robert Michael William David Richard Joseph Thomas Charles Daniel Matthew Peter Paul Hans Karl Jürgen Wolfgang Pierre Jean Jacques Carlos José Juan Luis Miguel Antonio Ivan Иван Сергей"
FIRST_F = "Mary Patricia Jennifer Linda Elizabeth Barbara Susan Jessica Sarah Karen Anna Emma Julia Claudia Sabine Ursula Marie Sophie Isabelle Carmen María Lucía Elena Olga Мария Ольга"
NEW_M = "Adrian Bernard Clement Desmond Edgar Florian Gordon Hector Ivo Julian Konrad Leopold Magnus Norbert Oswald Quentin Rupert Stefan Tobias Valentin"
NEW_F = "Adele Beatrix Celeste Dorothea Edith Flora Greta Helene Ingrid Josefine Klara Leonie Mathilde Nora Ottilie Petra Rosalind Selma Theresa Viola"
NEW_U = "Alexis Blair Casey Devon Emery Frankie Harley Jamie Kerry Lee Morgan Noel Parker Quinn Robin Sage Taylor Val"
NEW_SURNAMES = "Abbott Becker Calder Dorn Ellison Falk Garland Hollis Iversen Jarvis Keller Lindqvist Marlow Norwood Ostrander Pruitt Quill Ravens Sorley Thorne Ulrich Voss Wexler Yates Zeller"

_TITLES = "|".join(f"{TITLES_M} {TITLES_F} {TITLES_U}".split())
_FIRST = "|".join(f"{FIRST_M} {FIRST_F}".split())
_NUM = r"(?<![\p{L}\p{N}])"
_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
_LOCAL = r"A-Za-z0-9._%+\-\u00C0-\uFFDC"
# labels are one class, as a repeated group would need stack for each label
EMAIL = rf"(?<![{_LOCAL}])[{_LOCAL}]++@[\p{{L}}\p{{N}}-][\p{{L}}\p{{N}}.-]*\.\p{{L}}{{2,}}"
PHONE = rf"{_NUM}\+[0-9]{{1,3}}[ .-]?(?:\([0-9]{{2,4}}\)|[0-9]{{2,4}})[ .-]?[0-9]{{3}}[ .-]?[0-9]{{4}}(?![0-9])|{_NUM}\([0-9]{{3}}\) ?[0-9]{{3}}-[0-9]{{4}}(?![0-9])|{_NUM}(?<!-)[0-9]{{3}}-[0-9]{{3}}-[0-9]{{4}}(?![0-9-])"
IP = rf"(?<![\p{{L}}\p{{N}}.])(?:{_OCTET}\.){{3}}{_OCTET}(?![\p{{N}}]|\.[0-9])"
SSN = rf"{_NUM}(?<!-)[0-9]{{3}}-[0-9]{{2}}-[0-9]{{4}}(?![\p{{L}}\p{{N}}-])"
CARD = rf"{_NUM}[0-9](?:[ -]?[0-9]){{12,18}}(?![\p{{L}}\p{{N}}])"
IBAN = rf"{_NUM}[A-Z]{{2}}[0-9]{{2}}(?: ?[A-Z0-9]{{4}}){{3,7}}(?: ?[A-Z0-9]{{1,3}})?(?![\p{{L}}\p{{N}}])"
NAME = rf"(?<=(?<!\p{{L}})(?:{_TITLES})\.? )\p{{Lu}}\p{{Ll}}++(?: \p{{Lu}}\p{{Ll}}++)?|(?<!\p{{L}})(?:{_FIRST}) \p{{Lu}}\p{{Ll}}++"
# What the first character can't begin isn't tried.
PATTERN = rf"{EMAIL}|(?=[0-9+(])(?:{PHONE}|{IP}|{SSN}|{CARD})|(?=\p{{Lu}})(?:{IBAN}|{NAME})"
#: Where a text names someone, words that may be a surname alone are matched too.
WITH_BARE = rf"{PATTERN}|(?<!\p{{L}})(?!(?:{_TITLES})(?!\p{{L}}))\p{{Lu}}\p{{Ll}}++(?!\p{{L}})"
KINDS = ["email", "phone", "ip", "ssn", "card", "iban", "name"]
_ENTITIES = "array<struct<before:string,start:int,end:int,value:string,kind:string,units:array<struct<kind:string,canon:string>>>>"


def _kind(v: Column) -> Column:
    return (
        F.when(F.contains(v, F.lit("@")), "email").when(v.rlike(r"^[0-9]+(\.[0-9]+){3}$"), "ip").when(v.rlike(r"^[0-9]{3}-[0-9]{2}-[0-9]{4}$"), "ssn")
        .when(v.rlike(r"^[+(]|^[0-9]{3}-[0-9]{3}-[0-9]{4}$"), "phone").when(v.rlike(r"^[0-9 -]+$"), "card").when(v.rlike(r"^[A-Z]{2}[0-9]"), "iban").otherwise("name")
    )


def _in(word: Column, words: str) -> Column:
    return word.isin(*(w.lower() for w in words.split()))


def _units(kind: Column, v: Column, before: Column) -> Column:
    unit = lambda k, c: F.struct(F.lit(k).alias("kind") if isinstance(k, str) else k.alias("kind"), c.alias("canon"))
    digits = F.regexp_replace(v, "[^0-9]", "")
    first, last = F.lower(F.regexp_extract(v, r"^(\p{L}+) ", 1)), F.lower(F.regexp_extract(v, r"(\p{L}+)$", 1))
    title = F.lower(F.regexp_extract(before, rf"({_TITLES})\.? $", 1))
    gender = F.when(_in(title, TITLES_M) | (title.eqNullSafe("") | _in(title, TITLES_U)) & _in(first, FIRST_M), "first_m").when(_in(title, TITLES_F) | (title.eqNullSafe("") | _in(title, TITLES_U)) & _in(first, FIRST_F), "first_f").otherwise("first_u")
    names = F.when(first == "", F.array(unit("surname", last))).otherwise(F.array(unit(gender, first), unit("surname", last)))
    return (
        F.when(kind == "name", names).when(kind == "phone", F.array(unit("phone", F.right(digits, F.lit(10))))).when(kind.isin("card", "ssn"), F.array(unit(kind, digits)))
        .when(kind == "iban", F.array(unit("iban", F.replace(v, F.lit(" "), F.lit(""))))).when(kind == "email", F.array(unit("email", F.lower(v)))).otherwise(F.array(unit("ip", v)))
    )


def entities(text: Column) -> Column:
    """array<struct(before, start, end, value, kind, units)> of a text; a word of kind "bare" counts where its text names that person."""

    def one(m: Column, bare: bool) -> Column:
        kind = _kind(m["value"])
        if bare:
            title = F.regexp_extract(m["before"], rf"(?<!\p{{L}})(?:{_TITLES})\.? $", 0)
            kind = F.when(m["value"].rlike(r"^\p{Lu}\p{Ll}+$") & (title == ""), "bare").otherwise(kind)
        units = lambda k: F.when(k == "bare", F.array(F.struct(k.alias("kind"), F.lower(m["value"]).alias("canon")))).otherwise(_units(k, m["value"], m["before"]))
        return let(kind, lambda k: F.struct(m["before"].alias("before"), m["start"].alias("start"), m["end"].alias("end"), m["value"].alias("value"), k.alias("kind"), units(k).alias("units")))

    found = lambda pattern, bare: F.transform(matches(text, pattern), lambda m: one(m, bare)).cast(_ENTITIES)
    return F.when(text.rlike(NAME), found(WITH_BARE, True)).otherwise(found(PATTERN, False))


def _pick(names: str, h: Column) -> Column:
    words = names.split()
    return F.element_at(F.array(*(F.lit(w) for w in words)), (F.conv(F.substring(h, 1, 12), 16, 10).cast("long") % len(words) + 1).cast("int"))


def _syllables(canon: Column, h: Column, draw: Column) -> Column:
    """A name of three syllables in the script of canon, and two more for each draw after the first."""
    sets = {"latin": ("bdfgklmnprstvzhj", "aeiouaeiouaeioua"), "cyrillic": ("бвгдзклмнпрстфжш", "аеиоуаеиоуаеиоуа"), "greek": ("βγδζθκλμνπρστφχψ", "αεηιοαεηιοαεηιοα")}
    hexes = "0123456789abcdef"
    more = F.least(F.greatest(draw - 1, F.lit(0)) * 4, F.lit(96))
    letter = lambda i, a, b: F.when(i % 2 == 0, F.translate(F.substring(h, i + 13, F.lit(1)), hexes, a)).otherwise(F.translate(F.substring(h, i + 13, F.lit(1)), hexes, b))
    word = lambda a, b: F.array_join(F.transform(indexes(more + 7), lambda i: letter(i, a, b)), "")
    made = {k: word(*v) for k, v in sets.items()}
    return F.initcap(F.when(canon.rlike(r"\p{IsCyrillic}"), made["cyrillic"]).when(canon.rlike(r"\p{IsGreek}"), made["greek"]).otherwise(made["latin"]))


def _shape(canon: Column, h: Column, keep: int = 0) -> Column:
    """canon with digits and letters drawn anew from h; the first `keep` characters and all punctuation stay."""
    hexes = "0123456789abcdef"

    def char(c: Column, i: Column) -> Column:
        x = F.substring(h, i % F.lit(120) + 1, F.lit(1))
        letter = F.translate(x, hexes, "aeioubdglmnprstv")
        other = F.when(c.rlike(r"\p{IsCyrillic}"), F.translate(x, hexes, "аеиоубвгдзклмнпр")).when(c.rlike(r"\p{IsGreek}"), F.translate(x, hexes, "αεηιοβγδζθκλμνπρ")).otherwise(letter)
        drawn = F.when(c.rlike("[0-9]"), F.translate(x, "abcdef", "258147")).when(c.rlike(r"\p{Lu}"), F.upper(other)).when(c.rlike(r"\p{L}"), other).otherwise(c)
        return F.when(i < keep, c).otherwise(drawn) if keep else drawn

    return F.array_join(F.transform(F.split(canon, ""), char), "")


def _luhn(digits: Column) -> Column:
    """The sum that Luhn's rule takes modulo 10."""
    n = F.length(digits)
    each = F.transform(indexes(n), lambda i: let(F.substring(digits, n - i, F.lit(1)).cast("int") * (i % 2 + 1), lambda d: F.when(d > 9, d - 9).otherwise(d)))
    return F.aggregate(each, F.lit(0), lambda a, x: a + x) % 10


def _checked(canon: Column, drawn: Column) -> Column:
    """drawn, with a last digit that makes it pass where canon passes."""
    body = F.substring(drawn, F.lit(1), F.length(drawn) - 1)
    return F.when(_luhn(canon) == 0, let(body, lambda b: F.concat(b, ((10 - _luhn(F.concat(b, F.lit("0")))) % 10).cast("string")))).otherwise(drawn)


def surrogate(kind: Column, canon: Column, draw: Column, key: str) -> Column:
    h = F.sha2(F.concat_ws("|", F.lit(key), kind, canon, draw.cast("string")).cast("binary"), 512)

    def made(h: Column) -> Column:
        number = lambda a, span, base: (F.conv(F.substring(h, a, 6), 16, 10).cast("long") % span + base).cast("string")
        top = F.regexp_extract(canon, r"\.(com|org|net)$", 1)
        email = F.concat(_shape(F.substring_index(canon, "@", 1), h), F.translate(F.substring(h, F.lit(41), draw * 4), "0123456789abcdef", "aeioubdglmnprstv"), F.lit("@"), _shape(F.regexp_extract(canon, r"@([^.]+)", 1), F.reverse(h)), F.lit(".example."), F.when(top == "", "com").otherwise(top))
        name = lambda names: F.when(draw == 0, F.when(canon.rlike(r"^[\p{IsLatin}]+$"), _pick(names, h)).otherwise(_syllables(canon, h, draw))).otherwise(_syllables(canon, h, draw))
        return (
            F.when(kind == "email", email).when(kind == "ip", F.concat_ws(".", F.when(draw < WIDE_DRAW, number(1, 15, 240)).otherwise(number(1, 255, 1)), number(9, 256, 0), number(17, 256, 0), number(25, 254, 1)))
            .when(kind == "phone", _shape(canon, h)).when(kind == "card", _checked(canon, _shape(canon, h, 1))).when(kind == "ssn", F.concat(F.when(draw < WIDE_DRAW, F.lit("9")).otherwise(F.substring(_shape(canon, h), 1, 1)), F.substring(_shape(canon, h), 2, 8)))
            .when(kind == "iban", _shape(canon, h, 2)).when(kind == "first_m", name(NEW_M)).when(kind == "first_f", name(NEW_F)).when(kind == "first_u", name(NEW_U)).otherwise(name(NEW_SURNAMES))
        )

    return let(h, made)


def key_of(spark: SparkSession) -> str:
    """The key in KEY_CONF; where none is set, a random one for the rest of the session."""
    key = spark.conf.get(KEY_CONF, None)
    if not key:
        key = secrets.token_hex(32)
        spark.conf.set(KEY_CONF, key)
    return key


def assign(units: DataFrame, key: str | None = None) -> tuple[DataFrame, list[str]]:
    """(kind, canon, uses, new) for units: new differs for different units of a kind and from every unit of the corpus.

    A round draws for the units that are left, keeps what meets neither a unit, nor an
    earlier round's surrogate, nor one of its own that goes to another unit."""
    spark = units.sparkSession
    key = key or key_of(spark)
    real, real_path = write_scratch(units.groupBy("kind", "canon").agg(F.count("*").alias("uses")), "units")
    for r in real.where(F.col("kind").isin(*ROOM)).groupBy("kind").count().collect():
        if 2 * r["count"] > ROOM[r["kind"]]:
            raise ValueError(f"{r['count']} units of kind {r['kind']} are more than half of all numbers of their shape")
    taken = real.select("kind", F.lower("canon").alias("low"))
    left, done, paths, spare = real.withColumn("draw", F.lit(0)), None, [real_path], []
    while True:
        now, path = write_scratch(left.withColumn("new", surrogate(F.col("kind"), F.col("canon"), F.col("draw"), key)).withColumn("low", F.lower("new")), "drawn")
        winner = now.groupBy("kind", "low").agg(F.min("canon").alias("canon"))
        lows = now.select("kind", "low").distinct()
        meets = met_by(taken if done is None else taken.unionByName(done.select("kind", "low")), lows, ["kind", "low"]).distinct()
        fine, fine_path = write_scratch(now.join(winner, ["kind", "low", "canon"], "left_semi").join(meets, ["kind", "low"], "left_anti").select("kind", "canon", "uses", "new", "low"), "fine")
        done = fine if done is None else done.unionByName(fine)
        paths.append(fine_path)
        rest, rest_path = write_scratch(now.join(fine, ["kind", "canon"], "left_anti").select("kind", "canon", "uses", (F.col("draw") + 1).alias("draw")), "again")
        drop_scratch(spark, path, *spare)
        left, spare = rest, [rest_path]
        if rest.isEmpty():
            drop_scratch(spark, rest_path)
            return done.drop("low"), paths


def _mention(e: Column, news: Column) -> Column:
    """The value of an entity with its units' surrogates, in its own punctuation."""
    v, new = e["value"], F.get(news, F.lit(0))
    payload = F.when(e["kind"] == "iban", "[A-Z0-9]").otherwise("[0-9]")

    def filled(start: Column) -> Column:
        """From the start-th payload character on, payload characters are replaced by those of new."""

        def char(c: Column, i: Column) -> Column:
            at = F.length(F.regexp_replace(F.substring(v, F.lit(1), i + 1), F.when(e["kind"] == "iban", "[^A-Z0-9]").otherwise("[^0-9]"), F.lit(""))) - start
            return F.when(F.regexp_like(c, payload) & (at > 0), F.substring(new, at, F.lit(1))).otherwise(c)

        return F.array_join(F.transform(F.split(v, ""), char), "")

    extra = F.greatest(F.length(F.regexp_replace(v, "[^0-9]", "")) - 10, F.lit(0))
    return F.when(e["kind"].isin("email", "ip"), new).when(e["kind"] == "name", F.array_join(news, " ")).when(e["kind"] == "phone", filled(extra)).otherwise(filled(F.lit(0)))


def replace(docs: DataFrame, key: str | None = None, text_col: str = "text", entities_col: str = "entities") -> DataFrame:
    """docs with surrogates in text_col and a column entities_col: array of struct(start, end, kind) in the old text."""
    columns = docs.columns
    has = F.coalesce(F.col(text_col).rlike(PATTERN), F.lit(False))
    place = "array<struct<start:int,end:int,kind:string>>"
    others = [F.col(f"`{c}`") for c in columns if c != text_col]
    found = docs.where(has).withColumn("__e", entities(F.col(text_col))).withColumn("__tail", F.substring(F.col(text_col), F.element_at("__e", -1)["end"] + 1, F.length(text_col)))
    found, _ = write_scratch(found.select(*others, "__e", "__tail").withColumn("__uid", F.monotonically_increasing_id()), "pii")
    each = found.select("__uid", F.posexplode("__e.units").alias("p", "units")).select("__uid", "p", F.posexplode("units").alias("u", "unit")).select("__uid", "p", "u", "unit.kind", "unit.canon")
    named = each.where("kind = 'surname'").select("__uid", "canon", F.lit(True).alias("__named")).distinct()
    bare = each.where("kind = 'bare'").join(named, ["__uid", "canon"], "left").withColumn("kind", F.when(F.col("__named"), "surname"))
    units, units_path = write_scratch(each.where("kind != 'bare'").unionByName(bare.drop("__named")), "mentions")
    new, paths = assign(units.where(F.col("kind").isNotNull()), key)
    drawn = join_spread(units, new.select("kind", "canon", "new"), ["kind", "canon"], new, "uses", ["__uid", "p"], "left")
    mapped = drawn.groupBy("__uid").agg(F.array_sort(F.collect_list(F.struct("p", "u", "new"))).alias("__new"))  # of one text, a row for each unit
    joined = found.join(mapped, "__uid")

    def rebuild(p: Column) -> Column:
        """Every entity after the text before it; the first of its units stands at its running sum of them."""

        def said(at: Column) -> Column:
            news = lambda e, i: F.transform(e["units"], lambda _, j: F.get(p["new"], F.get(at, i) + j)["new"])
            return F.transform(p["e"], lambda e, i: let(news(e, i), lambda n: F.struct(e["start"].alias("start"), e["end"].alias("end"), F.when(e["kind"] == "bare", F.when(F.get(n, F.lit(0)).isNotNull(), "name")).otherwise(e["kind"]).alias("kind"), F.concat(e["before"], F.when(e["kind"] == "bare", F.coalesce(F.get(n, F.lit(0)), e["value"])).otherwise(_mention(e, n))).alias("said"))))

        return let(running(F.transform(p["e"], lambda e: F.size(e["units"]))), said)

    keep = [F.col(f"`{c}`") for c in columns]
    made = joined.withColumn("__said", let(F.struct(F.col("__e").alias("e"), F.col("__new").alias("new")), rebuild))
    kept = F.filter("__said", lambda e: e["kind"].isNotNull())
    changed = made.withColumn(text_col, F.concat(F.array_join(F.transform("__said", lambda e: e["said"]), ""), F.col("__tail")))
    changed = changed.select(*keep, F.transform(kept, lambda e: F.struct(e["start"], e["end"], e["kind"])).cast(place).alias(entities_col))
    return docs.where(~has).select(*keep, F.array().cast(place).alias(entities_col)).unionByName(changed)


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = replace(table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda k: F.size(F.filter("entities", lambda e: e["kind"] == k)).cast("long").alias(f"n_{k}")
    said = F.array_join(F.transform("entities", lambda e: F.concat_ws(":", e["kind"], e["start"], e["end"])), ",")
    return out.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.size("entities").cast("long").alias("n_entities"), *map(count, KINDS), said.alias("entities"))
