"""Text functions as Spark expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FENCE = "(?s)```[A-Za-z0-9+#-]*\\n(.*?)```"
# Cues of explanatory prose; comments of templates.
CUES = ["the", "this", "that", "we", "then", "because", "which", "using", "here", "first", "checks", "ensures", "iterate", "store", "avoid", "from", "into", "with"]
BOILERPLATE_COMMENTS = ["write your code here", "write your code here..."]
# Patterns of an entry point, of reading, of writing and of imports.
MAIN_PATTERN = r"(?m)\b(int|void)\s+main\s*\(|if\s+__name__\s*==|def\s+main\s*\("
INPUT_PATTERN = r"\bcin\b|\bscanf\s*\(|\bgetline\s*\(|\bstd::cin\b|\binput\s*\(|sys\.stdin"
OUTPUT_PATTERN = r"\bcout\b|\bprintf\s*\(|\bputs\s*\(|\bstd::cout\b|\bprint\s*\(|sys\.stdout"
INCLUDE_PATTERN = r"(?m)^\s*#\s*include\b|^\s*import\b|^\s*from\s+\S+\s+import\b"
BUILTIN_NAMES = ["self", "cls", "solution", "true", "false", "none", "null", "int_max", "int_min"]


def text_hash(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def cache_key(model: Column, text: Column) -> Column:
    """The address of a text's vector."""
    return F.sha2(F.concat_ws("|", model, F.lit("document"), text).cast("binary"), 256)


def opaque_user(user: Column, salt: str) -> Column:
    return F.when(F.trim(user) != "", F.sha2(F.concat_ws("|", F.lit(salt), user), 256))


def fingerprint(identity: Column) -> Column:
    return F.substring(F.sha2(identity.cast("string"), 256), 1, 12)


def parse_record_id(identity: Column) -> Column:
    """struct(prefix, index, key) of `prefix|index|key`."""
    p = F.split(identity, r"\|")
    return F.struct(F.get(p, F.lit(0)).alias("prefix"), F.get(p, F.lit(1)).try_cast("int").alias("index"), F.get(p, F.lit(2)).alias("key"))


def split_group_key(key: Column) -> Column:
    """struct(question_id, language), cut at the last colon."""
    return F.struct(F.regexp_extract(key, "^(.*):([^:]*)$", 1).alias("question_id"), F.regexp_extract(key, "^(.*):([^:]*)$", 2).alias("language"))


def normalised_lightly(text: Column) -> Column:
    """Lines without trailing blanks, no blank edges, runs of blank lines as one."""
    lines = F.regexp_replace(F.regexp_replace(text, "\r\n?", "\n"), r"[ \t]+(?=\n|$)", "")
    return F.regexp_replace(F.regexp_replace(lines, r"^\n+|\n+$", ""), r"\n{3,}", "\n\n")


def comparable(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"(?m)[ \t]+$", ""))


def dedented(text: Column, width: int) -> Column:
    return F.regexp_replace(text, rf"(?m)^ {{{width}}}", "")


def parsable_python(text: Column) -> Column:
    """Slashes that begin a line become a comment of the same length."""
    return F.regexp_replace(text, r"(?m)^([ \t]*)//", "$1# ")


def longest_fenced(text: Column) -> Column:
    """The longest fenced block, the first of equals; null without one."""
    blocks = F.regexp_extract_all(text, F.lit(FENCE), F.lit(1))
    ranked = F.array_sort(F.transform(blocks, lambda x, i: F.struct((-F.length(x)).alias("l"), i.alias("i"), x.alias("x"))))
    return F.get(ranked, F.lit(0))["x"]


def detect_logic(text: Column) -> Column:
    """struct(has_main, reads_input, writes_output)."""
    return F.struct(text.rlike(MAIN_PATTERN).alias("has_main"), text.rlike(INPUT_PATTERN).alias("reads_input"), text.rlike(OUTPUT_PATTERN).alias("writes_output"))


def excerpt(text: Column, pattern: str, around: int = 40) -> Column:
    """The first match with what stands around it, white space as single spaces."""
    at = F.regexp_instr(text, F.lit(pattern))
    found = F.regexp_extract(text, pattern, 0)
    start = F.greatest(at - around, F.lit(1))
    part = F.substring(text, start, at - start + F.length(found) + around)
    return F.when(at > 0, F.trim(F.regexp_replace(part, r"\s+", " ")))


def name_tokens(name: Column) -> Column:
    """Lower-case tokens of a snake or camel name."""
    snake = F.filter(F.split(name, "_"), lambda x: x != "")
    camel = F.regexp_extract_all(name, F.lit(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+"), F.lit(0))
    return F.transform(F.when(name.contains("_"), snake).otherwise(camel), F.lower)


def is_descriptive(name: Column) -> Column:
    return F.size(F.filter(name_tokens(name), lambda t: F.length(t) >= 3)) >= 2


def is_explanatory(comment: Column) -> Column:
    words = F.regexp_extract_all(F.lower(comment), F.lit("[a-z]+"), F.lit(0))
    n = F.size(words)
    template = F.lower(F.trim(comment_body(comment))).isin(*BOILERPLATE_COMMENTS)
    return ~template & ((n >= 5) | ((n >= 4) & comment.rlike(r"[.!?:;,]") & F.arrays_overlap(words, F.array(*(F.lit(c) for c in CUES)))))


def comment_body(comment: Column) -> Column:
    return F.trim(F.regexp_replace(comment, r"^\s*(?://+|#+|/\*+)|\*+/\s*$", ""))


def skips_name(name: Column) -> Column:
    return ~name.rlike("^[A-Za-z_][A-Za-z0-9_]*$") | F.lower(name).isin(*BUILTIN_NAMES) | name.rlike("^__.*__$")


def content_lines(code: Column) -> Column:
    """array<struct(number, line)>: lines, from 1, that aren't blank or wrappers."""
    lines = F.transform(F.split(code, "\n"), lambda x, i: F.struct((i + 1).alias("number"), F.trim(x).alias("line")))
    return F.filter(lines, lambda x: (x["line"] != "") & ~is_wrapper(x["line"]))


def is_wrapper(line: Column) -> Column:
    return F.replace(line, F.lit(" "), F.lit("")).isin("{", "}", "};", "public:", "classsolution", "classsolution:", "classsolution{")


def signature(code: Column) -> Column:
    """struct(name, params array) of the first Python or C++ function."""
    py, cpp = r"(?m)^\s*def\s+([A-Za-z_]\w*)\s*\(([^)]*)\)", r"(?m)^\s*[A-Za-z_][\w:<>,&\*\s]*?\b([A-Za-z_]\w*)\s*\(([^)]*)\)\s*(?:const\s*)?\{"
    pick = lambda i: F.when(code.rlike(py), F.regexp_extract(code, py, i)).otherwise(F.regexp_extract(code, cpp, i))
    names = F.filter(F.transform(F.split(pick(2), ","), lambda p: F.regexp_extract(F.regexp_replace(p, r"[:=].*$", ""), r"([A-Za-z_]\w*)\s*$", 1)), lambda x: x != "")
    return F.struct(pick(1).alias("name"), names.alias("params"))


def removal_issues(stripped: Column, contract: Column) -> Column:
    """What a stripped text should no longer have, as a list of issue names."""
    logic = detect_logic(stripped)
    rules = [
        F.when(logic["has_main"] & (contract == "function_only"), "main_left"),
        F.when(logic["reads_input"] & (contract == "function_only"), "input_left"),
        F.when(stripped.rlike(INCLUDE_PATTERN), "imports_left"),
        F.when(stripped.rlike(r"//|/\*|(?m)^\s*#(?!include)"), "comments_left"),
        F.when(stripped.rlike(r"\n{3,}"), "blank_runs"),
        F.when(F.trim(stripped) == "", "empty"),
    ]
    return F.array_compact(F.array(*rules))


def lost_parts(contract: Column, raw: Column, stripped: Column, boilerplate: Column, unavailable: str = "raw_code_unavailable") -> Column:
    """What stripping took from the raw text though its contract keeps it, as a list of issue names; none for an unavailable text.

    A full program keeps its entry point, reading and writing; a function keeps the author's
    own writing, and an entry point that no template brought; an unknown contract its entry point."""
    had, has, given = detect_logic(raw), detect_logic(stripped), detect_logic(boilerplate)
    gone = lambda part: had[part] & ~has[part]
    full, function, unknown = (contract == c for c in ("full_program", "function_only", "unknown"))
    rules = [
        F.when(full & gone("has_main"), "main_or___main__"),
        F.when(full & gone("reads_input"), "input_parsing"),
        F.when(full & gone("writes_output"), "required_output"),
        F.when(function & gone("writes_output") & ~given["writes_output"], "user_authored_output"),
        F.when(function & gone("has_main") & ~(given["has_main"] | given["reads_input"] | given["writes_output"]), "main_not_matching_known_template"),
        F.when(unknown & gone("has_main"), "main_removed_under_unknown_contract"),
    ]
    none = F.array().cast("array<string>")
    return F.when(raw == unavailable, none).otherwise(F.coalesce(F.array_compact(F.array(*rules)), none))


def fatal_quota_error(status: Column, message: Column) -> Column:
    return status.isin(402, 403) | F.lower(F.coalesce(message, F.lit(""))).rlike("insufficient|quota|credit")


def prompt(*parts: Column) -> Column:
    return F.array_join(F.filter(F.array(*parts), lambda p: F.trim(p) != ""), "\n\n")
