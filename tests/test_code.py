"""Parser-backed functions on literal code."""

from pyspark.sql import functions as F

from lumenframe.functions import code as C
from lumenframe.functions import text as T

PY = 'class Solution:\n    def add(self, a, b):\n        """Adds."""\n        total_value = a + b  # sum of the two given numbers here\n        return total_value\n'
CPP = "int add(int a, int b) {\n  // x = 1;\n  int total = a + b; /* note */\n  return total;\n}\n"


def test_token_counts_ignore_layout_and_comments():
    assert C.token_count("x = 1", "PYTHON") == C.token_count("x   =  1  # one", "PYTHON") == 3
    assert C.token_count("x = 'a' 'b'", "PYTHON") == C.token_count("x = 'long literal'", "PYTHON") == 3
    assert C.token_count("int a=1;", "CPP") == C.token_count("int a = 1; // c", "CPP") == 5
    assert C.token_count("f(", "PYTHON") is None and C.token_count("int f( {", "CPP") is None and C.token_count("  ", "CPP") is None


def test_comments_and_docstrings_go():
    assert "Adds" not in C.without_comments(PY, "PYTHON") and "#" not in C.without_comments(PY, "PYTHON")
    assert C.without_comments('s = "// no"; // yes', "CPP") == 's = "// no";'


def test_strip_keeps_author_lines():
    stub = "class Solution:\n    def add(self, a, b):\n        pass\n"
    text, targets, helpers, error = C.strip_solution(PY, stub, "PYTHON")
    assert error is None and targets == 1 and helpers == 0 and "total_value = a + b" in text and "class Solution" in text and "pass" not in text
    assert C.strip_solution("x = 1", stub, "PYTHON")[3] == "no_target"
    assert C.strip_solution("def (", stub, "PYTHON")[3] == "parse_error"


def test_strip_goes_by_functions():
    stub = "class Solution:\n    def add(self, a, b):\n        # write\n        res = 0\n        return res\n\nif __name__ == '__main__':\n    print(Solution().add(1, 2))\n"
    raw = "import math\nclass Solution:\n    def helper(self, x):\n        res = 0\n        return res\n    def add(self, a, b):\n        res = 0\n        for i in range(b):\n            res += math.floor(a)  # note\n        return res\n\nif __name__ == '__main__':\n    print(Solution().add(1, 2))\n"
    want = "import math\nclass Solution:\n    def helper(self, x):\n        res = 0\n        return res\n    def add(self, a, b):\n        for i in range(b):\n            res += math.floor(a)"
    assert C.strip_solution(raw, stub, "PYTHON") == (want, 1, 1, None)
    assert C.strip_solution(stub, stub, "PYTHON") == (None, 1, 0, "empty")
    assert C.strip_solution("def add(a, b): return a + b", "def add(a, b): pass", "PYTHON")[0] == "def add(a, b):\n    return a + b"
    stub = "#include <vector>\nclass Solution {\npublic:\n    int add(int a, int b) {\n        return 0;\n    }\n};\nint main() { return 0; }\n"
    raw = "#include <vector>\n#include <map>\nint gcd(int a, int b) { return b ? gcd(b, a % b) : a; }\nclass Solution {\npublic:\n    map<int,int> seen;\n    int add(int a, int b) {\n        int c = a + b; // sum\n        return c;\n    }\n};\nint main() { return 0; }\n"
    text, _, helpers, error = C.strip_solution(raw, stub, "CPP")
    assert error is None and helpers == 0 and "main" not in text and "<vector>" not in text and "<map>" in text and "seen;" in text and "gcd(b" in text and "return c;" in text and "//" not in text


def test_rename_only():
    assert C.rename_only("int a = 1; b = a;", "int x = 1; y = x; // z", "CPP") and not C.rename_only("int a = 1; b = a;", "int x = 1; y = y;", "CPP")
    assert not C.rename_only("return a", "return a + 1", "PYTHON")


def test_lost_parts(spark):
    rows = [("full_program", "int main() { cin >> x; cout << x; }", "f();", ""), ("function_only", "def main(): print(1)", "x", ""), ("function_only", "print(1)", "x", "print(0)"), ("unknown", "void main ()", "x", ""), ("full_program", "raw_code_unavailable", "x", ""), ("unknown", "main(1)", "x", "")]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, c string, r string, s string, b string")
    got = {r["i"]: r["x"] for r in df.select("i", T.lost_parts(F.col("c"), F.col("r"), F.col("s"), F.col("b")).alias("x")).collect()}
    assert got == {0: ["main_or___main__", "input_parsing", "required_output"], 1: ["user_authored_output", "main_not_matching_known_template"], 2: [], 3: ["main_removed_under_unknown_contract"], 4: [], 5: []}


def test_template_comments_explain_nothing():
    assert not C.explanatory("x = 1  # Write your code here", "PYTHON") and C.explanatory("x = 1  # store it here, then", "PYTHON") and not C.explanatory("x = 1  # one two three four", "PYTHON")


def test_style():
    assert C.commented_out(CPP, "CPP") and not C.commented_out(PY, "PYTHON")
    assert C.explanatory(PY, "PYTHON")
    assert C.unused_local("def f():\n    unused = 1\n    return 2", "PYTHON")
    assert C.naming("def f():\n    i = 1\n    max_value = 2\n    return i", "PYTHON") == (0.5, 0.5, 0.5)
    assert C.matching_span("a\nb\nc\nd", "x\nb\nc\ny") == (2, 3, ["b", "c"])
    assert C.matching_span("a\nb", "c\nd") == (None, None, [])


def test_udfs(spark):
    df = spark.createDataFrame([(PY, "PYTHON"), (CPP, "CPP"), ("(", "CPP"), (None, "CPP")], "c string, l string")
    got = df.select(C.parses_udf("c", "l"), C.token_count_udf("c", "l"), C.without_comments_udf("c", "l"), C.style_udf("c", "l"), C.naming_udf("c", "l"), C.strip_udf("c", "c", "l"), C.matching_span_udf("c", "c")).collect()
    assert [r[0] for r in got] == [True, True, False, False] and got[2][1] is None and len(got[0][3]) == 4 and got[1][5]["error"] == "empty"  # all of its body is the stub's


def test_text_functions(spark):
    row = spark.createDataFrame([("x\n```py\na\n```\n```py\nlonger\n```", "maxValue2", "q:1:CPP", "// because we check this now")], "t string, n string, k string, c string")
    got = row.select(T.longest_fenced(F.col("t")), T.name_tokens(F.col("n")), T.split_group_key(F.col("k")), T.is_explanatory(F.col("c")), T.comment_body(F.col("c")), T.signature(F.lit("def go(a: int, b=2):\n  pass"))).first()
    assert got[0] == "longer\n" and got[1] == ["max", "value", "2"] and got[2]["question_id"] == "q:1" and got[3] and got[4] == "because we check this now" and got[5]["params"] == ["a", "b"]
