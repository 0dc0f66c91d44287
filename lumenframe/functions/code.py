"""Functions over source code. They need a parser, so they are Arrow-batched Pandas UDFs.

Python is read by the standard ast and tokenize modules; C++ by a small lexer with bracket
balance. A real grammar can differ for code with errors and for some literals; counts of
such code may differ by a few tokens.
"""

from __future__ import annotations

import ast
import bisect
import difflib
import io
import keyword
import re
import tokenize
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from lumenframe.functions.text import BOILERPLATE_COMMENTS, CUES

_CPP = re.compile(r"""(?P<comment>//[^\n]*|/\*.*?\*/)|(?P<literal>(?:u8|[uUL])?R"\((?:.|\n)*?\)"|(?:u8|[uUL])?"(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])*')|(?P<word>[A-Za-z_]\w*)|(?P<number>\.?\d(?:[\w.']|[eEpP][+-])*)|(?P<mark><<=|>>=|->\*|\.\.\.|::|->|\+\+|--|<<|>>|<=|>=|==|!=|&&|\|\||[-+*/%&|^=]=|[^\s\w])""", re.S)
CUE_WORDS = frozenset(CUES)
_PAIRS = {")": "(", "]": "[", "}": "{"}
_SLASHES = re.compile(r"(?m)^([ \t]*)//")
_TRIVIA = {tokenize.COMMENT, tokenize.NL, tokenize.NEWLINE, tokenize.INDENT, tokenize.DEDENT, tokenize.ENDMARKER, tokenize.ENCODING}


def _cpp_tokens(code: str) -> list[tuple[str, str]] | None:
    """(kind, text) with comments; None if brackets don't balance."""
    out, stack = [], []
    for m in _CPP.finditer(code):
        kind, text = m.lastgroup or "", m.group()
        if kind == "mark":
            if text in "([{":
                stack.append(text)
            elif text in _PAIRS and (not stack or stack.pop() != _PAIRS[text]):
                return None
            elif text in "\"'":
                return None
        out.append((kind, text))
    return None if stack else out


def _python_tree(code: str) -> ast.Module | None:
    try:
        return ast.parse(_SLASHES.sub(r"\1# ", code))
    except (SyntaxError, ValueError, RecursionError):
        return None


def parses(code: str | None, language: str | None) -> bool:
    if not code or not code.strip():
        return False
    return _python_tree(code) is not None if (language or "").upper() == "PYTHON" else _cpp_tokens(code) is not None


def token_count(code: str | None, language: str | None) -> int | None:
    """Leaves that aren't comments; a literal is one; null for blank or broken code."""
    if not parses(code, language):
        return None
    if (language or "").upper() != "PYTHON":
        return sum(kind != "comment" for kind, _ in _cpp_tokens(code or "") or [])
    n, in_string, last = 0, 0, None
    for t in tokenize.generate_tokens(io.StringIO(_SLASHES.sub(r"\1# ", code or "")).readline):
        name = tokenize.tok_name[t.type]
        if name == "FSTRING_START":
            n += in_string == 0 and last != "STRING"
            in_string += 1
        elif name == "FSTRING_END":
            in_string -= 1
            last = "STRING"
            continue
        elif t.type in _TRIVIA or in_string:
            continue
        elif t.type == tokenize.STRING:
            n += last != "STRING"  # neighbours are one literal
        else:
            n += 1
        last = "STRING" if name in ("STRING", "FSTRING_START") else name
    return n


def without_comments(code: str | None, language: str | None) -> str | None:
    """Comments and docstrings blanked, lines kept, then lightly normalised."""
    if not parses(code, language):
        return None
    chars = list(code or "")
    lines = (code or "").split("\n")
    starts = [0]
    for line in lines:
        starts.append(starts[-1] + len(line) + 1)

    def blank(a: int, b: int) -> None:
        for i in range(a, min(b, len(chars))):
            if chars[i] != "\n":
                chars[i] = " "

    if (language or "").upper() == "PYTHON":
        source = _SLASHES.sub(r"\1# ", code or "")
        for t in tokenize.generate_tokens(io.StringIO(source).readline):
            if t.type == tokenize.COMMENT:
                blank(starts[t.start[0] - 1] + t.start[1], starts[t.end[0] - 1] + t.end[1])
        for node in ast.walk(ast.parse(source)):
            body = getattr(node, "body", None)
            if isinstance(body, list) and body and isinstance(body[0], ast.Expr) and isinstance(body[0].value, ast.Constant) and isinstance(body[0].value.value, str) and isinstance(node, (ast.Module, ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                doc = body[0]
                column = lambda line, offset: len(source.split("\n")[line - 1].encode()[:offset].decode())
                blank(starts[doc.lineno - 1] + column(doc.lineno, doc.col_offset), starts[doc.end_lineno - 1] + column(doc.end_lineno, doc.end_col_offset))
    else:
        for m in _CPP.finditer(code or ""):
            if m.lastgroup == "comment":
                blank(*m.span())
    text = "\n".join(x.rstrip() for x in "".join(chars).split("\n")).strip("\n")
    return re.sub(r"\n{3,}", "\n\n", text)


@dataclass
class Node:
    """A statement or member, by character offsets; `body` is where the lines of a function or class begin."""

    kind: str  # function, class or other
    name: str
    start: int
    end: int
    body: int = 0
    body_end: int = 0
    members: list[Node] = field(default_factory=list)


def _python_nodes(code: str) -> list[Node] | None:
    tree = _python_tree(code)
    if tree is None:
        return None
    source = _SLASHES.sub(r"\1# ", code)
    lines = source.split("\n")
    starts = [0]
    for line in lines:
        starts.append(starts[-1] + len(line) + 1)
    at = lambda row, column: starts[row - 1] + len(lines[row - 1].encode()[:column].decode())
    marks = [(starts[t.start[0] - 1] + t.start[1], t.string) for t in tokenize.generate_tokens(io.StringIO(source).readline) if t.type == tokenize.OP]

    def colon(start: int) -> int:
        """The end of the signature that begins at start."""
        depth = 0
        for pos, mark in marks[bisect.bisect_left(marks, (start, "")) :]:
            depth += (mark in "([{") - (mark in ")]}")
            if mark == ":" and depth == 0:
                return pos + 1
        return start

    def nodes(body: list[ast.stmt]) -> list[Node]:
        out = []
        for s in body:
            kind = "function" if isinstance(s, (ast.FunctionDef, ast.AsyncFunctionDef)) else "class" if isinstance(s, ast.ClassDef) else "other"
            start, end = at(s.lineno, s.col_offset), at(s.end_lineno, s.end_col_offset)
            node = Node(kind, getattr(s, "name", ""), start, end)
            if kind != "other":
                node.body, node.body_end = colon(start), end
                node.members = nodes(s.body) if kind == "class" else []
                node.start = min([start, *(at(d.lineno, d.col_offset) - 1 for d in s.decorator_list)])
            out.append(node)
        return out

    return nodes(tree.body)


def _cpp_nodes(code: str, a: int = 0, b: int | None = None) -> list[Node]:
    tokens = [m for m in _CPP.finditer(code, a, len(code) if b is None else b) if m.lastgroup != "comment"]
    out, k = [], 0
    while k < len(tokens):
        first = tokens[k]
        if first.group() == "#":  # a directive takes its line
            line = code.find("\n", first.start())
            end = len(code) if line < 0 else line
            out.append(Node("other", "", first.start(), end))
            while k < len(tokens) and tokens[k].start() < end:
                k += 1
            continue
        if first.group() in ("public", "private", "protected") and k + 1 < len(tokens) and tokens[k + 1].group() == ":":
            out.append(Node("other", "", first.start(), tokens[k + 1].end()))
            k += 2
            continue
        depth, paren, brace, assigned, kind, j = 0, None, None, False, "other", k
        close = first
        while j < len(tokens):
            t = tokens[j].group()
            if depth == 0 and brace is None:
                paren = j if t == "(" and paren is None else paren
                assigned |= t == "="
                if t == "{":
                    brace = tokens[j]
                    header = code[first.start() : brace.start()]
                    if paren is None and re.match(r"(?:template\s*<[^{}]*>\s*)?(?:class|struct|union|namespace)\b", header):
                        kind = "class"
                    elif paren is not None and not assigned:
                        kind = "function"
            depth += (t in ("(", "[", "{")) - (t in (")", "]", "}"))
            close = tokens[j]
            j += 1
            if depth == 0 and (t == ";" or t == "}" and (kind == "function" or first.group() == "namespace")):
                break
        end = close.end()
        if close.group() == "}" and j < len(tokens) and tokens[j].group() == ";":
            end, j = tokens[j].end(), j + 1
        node = Node(kind, "", first.start(), end)
        if kind != "other":
            node.body, node.body_end = brace.end(), code.rfind("}", brace.end(), end)
            node.name = tokens[paren - 1].group() if kind == "function" else ""
            node.members = _cpp_nodes(code, node.body, node.body_end) if kind == "class" else []
        out.append(node)
        k = j
    return out


def nodes_of(code: str, language: str) -> list[Node] | None:
    return _python_nodes(code) if language.upper() == "PYTHON" else _cpp_nodes(code)


def functions_in(nodes: list[Node]) -> list[Node]:
    """Functions at the top and in classes, in order; not those inside functions."""
    return [f for n in nodes for f in ([n] if n.kind == "function" else functions_in(n.members))]


def _plain(text: str) -> str:
    return "\n".join(x.rstrip() for x in text.strip().split("\n"))


def _tidy(text: str) -> str:
    return re.sub(r"\n{3,}", "\n\n", "\n".join(x.rstrip() for x in text.split("\n")).strip("\n"))


class Stripper:
    """What an author wrote in `code`, given the stub that came with the task."""

    def __init__(self, code: str, stub: str, language: str) -> None:
        self.code, self.python = code, language.upper() == "PYTHON"
        raw, given = nodes_of(code, language) or [], nodes_of(stub, language) or []
        mine: dict[str, Node] = {}
        for f in functions_in(raw):
            mine.setdefault(f.name, f)
        pairs = [(mine[f.name], f) for f in functions_in(given) if f.name in mine]
        self.nodes = raw
        self.stub_lines = {id(f): {x.strip() for x in stub[g.body : g.body_end].split("\n")} - {"", "{", "}", "};"} for f, g in pairs}
        paired = {id(g) for _, g in pairs}
        self.given = {_plain(stub[n.start : n.end]) for n in self._loose(given, paired)}

    def _loose(self, nodes: list[Node], paired: set[int]) -> list[Node]:
        """Nodes of the stub that neither are nor hold a paired function."""
        out = []
        for n in nodes:
            if id(n) in paired:
                continue
            if any(id(f) in paired for f in functions_in([n])):
                out += self._loose(n.members, paired)
            else:
                out.append(n)
        return out

    def _column(self, at: int) -> int:
        return at - (self.code.rfind("\n", 0, at) + 1)

    def target(self, f: Node) -> list[str]:
        """The signature and the body's lines that the stub hasn't; nothing if the stub has them all."""
        pad = " " * self._column(f.start)
        body = self.code[f.body : f.body_end].split("\n")
        if body and body[0].strip():  # it begins in the signature's line
            body[0] = f"{pad}    {body[0].strip()}"
        own = _tidy("\n".join(x for x in body if x.strip() not in self.stub_lines[id(f)]))
        if not own.strip():
            return []
        return [pad + self.code[f.start : f.body].rstrip(), *own.split("\n"), *([] if self.python else [pad + "}"])]

    def unit(self, n: Node) -> list[str]:
        """The lines of a node that are the author's, at its own indentation."""
        if id(n) in self.stub_lines:
            return self.target(n)
        pad, text = " " * self._column(n.start), self.code[n.start : n.end]
        if n.kind == "class" and any(id(f) in self.stub_lines for f in functions_in([n])):
            members = [line for m in n.members for line in self.unit(m)]
            written = any(x.strip() and x.strip() not in ("public:", "private:", "protected:") for x in members)
            return [pad + self.code[n.start : n.body].rstrip(), *members, *([] if self.python else [pad + "};"])] if written else []
        if _plain(text) in self.given and not text.rstrip().endswith(("public:", "private:", "protected:")):
            return []
        return (pad + text).split("\n")

    def __call__(self) -> str:
        chunks = []
        for n in self.nodes:
            cut = self._column(n.start)
            lines = [x[cut:] if not x[:cut].strip() else x.lstrip() for x in self.unit(n)]
            chunks += ["\n".join(lines).strip("\n")] if lines else []
        return _tidy("\n".join(c for c in chunks if c.strip()))


def strip_solution(code: str | None, boilerplate: str | None, language: str | None) -> tuple[str | None, int, int, str | None]:
    """(what the author wrote, target functions, helper functions, error).

    Functions that the boilerplate names are targets: their signatures stay, and the lines of
    their bodies that the stub's body of the same function doesn't have. Whole statements and
    members that the boilerplate has as they are go; all others stay."""
    if not parses(code, language) or not parses(boilerplate, language):
        return None, 0, 0, "parse_error"
    strip = Stripper(code or "", boilerplate or "", language or "")
    targets = len(strip.stub_lines)
    if not targets:
        return None, 0, 0, "no_target"
    text = without_comments(strip(), language)
    if not text or not text.strip():
        return None, targets, 0, "empty"
    return text, targets, max(len(functions_in(nodes_of(text, language or "") or [])) - targets, 0), None


def comments(code: str | None, language: str | None) -> list[str]:
    """Bodies of comments, neighbours on following lines joined."""
    if not code:
        return []
    spans = []
    if (language or "").upper() == "PYTHON":
        try:
            for t in tokenize.generate_tokens(io.StringIO(_SLASHES.sub(r"\1# ", code)).readline):
                if t.type == tokenize.COMMENT:
                    spans.append((t.start[0], t.end[0], t.string.lstrip("# ").rstrip()))
        except (tokenize.TokenError, SyntaxError, IndentationError):
            return []
    else:
        for m in _CPP.finditer(code):
            if m.lastgroup == "comment":
                row = code.count("\n", 0, m.start()) + 1
                spans.append((row, row + m.group().count("\n"), re.sub(r"^(//+|/\*+)|\*+/$", "", m.group()).strip()))
    out: list[list] = []
    for start, end, body in spans:
        if out and start <= out[-1][0] + 1:
            out[-1][0] = end
            out[-1][1] += "\n" + body
        else:
            out.append([end, body])
    return [b for _, b in out]


def _is_code(body: str, language: str) -> bool:
    """If a comment's body parses as statements of substance."""
    if language.upper() == "PYTHON":
        tree = _python_tree("def probe():\n" + "\n".join("    " + x for x in body.split("\n")))
        if tree is None:
            return False
        return any(not (isinstance(s, ast.Expr) and isinstance(s.value, (ast.Name, ast.Constant))) and not isinstance(s, ast.Pass) for s in tree.body[0].body)  # type: ignore[attr-defined]
    return bool(re.search(r"[;{}]\s*$|^\s*(?:if|for|while|return)\b.*[;({]", body, re.M)) and _cpp_tokens(body) is not None


def commented_out(code: str | None, language: str | None) -> bool:
    return any(_is_code(b, language or "") for b in comments(code, language))


def explanatory(code: str | None, language: str | None) -> bool:
    def prose(b: str) -> bool:
        words = re.findall("[a-z]+", b.lower())
        return b.strip().lower() not in BOILERPLATE_COMMENTS and (len(words) >= 5 or len(words) == 4 and bool(re.search("[.!?:;,]", b)) and not CUE_WORDS.isdisjoint(words))

    return any(prose(b) and not _is_code(b, language or "") for b in comments(code, language))


def local_names(code: str | None, language: str | None) -> list[str]:
    """Distinct local bindings, parameters left out."""
    if not parses(code, language):
        return []
    found: dict[str, None] = {}
    if (language or "").upper() == "PYTHON":
        for fn in ast.walk(_python_tree(code or "") or ast.Module([], [])):
            if isinstance(fn, (ast.FunctionDef, ast.AsyncFunctionDef)):
                own = {a.arg for a in [*fn.args.args, *fn.args.kwonlyargs, *fn.args.posonlyargs]}
                for n in ast.walk(fn):
                    if isinstance(n, ast.Name) and isinstance(n.ctx, ast.Store) and n.id not in own:
                        found[n.id] = None
    else:
        for m in re.finditer(r"\b(?:auto|int|long|double|float|bool|char|string|size_t|vector<[^;=()]*>|map<[^;=()]*>|set<[^;=()]*>)\s*&?\s*([A-Za-z_]\w*)\s*(?==|;|:|\{|,)", code or ""):
            found[m.group(1)] = None
    skip = {"self", "cls", "solution", "_"}
    return [n for n in found if n.lower() not in skip and not keyword.iskeyword(n) and not n.startswith("__")]


def _tokens(name: str) -> list[str]:
    return [t for t in name.split("_") if t] if "_" in name else re.findall(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+", name)


def naming(code: str | None, language: str | None) -> tuple[float, float, float]:
    """Shares of names with one letter, two at most, and of descriptive ones."""
    names = local_names(code, language)
    if not names:
        return 0.0, 0.0, 0.0
    n = len(names)
    wordy = sum(sum(len(t) >= 3 for t in _tokens(x)) >= 2 for x in names)
    return sum(len(x) == 1 for x in names) / n, sum(len(x) <= 2 for x in names) / n, wordy / n


def unused_local(code: str | None, language: str | None) -> bool:
    words = re.findall(r"[A-Za-z_]\w*", without_comments(code, language) or "")
    return any(words.count(n) == 1 for n in local_names(code, language))


def uniform_naming(code: str | None, language: str | None) -> bool:
    names = local_names(code, language)
    return len(names) >= 4 and naming(code, language)[2] >= 0.85 and min(map(len, names)) > 2


def matching_span(reference: str | None, query: str | None) -> tuple[int | None, int | None, list[str]]:
    """First and last reference line, and at most 8 lines, of the longest common block of two lines or more."""

    def content(code: str | None) -> list[tuple[int, str]]:
        wrappers = {"{", "}", "};", "public:", "classsolution", "classsolution:", "classsolution{"}
        return [(i, x.strip()) for i, x in enumerate((code or "").split("\n"), 1) if x.strip() and x.replace(" ", "").strip() not in wrappers]

    a, b = content(reference), content(query)
    blocks = difflib.SequenceMatcher(None, [x for _, x in a], [x for _, x in b], autojunk=False).get_matching_blocks()
    best = max((m for m in blocks if m.size >= 2), key=lambda m: m.size, default=None)
    if best is None:
        return None, None, []
    part = a[best.a : best.a + best.size]
    return part[0][0], part[-1][0], [x for _, x in part[:8]]


def rename_only(before: str | None, after: str | None, language: str | None) -> bool:
    """If the texts have the same tokens but for names, and each name always becomes the same other one."""
    if not parses(before, language) or not parses(after, language):
        return False
    words = lambda c: [m.group() for m in _CPP.finditer(without_comments(c, language) or "")]
    a, b = words(before), words(after)
    there: dict[str, str] = {}
    back: dict[str, str] = {}
    for x, y in zip(a, b):
        if x != y and not (x.isidentifier() and y.isidentifier() and not keyword.iskeyword(x) and not keyword.iskeyword(y)):
            return False
        if x.isidentifier() and (there.setdefault(x, y) != y or back.setdefault(y, x) != x):
            return False
    return len(a) == len(b)


def rename(code: str | None, names: dict[str, str]) -> str | None:
    """Whole-word renames."""
    if code is None or not names:
        return code
    return re.sub(r"\b(" + "|".join(map(re.escape, names)) + r")\b", lambda m: names[m.group()], code)


@pandas_udf(T.BooleanType())
def parses_udf(code: pd.Series, language: pd.Series) -> pd.Series:
    return pd.Series([parses(c, k) for c, k in zip(code, language)])


@pandas_udf(T.IntegerType())
def token_count_udf(code: pd.Series, language: pd.Series) -> pd.Series:
    return pd.Series([token_count(c, k) for c, k in zip(code, language)], dtype="Int32")


@pandas_udf(T.StringType())
def without_comments_udf(code: pd.Series, language: pd.Series) -> pd.Series:
    return pd.Series([without_comments(c, k) for c, k in zip(code, language)], dtype=object)


@pandas_udf(T.StructType([T.StructField("stripped", T.StringType()), T.StructField("target_count", T.IntegerType()), T.StructField("author_definition_count", T.IntegerType()), T.StructField("error", T.StringType())]))
def strip_udf(code: pd.Series, boilerplate: pd.Series, language: pd.Series) -> pd.DataFrame:
    rows = [strip_solution(c, b, k) for c, b, k in zip(code, boilerplate, language)]
    return pd.DataFrame(rows, columns=["stripped", "target_count", "author_definition_count", "error"])


@pandas_udf(T.ArrayType(T.StructType([T.StructField("name", T.StringType()), T.StructField("fired", T.BooleanType()), T.StructField("direction", T.StringType()), T.StructField("experimental", T.BooleanType())])))
def style_udf(code: pd.Series, language: pd.Series) -> pd.Series:
    flags = (("explanatory_comments", explanatory, "ai", False), ("commented_out_code", commented_out, "human", False), ("unused_local", unused_local, "human", False), ("uniform_verbose_naming", uniform_naming, "ai", True))
    return pd.Series([[{"name": n, "fired": f(c, k), "direction": d, "experimental": e} for n, f, d, e in flags] for c, k in zip(code, language)])


@pandas_udf(T.StructType([T.StructField("single", T.DoubleType()), T.StructField("short", T.DoubleType()), T.StructField("descriptive", T.DoubleType())]))
def naming_udf(code: pd.Series, language: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([naming(c, k) for c, k in zip(code, language)], columns=["single", "short", "descriptive"])


@pandas_udf(T.StructType([T.StructField("line_start", T.IntegerType()), T.StructField("line_end", T.IntegerType()), T.StructField("lines", T.ArrayType(T.StringType()))]))
def matching_span_udf(reference: pd.Series, query: pd.Series) -> pd.DataFrame:
    out = pd.DataFrame([matching_span(a, b) for a, b in zip(reference, query)], columns=["line_start", "line_end", "lines"])
    return out.astype({"line_start": "Int32", "line_end": "Int32"})
