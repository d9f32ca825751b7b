"""Functions paired with their documentation.

``functions_of`` reads a source text: regular expressions detect signatures, a stack of braces, of
indentations or of end keywords delimits bodies, and the comment that ends nearest above a signature (or
the string that opens a body) within ``MAX_DISTANCE`` lines is its documentation. ``paired`` reads functions
from code that was cut out of its file, and joins them, by the name in the signature, with documentation that
was taken out of the file before. ``informative`` tells documentation that says something beyond the
function's name from the rest.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Lines that may lie between the end of a comment and the signature it belongs to (decorators don't count).
MAX_DISTANCE = 2
#: Words, other than those of the name and fillers, that a description must have.
LEAST_WORDS = 2


class Function(NamedTuple):
    name: str
    signature: str
    body: str
    description: str
    start_line: int
    end_line: int


#: Heads of signatures, up to the bracket that opens the parameters (or the one parameter of an arrow function).
_BRACE = re.compile(
    r"^[ \t]*+(?P<sig>(?:(?:export|default|declare|public|private|protected|internal|static|final|abstract|override|virtual|async|unsafe|pub(?:\([a-z]+\))?|inline|const)\s+)*"
    r"(?:function\b\s*\*?\s*(?P<a>[\w$]+)\s*(?:<[^>\n]*>)?\s*(?=\()|(?:fn|func)\s+(?:\([^)\n]*\)\s*)?(?P<b>\w+)\s*(?:<[^>\n]*>)?\s*(?=\()"
    r"|(?:(?:let|var|const)\s++)?(?P<c>[\w$]+)\s*(?::[^=\n]+)?=\s*(?:async\s*)?(?:(?=\()|[\w$]+(?=\s*=>))"
    r"|(?:[\w<>\[\],.?]+\s+)?(?P<d>(?!if\b|for\b|while\b|switch\b|catch\b|return\b|else\b|new\b|function\b|await\b)[\w$]+)\s*(?=\()))",
    re.M,
)
#: What lies between the closing bracket and the body, for each kind of head.
_TAIL = {"a": re.compile(r"\s*(?::\s*[^={};\n]+)?(?=\{)"), "b": re.compile(r"[^{;\n]*(?=\{)"), "c": re.compile(r"\s*(?::\s*[^=\n{]+)?=>\s*"), "d": re.compile(r"\s*(?::\s*[^={};\n]+|throws\s+[\w., ]+|const)?\s*(?=\{)")}
_INDENT = re.compile(r"^(?P<pad>[ \t]*+)(?P<sig>(?:async\s+)?def\s+(?P<a>\w+)\s*(?=\())", re.M)
_COLON = re.compile(r"\s*(?:->\s*[^:\n]+)?:")
_END = re.compile(r"^[ \t]*+(?P<sig>(?:local\s+)?(?:def|function)\s+(?:self\.)?(?P<a>[\w.:?!]+)[ \t]*(?:\([^)\n]*\))?)[ \t]*$", re.M)
_OPENS = re.compile(r"^\s*(?:if|unless|while|until|for|case|begin|def|class|module|function|local function|repeat)\b|\bdo\b(?:\s*\|[^|]*\|)?\s*$|=\s*(?:if|case|begin|function)\b|\bfunction\s*\([^)]*\)\s*$")
_DECORATOR = re.compile(r"^\s*(?:@\w|#\[|\[\w)")
_SKIP = re.compile(r"""^[ \t]*(?:```|~~~)[^\n]*|\"{3}[\s\S]*?\"{3}|'{3}[\s\S]*?'{3}|'(?:[^'\\\n]|\\.)*'|"(?:[^"\\\n]|\\.)*"|`(?:[^`\\]|\\.)*`|//[^\n]*|/\*[\s\S]*?(?:\*/|\Z)|[(){}]""", re.M)


def comments(lines: list[str]) -> dict[int, tuple[int, str]]:
    """Last line of each comment block -> (first line, text): ``/* */`` blocks and runs of line comments."""
    out: dict[int, tuple[int, str]] = {}
    i = 0
    while i < len(lines):
        s = lines[i].strip()
        if s.startswith("/*"):
            j = i
            while j < len(lines) and "*/" not in lines[j][lines[j].find("/*") + 2 if j == i else 0 :]:
                j += 1
            j = min(j, len(lines) - 1)
            text = "\n".join(lines[i : j + 1])
            text = re.sub(r"\*+/.*$", "", re.sub(r"^\s*/\*+!?", "", text), flags=re.S)
            out[j] = (i, "\n".join(re.sub(r"^\s*\*+ ?", "", x) for x in text.split("\n")).strip())
            i = j + 1
            continue
        mark = next((m for m in ("///", "//", "#", "--") if s.startswith(m) and not s.startswith("#[")), None)
        if mark:
            j = i
            while j + 1 < len(lines) and lines[j + 1].strip().startswith(mark):
                j += 1
            out[j] = (i, "\n".join(x.strip()[len(mark) :].strip() for x in lines[i : j + 1]).strip())
            i = j + 1
            continue
        i += 1
    return out


def brackets(text: str) -> dict[int, int]:
    """Place of each opening bracket -> place of its closing one, by a stack, outside strings and comments, in one pass.

    Brackets that nothing closes have no entry; those that are still open inside one that closes are dropped.
    """
    out: dict[int, int] = {}
    open_: list[tuple[str, int]] = []
    for m in _SKIP.finditer(text):
        c = m[0]
        if c in ("(", "{"):
            open_.append((c, m.start()))
        elif c in (")", "}"):
            want = "(" if c == ")" else "{"
            while open_ and open_[-1][0] != want and want == "{":
                open_.pop()
            if open_ and open_[-1][0] == want:
                out[open_.pop()[1]] = m.start()
    return out


def _indented(lines: list[str], first: int, pad: int) -> int:
    """Last line of the block under line ``first``: lines that are blank or stand deeper than ``pad``."""
    last = first
    for i in range(first + 1, len(lines)):
        s = lines[i]
        if s.strip():
            if len(s) - len(s.lstrip()) <= pad:
                break
            last = i
    return last


def _ended(lines: list[str], first: int) -> int:
    """Line of the ``end`` that closes the keyword opened on line ``first``."""
    depth = 0
    for i in range(first, len(lines)):
        s = lines[i]
        depth += bool(_OPENS.search(s)) - len(re.findall(r"(?<![\w.:])(?:end|until)\b", s)) * (i > first)
        if depth <= 0:
            return i
    return len(lines) - 1


def functions_of(text: str) -> list[Function]:
    """The functions of a source text in order. A text without any, or an empty one, gives none."""
    lines = text.split("\n")
    at = [0]
    for s in lines:
        at.append(at[-1] + len(s) + 1)
    above = comments(lines)
    inside = {i for end, (first, _) in above.items() for i in range(first, end + 1)}

    def line_of(pos: int) -> int:
        return min(bisect_right(at, pos) - 1, len(lines) - 1)

    pairs = brackets(text)
    found: dict[int, tuple[str, str, int, int]] = {}
    for m in _INDENT.finditer(text):
        close = pairs.get(m.end())
        tail = _COLON.match(text, close + 1) if close is not None else None
        if tail:
            first, head = line_of(m.start("sig")), line_of(tail.end() - 1)
            found[first] = (m["a"], text[m.start("sig") : tail.end() - 1], head, _indented(lines, head, len(m["pad"])))
    for m in _END.finditer(text):
        first = line_of(m.start("sig"))
        if first not in found:
            found[first] = (m["a"], m["sig"], first, _ended(lines, first))
    for m in _BRACE.finditer(text):
        first = line_of(m.start("sig"))
        kind = next(k for k in "abcd" if m[k])
        if first in found or first in inside:
            continue
        after = m.end() if kind == "c" and text[m.end() : m.end() + 1] != "(" else pairs.get(m.end(), -2) + 1
        tail = _TAIL[kind].match(text, after) if after >= 0 else None
        if tail:
            body = tail.end()
            stop = pairs.get(body, len(text) - 1) if text[body : body + 1] == "{" else at[line_of(body) + 1] - 2  # an expression ends with its line
            found[first] = (m[kind], text[m.start("sig") : body], line_of(max(after - 1, m.start("sig"))), line_of(max(stop, body - 1)))
    out = []
    for first, (name, sig, head, last) in sorted(found.items()):
        out.append(Function(name, re.sub(r"\s+", " ", sig).strip(), "\n".join(lines[first : last + 1]), _documentation(lines, above, first, head), first, last))
    return out


def _documentation(lines: list[str], above: dict[int, tuple[int, str]], first: int, head: int) -> str:
    opens = next((i for i in range(head + 1, len(lines)) if lines[i].strip()), len(lines))
    inner = "\n".join(lines[opens:]).lstrip() if opens < len(lines) and re.match(r"\s*[rRuU]?(?:\"\"\"|''')", lines[opens]) else ""
    if lines[first].lstrip().startswith(("def ", "async def")) and (m := re.match(r"[rRuU]?(\"\"\"|''')([\s\S]*?)\1", inner)):
        return m[2].strip()
    distance, i = 0, first - 1
    while i >= 0 and distance <= MAX_DISTANCE:
        if i in above:
            return above[i][1]
        if not _DECORATOR.match(lines[i]):
            if lines[i].strip():
                return ""
            distance += 1
        i -= 1
    return ""


# Words that carry nothing beside a name, and phrases that stand where documentation will be.
FILLERS = frozenset(
    "a an the this that these it its of to for in on by with from as and or is are be been do does done will can function functions method methods helper helpers util utility "
    "procedure routine class service handler wrapper implementation handle handles handling given new perform performs simple simply just main used use uses".split()
)
PLACEHOLDERS = re.compile(
    r"(?i)^\W*(?:(?:to ?do|fix ?me|tbd|tba|wip|xxx|hack)\b.*|n/?a|none|description|documentation|docs?|comment|lorem ipsum.*|(?:add|insert|write|put|missing|no|needs?)\s+(?:a\s+|the\s+|some\s+|more\s+)?(?:descriptions?|docs?|documentation|comments?)\b.*"
    r"|(?:documentation|docs?|description|comments?)\s+(?:is\s+)?(?:pending|missing|needed|to (?:do|come)|goes here|here|follows)\b.*|undocumented|not documented.*|auto-?\s?generated\b.*|generated (?:by|documentation|docs?)\b.*|placeholder.*"
    r"|(?:see|cf\.?|refer to|same as|like|as)\s+(?:the\s+)?(?:above|below|docs?|documentation|there|readme|spec|parent|base|super|interface|wiki|ticket|issue|implementation|source|code|previous|https?://\S+|#\d+|[\w.#/]+\(?\)?)\W*|https?://\S+)\W*$"
)


def stem(w: str) -> str:
    """A word without its usual English endings, so that ``verifies`` and ``verify`` agree."""
    for a, b in (("ies", "y"), ("ied", "y"), ("sses", "ss"), ("shes", "sh"), ("ches", "ch"), ("xes", "x"), ("zes", "z"), ("ing", ""), ("ed", ""), ("es", ""), ("s", ""), ("e", "")):
        if w.endswith(a) and len(w) - len(a) >= 3 and not w.endswith("ss"):
            return (w[: -len(a)] + b).rstrip("e")
    return w.rstrip("e") if len(w) > 3 else w


def name_words(name: str) -> set[str]:
    return {stem(w.lower()) for w in re.findall(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+", name or "")}


def informative(description: str | None, name: str) -> bool:
    """Whether a description tells something beyond the function's name.

    Markup, tags, decoration, placeholders and pointers are dropped; a sentence of the rest counts if it
    has ``LEAST_WORDS`` words that are neither fillers nor words of the name. Null and empty texts don't.
    """
    if not description:
        return False
    text = re.sub(r"\{@\w+[^}]*\}|<[^>\n]*>", " ", description)
    text = re.sub(r"(?m)^[\s/*#-]*@\w+.*$", " ", text)
    text = re.sub(r"\b" + re.escape(name) + r"\b(?:\(\))?", " ", text) if name else text
    own = name_words(name)
    for sentence in re.split(r"(?<=[.!?;])\s+|\n", text):
        s = sentence.strip(" \t*/#-=_~.")
        if not s or PLACEHOLDERS.match(s):
            continue
        words = [w for w in re.findall(r"[^\W\d_]{2,}", s.lower()) if w not in FILLERS]
        if len({w for w in map(stem, words)} - own) >= LEAST_WORDS:
            return True
    return False


#: Columns that ``parsed`` gives besides the keys: the signature, the code up to the body's end, and the comment beside it.
PARSED = ("signature", "code", "comment")


def parsed(functions: DataFrame, *columns: str) -> DataFrame:
    """(func_id, repo, path, name, extracted_at, *columns) of the function in each row's code: a narrow map.

    The name is the one read from the signature: that of the row's own function, or of the first one where the row
    names none. Rows with null or blank code, and those in whose code no such signature is found, give nothing. ``columns`` are some of PARSED.
    """
    own = functions.where(F.length(F.trim("code_snippet")) > 0).select("func_id", "repo", "path", "func_name", "code_snippet", "extracted_at")
    kind = {c: own.schema[c].dataType.simpleString() for c in own.columns}
    schema = f"func_id {kind['func_id']}, repo string, path string, name string, extracted_at {kind['extracted_at']}" + "".join(f", {c} string" for c in columns)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            got = []
            for name, code in zip(pdf["func_name"], pdf["code_snippet"], strict=True):
                every = functions_of(code)
                got.append(next((x for x in every if name is None or x.name == name), None))
            out = pdf[["func_id", "repo", "path", "extracted_at"]].assign(name=[f.name if f else None for f in got])
            field = {"signature": "signature", "code": "body", "comment": "description"}
            for c in columns:
                out[c] = [getattr(f, field[c]) if f else None for f in got]
            yield out[out["name"].notna()][["func_id", "repo", "path", "name", "extracted_at", *columns]]

    return own.mapInPandas(run, schema)


def entries(files: DataFrame, *columns: str) -> DataFrame:
    """(repo, path, name, file_at, kept, *columns) of each documentation entry with letters in its description: a narrow map.

    ``kept`` says whether the description is informative for its name. ``columns`` may be ("description",).
    """
    own = files.where(F.col("jsdoc").isNotNull()).select("repo", "path", F.col("extracted_at").alias("file_at"), F.explode("jsdoc").alias("name", "_doc"))
    own = own.select("repo", "path", "name", "file_at", F.col("_doc.description").alias("description")).where(F.col("description").rlike(r"\p{L}{2,}"))
    at = own.schema["file_at"].dataType.simpleString()
    schema = f"repo string, path string, name string, file_at {at}, kept boolean" + "".join(f", {c} string" for c in columns)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            kept = [informative(t, n or "") for t, n in zip(pdf["description"], pdf["name"], strict=True)]
            yield pdf.assign(kept=kept)[["repo", "path", "name", "file_at", "kept", *columns]]

    return own.mapInPandas(run, schema)


def paired(functions: DataFrame, files: DataFrame, *columns: str) -> DataFrame:
    """(func_id, seen, kept, *columns) of each function in whose code a signature is found and its documentation entry.

    Equal on repo, path and the name in the signature, so the key is a function, which no hot file can make
    hot. ``seen`` orders the versions of a function and of its entry; ``columns`` are some of PARSED and
    "description".
    """
    code = parsed(functions, *[c for c in columns if c in PARSED])
    docs = entries(files, *[c for c in columns if c not in PARSED])
    seen = F.struct(F.col("extracted_at"), F.col("file_at"))
    return code.join(docs, ["repo", "path", "name"]).select("func_id", seen.alias("seen"), "kept", *columns)


def newest(pairs: DataFrame, *columns: str) -> DataFrame:
    """One row per function: its newest version (a function re-extracted later replaces the earlier rows)."""
    picked = pairs.groupBy("func_id").agg(F.max_by(F.struct(*columns), "seen").alias("_p"))
    return picked.select("func_id", *[F.col(f"_p.{c}").alias(c) for c in columns])
