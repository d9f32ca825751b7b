"""A small scanner for TypeScript sources: enough structure for the graph, without a compiler.

Strings, templates, comments and regular expressions are blanked out first, so that brackets and words in
them mislead nothing; declarations are then read from what is left. Types that aren't written are null.
"""

from __future__ import annotations

import hashlib
import re

_SKIP = re.compile(r"//[^\n]*|/\*[\s\S]*?\*/|'(?:[^'\\\n]|\\.)*'|\"(?:[^\"\\\n]|\\.)*\"|`(?:[^`\\]|\\.)*`|(?<=[=(,:;!&|?{}\n])\s*/(?![/*])(?:[^/\\\n\[]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[gimsuy]*")
_FUNCTION = re.compile(r"^[ \t]*(?P<head>(?P<exp>export\s+)?(?P<def>default\s+)?(?:declare\s+)?(?P<async>async\s+)?function\s*\*?\s*(?P<name>[\w$]*)\s*(?:<[^>(]*>)?)\(", re.M)
_CLASS = re.compile(r"^[ \t]*(?P<exp>export\s+)?(?P<def>default\s+)?(?:abstract\s+)?class\s+(?P<name>\w+)(?:<[^{]*?>)?(?:\s+extends\s+(?P<ext>[\w.$]+)(?:<[^{]*?>)?)?(?:\s+implements\s+(?P<imp>[^{]+?))?\s*\{", re.M)
_INTERFACE = re.compile(r"^[ \t]*(?P<exp>export\s+)?interface\s+(?P<name>\w+)[^{]*\{", re.M)
_TYPE = re.compile(r"^[ \t]*export\s+(?:declare\s+)?type\s+(?P<name>\w+)", re.M)
_CONST = re.compile(r"^[ \t]*export\s+(?:declare\s+)?(?:const|let|var)\s+(?P<name>\w+)", re.M)
_NAMED = re.compile(r"^[ \t]*export\s+(?:type\s+)?\{(?P<names>[^}]*)\}(?P<from>\s*from\s)?", re.M)
_STAR = re.compile(r"^[ \t]*export\s+\*", re.M)
_IMPORT = re.compile(r"^[ \t]*import\s+(?P<type>type\s+)?(?:(?P<what>[\w$*{}\s,]+?)\s+from\s+)?(?P<q>['\"])(?P<spec>[^'\"\n]+)(?P=q)", re.M)
_METHOD = re.compile(r"^[ \t]*(?P<mods>(?:(?:public|private|protected|static|override|abstract|async|get|set)\s+)*)(?P<name>(?!if\b|for\b|while\b|switch\b|catch\b|return\b|function\b)[\w$]+)\s*(?:<[^>(]*>)?\(", re.M)
_PROPERTY = re.compile(r"^[ \t]*(?:(?:public|private|protected|static|readonly|override|declare)\s+)*(?P<name>[\w$]+)[?!]?\s*(?::|=|;)", re.M)
SNIPPET, SNIPPET_MANY, HEAD, AROUND, MANY = 15, 30, 3, 3, 5


def blank(text: str) -> str:
    """The text with strings, comments and patterns blanked out, every position where it was."""
    return _SKIP.sub(lambda m: re.sub(r"[^\n]", " ", m[0]), text)


def closing(text: str, at: int) -> int:
    """Place after the bracket that closes the one at ``at``; the end of a text cut short."""
    pair = {"{": "}", "(": ")", "[": "]"}
    stack = []
    for i in range(at, len(text)):
        c = text[i]
        if c in pair:
            stack.append(pair[c])
        elif stack and c == stack[-1]:
            stack.pop()
            if not stack:
                return i + 1
    return len(text)


def _line(text: str, at: int) -> int:
    return text.count("\n", 0, at) + 1


def imports(text: str) -> list[dict]:
    out = []
    for m in _IMPORT.finditer(text):
        what = (m["what"] or "").strip()
        inner = re.search(r"\{([^}]*)\}", what)
        names = [re.split(r"\s+as\s+", re.sub(r"^type\s+", "", x.strip()))[0] for x in inner[1].split(",") if x.strip()] if inner else []
        space = re.search(r"\*\s+as\s+(\w+)", what)
        lead = re.match(r"([\w$]+)\s*(?:,|$)", what)
        out.append({"ord": len(out), "spec": m["spec"], "names": names, "default_name": lead[1] if lead else None, "namespace": space[1] if space else None, "type_only": bool(m["type"])})
    return out


def snippet(lines: list[str], start: int, marks: list[int]) -> str:
    """A function's code: whole if short; else its head and the lines around key statements, or the head alone."""
    limit = SNIPPET_MANY if len(marks) > MANY else SNIPPET
    if len(lines) <= limit:
        return "\n".join(lines)
    keep = sorted({*range(HEAD), *(i for k in marks for i in range(k - start - AROUND, k - start + AROUND + 1) if 0 <= i < len(lines))})
    if marks and len(keep) <= limit:
        out, last = [], -1
        for i in keep:
            if i > last + 1:
                out.append("  // ...")
            out.append(lines[i])
            last = i
        return "\n".join([*out, *(["  // ..."] if last < len(lines) - 1 else [])])
    rest = len(lines) - limit
    unseen = sum(k - start >= limit for k in marks)
    return "\n".join([*lines[:limit], f"// ... ({rest} more lines" + (f", {unseen} more key statements" if unseen else "") + ")"])


def expression(text: str) -> str:
    """What is left of a line up to the end of the expression that it starts with."""
    depth = 0
    for i, c in enumerate(text):
        depth += (c in "([{") - (c in ")]}")
        if depth < 0 or depth == 0 and c in ";,":
            return text[:i].strip()
    return text.strip()


def key_statements(lines: list[str], first: int) -> list[dict]:
    """One category at most for each line; the first rule that applies wins."""
    rules = (
        ("config", r"\b(?:const|let|var)\s+\w+\s*(?::[^=]+)?=\s*-?[\d_.]+\s*;|(?:\?\?|\|\|)\s*\d"), ("url", r"['\"`](?:https?|wss?)://"), ("math", r"Math\.pow|\*\*"), ("condition", r"\bif\s*\(.*status.*\b\d{3}\b"),
        ("error", r"\bcatch\s*\(\s*\w"), ("loop", r"^\s*(?:\}\s*)?(?:for|while)\s*(?:await\s*)?\("), ("async-pattern", r"Promise\.(?:all|allSettled|race|any)\s*\("),
    )
    loop = dict(rules)["loop"]
    out, depth, loops = [], 0, []
    for i, s in enumerate(lines):
        bare = re.sub(r"^\s*(?://|\*).*", "", s)
        kind = next((k for k, p in rules if re.search(p, bare)), None)
        if kind is None and loops and (m := re.search(r"\bawait\b", bare)):
            kind = "async-pattern"
            s = f"[sequential] {expression(bare[m.start() :])}"
        if re.search(loop, bare):
            loops.append(depth)
        if kind:
            out.append({"line": first + i, "text": s.strip(), "category": kind})
        depth += bare.count("{") - bare.count("}")
        while loops and depth <= loops[-1] and "}" in bare:
            loops.pop()
    return out


_STATUS = ((404, r"not\s*found"), (401, r"unauthorized"), (403, r"forbidden"), (400, r"bad\s*request|invalidrequest|validationerror"), (429, r"too\s*many\s*requests|rate\s*limit"))


def status_of(condition: str | None, action: str) -> int | None:
    t = f"{condition or ''} {action}"
    m = re.search(r"\b([45]\d{2})\b", t)
    if m and (400 <= int(m[1]) <= 451 or 500 <= int(m[1]) <= 511):
        return int(m[1])
    return next((code for code, p in _STATUS if re.search(p, t, re.I)), None)


def last_statement(bare: str, body: int) -> int:
    """Line, from 0, on which the last statement of a function's body starts."""
    at, end, start = body + 1, closing(bare, body) - 1, -1
    while at < end:
        lead = re.match(r"[\s;]*", bare[at:end]).end()
        at += lead
        if at >= end:
            break
        start = at
        while at < end:  # a statement ends with its semicolon, or with a block that nothing goes on from
            c = bare[at]
            if c == ";":
                at += 1
                break
            if c in "([{":
                at = closing(bare, at)
                if c == "{" and not re.match(r"\s*(?:else\b|catch\b|finally\b|while\b|[.,;)=?:&|+*/<-])", bare[at:end]):
                    break
                continue
            at += 1
    return bare.count("\n", 0, start) if start >= 0 else -1


def error_paths(code: str, first: int) -> list[dict]:
    """Guards, early returns, throws and catches of a function, by line; a guard that returns is in both of its kinds."""
    bare = blank(code)
    ifs = []
    for m in re.finditer(r"\bif\s*\(", bare):
        end = closing(bare, m.end() - 1)
        at = end + len(bare[end:]) - len(bare[end:].lstrip())
        stop = closing(bare, at) if bare[at : at + 1] == "{" else (bare.find(";", at) + 1 or len(bare))
        ifs.append((m.start(), at, stop, code[m.end() : end - 1].strip()))
    labels = []  # (start, end) of what a case label covers, and the label
    for m in re.finditer(r"\bswitch\s*\(", bare):
        at = bare.find("{", closing(bare, m.end() - 1))
        stop = closing(bare, at) if at >= 0 else len(bare)
        own = [x for x in re.finditer(r"\b(?:case\b([^:]*)|default\s*):", bare[at:stop]) if bare.count("{", at, at + x.start()) - bare.count("}", at, at + x.start()) == 1]
        for x, after in zip(own, [*(y.start() for y in own[1:]), stop - at], strict=False):
            if x[1] is not None:
                labels.append((at + x.end(), at + after, "case " + code[at + x.start(1) : at + x.end(1)].strip()))
    catches = [(m.start(), m.end() - 1, closing(bare, m.end() - 1), (m[1] or "").strip("() ")) for m in re.finditer(r"\bcatch\s*(\([^)]*\))?\s*\{", bare)]
    body = bare.find("{")
    depth_at = lambda i: bare.count("{", body + 1, i) - bare.count("}", body + 1, i)
    out = []

    def add(kind: str, at: int, condition: str | None, action: str) -> None:
        out.append({"type": kind, "line": first + code.count("\n", 0, at), "condition": condition, "action": action.strip(), "http_status": status_of(condition, action)})

    def why(at: int) -> str | None:
        own = [x for x in ifs if x[1] <= at < x[2]]
        return max(own)[3] if own else max(((a, label) for a, b, label in labels if a <= at < b), default=(0, None))[1]

    def statement(at: int) -> str:
        end = bare.find(";", at)
        return code[at : end if end > 0 else len(code)].strip()

    tops = 0
    for at, then, stop, cond in sorted(ifs):
        if depth_at(at) == 0:
            tops = bare.count(";", body, at)
            if tops < MANY and re.search(r"\b(?:return|throw)\b", bare[then:stop]):
                add("guard", at, cond, statement(then + re.search(r"\b(?:return|throw)\b", bare[then:stop]).start()))
    last = last_statement(bare, body)
    for m in re.finditer(r"\breturn\b", bare):
        if code.count("\n", 0, m.start()) == last:
            continue
        inside = why(m.start()) or next((f"catch ({c[3]})" for c in catches if c[1] <= m.start() < c[2]), None)
        if inside:
            add("early-return", m.start(), inside, statement(m.start()))
    for m in re.finditer(r"\bthrow\b", bare):
        add("throw", m.start(), why(m.start()), statement(m.start()))
    for at, a, b, name in catches:
        inner = bare[a + 1 : b - 1].strip()
        what = "swallows the error" if not inner else ("re-throws" if re.fullmatch(rf"throw\s+{name or '_'}\s*;?", inner) else "transforms the error" if name and re.search(rf"throw\s+new\b[^;]*\b{name}\b", inner) else "throws another error") if "throw" in inner else "returns" if re.search(r"\breturn\b", inner) else "logs" if "console" in inner else "handles"
        add("catch", at, f"catch ({name})" if name else None, what)
    return sorted(out, key=lambda e: e["line"])


def documentation(block: str, name: str) -> dict:
    """A documentation block's parts; tags without text count as empty, not as missing."""
    body = re.sub(r"(?m)^\s*\* ?", "", re.sub(r"^/\*\*|\*/$", "", block.strip())).strip()
    head, *tags = re.split(r"(?m)^\s*(?=@\w)", body)
    out = {"name": name, "description": head.strip() or None, "params": [], "returns": None, "throws": [], "examples": [], "deprecated": None, "see": []}
    for t in tags:
        m = re.match(r"@(\w+)\s*([\s\S]*)", t)
        kind, rest = m[1], m[2].strip()
        if kind in ("param", "arg"):
            p = re.match(r"(?:\{([^}]*)\}\s*)?\[?([\w.$]+)[^\]\s]*\]?\s*(?:-\s*)?([\s\S]*)", rest)
            if p:
                out["params"].append({"name": p[2], "type": p[1], "description": re.sub(r"\s+", " ", p[3]).strip()})
        elif kind in ("returns", "return"):
            out["returns"] = re.sub(r"^\{[^}]*\}\s*", "", rest)
        elif kind in ("throws", "exception"):
            out["throws"].append(rest)
        elif kind == "example":
            out["examples"].append(rest)
        elif kind == "deprecated":
            out["deprecated"] = rest
        elif kind == "see":
            out["see"].append(rest)
    return out


def parse(path: str, text: str) -> dict:
    """Everything that is known of one source file."""
    bare = blank(text)
    lines = text.split("\n")
    fns, classes, interfaces, exports = [], [], [], []
    spans: list[tuple[int, int, str]] = []

    def function(m: re.Match, open_at: int, name: str, owner: str | None, exported: bool, default: bool, is_async: bool) -> None:
        args = closing(bare, open_at)
        tail = re.match(r"\s*(?::\s*(?:\{[^}]*\}\s*)?(?:[^={;\n]|=>)*)?", bare[args:])
        at = args + tail.end()
        has_body = bare[at : at + 1] == "{"
        end = closing(bare, at) if has_body else at
        first, last = _line(text, m.start() + len(m[0]) - len(m[0].lstrip())), _line(text, max(end - 1, m.start()))
        code = lines[first - 1 : last]
        marks = key_statements(code, first) if has_body else []
        sig = re.sub(r"^(?:export\s+)?(?:default\s+)?", "", re.sub(r"\s+", " ", text[m.start() : at].strip()))
        fns.append({"name": name or "anonymous", "owner": owner, "signature": sig.strip(), "is_async": is_async, "is_exported": exported, "is_default_export": default, "start_line": first, "end_line": last, "code_snippet": snippet(code, first, [k["line"] for k in marks]),
                    "calls": [], "key_statements": marks, "error_paths": error_paths("\n".join(code), first) if has_body else [], "_at": (at, end)})
        spans.append((m.start(), end, name))

    for m in _FUNCTION.finditer(bare):
        function(m, m.end() - 1, m["name"], None, bool(m["exp"]), bool(m["def"]), bool(m["async"]))
    for m in _CLASS.finditer(bare):
        end = closing(bare, m.end() - 1)
        inner = bare[m.end() : end - 1]
        flat, depth = [], 0
        for c in inner:
            depth -= c == "}"
            flat.append(c if depth == 0 or c == "\n" else " ")
            depth += c == "{"
        top = "".join(flat)
        own = []
        for x in _METHOD.finditer(top):
            start = m.end() + x.start()
            args = closing(bare, m.end() + x.end() - 1)
            if re.match(r"\s*(?::[^;={]*)?\{", bare[args:]):
                y = re.compile(re.escape(bare[start : m.end() + x.end()])).match(bare, start)
                function(y, m.end() + x.end() - 1, x["name"], m["name"], False, False, "async" in x["mods"])
                own.append(x["name"])
        props = [x["name"] for x in _PROPERTY.finditer(re.sub(r"\([^)]*\)[^;{\n]*[{;]?", "(", top)) if x["name"] not in own]
        classes.append({"name": m["name"], "extends": m["ext"], "implements": [x.strip() for x in (m["imp"] or "").split(",") if x.strip()], "methods": own, "properties": props})
    for m in _INTERFACE.finditer(bare):
        interfaces.append({"name": m["name"], "properties": [x["name"] for x in _PROPERTY.finditer(re.sub(r"[;,]", ";\n", bare[m.end() : closing(bare, m.end() - 1) - 1]))]})
    local = {f["name"] for f in fns}
    for f in fns:
        a, b = f.pop("_at")
        f["calls"] = list(dict.fromkeys(x for x in re.findall(r"(?<![\w.$])([\w$]+)\s*\(", bare[a:b]) if x in local))
    add = lambda name, kind, again=False: exports.append({"ord": len(exports), "name": name, "kind": kind, "reexport": again})
    for f in fns:
        if f["is_exported"]:
            add(f["name"], "function")
    for p, kind in ((_CLASS, "class"), (_INTERFACE, "interface")):
        for m in p.finditer(bare):
            if m["exp"]:
                add(m["name"], kind)
    for p, kind in ((_TYPE, "type"), (_CONST, "const")):
        for m in p.finditer(bare):
            add(m["name"], kind)
    for m in _NAMED.finditer(bare):
        for x in m["names"].split(","):
            if x.strip():
                add(re.split(r"\s+as\s+", x.strip())[-1].strip(), "const", bool(m["from"]))
    for _ in _STAR.finditer(bare):
        add("*", "star", True)
    imps = imports(re.sub(r"//[^\n]*|/\*[\s\S]*?\*/", lambda m: re.sub(r"[^\n]", " ", m[0]), text))
    import_lines = {_line(text, m.start()) + k for m in _IMPORT.finditer(text) for k in range(m[0].strip().count("\n") + 1)}
    usages = []
    for i in imps:
        for name in [*i["names"], *([i["default_name"]] if i["default_name"] else [])]:
            if not i["spec"].startswith("."):
                continue
            at = [x for x in re.finditer(rf"(?<![\w$.]){re.escape(name)}(?![\w$])", bare) if _line(text, x.start()) not in import_lines]
            if at:
                kind = "type" if i["type_only"] else "call" if any(re.match(r"\s*(?:<[^>(]*>)?\(", bare[x.end() :]) for x in at) else "reference"
                usages.append({"symbol": name, "source": i["spec"], "lines": sorted({_line(text, x.start()) for x in at}), "usage": kind})
    docs: dict[str, dict] = {}
    for m in re.finditer(r"/\*\*[\s\S]*?\*/", text):
        d = re.match(r"\s*(?:export\s+)?(?:default\s+)?(?:abstract\s+|declare\s+|public\s+|private\s+|protected\s+|static\s+|async\s+)*(?:function\s*\*?|class|interface|type|const)?\s*([\w$]+)", text[m.end() :])
        if d and (d[1] in local or any(c["name"] == d[1] for c in classes)):
            docs[d[1]] = documentation(m[0], d[1])
    tops = [f for f in fns if f["owner"] is None]
    comments, todos = [], []
    for n, s in enumerate(lines, 1):
        if c := re.search(r"(?<!:)//\s*(.+)", s):
            comments.append({"line": n, "text": c[1].strip(), "near_function": next((f["name"] for f in tops if f["start_line"] <= n <= f["end_line"]), None)})
        if t := re.search(r"(?://|/\*).*?\b(TODO|FIXME|HACK|XXX):?\s*(.*)$", s, re.I):
            todos.append({"line": n, "type": t[1].upper(), "text": re.sub(r"\*/\s*$", "", t[2]).strip()})
    return {"path": path, "lines": len(lines), "content_hash": "sha256-" + hashlib.sha256(text.encode()).hexdigest(), "imports": imps, "exports": exports, "functions": fns, "classes": classes, "interfaces": interfaces, "usages": usages, "docs": list(docs.values()), "comments": comments, "todos": todos, "error": None}
