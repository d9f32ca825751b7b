"""Credentials embedded in source code: find them, and mask them in place.

Candidates are quoted strings (pieces that are added or joined count as one) and long tokens: values of options,
of assignments and of query parameters, what stands in an address before the host, key blocks, and runs of 20
characters or more. Each is judged by its Shannon entropy, that of its characters and that of the alphabets
(lower and upper case, digits, signs) which neighbours are drawn from, against what a random string of the same
length over the same alphabet would have. Where the text around names a credential less is asked, elsewhere
more. Hashes, identifiers, addresses, placeholders and lookups are excluded.

Nulls and empty texts hold nothing. A text is examined whole, whatever its length, and what stands before a
candidate is read from it backwards without a limit.
"""

from __future__ import annotations

import base64
import binascii
import math
import re
import string
from collections import Counter
from collections.abc import Iterator, Sequence
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MASK = "REDACTED"
MASK64 = base64.b64encode(MASK.encode()).decode()

#: Share of the information of a random string that a secret has where nothing names it.
BARE_SHARE = 0.78
#: Where its surroundings name it: bits that its characters and the kinds of neighbours hold in all, so that a
#: short one must hold more a character, and share of a random string's entropy.
NAMED_BITS, NAMED_SHARE = 34.0, 0.45
#: Least lengths of a secret whose surroundings name it, and of one that stands alone.
NAMED_LEAST, BARE_LEAST = 6, 20
#: Characters up to which the expected entropy is computed exactly; beyond, by its first-order bias.
EXACT = 256

# Words that name a credential, words that turn such a name into something else, and
# strings that people write where a secret will stand.
NAME = r"(?:pass(?:word|wd|phrase|code)?|pwd|pin|secret|token|api[_-]?key|access[_-]?key|private[_-]?key|auth[_-]?key|signing[_-]?key|client[_-]?key|credentials?|bearer|jwt|authorization)"
NOT_SECRET = re.compile(r"(?i)(?:url|uri|field|name|label|policy|length|count|type|header|path|file|id|hint|prompt|title|prefix|public\w*|cache\w*)$")
PLACEHOLDER = re.compile(
    r"(?i)^(?:|\W+|change[-_ ]?me\d*|redacted|replace[-_ ]?(?:me|this)|(?:your|my|the|some|insert|enter|put)[-_ ].*|<.*>|\[.*\]|\{.*\}|%.*%|.*(?:_|-)here|n/?a"
    r"|(?:default|dummy|fake|mock|sample|example|demo|placeholder|test|dev|local(?:host)?)[-_]?(?:password|secret|token|key|pass|value)[-_]?\d{0,4}|x{3,}.*)$"
)
VENDOR = r"(?:AKIA[0-9A-Z]{12,}|gh[pousr]_[A-Za-z0-9]{16,}|glpat-[A-Za-z0-9_-]{12,}|xox[abeprs]-[A-Za-z0-9-]{16,}|npm_[A-Za-z0-9]{20,}|[sr]k_(?:live|test)_[A-Za-z0-9]{12,}|eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,})"

UUID = re.compile(r"^[0-9a-fA-F]{8}-(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}$")
HEX = re.compile(r"^[0-9a-fA-F]+$")
HASHED = re.compile(r"^(?:sha\d+|md5)[-:=]")
LOOKUP = re.compile(r"^\$(?:[A-Z_][A-Z0-9_]*|[a-z_]+|\d)$|^%\w+%$|\$\{|\$\(|^process\.env|^env[.:(]|^(?:vault|ssm|secret|op|arn):")
IDENTIFIER = re.compile(r"^[A-Za-z_$][A-Za-z]*(?:[-_./: ][A-Za-z]+)*$")
PATHLIKE = re.compile(r"^(?:\.{0,2}/|[\w-]+(?:\.[\w-]+)+$|@?[\w-]+(?:/[\w.-]+)+\.\w+$)")

STRING = r"""'(?:[^'\\\n]|\\.)*'|"(?:[^"\\\n]|\\.)*"|`(?:[^`\\]|\\.)*`"""
_PEM = re.compile(r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----(?P<body>(?:(?!-----END)[\s\S])*)(?:-----END[^-]*-----)?")
_URL = re.compile(r"(?<![a-zA-Z0-9+.-])[a-zA-Z0-9+.-]++://[^\s/:@'\"`$<>{}]*:(?P<v>[^\s/'\"`]+?)@(?=[\w\[$])")
_QUERY = re.compile(r"(?i)[?&](?:[\w-]*(?:token|key|secret|sig(?:nature)?|pass(?:word)?|auth|code))=(?P<v>[^&\s'\"`#]+)")
_SCHEME = re.compile(r"(?i)\b(?P<s>bearer|basic|token)\s+(?P<v>[A-Za-z0-9._~+/=\-]{8,}|\$[^\s'\"`]+)")
_FLAG = re.compile(r"(?i)(?<=\s)--?(?P<n>[a-z-]*(?:pass(?:word|wd)?|pwd|secret|token|key|pin))[= ](?P<q>['\"]?)(?P<v>[^\s'\"]+)(?P=q)")
_SHORT = re.compile(r"(?<=\s)-p\s?(?P<q>['\"]?)(?P<v>[^\s'\"]{6,})(?P=q)(?=\s|$)")
_USER = re.compile(r"(?<=\s)(?:-u\s?|--user[= ])(?P<q>['\"]?)[\w.@-]+:(?P<v>[^\s'\"]+)(?P=q)")
_ENV = re.compile(r"(?i)(?:^|(?<=[\s;&|'\"`])|(?<=\\n))(?P<n>[a-z][a-z0-9_]*)=(?P<q>['\"]?)(?P<v>[^\s'\"`;&|\\]+)(?P=q)")
_NOTE = re.compile(rf"(?i)\b(?:{NAME}|key|creds?)\b")
_NOTED = re.compile(r"\s*(?P<v>[A-Za-z0-9+/=_.~\-]{16,})")
_STOP = re.compile(r"[\n:=]")
_PUBLIC = re.compile(r"-----BEGIN (?:[A-Z0-9]+ )*(?:PUBLIC KEY|CERTIFICATE)[^-]*-----(?:(?!-----END)[\s\S])*")
_VENDOR = re.compile(rf"(?<![A-Za-z0-9_+/-]){VENDOR}")
_LONG = re.compile(r"(?<![A-Za-z0-9+/=_.\-])[A-Za-z0-9+/_\-]{20,}={0,2}(?![A-Za-z0-9+/_\-])")
_JOINED = re.compile(rf"(?P<all>(?:{STRING})(?:\s*\+\s*(?:{STRING}))+|\[\s*(?:{STRING})(?:\s*,\s*(?:{STRING}))+\s*\]\s*\.join\(\s*(?:''|\"\"|``)\s*\))")
_STRING = re.compile(STRING)
#: What stands before a candidate is matched in the text written backwards, from the candidate on: no window is needed.
_QUOTE = r"['\"`\]]"
_NAMED = re.compile(rf"(?:\s*\((?:morf\.reffuB|bota|edoced46b))?\s*(?:\btiawa\s+)?(?P<op>:|>=|={{1,3}}|==?!|\?\?|\|\||\()[^\S\n]*{_QUOTE}*(?P<n>[\w$.\[\]'\"`-]+)")
_OR = re.compile(r"[^\S\n]*(?:\?\?|\|\|)[^\S\n]*(?P<n>\w+)")
_OR_SET = re.compile(r"[^\S\n]*(?:\?\?|\|\|)[^\S\n]*[\w.\[\]'\"]+[^\S\n]*[:=][^\S\n]*(?P<n>\w+)")
_CALLED = re.compile(r"[^\S\n]*,[^\S\n]*(?:'[^'\n]*'|\"[^\"\n]*\"|`[^`\n]*`)[^\S\n]*\([^\S\n]*(?P<n>\w+)")
_DECODER = re.compile(r"[^\S\n]*\([^\S\n]*(?:morf\.reffuB|bota|edoced46b|edoced\.46esab)")
_LABEL = re.compile(r"(?i)-\d{1,3}ahs|,46esab|\W*ytirgetni|\W*tsegid|\W*muskcehc")
_INSIDE = re.compile(r"[^\s'\"`<>]*")
_CREDENTIAL_NAME = re.compile(rf"(?i)(?:^|[^a-z]|(?<=[a-z])){NAME}s?['\"`\]]*$")
_CALL = re.compile(r"(?i)^(?:log_?in|sign_?in|bind_?as|set_?password|authenticate|connect|credentials?|\w*client|auth\w*)$")

#: A text without any of this holds no candidate; evaluated by the JVM, so that other texts never reach Python.
WORTH = (
    r"(?i)pass|pwd|secret|token|key|cred|auth|jwt|bearer|basic|base64|atob|\bpin\b|login|sign_?in|bind_?as|connect|client|sig=|[?&][\w-]*(?:code|signature)=|\s-u|\s--user[= ]|\s-p|://[^\s/]*:[^\s/]*@"
    r"|[A-Za-z0-9+/_=-]{20,}"
)


def entropy(s: Sequence) -> float:
    """Bits per symbol."""
    n = len(s)
    return -sum(k / n * math.log2(k / n) for k in Counter(s).values()) if n else 0.0


#: Size of an alphabet -> characters of each kind in it: lower case, upper case, digits, signs.
ALPHABETS = {10: (0, 0, 10, 0), 16: (6, 0, 10, 0), 26: (26, 0, 0, 0), 36: (26, 0, 10, 0), 62: (26, 26, 10, 0), 65: (26, 26, 10, 3), 94: (26, 26, 10, 32)}
_KINDS = str.maketrans({**{chr(c): "s" for c in range(128)}, **dict.fromkeys(string.ascii_lowercase, "l"), **dict.fromkeys(string.ascii_uppercase, "u"), **dict.fromkeys(string.digits, "d")})


def alphabet(s: str) -> int:
    """Size of the smallest common alphabet that ``s`` is drawn from."""
    if s.isascii() and s.isalnum():
        one_case = s == s.lower() or s == s.upper()
        if s.isdigit():
            return 10
        if HEX.match(s) and one_case and re.search(r"\d", s):
            return 16
        return (26 if s.isalpha() else 36) if one_case else 62
    return 65 if re.fullmatch(r"[A-Za-z0-9+/=_-]+", s) else 94


@lru_cache(1 << 16)
def _share(n: int, p: float) -> float:
    """Expected part, in the entropy seen in ``n`` draws, of a symbol of probability ``p``."""
    q, s, k = (1 - p) ** n, 0.0, 0
    while k < n:
        q *= (n - k) / (k + 1) * p / (1 - p)
        k += 1
        s -= q * k / n * math.log2(k / n)
        if k > n * p and q < 1e-12:
            break
    return s


@lru_cache(1 << 14)
def expected(n: int, size: int) -> tuple[float, float]:
    """Entropies to expect of a random string of ``n`` characters over an alphabet: of its characters, and of the kinds of neighbours.

    Exact for short strings, which can't reach log2(size); for long ones less the bias (size - 1) / (2 n ln 2).
    """
    kinds = [k / size for k in ALPHABETS[size] if k]
    cells = [a * b for a in kinds for b in kinds] if len(kinds) > 1 else []
    if n > EXACT:
        return math.log2(size) - (size - 1) / (2 * n * math.log(2)), -sum(p * math.log2(p) for p in cells) - max(len(cells) - 1, 0) / (2 * n * math.log(2))
    return size * _share(n, 1 / size) if n else 0.0, sum(_share(n - 1, p) for p in cells) if n > 1 else 0.0


def information(s: str) -> tuple[float, float]:
    """(entropy of the characters as a share of a random string's, the same of characters and kinds of neighbours together)."""
    chars, pairs = expected(len(s), alphabet(s))
    if not chars:
        return 0.0, 0.0
    own = entropy(s)
    return own / chars, (own / chars + _mixture(s) / pairs) / 2 if pairs else own / chars


def _mixture(s: str) -> float:
    """Entropy of the kinds of neighbouring characters."""
    kinds = s.translate(_KINDS)
    return entropy(list(zip(kinds, kinds[1:], strict=False)))


def random_named(s: str) -> bool:
    """Whether a value that a name announces holds enough to be guessed by nobody."""
    return entropy(s) * len(s) + _mixture(s) * (len(s) - 1) >= NAMED_BITS and information(s)[0] >= NAMED_SHARE


def random_bare(s: str) -> bool:
    """Whether a value that nothing names is as random as its length and alphabet allow."""
    return information(s)[1] >= BARE_SHARE


def _vowels(s: str) -> bool:
    """Letters as languages have them: vowels at the usual rate and no long runs of consonants."""
    t = re.sub(r"[^A-Za-z]", "", s).lower()
    v = sum(c in "aeiouy" for c in t)
    return bool(t) and v >= 0.22 * len(t) and not re.search(r"[bcdfghjklmnpqrstvwxz]{6}", t)


def is_identifier(s: str) -> bool:
    """Only words, as in an identifier, a path or prose."""
    return bool(IDENTIFIER.match(s)) and (s == s.lower() or not re.search(r"[A-Z]{2,}[a-z]|[a-z][A-Z][a-z]?[A-Z]", s)) and _vowels(s)


def excluded(v: str) -> bool:
    """Placeholder, lookup, hash with its label, UUID, or prose."""
    return bool(PLACEHOLDER.match(v) or LOOKUP.search(v) or HASHED.match(v) or UUID.match(v) or v.startswith("data:") or re.search(r"\s", v))


def is_named_secret(v: str, name: str = "") -> bool:
    """A value whose surroundings name a credential."""
    if excluded(v) or len(v) < NAMED_LEAST or NOT_SECRET.search(name) or v.isdigit():
        return False
    if "://" in v or v.startswith("//") or PATHLIKE.match(v) and "/" in v[:2]:
        return False
    if is_identifier(v) and (v == v.lower() or re.search(rf"(?i){NAME}$", v)):
        return False
    return random_named(v)


def is_bare_secret(v: str) -> bool:
    """A value that nothing names: long, no hash, and random."""
    return len(v) >= BARE_LEAST and not excluded(v) and "://" not in v and not HEX.match(v) and not PATHLIKE.match(v) and random_bare(v)


def decoded(v: str) -> str | None:
    """The text that ``v`` is the base64 form of, or None."""
    if len(v) < 8 or not re.fullmatch(r"[A-Za-z0-9+/_-]+={0,2}", v):
        return None
    try:
        t = base64.b64decode(v + "=" * (-len(v) % 4), altchars=b"-_" if "-" in v or "_" in v else None, validate=True).decode("utf-8")
    except (binascii.Error, ValueError):
        return None
    return t if t.isprintable() else None


def _encoded(v: str) -> bool | None:
    """Whether base64 text hides a secret; None: it isn't the base64 form of a text."""
    t = decoded(v)
    if t is None:
        return None
    if ":" in t and not re.search(r"\s", t) and "://" not in t:
        t = t.split(":", 1)[1]
    return bool(re.search(VENDOR, t)) or is_named_secret(t)


def find(text: str) -> list[tuple[int, int, str]]:
    """Spans (start, end, replacement) of the secrets in a text, in order, none inside another."""
    out: list[tuple[int, int, str]] = []
    taken = bytearray(len(text))
    back = text[::-1]

    def take(a: int, b: int, mask: str = MASK) -> None:
        if b > a and not any(taken[a:b]):
            taken[a:b] = b"\1" * (b - a)
            out.append((a, b, mask))

    public = [m.span() for m in _PUBLIC.finditer(text)] if "-----BEGIN" in text else []
    for m in _PEM.finditer(text):
        body = re.sub(r"[^A-Za-z0-9+/=]", "", m["body"].replace("\\n", ""))
        if len(body) >= BARE_LEAST and not LOOKUP.search(m["body"]) and random_named(body):
            a, b = m.span("body")
            core = re.search(r"(?:\\n|[\s\"'`+,])*([\s\S]*?)(?:\\n|[\s\"'`+,;\])])*$", m["body"])
            take(a + core.start(1), a + core.end(1)) if core and core[1] else take(a, b)
    for a, b, name, mask in _tokens(text):
        v = text[a:b]
        if _encoded(v) if mask == MASK64 else is_named_secret(v, name):
            take(a, b, mask)
    covered: list[tuple[int, int]] = []
    for m in _JOINED.finditer(text):
        parts = [s.span() for s in _STRING.finditer(text, *m.span()) if s.end() - s.start() > 2]
        whole = "".join(text[a + 1 : b - 1] for a, b in parts)
        covered.append(m.span())
        if _judge(text, back, m.start(), m.end(), whole):
            for a, b in parts:
                take(a + 1, b - 1)
    inside = bytearray(len(text) + 1)
    for a, b in covered:
        inside[a:b] = b"\1" * (b - a)
    for m in _STRING.finditer(text):
        a, b = m.start() + 1, m.end() - 1
        if b - a >= NAMED_LEAST and not inside[a]:
            kind = _judge(text, back, m.start(), m.end(), text[a:b])
            if kind:
                take(a, b, MASK64 if kind == "encoded" else MASK)
    for m in _VENDOR.finditer(text):
        if random_named(m[0]) and not re.search(r"(?i)x{6}|example", m[0]):
            take(*m.span())
    for m in _LONG.finditer(text):
        a = m.start()
        if is_bare_secret(m[0]) and not _LABEL.match(back, len(text) - a) and "//:" not in _INSIDE.match(back, len(text) - a)[0] and not any(x < m.end() and a < y for x, y in public):
            if "---" not in m[0] and decoded(m[0]) is None:
                take(*m.span())
    return sorted(out)


def _tokens(text: str) -> Iterator[tuple[int, int, str, str]]:
    """(start, end, name, mask) of the long tokens that an address, a header, an option, an assignment or a note announces."""
    for m in _URL.finditer(text):
        yield *m.span("v"), "", MASK
    for m in _SCHEME.finditer(text):
        v, scheme = m["v"], m["s"]
        if scheme.lower() == "basic":
            yield *m.span("v"), "", MASK64
        elif re.search(r"\d|[A-Z]", v) and (scheme[0] == "B" or scheme.lower() == "bearer"):
            yield *m.span("v"), "", MASK
    for m in _QUERY.finditer(text):
        yield *m.span("v"), "", MASK
    for p in (_FLAG, _SHORT, _USER, _ENV):
        for m in p.finditer(text):
            name = m.groupdict().get("n") or ""
            if p is _ENV and not _CREDENTIAL_NAME.search(name) or p is _SHORT and not re.search(r"\d|[A-Z]", m["v"]):
                continue
            yield *m.span("v"), name, MASK
    start = before = 0  # of the line, and of what lies between two separators
    for m in _STOP.finditer(text):
        if m[0] != "\n" and (v := _NOTED.match(text, m.end())) and re.search(r"\d|[+/=]", v["v"]) and not is_identifier(v["v"]):
            said = text[before : m.start()]
            n = _NOTE.search(said)
            if n and "'" not in said[n.start() :] and re.search(r"//|/\*|^\s*[*#]", text[start : before + n.start() + 1]):
                yield *v.span("v"), "", MASK
        before = m.end()
        if m[0] == "\n":
            start = before


def _judge(text: str, back: str, start: int, end: int, v: str) -> str:
    """What the string literal at ``start`` is: '' (no secret), 'plain' or 'encoded'. ``back`` is the text written backwards."""
    if excluded(v):
        return ""
    at = len(text) - start
    named, hides = _NAMED.match(back, at), bool(_DECODER.match(back, at))
    name = re.sub(r"['\"`\[\]]+$", "", named["n"][::-1]) if named else ""
    is_call = bool(named) and named["op"] == "(" and not hides
    credential = bool(named) and not is_call and bool(_CREDENTIAL_NAME.search(name)) and not NOT_SECRET.search(name)
    if not credential and (m := _OR.match(back, at)) and re.search(rf"(?i){NAME}", m["n"][::-1]):
        credential = True
    if not credential and (m := _OR_SET.match(back, at)):
        name = m["n"][::-1]
        credential = bool(_CREDENTIAL_NAME.search(name))
    if hides or re.match(r"""\s*,\s*['"`]base64""", text[end : end + 16]):
        hidden = _encoded(v)
        return "encoded" if hidden and (credential or not re.search(r"\s", decoded(v) or " ")) else "" if hidden is not None else "plain" if credential and is_named_secret(v, name) else ""
    called = _CALLED.match(back, at)
    if credential or called and _CALL.match(called["n"][::-1]):
        if is_named_secret(v, name if credential else ""):
            return "plain"
    if re.search(VENDOR, v) and not re.search(r"(?i)x{6}|example", v) and " " not in v and random_named(v):
        return "plain"
    if re.fullmatch(r"[A-Za-z0-9+/_-]{20,}={0,2}", v) and is_bare_secret(v):
        return "plain" if decoded(v) is None else "encoded" if _encoded(v) and re.search(VENDOR, decoded(v) or "") else ""
    return ""


def redact(text: str) -> str:
    """The text with every secret replaced by a mask of the same syntactic kind. Texts without one stay as they are."""
    at, out = 0, []
    for a, b, mask in find(text):
        out += [text[at:a], mask]
        at = b
    return "".join(out) + text[at:]


def worth(c: Column) -> Column:
    return c.rlike(WORTH)


def scan(texts: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """(*keys, secrets int, redacted string) of the rows of ``texts`` that hold a secret.

    A narrow map: nothing is shuffled. Null texts hold none; extra columns are left out.
    """
    schema = ", ".join(f"`{k}` {texts.schema[k].dataType.simpleString()}" for k in keys) + ", secrets int, redacted string"
    asked = texts.select(*keys, F.col(text).alias("_text")).where(F.col("_text").isNotNull() & worth(F.col("_text")))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            n, masked = [], []
            for t in pdf["_text"]:
                spans = find(t)
                n.append(len(spans))
                masked.append(redact(t) if spans else None)
            out = pdf[keys].assign(secrets=n, redacted=masked)
            yield out[out["secrets"] > 0]

    return asked.mapInPandas(run, schema)


def places(functions: DataFrame, packages: DataFrame) -> DataFrame:
    """(field, record_id, slot, text) of every text value that may hold a secret; null values are left out."""
    statements = functions.select("func_id", F.explode("key_statements").alias("s")).select(
        F.lit("key_statements").alias("field"), F.col("func_id").alias("record_id"), F.col("s.line").cast("string").alias("slot"), F.col("s.text").alias("text")
    )
    snippets = functions.select(F.lit("code_snippet").alias("field"), F.col("func_id").alias("record_id"), F.lit("").alias("slot"), F.col("code_snippet").alias("text"))
    scripts = packages.select("package_id", F.explode("scripts").alias("slot", "text")).select(F.lit("scripts").alias("field"), F.col("package_id").alias("record_id"), "slot", "text")
    return statements.unionByName(snippets).unionByName(scripts).where(F.col("text").isNotNull())
