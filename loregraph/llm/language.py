"""Natural language inside code: a character-level hidden Markov model with a code state and language states.

Each state emits a character given the few before it (an interpolated n-gram model, trained from
``seeds``). The states change seldom, and only between words. Viterbi runs over the whole text; where the
text is source code, language states are allowed in comments and string literals only. What the best path
gives to a language is kept if it makes a clause.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loregraph.llm.seeds import CODE, PROSE

LANGUAGES = ("en", "de", "fr", "es", "pt", "pl", "ru", "zh", "ja")
STATES = ("code", *LANGUAGES)
#: Characters in an n-gram.
ORDER = 5
#: Log-probability of a change of state between words, and after the end of a clause.
CHANGE, CHANGE_CLAUSE = -14.0, -7.0
#: Log-probability that a language emits a character of a token that is code by its look.
IN_CODE = -4.0
#: Words of a clause; characters of a phrase in a script without blanks.
WORDS, SIGNS = 3, 4
#: Characters of a text whose emissions are held at a time. Scores and the n-gram's context go on from one block to
#: the next and the best path is traced back through all of them, so that where a text is cut makes no difference.
BLOCK = 4096

_HAN, _KATA, _DIGIT, _OTHER, _GAP = "漢", "ア", "0", "¤", " "


def repair(text: str) -> str:
    """Text that was decoded with the wrong code page, put right where that is possible; composed accents."""
    if re.search(r"[ÃÂÄÅÐÑ][\x80-\xbfŒœŠšŽžŸƒˆ˜–-€™]|[ÐÑ].[ÐÑ]|[ãäåæçèé][\x80-\xbfŒœŠšŽžŸƒˆ˜–-€™]", text):
        for page in ("cp1252", "latin-1"):
            try:
                text = text.encode(page).decode("utf-8")
                break
            except UnicodeError:
                continue
        else:
            text = re.sub(r"[ÂÃÄÅ][\x80-\xbf]", lambda m: m[0].encode("latin-1").decode("utf-8", "replace"), text)
    return unicodedata.normalize("NFC", text)


def plain(text: str) -> str:
    """The characters that the model sees, one for each of the text: lower case, scripts and digits in classes."""
    out = []
    for c in text:
        if c.isdigit():
            out.append(_DIGIT)
        elif "一" <= c <= "鿿" or c == "々":
            out.append(_HAN)
        elif "゠" <= c <= "ヿ":
            out.append(_KATA)
        elif c.isspace():
            out.append(_GAP)
        else:
            low = c.lower()
            out.append(low if len(low) == 1 and (low.isalpha() or low in "'’.,;:!?()[]{}<>=+-*/\\|&@#$%^~`\"_，。、！？；：") else _OTHER)
    return "".join(out)


class Characters:
    """What is known of a character, by its number: the model's code, whether it is a letter or an apostrophe, whether words may part beside it.

    A table over all characters, filled as they turn up.
    """

    def __init__(self, codes: dict[str, int]) -> None:
        self.codes = codes
        self.code = np.full(0x110000, -1, np.int16)
        self.letter = np.zeros(0x110000, bool)
        self.sign = np.zeros(0x110000, bool)

    def read(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(codes, letters, signs of a script without blanks) of a text's characters."""
        at = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        code = self.code[at]
        if code.min(initial=0) < 0:
            for x in np.unique(at[code < 0]):
                c = plain(chr(x))
                self.code[x], self.letter[x], self.sign[x] = self.codes.get(c, 0), c.isalpha() or c in "'’", c in (_HAN, _KATA)
            code = self.code[at]
        return code, self.letter[at], self.sign[at]


def bare(text: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKD", text.translate(str.maketrans("łŁøØ", "lLoO"))) if not unicodedata.combining(c))


class Model:
    """Emissions of all states: n-gram tables of log-probabilities, a row per n-gram and a column per state."""

    def __init__(self) -> None:
        texts: list[list[str]] = [CODE.split("\n")]
        for lang in LANGUAGES:
            own = [s.strip() for s in re.split(r"(?<=[.?!。？])\s*|\n", PROSE[lang]) if s.strip()]
            texts.append(own + ([bare(s) for s in own] if lang not in ("ru", "zh", "ja", "en") else []))
        counts = [Counter() for _ in STATES]
        for k, lines in enumerate(texts):
            for s in lines:
                t = _GAP * (ORDER - 1) + plain(s) + _GAP
                for i in range(ORDER - 1, len(t)):
                    for n in range(1, ORDER + 1):
                        counts[k][t[i - n + 1 : i + 1]] += 1
        chars = sorted({g for c in counts for g in c if len(g) == 1})
        self.codes = {c: i + 1 for i, c in enumerate(chars)}
        self.characters = Characters(self.codes)
        size, n_states = len(chars) + 1, len(STATES)
        self.base = size + 1
        self.tables = []
        floor = np.full(n_states, 1.0 / (size + 60))
        known: dict[str, int] = {}
        shares = floor[None]  # of the n-grams that are one character shorter
        for n in range(1, ORDER + 1):
            grams = sorted({g for c in counts for g in c if len(g) == n}, key=self._key)
            at = {g: i for i, g in enumerate(grams)}
            seen = np.zeros((len(grams), n_states))
            for k, c in enumerate(counts):
                own = [(at[g], v) for g, v in c.items() if len(g) == n]
                seen[[i for i, _ in own], k] = [v for _, v in own]
            heads = sorted({g[:-1] for g in grams}, key=self._key)
            place = {h: i for i, h in enumerate(heads)}
            head = np.array([place[g[:-1]] for g in grams])
            mass, kinds = np.zeros((len(heads), n_states)), np.zeros((len(heads), n_states))
            np.add.at(mass, head, seen)
            np.add.at(kinds, head, seen > 0)
            weight = np.where(mass > 0, kinds / np.maximum(mass + kinds, 1e-9), 1.0)  # Witten-Bell: the share of what hasn't been seen is that of the different successors
            lower = shares[[known[g[1:]] for g in grams]] if n > 1 else shares
            shares = np.where(mass[head] > 0, (1 - weight[head]) * seen / np.maximum(mass[head], 1e-9), 0) + weight[head] * lower
            known = at
            if n == 1:
                self.floor = np.log(floor * weight[0]).astype(np.float32)
            self.tables.append((np.array([self._key(x) for x in grams]), np.log(shares).astype(np.float32), np.array([self._key(x) for x in heads]), np.log(weight).astype(np.float32)))

    def _key(self, gram: str) -> int:
        k = 0
        for c in gram:
            k = k * self.base + self.codes.get(c, 0)
        return k

    def encode(self, t: str) -> np.ndarray:
        get = self.codes.get
        return np.fromiter((get(c, 0) for c in t), np.int64, len(t))

    def emissions(self, codes: np.ndarray, step: int = 1, asked: np.ndarray | None = None) -> np.ndarray:
        """Log-probability (position, state) of each character of texts that are parted by at least ORDER - 1 gaps.

        The character before one stands ``step`` positions before it. Only ``asked`` positions are filled, if given.
        """
        n_pos = len(codes)
        out = np.zeros((n_pos, len(STATES)), np.float32)
        todo = np.arange(n_pos) if asked is None else asked
        gap = self.codes[_GAP]
        padded = np.concatenate([np.full((ORDER - 1) * step, gap, np.int64), codes])
        for n in range(ORDER, 0, -1):
            grams, logs, heads, weights = self.tables[n - 1]
            key = np.zeros(len(todo), np.int64)
            for j in range(n - 1, -1, -1):
                key = key * self.base + padded[todo + (ORDER - 1 - j) * step]
            at = np.minimum(np.searchsorted(grams, key), len(grams) - 1)
            hit = grams[at] == key
            out[todo[hit]] += logs[at[hit]]
            todo, key = todo[~hit], key[~hit] // self.base
            at = np.minimum(np.searchsorted(heads, key), len(heads) - 1)
            near = heads[at] == key
            out[todo[near]] += weights[at[near]]
        out[todo] += self.floor
        return out


_MODEL: Model | None = None


def model() -> Model:
    """Trained once in each process; takes a fraction of a second."""
    global _MODEL
    if _MODEL is None:
        _MODEL = Model()
    return _MODEL


_CODE_TOKEN = re.compile(
    r"`[^`\s\u3040-\u30ff\u4e00-\u9fff]*`|https?://\S+|\b[a-z]+[A-Z]\w*(?:\(\w*\)|\[[^\]]*\])?|\b[A-Z][a-z]+[A-Z]\w*(?:\(\w*\))?|\b\w+\([\w.,]*\)|\b\w+(?:\.\w+)+\b(?:\s*=\s*\w+)?|\b\w+\[\d+\]\S*|@[\w/-]+-[\w-]+|#region\b|#\d+"
    r"|\b[a-z]+(?:-[a-z]+){2,}\b|\b[A-Z]{2,}-\d+\b|\b0x[0-9a-fA-F]+\b|\bv?\d+(?:\.\d+)+\b|[<{}\[\]=;|\\/]{1,3}|=>|->|\b\w*_\w+\b|\b(?=\w*\d)(?=\w*[a-zA-Z])\w+\b"
)
_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
_LITERAL = re.compile(r"\"(?:[^\"\\\n]|\\.)*\"|`(?:[^`\\]|\\.)*`|(?<![^\W\d_])'(?:[^'\\\n]|\\.)*'(?![^\W\d_])")
_STATEMENT = re.compile(
    r"^\s*(?:(?:const|let|var|return|throw|import|export|await|new|if|for|while|else|try|case|switch)\b.*[;{}()=]|[\w.$]+(?:\[[^\]]*\])?\s*(?:=(?!>)|\+=|-=|\+\+|--)\s*\S*;?|[\w.$]+\s*\(.*\)\s*;?\s*$|<\/?[A-Za-z][^>]*\/?>\s*$|[{}()\[\];]+\s*$)"
)
_MARKER = re.compile(r"^\s*(?:[@#>*/!-]|\(\w{1,3}\)|\b(?:TODO|FIXME|HACK|XXX|NB|NOTE|todo|fixme|hack|xxx|nb|note)\b(?:\([\w ]*\))?:?)\s*")


def spans_of_source(text: str) -> list[tuple[int, int]]:
    """The comments and string literals of a source text: the only places where language is looked for."""
    out = []
    for m in re.finditer(rf"//[^\n]*|/\*[\s\S]*?(?:\*/|\Z)|(?m:^[^\S\n]*+(?:#|--)[^\n]*)|{_LITERAL.pattern}", text):
        out.append(m.span())
    return out


_OPEN, _CODE = 1, 2


def _allow(ok: np.ndarray, text: str, source: bool, tokens: list[tuple[int, int]]) -> None:
    """Set, per character, 0 where only code may be, and _CODE in ``tokens`` that look like code; _OPEN stays where language may be."""
    line = _MARKER.sub("", text)
    if source or _STATEMENT.match(line) or re.match(r"\s*[\w.]+\((?:\"|`|')", line):
        ok[:] = 0
        for a, b in spans_of_source(text) if source else [m.span() for m in _LITERAL.finditer(text)]:
            ok[a:b] = _OPEN
    for a, b in tokens:
        ok[a:b] *= _CODE


#: What every match of _CODE_TOKEN holds.
_MAY = re.compile(r"[`(\[@#\d<>{\]}=;|\\/_]|\w\.\w|\w-\w+-\w|[a-z][A-Z]")


def code_tokens(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in _CODE_TOKEN.finditer(text)] if _MAY.search(text) else []


#: Scores of _allow's values.
_BAN = np.array([-1e3, 0, IN_CODE], np.float32)
_ENDS = re.compile(r"[.!?;:/。！？]\s*(?=\S)|--\s+|[\"`']")


def paths(texts: list[str], source: bool = False, tokens: list[list[tuple[int, int]]] | None = None) -> list[np.ndarray]:
    """The state of each character of each text, by Viterbi over all texts at once, grouped by length."""
    tokens = [code_tokens(t) for t in texts] if tokens is None else tokens
    m = model()
    gap = m.codes[_GAP]
    out: list[np.ndarray] = [np.zeros(len(t), np.int8) for t in texts]
    jobs = sorted(((i, t) for i, t in enumerate(texts) if t), key=lambda j: len(j[1]))
    at = 0
    while at < len(jobs):
        end, cells = at, 0
        while end < len(jobs) and (end == at or (end - at + 1) * (len(jobs[end][1]) + 1) <= 400_000) and len(jobs[end][1]) <= len(jobs[at][1]) * 1.3 + 16:
            end += 1
        group = jobs[at:end]
        at = end
        n, width = len(group), len(group[-1][1])
        codes = np.full((ORDER - 1 + width, n), gap, np.int64)  # a column per text, after the gaps that it starts from
        change = np.full((width, n), -1e4, np.float32)
        ban = np.zeros((width, n), np.float32)
        own, letter, sign = m.characters.read("".join(t for _, t in group))  # all texts of the group end to end
        size = np.array([len(t) for _, t in group])
        start = np.cumsum(size) - size
        text, place = np.repeat(np.arange(n), size), np.arange(len(own)) - np.repeat(start, size)
        move = np.full(len(own), CHANGE, np.float32)
        move[1:][letter[:-1] & letter[1:] & ~sign[1:]] = -1e4
        ok = np.full(len(own), _OPEN, np.int8)
        ends: list[int] = []
        for at_, (i, t) in zip(start.tolist(), group, strict=True):
            ends += [at_ + x.end() for x in _ENDS.finditer(t) if x.end() < len(t)]
            _allow(ok[at_ : at_ + len(t)], t, source, tokens[i])
        move[ends] = np.maximum(move[ends], CHANGE_CLAUSE)
        codes[ORDER - 1 + place, text] = own
        change[place, text], ban[place, text] = move, _BAN[ok]
        moved = np.zeros((width, n, len(STATES)), bool)
        best = np.zeros((width, n), np.int8)
        live = np.searchsorted(size, np.arange(width), "right")  # texts are sorted by length: those from here on reach a position
        for first in range(0, width, BLOCK):
            last = min(first + BLOCK, width)
            asked = np.flatnonzero(np.arange(first, last)[:, None] < size) + (ORDER - 1) * n
            emit = m.emissions(codes[first : last + ORDER - 1].ravel(), n, asked).reshape(last - first + ORDER - 1, n, -1)[ORDER - 1 :]
            emit[:, :, 1:] += ban[first:last, :, None]
            for t in range(first, last):
                if t == 0:
                    score = emit[0].astype(np.float64)
                    continue
                k = live[t]
                now = score[k:]
                best[t, k:] = now.argmax(1)
                jump = (now.max(1) + change[t, k:])[:, None]
                np.greater(jump, now, out=moved[t, k:])
                np.maximum(jump, now, out=now)
                now += emit[t - first, k:]
        state = score.argmax(1)
        states = np.zeros((width, n), np.int8)
        rows = np.arange(n)
        for t in range(width - 1, -1, -1):
            states[t] = state
            if t:
                state = np.where(moved[t, rows, state], best[t], state)
        states = np.ascontiguousarray(states.T)
        for r, (i, t) in enumerate(group):
            out[i][:] = states[r, : len(t)]
    return out


def clauses(text: str, path: np.ndarray, tokens: list[tuple[int, int]] | None = None) -> dict[str, int]:
    """Language -> characters of its clauses in a text, given its path.

    Tokens that look like code may stand inside a clause. A clause has WORDS words, or SIGNS characters of
    a script without blanks.
    """
    out: dict[str, int] = {}
    if not path.any():
        return out
    at, parts = 0, []
    for a, b in code_tokens(text) if tokens is None else tokens:
        parts += [text[at:a], " " * (b - a)]
        at = b
    own = "".join([*parts, text[at:]])  # without code
    cuts = [0, *((path[1:] != path[:-1]).nonzero()[0] + 1).tolist(), len(path)]
    runs: list[list[int]] = []
    for a, b in zip(cuts, cuts[1:], strict=False):
        s = int(path[a])
        if s == 0:
            continue
        if runs and runs[-1][0] == s and not re.search(r"\w", own[runs[-1][2] : a]):
            runs[-1][2] = b
        else:
            runs.append([s, a, b])
    for s, a, b in runs:
        lang, said = STATES[s], own[a:b]
        if lang in ("zh", "ja"):  # one script in common: kana tell
            lang = "ja" if re.search(r"[\u3040-\u30ff]", said) else "zh"
            n = len(re.findall(r"[぀-ヿ一-鿿々]", said))
            enough = n >= SIGNS
        else:
            words = _WORD.findall(said)
            n = sum(map(len, words))
            enough = len(words) >= WORDS
        if enough:
            out[lang] = out.get(lang, 0) + n
    return out


def detect(texts: list[str], source: bool = False) -> list[dict[str, int]]:
    """Language -> letters in clauses, for each text. Empty texts and those without a clause give {}."""
    fixed = [repair(t or "") for t in texts]
    tokens = [code_tokens(t) for t in fixed]
    return [clauses(t, p, k) if len(t) else {} for t, p, k in zip(fixed, paths(fixed, source, tokens), tokens, strict=True)]


def spoken(texts: DataFrame, keys: list[str], text: str = "text", source: bool = False) -> DataFrame:
    """(*keys, lang, letters) of each language with a clause in each row's text: a narrow map.

    Null and blank texts have none. Equal texts in a batch are examined once.
    """
    schema = ", ".join(f"`{k}` {texts.schema[k].dataType.simpleString()}" for k in keys) + ", lang string, letters long"
    asked = texts.where(F.col(text).rlike(r"\p{L}\s*\P{L}*\p{L}")).select(*keys, F.col(text).alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column("_text").dictionary_encode()
            found = detect(own.dictionary.to_pylist(), source)
            row, lang, n = [], [], []
            for i, k in enumerate(own.indices.to_pylist()):
                for x, v in found[k].items():
                    row.append(i), lang.append(x), n.append(v)
            if row:  # keys stay as they are: in pandas, numbers beside a null would become floats
                yield pa.RecordBatch.from_arrays([*(batch.column(k).take(pa.array(row)) for k in keys), pa.array(lang, pa.string()), pa.array(n, pa.int64())], [*keys, "lang", "letters"])

    return asked.mapInArrow(run, schema)
