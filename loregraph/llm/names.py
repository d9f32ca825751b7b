"""Variant spellings of names typed by people.

Spellings are read into forms: a person's or organisation's words, folded to plain lower-case letters, in
alphabetical order. Equal forms are one entity. Forms within one edit of each other (a letter added, lost,
changed, or two neighbours swapped), or two in one long word, are found by a pigeonhole segment join: each form is cut into K + 1
segments, of which K edits leave at least one intact; substrings of the other form at the positions where
the segment can have moved to are looked up in an inverted index of segments, and what meets is verified
with a banded edit distance. Spellings that hold less than the name (initials, log-ins, abbreviations) join
the one entity in the same repository that they can stand for; where there are several, none.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loregraph.operators.orphans import hot_keys
from loregraph.session import cut

#: Edits that segments are cut for: a swap of neighbours is two edits of the banded distance.
K = 2
#: Shorter forms have no typing errors: on them an edit makes another name.
LEAST = 6
#: Letters of a word in which two edits are a typing error too, where all other words of the name are equal. On
#: shorter ones they make other names (alexander, alexandra).
LONG = 10
#: A segment, or an entity, that has more than this share of all rows is split into SALTS parts.
HOT, SALTS = 0.001, 16

# What is written where nobody's name is known.
NOBODY = frozenset("none null nil nan na unknown anonymous anon nobody noname no-name admin administrator root user users guest default test tester system author no-author undefined unset todo tbd someone somebody person me x xxx - ? . noreply no-reply".split())

# Short forms of given names in common use -> the names they stand for.
NICKNAMES = {
    "abby": "abigail", "alex": "alexander alexandra", "andy": "andrew", "bella": "isabella", "ben": "benjamin", "benji": "benjamin", "bert": "albert robert", "beth": "elizabeth", "betty": "elizabeth", "bill": "william",
    "billy": "william", "bob": "robert", "bobby": "robert", "cathy": "catherine", "charlie": "charles charlotte", "chris": "christopher christine", "dan": "daniel", "danny": "daniel", "dave": "david", "dick": "richard",
    "dima": "dimitri dmitri", "dora": "theodora", "ed": "edward", "eliza": "elizabeth", "ellie": "eleanor", "etta": "henrietta", "fred": "frederick", "freddy": "frederick", "gabi": "gabriela", "gabby": "gabriela", "greg": "gregory", "hank": "henry",
    "harry": "henry harold", "hettie": "henrietta", "izzy": "isabella", "jack": "john", "jake": "jacob", "jamie": "james", "jen": "jennifer", "jenny": "jennifer", "jim": "james", "jimmy": "james", "joe": "joseph", "joey": "joseph", "johnny": "john", "jon": "jonathan",
    "jonny": "jonathan", "kasia": "katarzyna", "kate": "catherine katherine", "katie": "catherine katherine", "kathy": "katherine", "ken": "kenneth", "kit": "christopher", "kostya": "konstantin", "larry": "lawrence", "leo": "leonardo leonard", "lisa": "elizabeth", "liz": "elizabeth",
    "maggie": "margaret", "matt": "matthew", "meg": "margaret", "memo": "guillermo", "mick": "michael", "mike": "michael", "miki": "mikolaj", "nate": "nathaniel nathan", "nell": "eleanor", "nick": "nicholas", "ola": "aleksandra", "paco": "francisco", "pancho": "francisco",
    "pat": "patricia patrick", "patty": "patricia", "peggy": "margaret", "pepe": "jose", "pete": "peter", "phil": "philip", "rick": "richard", "rob": "robert", "robbie": "robert", "ron": "ronald", "sam": "samantha samuel", "sammy": "samantha samuel", "sasha": "alexander alexandra oleksandr aleksandr", "sashko": "oleksandr",
    "steve": "steven stephen", "sue": "susan", "ted": "theodore edward", "thea": "theodora", "theo": "theodore theodora", "tim": "timothy", "tom": "thomas tomas", "tommy": "thomas tomas", "tony": "anthony antonio", "tricia": "patricia", "trish": "patricia", "uli": "ulrike ulrich", "vicky": "victoria", "will": "william",
    "wolf": "wolfgang", "zach": "zachary", "zack": "zachary",
}

# Legal forms, dropped from organisations' names, and words that mark an organisation.
LEGAL = frozenset("inc incorporated ltd limited llc llp plc gmbh ag kg sa sas sarl srl spa bv nv ab oy as corp corporation co company pty".split())
ORG = frozenset(
    "systems software networks research foundation services data tooling robotics labs laboratories laboratory group solutions technologies technology consulting studio studios media institute university college partners ventures holdings industries international global digital analytics cloud security engineering team department council association society agency bank energy health press works".split()
)
LETTERS = str.maketrans({"ł": "l", "ø": "o", "đ": "d", "ð": "d", "þ": "th", "æ": "ae", "œ": "oe", "ß": "ss", "ı": "i", "’": "'", "ħ": "h"})


def fold(s: str) -> str:
    """Lower case without accents; text that was decoded with the wrong code page is repaired first."""
    if re.search(r"[ÃÂÅÄ][\x80-\xbfŒ-™]", s):
        for page in ("cp1252", "latin-1"):
            try:
                s = s.encode(page).decode("utf-8")
                break
            except UnicodeError:
                pass
    s = unicodedata.normalize("NFKD", s.casefold().translate(LETTERS))
    return "".join(c for c in s if not unicodedata.combining(c)).translate(LETTERS)


def formal(word: str) -> list[str]:
    return NICKNAMES.get(word, word).split()


def read(raw: str | None) -> tuple[list[str], list[str], list[str]] | None:
    """(forms, offers, asks) of a spelling, or None where it names nobody.

    ``forms``: its full forms (several for a short name that stands for several). ``offers``: the keys under
    which an initial, a log-in or an abbreviation may ask for it; ``asks``: such keys, of a spelling that
    holds no full name.
    """
    if raw is None or not re.search(r"\w", raw):
        return None
    plain = re.sub(r"\s+", " ", fold(raw)).strip()
    bare = plain.strip("()[]<>{}\"' -*")
    local, _, host = bare.partition("@")
    if re.sub(r"[\s_]+", "-", bare) in NOBODY or re.fullmatch(r"(?:no|not|unknown|anonymous)[ _-]?(?:author|name|user|one|known|available|set)?", bare) or host and re.sub(r"[\s_.]+", "-", local) in NOBODY:
        return None
    text = re.sub(r"\s+", " ", raw).strip()
    acronym = re.search(r"\(([A-Z]{2,6})\)", text)
    text = re.sub(r"\([^)]*\)", " ", text)
    if "@" in text and " " not in text.strip():
        text = re.sub(r"[._+]|(?<=\w)-(?=\w)", " ", text.split("@")[0])
    elif re.fullmatch(r"[a-z0-9]+(?:[-._][a-z0-9]+)+", text.strip()):
        text = re.sub(r"[-._]", " ", text)
    elif re.fullmatch(r"(?:[^\W\d_a-z][^\W\d_A-Z]+){2,3}", text.strip()) and len(re.findall(r"[A-ZÀ-ÞŁŚŻŹĆŠŽČ]", text)) >= 2:
        text = re.sub(r"(?<=[^\W\d_])(?=[A-ZÀ-ÞŁŚŻŹĆŠŽČ][^\W\d_A-Z])", " ", text)
    if "," in text:
        head, _, tail = text.partition(",")
        if not re.fullmatch(r"\W*(?:" + "|".join(LEGAL) + r"|s\.?a\.?)\W*", fold(tail)):
            text = f"{tail} {head}"
    folded = fold(text)
    folded = re.sub(r"\b([a-z])\.([a-z])\.(?=\W|$)", lambda m: m[1] + m[2] if m[1] + m[2] in LEGAL else f"{m[1]} {m[2]}", folded)
    cut_short = {m[1] for m in re.finditer(r"\b([a-z]{2,5})\.", folded)}
    words = re.findall(r"[^\W_]+(?:'[^\W_]+)?", folded)
    legal = [w for w in words if w in LEGAL]
    core = [w for w in words if w not in LEGAL] or words
    is_org = bool(len(words) > 1 and (legal or words[0] == "the" or acronym or any(w in ORG for w in core)))
    if is_org:
        core = [w for w in core if w not in ("the", "and", "of")] or core
        short = [w for w in core if w in cut_short and w not in ORG]
        whole = [w for w in core if w not in cut_short or w in ORG]
        if short and whole:
            return [], [], [f"A:{whole[0]} {short[0][:3]}"]
        offers = [f"A:{a} {b[:3]}" for a in core for b in core if a != b and b in ORG]
        return ["org " + " ".join(sorted(core))], offers, []
    long = [w for w in core if len(w) > 1]
    single = [w for w in core if len(w) == 1]
    if len(long) >= 2:
        forms = sorted({" ".join(sorted([x, *(w for j, w in enumerate(long) if j != i)])) for i, w in enumerate(long) for x in formal(w)})
        if any(w in NICKNAMES for w in long):
            forms = [f for f in forms if f != " ".join(sorted(long))] or forms
        offers = set()
        for f in forms:
            ws = f.split()
            for i, w in enumerate(ws):
                rest = " ".join(x for j, x in enumerate(ws) if j != i)
                offers |= {f"I:{w[0]} {rest}", f"L:{w[0]}{rest.replace(' ', '')}", f"L:{rest.replace(' ', '')}{w[0]}", f"L:{w}{rest.replace(' ', '')}"}
        return forms, sorted(offers), []
    if len(long) == 1 and single:
        return [], [f"L:{single[0]}{long[0]}"], [f"I:{single[0]} {long[0]}"]
    if long:
        return [], [], [f"L:{long[0]}"]
    return None


def spellings(commits: DataFrame, files: DataFrame) -> DataFrame:
    """(repo, author): the distinct spellings of each repository, from all three fields. Rows fall together before the shuffle."""
    a = commits.select("repo", "author")
    b = files.select("repo", F.explode("authors").alias("author"))
    c = files.select("repo", F.col("primary_author").alias("author"))
    return a.unionByName(b).unionByName(c).where(F.col("repo").isNotNull() & (F.trim("author") != "")).distinct()


def parsed(names: DataFrame) -> DataFrame:
    """(repo, author, forms, offers, asks) of the spellings that name somebody."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            got = [(r, a, *x) for r, a in zip(pdf["repo"], pdf["author"], strict=True) if (x := read(a))]
            yield pd.DataFrame(got, columns=["repo", "author", "forms", "offers", "asks"])

    return names.select("repo", "author").mapInPandas(run, "repo string, author string, forms array<string>, offers array<string>, asks array<string>")


def _cuts(size: Column) -> list[tuple[Column, Column]]:
    """(start, length) of the K + 1 segments, as even as can be, of a form of this size."""
    small = F.floor(size / (K + 1)).cast("int")
    out, at = [], F.lit(1)
    for i in range(K + 1):
        length = F.floor((size + i) / (K + 1)).cast("int")
        out.append((at, length))
        at = at + length
    return out


def segments(forms: DataFrame) -> DataFrame:
    """Inverted index of (repo, form): (repo, size, no, part, form), a row for each of K + 1 segments."""
    n = F.length("form")
    each = F.array(*[F.struct(F.lit(i).alias("no"), F.substring(F.col("form"), at, ln).alias("part")) for i, (at, ln) in enumerate(_cuts(n))])
    return forms.where(n >= LEAST).select("repo", "form", n.alias("size"), F.explode(each).alias("s")).select("repo", "size", "s.no", "s.part", "form")


def probes(forms: DataFrame) -> DataFrame:
    """Substrings of (repo, form, probe) that a segment of a form no longer than ``probe`` may have moved to.

    For a form shorter by d, a segment that is intact somewhere lies from ``(K - d) // 2`` places before to
    ``(K + d) // 2`` after its own place: K insertions and deletions in all, d more of one kind.
    """
    n = F.length("probe")
    each = []
    for d in range(K + 1):
        for i, (at, ln) in enumerate(_cuts(n - d)):
            for shift in range(-((K - d) // 2), (K + d) // 2 + 1):
                start = at + shift
                each.append(F.when((n - d >= LEAST) & (start >= 1) & (start + ln - 1 <= n), F.struct((n - d).alias("size"), F.lit(i).alias("no"), F.substring(F.col("probe"), start, ln).alias("part"))))
    rows = forms.select("repo", "form", "probe", F.explode(F.array_compact(F.array(*each))).alias("s"))
    return rows.select("repo", F.col("form").alias("asked"), "probe", "s.size", "s.no", "s.part").distinct()


def swapped(a: Column, b: Column) -> Column:
    """Whether two strings of the same length differ by one swap of neighbours."""
    at = F.sequence(F.lit(1), F.greatest(F.length(a) - 1, F.lit(1)))
    turned = lambda i: F.concat(F.substring(a, F.lit(1), i - 1), F.substring(a, i + 1, F.lit(1)), F.substring(a, i, F.lit(1)), F.substring(a, i + 2, F.length(a)))
    return F.exists(at, lambda i: turned(i) == b)


def one_edit(a: Column, b: Column) -> Column:
    """Whether two strings are within one edit, a swap of neighbours counting as one. The distance is banded."""
    d = F.levenshtein(a, b, K)
    return ((d >= 0) & (d <= 1)) | ((d == 2) & (F.length(a) == F.length(b)) & swapped(a, b))


def two_edits(a: Column, b: Column) -> Column:
    """Whether two names are within two edits, both in one word of LONG letters or more."""
    d = F.levenshtein(a, b, K)
    x, y = F.split(a, " "), F.split(b, " ")
    own, other = F.array_except(x, y), F.array_except(y, x)
    one = (F.size(x) == F.size(y)) & (F.size(own) == 1) & (F.size(other) == 1)
    return (d == 2) & one & (F.length(F.get(own, F.lit(0))) >= LONG) & (F.length(F.get(other, F.lit(0))) >= LONG)


def split_join(index: DataFrame, asked: DataFrame, keys: list[str], by: str) -> DataFrame:
    """``index`` and ``asked`` joined on ``keys``; rows of ``index`` under a hot key are split by a hash of ``by``.

    Hot keys come from a sketch of frequent items, 1/HOT at most, so their list is broadcast; ``asked`` is
    repeated for each part of them, and only of them.
    """
    key = F.concat_ws("\n", *[F.col(k).cast("string") for k in keys])
    index, asked = index.withColumn("_key", key), asked.withColumn("_key", key)
    hot = F.broadcast(hot_keys(index.select("_key"), "_key", HOT).withColumn("_hot", F.lit(True)))
    index = index.join(hot, "_key", "left").withColumn("_part", F.when(F.col("_hot"), F.pmod(F.xxhash64(by), F.lit(SALTS))).otherwise(0).cast("int")).drop("_hot", "_key")
    parts = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    asked = asked.join(hot, "_key", "left").withColumn("_part", F.explode(parts)).drop("_hot", "_key")
    return asked.join(index, [*keys, "_part"]).drop("_part")


def near(forms: DataFrame) -> DataFrame:
    """(repo, a, b) with a < b: distinct forms (repo, form) of one repository within one edit, or two in one long word.

    A form of two words is also looked up with its words turned round, as an error in a first letter can
    change their order.
    """
    words = F.split("form", " ")
    turned = F.when(F.size(words) == 2, F.concat_ws(" ", F.element_at(words, 2), F.element_at(words, 1)))
    asked = forms.select("repo", "form", F.explode(F.array_compact(F.array(F.col("form"), turned))).alias("probe"))
    met = split_join(segments(forms), probes(asked), ["repo", "size", "no", "part"], "form").where(F.col("asked") != F.col("form"))
    close = one_edit(F.col("probe"), F.col("form")) | two_edits(F.col("probe"), F.col("form"))
    pairs = met.where(close).select("repo", F.least("asked", "form").alias("a"), F.greatest("asked", "form").alias("b"))
    return pairs.distinct()


def components(edges: DataFrame) -> DataFrame:
    """(repo, node, label) of the nodes of (repo, a, b): the least node that each is connected with.

    Labels spread along edges and then jump to their own label's label, so the rounds grow with the
    logarithm of the longest chain. Every round is a checkpoint; nothing but a count reaches the driver.
    """
    both = edges.select("repo", F.col("a").alias("node"), F.col("b").alias("other")).unionByName(edges.select("repo", F.col("b").alias("node"), F.col("a").alias("other")))
    both = cut(both.where(F.col("node") != F.col("other")).distinct())
    label = cut(both.groupBy("repo", "node").agg(F.least(F.min("other"), F.first("node")).alias("label")))
    none = F.lit(None).cast("string")
    while True:
        told = both.join(label.withColumnRenamed("node", "other"), ["repo", "other"]).select("repo", "node", "label", none.alias("was"))
        jumped = label.join(label.select("repo", F.col("node").alias("label"), F.col("label").alias("root")), ["repo", "label"]).select("repo", "node", F.col("root").alias("label"), none.alias("was"))
        kept = label.withColumn("was", F.col("label"))
        new = cut(kept.unionByName(told).unionByName(jumped).groupBy("repo", "node").agg(F.min("label").alias("label"), F.max("was").alias("was")))
        label = new.drop("was")
        if new.where(F.col("label") != F.col("was")).isEmpty():
            return label


def entities(names: DataFrame) -> DataFrame:
    """(repo, author, entity, route) of each spelling (repo, author) that names somebody.

    ``route`` tells what joins it to its entity: its form, an edit, a short given name, an initial, a log-in, an
    abbreviation; or that it stands alone, as what it says could be none or several.

    Null and blank spellings and placeholders have no entity. Spellings count as they stand: case and
    blanks make different ones. Repeated rows count once; without rows there are no entities.
    """
    rows = cut(parsed(names.select("repo", "author").where(F.col("repo").isNotNull() & F.col("author").isNotNull()).distinct()))
    known = rows.where(F.size("forms") == 1).select("repo", "author", F.col("forms")[0].alias("form"), "offers")
    written = known.select("repo", "form").distinct()
    maybe = rows.where(F.size("forms") > 1).select("repo", F.explode("forms").alias("form")).distinct()
    forms = written.select("repo", "form", F.lit(1).alias("w")).unionByName(maybe.withColumn("w", F.lit(0))).groupBy("repo", "form").agg((F.max("w") == 1).alias("written"))
    forms = cut(forms)
    pairs = cut(near(forms.select("repo", "form")))
    flag = forms.where("written").select("repo", "form")
    sides = pairs.join(flag.withColumnRenamed("form", "a").withColumn("wa", F.lit(True)), ["repo", "a"], "left").join(flag.withColumnRenamed("form", "b").withColumn("wb", F.lit(True)), ["repo", "b"], "left")
    label = components(sides.where("wa AND wb").select("repo", "a", "b"))
    entity = F.coalesce("label", "form").alias("entity")
    labelled = known.join(label.withColumnRenamed("node", "form"), ["repo", "form"], "left").select("repo", "author", "form", entity, "offers")
    half = sides.where("wa AND wb IS NULL").select("repo", F.col("a").alias("form"), F.col("b").alias("near")).unionByName(sides.where("wb AND wa IS NULL").select("repo", F.col("b").alias("form"), F.col("a").alias("near")))
    beside = half.join(label.withColumnRenamed("node", "form"), ["repo", "form"], "left").select("repo", F.concat(F.lit("F:"), "near").alias("ask"), entity)
    offered = (
        labelled.select("repo", F.explode(F.concat("offers", F.array(F.concat(F.lit("F:"), "form")))).alias("ask"), "entity")
        .unionByName(beside)
        .groupBy("repo", "ask")
        .agg(F.min("entity").alias("least"), F.max("entity").alias("most"))
    )
    asks = F.concat("asks", F.when(F.size("forms") > 1, F.transform("forms", lambda x: F.concat(F.lit("F:"), x))).otherwise(F.array().cast("array<string>")))
    weak = rows.where(F.size("forms") != 1).select("repo", "author", F.explode(asks).alias("ask"))
    answered = weak.join(offered, ["repo", "ask"], "left").groupBy("repo", "author").agg(F.min("least").alias("least"), F.max("most").alias("most"), F.min("ask").alias("ask"))
    alone = F.concat(F.lit("? "), F.regexp_replace(F.regexp_replace("ask", "^[IL]:", ""), " ", ""))
    kind = F.substring("ask", 1, 2)
    route = F.when(kind == "F:", "nickname").when(kind == "I:", "initial").when(kind == "L:", "login").otherwise("abbreviation")
    joined = answered.select("repo", "author", F.when(F.col("least") == F.col("most"), F.col("least")).otherwise(alone).alias("entity"), F.when(F.col("least") == F.col("most"), route).otherwise("alone").alias("route"))
    edited = F.when(F.col("entity") != F.col("form"), "edit").otherwise("form").alias("route")
    return labelled.select("repo", "author", "entity", edited).unionByName(joined)


def same(ents: DataFrame) -> DataFrame:
    """(repo, author_a, author_b): the complete pairs of spellings within an entity, author_a < author_b."""
    a = ents.select("repo", "entity", F.col("author").alias("author_a"))
    b = ents.select("repo", "entity", F.col("author").alias("author_b"))
    return split_join(b, a, ["repo", "entity"], "author_b").where(F.col("author_a") < F.col("author_b")).select("repo", "author_a", "author_b").distinct()
