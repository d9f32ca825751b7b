"""Spellings of names: reading, the segment join against brute force, components and ambiguity."""

import random
from itertools import combinations

import pytest

from loregraph.llm import names


def osa(a, b):
    d = [[i + j if i * j == 0 else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
    return d[-1][-1]


def lev(a, b):
    d = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        d = _row(d, i, x, b)
    return d[-1]


def _row(above, i, x, b):
    out = [i]
    for j, y in enumerate(b, 1):
        out.append(min(above[j] + 1, out[-1] + 1, above[j - 1] + (x != y)))
    return out


@pytest.mark.parametrize("raw", [None, "", "  ", "no author", "nobody@localhost", "(none)", "unknown", "root", "admin", "???", "-"])
def test_nobody(raw):
    assert names.read(raw) is None


@pytest.mark.parametrize("raw", ["Łukasz Mirovic", " łukasz  mirovic ", "MIROVIC Łukasz", "Mirovic, Lukasz", "LukaszMirovic", "lukasz.mirovic@a.example", "Łukasz B. Mirovic", "Å\x82ukasz Mirovic"])
def test_one_person(raw):
    assert names.read(raw)[0] == ["lukasz mirovic"]


@pytest.mark.parametrize("raw", ["Torvex Data Services Ltd", "The Torvex Data Services", "TORVEX DATA SERVICES LIMITED", "torvex-data-services", "Data Services, Torvex", "Torvex Data Services (TDS)", "Torvex Data Services S.A."])
def test_one_organisation(raw):
    forms, offers, asks = names.read(raw)
    assert forms == ["org data services torvex"] and not asks
    assert set(names.read("Torvex Dat. Ltd")[2]) & set(offers)


def test_short_forms_ask():
    offers = set(names.read("Samantha Mirovic")[1])
    for raw in ("S. Mirovic", "S Mirovic", "Mirovic, S.K.", "smirovic"):
        forms, _, asks = names.read(raw)
        assert not forms and set(asks) & offers, raw
    assert names.read("Sam Mirovic")[0] == ["mirovic samantha", "mirovic samuel"] and names.read("Kasia Mirovic")[0] == ["katarzyna mirovic"]


def test_segment_join_against_brute_force(spark):
    rng = random.Random(7)
    base = ["".join(rng.choice("abcde") for _ in range(rng.randrange(5, 14))) for _ in range(60)]
    forms = set(base)
    for s in base:
        i = rng.randrange(len(s) - 1)
        forms |= {s[:i] + s[i + 1 :], s[:i] + "x" + s[i:], s[:i] + "y" + s[i + 1 :], s[:i] + s[i + 1] + s[i] + s[i + 2 :], s[:i] + "zz" + s[i + 1 :]}
    want = {(a, b) for a, b in combinations(sorted(forms), 2) if min(len(a), len(b)) >= names.LEAST and (osa(a, b) <= 1 or min(len(a), len(b)) >= names.LONG and lev(a, b) == 2)}
    df = spark.createDataFrame([("r", f) for f in forms], "repo string, form string")
    got = {(r.a, r.b) for r in names.near(df).collect()}
    assert got == want and len(want) > 200


def test_two_edits_in_a_long_word(spark):
    pairs = [("christopher mirovic", "christofer mirovic", True), ("alexander torvenko", "alexandra torvenko", False), ("kelshinezova maria", "kelshimezoba maria", True), ("kelshinezova maria", "kelshinesova mario", False), ("kelshinezova maria", "kelshimezoba mario", False)]
    df = spark.createDataFrame(pairs, "a string, b string, want boolean")
    assert all(r.got == r.want for r in df.select("want", names.two_edits(df.a, df.b).alias("got")).collect())
    rows = spark.createDataFrame([("r", x) for p in pairs for x in p[:2]], "repo string, form string").distinct()
    assert {(r.a, r.b) for r in names.near(rows).collect()} == {("christofer mirovic", "christopher mirovic"), ("kelshimezoba maria", "kelshinezova maria")} | {("kelshimezoba maria", "kelshimezoba mario")}


def test_hot_keys_are_split_and_lose_nothing(spark):
    index = spark.createDataFrame([("r", f"f{i}") for i in range(300)] + [("s", "f1"), (None, "f2")], "repo string, form string")
    asked = spark.createDataFrame([("r", f"q{i}") for i in range(5)] + [("s", "q1"), ("t", "q2"), (None, "q3")], "repo string, q string")
    got = names.split_join(index, asked, ["repo"], "form").collect()
    assert sorted((r.q, r.form) for r in got if r.repo == "r") == sorted((f"q{i}", f"f{k}") for i in range(5) for k in range(300)) and len(got) == 1501


def test_components_of_a_long_chain(spark):
    edges = [("r", f"n{i:03}", f"n{i + 1:03}") for i in range(40)] + [("r", "x", "y"), ("s", "n000", "n001"), ("r", "x", "y"), ("r", "z", "z")]
    got = {(r.repo, r.node): r.label for r in names.components(spark.createDataFrame(edges, "repo string, a string, b string")).collect()}
    assert all(got["r", f"n{i:03}"] == "n000" for i in range(41)) and got["r", "y"] == "x" and got["s", "n001"] == "n000" and ("r", "z") not in got


def test_entities(spark):
    rows = [
        ("r", x) for x in ("Samantha Mirovic", "Samatnha Mirovic", "Mirovic, S.", "smirovic", "Sam Mirovic", "Joseph Mirovic", "Alexander Torv", "Alexandra Torv", "Alex Torv", "A. Torv", "Vexal Research Ltd", "Vexal Res. Ltd", "Vexall Research Limited",
                           "Sasha Kolemska", "Alexandra Kolemskaa", "B Lonely", "blonely", "no author", "", "Samantha Mirovic")
    ] + [("s", "S. Mirovic"), ("s", None), (None, "Samantha Mirovic"), ("s", "Sofia Mirovic"), ("s", "Samantha Mirovic")]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "repo string, author string, form string")
    ents = names.entities(df)
    got = {frozenset((r.author_a, r.author_b)) for r in names.same(ents).where("repo = 'r'").collect()}
    groups = [("Samantha Mirovic", "Samatnha Mirovic", "Mirovic, S.", "smirovic", "Sam Mirovic"), ("Vexal Research Ltd", "Vexal Res. Ltd", "Vexall Research Limited"), ("Sasha Kolemska", "Alexandra Kolemskaa"), ("B Lonely", "blonely")]
    assert got == {frozenset(p) for g in groups for p in combinations(g, 2)}
    assert names.same(ents).where("repo = 's'").count() == 0
    assert all(r.author_a < r.author_b for r in names.same(ents).collect())
    assert names.same(names.entities(df.limit(0))).count() == 0
