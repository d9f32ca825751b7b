"""Operators on small hand-made rows: the cases that the tables don't hold."""

from datetime import datetime, timezone

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loregraph.functions import paths as P
from loregraph.functions import text as T
from loregraph.operators import graph, history, search, targets, textops
from loregraph.sources.tables import latest


def one(spark, col, **values):
    df = spark.createDataFrame([tuple(values.values()) or (1,)], list(values) or ["x"])
    return df.select(col).first()[0]


def test_tokens(spark):
    assert one(spark, T.query_tokens(F.lit("How does retry work?"))) == ["retry", "work"]
    assert one(spark, T.query_tokens(F.lit("HTTPServer 404 maxRetries maxRetries is"))) == ["httpserver".replace("httpserver", "http"), "server", "404", "max", "retries"]
    assert one(spark, T.statement_keywords(F.lit("maxRetries = 3"))) == ["maxretries", "max", "retries"]
    assert one(spark, T.identifiers(F.lit("loginUser calls API_KEY and my_name, the cat or session"))) == ["loginUser", "my_name", "session"]
    assert one(spark, T.summary_words(F.lit("The retry of a Retry, OK"))) == ["retry", "retry"]


@pytest.mark.parametrize("text,code", [("status === 404", 404), ("throw new UserNotFound()", 404), ("code 418", 418), ("520 items", None), ("Rate limit hit", 429), ("ValidationError", 400), ("fine", None)])
def test_status(spark, text, code):
    assert one(spark, T.http_status(F.lit(text), F.lit(""))) == code


def test_paths(spark):
    assert one(spark, P.normalize(F.lit("a/b/../c/./d"))) == "a/c/d" and one(spark, P.normalize(F.lit("../a"))) == "../a" and one(spark, P.dirname(F.lit("x.ts"))) == "."
    assert one(spark, P.similarity(F.lit("src/extract/index.ts"), F.lit("src/extractor/index.ts"))) == 63
    assert one(spark, P.confidence(F.lit(70))) == 1.0 and one(spark, P.confidence(F.lit(-10))) == 0.0
    assert one(spark, P.suffixes(F.lit("a/b/c"))) == ["a/b/c", "b/c", "c"]
    assert one(spark, F.levenshtein(F.lit("kitten"), F.lit("sitting"))) == 3


def _edges(spark, pairs):
    return spark.createDataFrame([("r", a, "imports", b) for a, b in pairs], "repo string, src string, edge_type string, dst string")


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 12), st.integers(0, 12)), max_size=30))
def test_impact_against_search(spark, pairs):
    pairs = [(str(a), str(b)) for a, b in pairs]
    want, frontier, depth = {"0": 0}, ["0"], 0
    while frontier and depth < 10:
        depth += 1
        frontier = sorted({a for a, b in pairs if b in frontier and a not in want})
        want |= dict.fromkeys(frontier, depth)
    got = graph.impact(_edges(spark, pairs), spark.createDataFrame([("r", "0")], "repo string, node string")).collect()
    assert {r.node: r.depth for r in got} == {k: v for k, v in want.items() if v}


def test_edges_and_fan(spark):
    files = spark.createDataFrame([("r", p) for p in ("src/a.ts", "src/a.test.ts", "src/index.ts", "lib/b.ts", "lib/__tests__/b.spec.ts", "c.ts")], "repo string, path string")
    assert {(r.src, r.dst) for r in graph.test_file_edges(files).collect()} == {("src/a.ts", "src/a.test.ts"), ("lib/b.ts", "lib/__tests__/b.spec.ts")}
    assert {(r.module, r.files) for r in graph.module_nodes(files).collect()} == {("src", 3)}
    fan = {r.path: (r.fan_in, r.fan_out) for r in graph.fan(_edges(spark, [("src/a.ts", "c.ts"), ("src/a.ts", "c.ts"), ("c.ts", "c.ts")]), files).collect()}
    assert fan["c.ts"] == (3, 1) and fan["src/a.ts"] == (0, 2) and fan["lib/b.ts"] == (0, 0)
    assert {(r.src, r.dst) for r in graph.reverse_edges(_edges(spark, [("a", "b"), ("a", "b"), ("c", "c")])).collect()} == {("b", "a")}
    root = spark.createDataFrame([("r", "c.ts", 0, "./src/a"), ("r", "src/a.ts", 0, "../c"), ("r", "src/a.ts", 1, "./index.js"), ("r", "src/a.ts", 2, "react")], "repo string, path string, ord int, spec string")
    by = lambda mode: {(r.path, r.ord): r.target for r in graph.resolve_imports(root, files, mode).collect()}
    assert by("graph") == {("c.ts", 0): None, ("src/a.ts", 0): "c.ts", ("src/a.ts", 1): "src/index.ts", ("src/a.ts", 2): None}
    assert by("calls")["c.ts", 0] == "src/a.ts"


def test_chain_stops(spark):
    rows = [("r", f"f{i}", "x", f"f{i + 1}") for i in range(8)] + [("r", "a", "y", "b"), ("r", "b", "y", "a")]
    got = {(r.path, r.symbol_name): (r.origin, r.hops) for r in graph.follow_chain(spark.createDataFrame(rows, "repo string, path string, symbol_name string, source_file string")).collect()}
    assert got["f0", "x"] == ("f5", 5) and got["f7", "x"] == ("f8", 1) and got["a", "y"][1] == 5


def test_history(spark):
    t = lambda n: datetime(2024, 1, n, tzinfo=timezone.utc)
    c = spark.createDataFrame([(1, "r", "p", "x", t(1)), (2, "r", "p", "y", t(2)), (3, "r", "p", "x", t(3)), (4, "r", "p", "y", t(4)), (5, "r", "p", None, t(5))], "commit_id long, repo string, path string, author string, commit_date timestamp")
    assert history.primary_author(c).first().author == "y"
    r = history.rollup(c).first()
    assert r.commit_count == 5 and r.authors == ["y", "x"]
    old = spark.createDataFrame([(1, "a", "prose"), (2, "b", None)], "k long, v string, kept string")
    new = spark.createDataFrame([(1, "A"), (3, "C"), (2, None)], "k long, v string")
    assert sorted((r.k, r.v, r.kept) for r in history.upsert(old, new, ["k"]).collect()) == [(1, "A", "prose"), (2, "b", None), (3, "C", None)]
    now = spark.createDataFrame([(1, "same"), (2, "new"), (3, None)], "k long, t string")
    before = now.where("k = 1").select("k", T.content_hash(F.col("t")).alias("content_hash")).unionByName(spark.createDataFrame([(2, "old")], "k long, content_hash string"))
    assert [r.k for r in history.changed(now, before, "k", "t").collect()] == [2]
    dup = spark.createDataFrame([(1, 5, "late"), (1, 3, "early"), (2, None, "x")], "id long, at long, v string")
    assert {(r.id, r.v) for r in latest(dup, "id", "at").collect()} == {(1, "late"), (2, "x")}


FN = "repo string, path string, func_name string, is_exported boolean, signature string, code_snippet string, key_statements array<struct<line int, text string, category string>>"


def test_patterns_and_index(spark):
    rows = [
        ("r", "a.ts", "tryAgain", True, "f()", "for (;;) {}", [(1, "const attempts = 3, maxRetries", "config"), (2, "catch (e)", "error"), (3, "if (status === 404)", "condition")]),
        ("r", "b.ts", "loadCache", True, "f()", "", None), ("r", "b.ts", "saveCache", False, "f()", None, []), ("r", "c.ts", "getInstance", False, "f()", None, None), ("r", "d.ts", "onlyCache", False, "f()", None, None),
    ]
    f = spark.createDataFrame(rows, FN)
    assert {(r.path, r.pattern) for r in textops.patterns(f).collect()} == {("a.ts", "retry"), ("b.ts", "cache"), ("c.ts", "singleton")}
    mods = spark.createDataFrame([("r", "src/x", 3)], "repo string, module string, files long")
    ix = {(r.kind, r.token, r.path) for r in search.keyword_index(f, mods, textops.patterns(f)).collect()}
    assert {("export", "tryagain", "a.ts"), ("export", "try", "a.ts"), ("error", "404", "a.ts"), ("keyStatement", "retries", "a.ts"), ("module", "x", "src/x"), ("pattern", "cache", "b.ts")} <= ix
    assert ("export", "savecache", "b.ts") not in ix


def test_prefilter_caps_and_bonus(spark):
    ix = spark.createDataFrame([("export", "load", "r", f"f{i:02}") for i in range(50)], "kind string, token string, repo string, path string")
    parents = spark.createDataFrame([("r", "f00", "src")], "repo string, src string, dst string")
    fan = spark.createDataFrame([("r", "far", 9), ("r", "f49", 5), ("r", "f01", 4)], "repo string, path string, fan_in long")
    got = search.prefilter(spark, "load it", ix, parents, fan).collect()
    assert len(got) == 25 and got[0].path == "f49" and got[0].score == 11
    assert [(r.path, r.score, r.reasons) for r in search.prefilter(spark, "", ix, parents, fan).collect()] == [("f49", 1, ["high fanIn"]), ("far", 1, ["high fanIn"])]
    assert {r.path for r in search.prefilter(spark, "load", ix.where("path = 'f00'"), parents, fan).collect()} == {"f00", "src", "f49", "far"}


def test_pattern_guard_and_targets(spark):
    assert search.check_pattern("a" * 201) and search.check_pattern("(a*+)") and search.check_pattern("a++") and not search.check_pattern("^a.*b$")
    f = spark.createDataFrame([("r", "src/a.ts", "go", True, "function go()", "fetch(1)", None)], FN)
    with pytest.raises(ValueError):
        search.grep(f, "a**")
    sym = spark.createDataFrame([("r", "src/b.ts", "go", "go", "src/a.ts")], "repo string, path string, local_name string, symbol_name string, source_file string")
    calls = spark.createDataFrame([("r", "src/b.ts:x", "src/a.ts:go")], "repo string, src string, dst string")
    plan = targets.parse_targets('```json\n{"targets": [{"type": "file", "path": "src/a.ts"}, {"type": "grep", "pattern": "FETCH", "scope": "src/"}, {"type": "importers", "of": "go"}, {"type": "callers", "of": "src/a.ts:go"}, {"type": "function", "name": "go", "in": "src/a.ts"}]}\n```')
    assert sorted((r.ord, r.path) for r in targets.resolve(plan, f, sym, calls).collect()) == [(0, "src/a.ts"), (1, "src/a.ts"), (2, "src/b.ts"), (3, "src/b.ts"), (4, "src/a.ts")]
    for bad in ('{"targets": [{"type": "file"}]}', '{"targets": [{"type": "function", "name": "go"}]}', '{"x": 1}', '{"targets": [{"type": "callers", "of": "go"}]}'):
        with pytest.raises(ValueError):
            targets.parse_targets(bad)


def test_markers_and_comments(spark):
    df = spark.createDataFrame([(1, "a(); // plain one\n// todo: fix it */\nconst u = 'http://x.y';\nTODO no comment\n/* HACK */"), (2, None)], "id long, t string")
    assert [(r.n, r.marker, r.note) for r in textops.markers(df, ["id"], "t").collect()] == [(2, "TODO", "fix it"), (5, "HACK", "")]
    assert [(r.n, r.comment) for r in textops.inline_comments(df, ["id"], "t").collect()] == [(1, "plain one"), (2, "todo: fix it */")]


def test_function_target_is_looked_up_in_its_file(spark):
    f = spark.createDataFrame([("r", "a.ts", "go", "go()"), ("r", "b.ts", "go", "go(x)")], "repo string, path string, func_name string, signature string")
    plan = targets.parse_targets('{"targets": [{"type": "function", "name": "go", "in": "b.ts"}]}')
    none = spark.createDataFrame([], "repo string, path string, symbol_name string, source_file string")
    calls = spark.createDataFrame([], "repo string, src string, dst string")
    assert [(r.path, r.detail) for r in targets.resolve(plan, f, none, calls).collect()] == [("b.ts", "go(x)")]


def test_kept_index_reads_its_buckets_only(spark, tmp_path):
    rows = [("export", f"token{i}", "r", f"p{i % 7}.ts") for i in range(300)] + [("module", "cache", "r", "src"), ("export", "cache", "r", "p1.ts")]
    index = spark.createDataFrame(rows, "kind string, token string, repo string, path string")
    folder = str(tmp_path / "index")
    search.write_index(index, folder, 16)
    got = search.read_index(spark, folder, "where is the cache for 12?", 16)
    assert sorted(map(tuple, got.collect())) == [("export", "cache", "r", "p1.ts"), ("module", "cache", "r", "src")]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan or "PartitionFilters: [bucket" in plan
    assert search.read_index(spark, folder, "the and of", 16).count() == 0


def test_index_of_a_question_is_the_index_filtered(spark):
    s = "array<struct<line int, text string, category string>>"
    f = spark.createDataFrame([("r", "a.ts", "loadCache", True, [(1, "if (status === 404) {", "condition"), (2, "const ttl = cacheSeconds;", "config")]), ("r", "b.ts", "other", True, None)], f"repo string, path string, func_name string, is_exported boolean, key_statements {s}")
    modules = spark.createDataFrame([("r", "src/cache"), ("r", "src/door")], "repo string, module string")
    q = "cache 404 door"
    whole = search.keyword_index(f, modules).where(F.col("token").isin("cache", "404", "door"))
    assert sorted(map(tuple, search.keyword_index(f, modules, question=q).collect())) == sorted(map(tuple, whole.collect())) != []


def test_fuzzy_takes_blocks_beyond_a_few(spark, monkeypatch):
    files = spark.createDataFrame([(f"src/m{i}/file{i}.ts",) for i in range(12)], "path string")
    queries = spark.createDataFrame([(f"src/m{i}/fle{i}.ts",) for i in range(12)], "query string")
    rows = lambda: sorted(map(tuple, search.fuzzy(queries, files, 1).select("query", "path", "score").collect()))
    few = rows()
    monkeypatch.setattr(search, "FEW", 3)
    assert rows() == few and len(few) == 12


def test_latest_reads_only_what_is_asked_for(spark, tmp_path):
    from loregraph.sources.tables import latest

    spark.createDataFrame([(1, "a", "x", 1), (1, "b", "y", 2), (2, None, None, None), (None, "c", "z", 1)], "id long, v string, w string, t long").write.parquet(str(tmp_path / "t"))
    got = latest(spark.read.parquet(str(tmp_path / "t")), "id", "t", ["v"])
    assert got.columns == ["v"] and sorted(str(r.v) for r in got.collect()) == ["None", "b", "c"]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<id:bigint,v:string,t:bigint>" in plan


def test_comments_find_their_function_across_blocks(spark):
    f = spark.createDataFrame([("r", "p", "outer", 1, 300), ("r", "p", "inner", 70, 75), ("r", "p", "none", None, None), ("r", "p", "odd", 9, 3)], "repo string, path string, func_name string, start_line int, end_line int")
    c = spark.createDataFrame([(1, "r", "p", 70), (2, "r", "p", 301), (3, "r", "p", None), (4, "r", "p", 300)], "id int, repo string, path string, line int")
    assert sorted((r.id, r.enclosing) for r in graph.nearest_function(c, f).collect()) == [(1, "outer"), (2, None), (3, None), (4, "outer")]
