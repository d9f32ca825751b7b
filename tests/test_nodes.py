"""Nodes, what is kept of them, errors and project settings."""

import json

import pytest
from pyspark.sql import functions as F

from loregraph import errors
from loregraph.operators import nodes
from loregraph.sources import files


def test_nodes_and_their_text(spark, tmp_path):
    docs = spark.createDataFrame([("r", "src/a.ts", 10), ("r", "src/index.ts", 2), ("r", "src/a.test.ts", 5), ("r", "other/b.ts", 1)], "repo string, path string, lines int")
    log = spark.createDataFrame([("r", "src/a.ts", 3, ["x"], "2024-01-01", "2024-02-02")], "repo string, path string, commit_count long, authors array<string>, created_at string, last_modified string")
    log = log.withColumn("created_at", F.col("created_at").cast("timestamp")).withColumn("last_modified", F.col("last_modified").cast("timestamp"))
    f = {r.id: r for r in nodes.file_nodes(docs, log, "2024-06-01 00:00:00").collect()}
    assert f["src/a.ts"].commits == 3 and f["src/index.ts"].commits == 0 and f["src/index.ts"].authors == [] and str(f["src/index.ts"].created_at).startswith("2024-06-01")
    assert f["src/a.test.ts"].test_command == "npm test -- src/a.test.ts" and f["src/a.ts"].test_command is None
    fn = spark.createDataFrame([("r", "src/a.ts", "go", 3, 7, True), ("r", "src/a.ts", "no", 9, 9, False)], "repo string, path string, func_name string, start_line int, end_line int, is_exported boolean")
    assert [(r.id, r.lines) for r in nodes.function_nodes(fn).collect()] == [("src/a.ts:go", 5)]
    m = nodes.modules(docs, spark.createDataFrame([("r", "src", "Read")], "repo string, directory string, text string")).collect()
    assert [(r.id, r.readme, r.lines, r.commits) for r in m] == [("src", "Read", 0, 0)]
    store = nodes.Store(spark, str(tmp_path / "kept"))
    assert store.mark_stale() == 0 and store.find().count() == 0
    store.put(nodes.file_nodes(docs, log, "2024-06-01 00:00:00"))
    text = lambda i, at: spark.createDataFrame([("r", i, f"about {i}")], "repo string, id string, summary string").withColumn("generated_at", F.lit(at).cast("timestamp"))
    assert store.describe(text("src/a.ts", "2024-01-05")) == 1 and store.describe(text("gone.ts", "2024-01-05")) == 0 and store.describe(text("src/index.ts", "2024-07-05")) == 1
    assert store.mark_stale() == 1 and [r.id for r in store.find().where("stale").collect()] == ["src/a.ts"]
    assert store.describe(text("src/a.ts", "2024-08-01")) == 1 and store.mark_stale() == 0
    store.put(nodes.file_nodes(docs.limit(0).unionByName(spark.createDataFrame([("r", "new.ts", 1)], "repo string, path string, lines int"))))
    assert {r.id for r in store.find("file", without_text=True).collect()} == {"new.ts", "src/a.test.ts", "other/b.ts"}
    assert [r.summary for r in store.find(ids=["src/a.ts"]).collect()] == ["about src/a.ts"]


def test_expanded_functions_and_readme(spark):
    rows = [("r", "a.ts", f"f{i}", None) for i in range(4)] + [("r", "b.ts", f"g{i}", [1] if i == 1 else []) for i in range(6)] + [("r", "c.ts", f"h{i}", None) for i in range(5)]
    f = spark.createDataFrame(rows, "repo string, path string, func_name string, error_paths array<int>")
    fan = spark.createDataFrame([("r", "c.ts", 6), ("r", "b.ts", 5)], "repo string, path string, fan_in int")
    pats = spark.createDataFrame([("r", "b.ts", "retry", "b.ts:g2"), ("r", "b.ts", "cache", "b.ts")], "repo string, path string, pattern string, location string")
    got = {r.func_name for r in nodes.expanded(f, fan, pats).where("expanded").collect()}
    assert got == {"f0", "f1", "f2", "f3", "g1", "g2", "h0", "h1", "h2", "h3", "h4"}
    readmes = spark.createDataFrame([("r", "src/long", "x"), ("r", "src", "y"), ("r", "lib", "z"), ("r", "a", "no module")], "repo string, directory string, text string")
    dirs = spark.createDataFrame([("r", "src/long"), ("r", "src"), ("r", "lib")], "repo string, module string")
    assert [tuple(r) for r in nodes.readme_of(readmes, dirs).collect()] == [("r", "lib", "z")]


def test_errors():
    own = errors.LoreError("it broke", "parse", "fatal", "a.ts")
    assert errors.show(own) == "Fatal [a.ts]: it broke\n  Hint: " + errors.HINTS["parse"] and errors.show(KeyError("x")) == "Error: 'x'"
    got = errors.by_severity([own, ValueError("v"), errors.LoreError("w", severity="warning")])
    assert [len(got[s]) for s in errors.SEVERITIES] == [1, 1, 1] and errors.hint("zzz") != errors.hint("parse")
    with pytest.raises(ValueError):
        errors.LoreError("x", severity="bad")


def test_configs(tmp_path):
    (tmp_path / "package.json").write_text(json.dumps({"name": "x", "version": 3, "scripts": {"a": "b"}, "dependencies": {"a": 1}}))
    (tmp_path / "tsconfig.json").write_text("{broken")
    (tmp_path / "loregraph.json").write_text(json.dumps({"extraction": {"include": ["a"]}, "llm": {"provider": 1}, "output": {"directory": "out"}, "more": 1}))
    assert files.all_configs(str(tmp_path)) == {"package": {"name": "x", "scripts": {"a": "b"}}, "compiler": {}, "tool": {"extraction": {"include": ["a"]}, "output": {"directory": "out"}}}
    assert files.all_configs(str(tmp_path / "none")) == {"package": {}, "compiler": {}, "tool": {}}


def test_renames_are_followed(spark, tmp_path):
    entry = lambda h, day, *lines: f"\x1e{h}\x1fa@b\x1f2024-01-{day:02}T00:00:00Z\x1fmsg\n\n" + "\n".join(lines) + "\n"
    dump = tmp_path / "log"
    dump.write_text(entry("5", 5, "A\ta.ts") + entry("4", 4, "M\tc.ts", "M\tz.ts") + entry("3", 3, "R090\tb.ts\tc.ts") + entry("2", 2, "R100\ta.ts\tb.ts") + entry("1", 1, "A\ta.ts", "A\tz.ts"))
    log = files.git_log(spark, str(dump))
    assert sorted((r.hash, r.path) for r in files.follow_renames(log).collect()) == [("1", "c.ts"), ("1", "z.ts"), ("2", "c.ts"), ("3", "c.ts"), ("4", "c.ts"), ("4", "z.ts"), ("5", "a.ts")]
    assert {r.path for r in files.follow_renames(log, 1).where("hash = '1'").collect()} == {"b.ts", "z.ts"}
