"""Prose, rendering, the API and incremental refresh."""

import os

import pytest

from loregraph.prose import model
from loregraph.render import markdown


def test_replies():
    good = '{"summary": "a", "purpose": "b", "gotchas": ["c"], "keyExports": "no"}'
    assert model.parse_reply(good) == model.parse_reply(f"text\n```json\n{good}\n```") == {"summary": "a", "purpose": "b", "gotchas": ["c"]}
    for bad in ('{"summary": "a"}', '{"summary": "a", "pur', "[]"):
        with pytest.raises(ValueError):
            model.parse_reply(bad)


def test_retries():
    calls, waits = [], []

    def flaky(prompt):
        calls.append(prompt)
        if len(calls) < 3:
            raise RuntimeError("network timeout")
        return '{"summary": "a", "purpose": "b"}' if len(calls) > 3 else "no json"

    assert model.generate(flaky, "p", waits.append)["summary"] == "a" and len(calls) == 4 and waits == [1.0, 2.0, 1.0]
    with pytest.raises(RuntimeError, match="denied"):
        model.call(lambda p: (_ for _ in ()).throw(RuntimeError("denied")), "p", waits.append)


def test_write_prose(spark):
    df = spark.createDataFrame([("r", "a.ts", model.file_prompt("a.ts", 3, ["go"], [])), ("r", "m", "boom")], "repo string, id string, prompt string")

    def own(prompt):
        if prompt == "boom":
            raise RuntimeError("denied")
        return model.offline(prompt)

    got = {r.id: r for r in model.write_prose(df, own, 2).collect()}
    assert got["a.ts"].summary == "a.ts provides go." and got["m"].error == "denied" and got["m"].summary is None


def test_markdown():
    page = markdown.context([{"path": "src/a.ts", "fan_in": 9, "summary": "Does it."}, {"path": "src", "type": "module"}])
    assert page.index("## src\n") < page.index("## src/a.ts") and "9 files depend" in page
    assert "## Direct\n- b" in markdown.impact("a", [{"depth": 1, "node": "b"}, {"depth": 2, "node": "c"}], ["b.test.ts"])
    assert markdown.errors([{"status": None, "line": 3}, {"status": 404, "description": "Not Found", "line": 1, "condition": "x"}]).startswith("## 404 Not Found")


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no tables")
def test_api(spark):
    from loregraph.api import Engine, NotFound
    from loregraph.plans import catalog

    d = "/root/testdata/sf0.001"
    e = Engine(spark, d)
    f = catalog._files(spark, d).orderBy("repo", "path").first()
    assert e.node(f.repo, f.path)["path"] == f.path
    with pytest.raises(NotFound):
        e.node(f.repo, "zzz/qqq")
    assert f.path in e.context(f.repo, [f.path]) and e.impact(f.repo, f.path)["source"] == f.path
    with pytest.raises(ValueError):
        e.context(f.repo, [" "])
    assert e.query("session token cache")


def test_streaming_refresh(spark, tmp_path):
    from loregraph.streaming.incremental import State, follow

    src = str(tmp_path / "in")
    state = State(spark, str(tmp_path / "state"))
    write = lambda rows: spark.createDataFrame(rows, "path string, content string").coalesce(1).write.mode("append").json(src)
    for rows in ([("a", "1"), ("b", "1")], [("a", "2"), ("c", "1")]):
        write(rows)
        follow(spark.readStream.schema("path string, content string").json(src), state, str(tmp_path / "cp")).awaitTermination()
    assert sorted((r.path, r.content) for r in state.read().collect()) == [("a", "2"), ("b", "1"), ("c", "1")] and state.version() == 1


def test_a_batch_that_comes_again_starts_from_what_was_before(spark, tmp_path):
    from loregraph.streaming.incremental import State, refresh

    state = State(spark, str(tmp_path / "state"))
    rows = lambda *x: spark.createDataFrame(list(x), "path string, content string")
    refresh(state, rows(("a", "1"), ("b", "1")), "path", "content", 0)
    refresh(state, rows(("a", "2")), "path", "content", 0)  # batch 0 again, with other rows: nothing of its first run stays
    assert sorted((r.path, r.content) for r in state.read().collect()) == [("a", "2")]
    refresh(state, rows(("c", "1")), "path", "content", 1)
    refresh(state, rows(("d", "1")), "path", "content", 1)
    assert sorted(r.path for r in state.read().collect()) == ["a", "d"] and state.version() == 1


def test_a_cluster_names_its_checkpoint_folder():
    from types import SimpleNamespace as N

    from loregraph.session import ensure_checkpoint_dir

    conf = N(get=lambda k, d=None: None)
    none = N(isDefined=lambda: False)
    sc = N(master="spark://host:7077", getConf=lambda: conf, _jsc=N(sc=lambda: N(getCheckpointDir=lambda: none)))
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        ensure_checkpoint_dir(N(sparkContext=sc, conf=conf))
