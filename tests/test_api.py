"""The application: context, impact, questions with and without a model, and its HTTP form."""

import json
import os
import threading
import urllib.error
import urllib.request

import pytest

from loregraph.api import Engine, NotFound
from loregraph.prose import answers, model
from loregraph.render import markdown
from loregraph.server import route, serve

DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no tables")


@pytest.fixture(scope="module")
def engine(spark):
    return Engine(spark, DIR)


@pytest.fixture(scope="module")
def hub(engine):
    """The file of one repository that most files import, its repository, and one that imports it."""
    from pyspark.sql import functions as F

    from loregraph.plans import catalog

    e = catalog._imports(engine.spark, DIR).join(catalog._paths(engine.spark, DIR).withColumnRenamed("path", "dst"), ["repo", "dst"], "left_semi")
    top = e.where("src <> dst").groupBy("repo", "dst").agg(F.count(F.lit(1)).alias("n"), F.min("src").alias("src")).orderBy(F.desc("n"), "repo", "dst").first()
    return top.repo, top.dst, top.src


def test_context_and_impact(engine, hub):
    repo, path, importer = hub
    rows = engine.context(repo, [path, "no/such/file"], "json")
    own = next(r for r in rows if r["path"] == path)
    assert own["fan_in"] >= 1 and importer in own["dependents"] and own["functions"] and own["detail"]
    page = engine.context(repo, [path])
    assert f"## {path}" in page and "### Before a change" in page and "### Functions" in page
    hit = engine.impact(repo, path)
    assert importer in [r["node"] for r in hit["dependents"] if r["depth"] == 1]
    names = [f["func_name"] for f in own["functions"]]
    assert all(set(r["symbols"]) <= set(names) for r in engine.impact(repo, path, exports=names)["dependents"] if "symbols" in r)
    assert engine.impact(repo, path, "markdown").startswith(f"# Impact of {path}")
    with pytest.raises(NotFound):
        engine.impact(repo, path[:-1] + "x")


def test_questions(engine, hub, tmp_path):
    repo, path, _ = hub
    plain = engine.query("session token cache")
    kept = Engine(engine.spark, DIR)
    kept.build_index(str(tmp_path / "index"))
    assert kept.query("session token cache") == plain and plain
    said = []

    def own(prompt):
        said.append(prompt)
        return '{"answer": "It is there."}' if len(said) == 2 else json.dumps({"reasoning": "by its name", "targets": [{"type": "file", "path": path}, {"type": "grep", "pattern": "zzzzqq"}]})

    got = Engine(engine.spark, DIR, text_model=own).query("where?", repo)
    assert got == {"mode": "navigator", "reasoning": "by its name", "files": [path], "not_found": ["grep zzzzqq"], "answer": "It is there."}
    assert "Entry points" in said[0] and path in said[1] and "zzzzqq" in said[1]
    none = Engine(engine.spark, DIR, text_model=lambda p: '{"targets": []}' if "Name the places" in p else "plain words")
    got = none.query("session token cache", repo)
    assert got["mode"] == "candidates" and got["answer"] == "plain words"


def test_overview_and_text_on_demand(engine, hub, tmp_path):
    from loregraph.operators.nodes import Store, file_nodes
    from loregraph.plans import catalog

    repo, path, _ = hub
    o = engine.overview(repo)
    assert o["tree"] and all(x["description"] for x in o["entry_points"])
    assert "Files" in answers.overview_text(o)
    e = Engine(engine.spark, DIR, text_model=lambda p: json.dumps({"summary": "s", "purpose": "p", "gotchas": ["calls noSuchFunction twice"]}))
    store = Store(engine.spark, str(tmp_path / "store"))
    docs = catalog._files(engine.spark, DIR, "repo", "path", "line_count").withColumnRenamed("line_count", "lines").dropDuplicates(["repo", "path"])
    store.put(file_nodes(docs))
    assert e.describe(repo, path, store)["gotcha_confidence"] == ["low"]
    assert [r.summary for r in store.find(ids=[path]).where(f"repo = '{repo}'").collect()] == ["s"]
    m = catalog._modules(engine.spark, DIR).orderBy("repo", "module").first()
    assert e.describe(m.repo, m.module)["summary"] == "s" and [x["path"] for x in engine.overview(m.repo)["modules"]][0] == m.module


def test_http(engine, hub):
    repo, path, importer = hub
    get = lambda url: route(engine, "GET", url, repo=repo)
    assert get(f"/node/{path}")[0] == 200 and json.loads(get(f"/node/{path}")[2])["path"] == path
    status, kind, body = get(f"/context?files={path}")
    assert (status, kind) == (200, "text/markdown") and path in body
    assert json.loads(get(f"/impact/{path}?exports=a,b")[2])["source"] == path
    for url in ("/context", "/context?files=%20"):
        assert get(url)[0] == 400
    for url in ("/node/zzz/qqq", "/impact/zzz", "/consumers/zzz/f", "/nothing", "/node/"):
        assert get(url)[0] == 404, url
    assert route(engine, "GET", f"/node/{path}")[0] == 400 and route(engine, "DELETE", "/node/x", repo=repo)[0] == 404
    assert json.loads(get("/overview")[2])["tree"]
    post = lambda url, body: route(engine, "POST", url, body, repo)
    assert post("/query", "{")[0] == post("/query", "{}")[0] == post("/query", "[]")[0] == post("/refresh", "{}")[0] == 400
    assert json.loads(post("/query", '{"question": "session token cache"}')[2])["candidates"]
    assert post("/refresh", json.dumps({"path": path}))[0] == 200
    server = serve(engine, 0, repo)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{server.server_port}"
    with urllib.request.urlopen(f"{base}/node/{path}") as r:
        assert r.status == 200 and json.load(r)["path"] == path
    with pytest.raises(urllib.error.HTTPError):
        urllib.request.urlopen(f"{base}/node/zzz")
    server.shutdown()
    server.server_close()


def test_replies_and_pages():
    assert answers.parse_answer("") == {"error": "the model gave no answer"} and answers.parse_answer("```json\n{\"answer\": \"a\"}\n```") == {"answer": "a"}
    assert answers.parse_answer("just words") == {"answer": "just words"} and answers.unfenced("```\nx\n```") == "x"
    assert answers.reasoning_of("no") is None
    assert markdown.call_reference("a/b.ts:go") == "- `a/b.ts` → `go()`" and markdown.call_reference("a.ts:go", False) == "- `a.ts` ← `go()`" and markdown.call_reference("a.ts") == "- `a.ts`"
    assert markdown.test_links(["a.test.ts", "b.test.ts"], {"a.test.ts": "run a"}) == ["- Run: `run a`", "- See: `b.test.ts`"]
    page = markdown.context([{"path": "a.ts", "fan_in": 6, "detail": True, "patterns": [{"pattern": "retry", "location": "a.ts:go"}], "errors": [{"line": 3, "status": 404, "description": "Not Found"}], "calls": ["b.ts:f"], "readme": "Read me.",
                              "functions": [{"signature": "go()", "func_name": "go", "start_line": 1, "expanded": True, "key_statements": [{"line": 2, "category": "url", "text": "x"}], "code_snippet": "go"}]}])
    for part in ("6 files depend", "- [ ] it has no tests", "retry at `a.ts:go`", "line 2 url: `x`", "#### 404 Not Found", "`b.ts` → `f()`", "Read me."):
        assert part in page, part
    assert "README\n" + "x" * 500 + "..." in answers.overview_text({"readme": "x" * 600})
    assert model.offline("Path: a\nExports: b")
