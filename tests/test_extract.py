"""The scanner and the file sources on a small project written for the purpose."""

import json

from pyspark.sql import functions as F

from loregraph.extract import scanner
from loregraph.operators import graph
from loregraph.sources import files

SERVICE = '''import { pad, join as glue } from './utils';
import type { User } from './types';
import fs from 'node:fs';
import * as all from './utils';

const LIMIT = 5;

/**
 * Makes a user.
 * @param name - the name to use
 * @returns {User} the user
 * @throws when empty
 * @deprecated use makeAll
 */
export async function makeUser(name: string): Promise<User> {
  if (!name) {
    throw new Error('not found');
  }
  // TODO: check "{ braces"
  const maxRetries = 3;
  for (const x of [1, 2]) {
    await save(x);
  }
  try {
    return pad(name);
  } catch (err) {
    console.error(err);
  }
  return helper(name); // see http://a.example
}

function helper(n: string): string { return n; }

export class Store extends Base implements Disposable {
  private size: number = 0;
  /** Adds one. */
  add(n: number): this {
    if (n < 0) { return this; }
    return this;
  }
  drop(): void { helper('x'); }
}

export interface Shape { id: string; label?: string; }
export type Id = string;
export const NAME = "x";
export { LIMIT };
export { pad } from './utils';
export * from './types';
'''


def test_parse():
    d = scanner.parse("src/service.ts", SERVICE)
    assert [(i["spec"], i["names"], i["default_name"], i["namespace"], i["type_only"]) for i in d["imports"]] == [("./utils", ["pad", "join"], None, None, False), ("./types", ["User"], None, None, True), ("node:fs", [], "fs", None, False), ("./utils", [], None, "all", False)]
    f = {x["name"]: x for x in d["functions"]}
    assert set(f) == {"makeUser", "helper", "add", "drop"} and f["makeUser"]["is_exported"] and f["makeUser"]["is_async"] and not f["add"]["is_exported"] and f["add"]["owner"] == "Store"
    assert f["makeUser"]["calls"] == ["helper"] and f["drop"]["calls"] == ["helper"]
    assert f["makeUser"]["signature"].startswith("async function makeUser(name: string): Promise<User>")
    assert {(k["category"]) for k in f["makeUser"]["key_statements"]} == {"config", "loop", "async-pattern", "error"}
    kinds = [(e["type"], e["http_status"]) for e in f["makeUser"]["error_paths"]]
    assert kinds.count(("guard", 404)) == 1 and kinds.count(("throw", 404)) == 1 and ("catch", None) in kinds
    assert [(e["name"], e["kind"], e["reexport"]) for e in d["exports"]] == [("makeUser", "function", False), ("Store", "class", False), ("Shape", "interface", False), ("Id", "type", False), ("NAME", "const", False), ("LIMIT", "const", False), ("pad", "const", True), ("*", "star", True)]
    (c,) = d["classes"]
    assert c["extends"] == "Base" and c["implements"] == ["Disposable"] and c["methods"] == ["add", "drop"] and c["properties"] == ["size"]
    assert d["interfaces"] == [{"name": "Shape", "properties": ["id", "label"]}]
    use = {u["symbol"]: u for u in d["usages"]}
    assert use["pad"]["usage"] == "call" and use["User"]["usage"] == "type"
    doc = {x["name"]: x for x in d["docs"]}
    assert doc["makeUser"]["description"] == "Makes a user." and doc["makeUser"]["deprecated"] == "use makeAll" and doc["makeUser"]["params"][0]["name"] == "name" and doc["makeUser"]["throws"] == ["when empty"]
    assert [(t["type"], t["text"]) for t in d["todos"]] == [("TODO", 'check "{ braces"')] and all("a.example" not in c["text"] or c["text"].startswith("see") for c in d["comments"])
    assert next(c for c in d["comments"] if c["text"].startswith("TODO"))["near_function"] == "makeUser"


def test_cut_short_and_empty():
    assert scanner.parse("a.ts", "")["functions"] == []
    d = scanner.parse("a.ts", "export function f(a: { b: number }) {\n  if (a) {")
    assert [x["name"] for x in d["functions"]] == ["f"]
    long = "function f() {\n" + "\n".join(f"  a({i});" for i in range(60)) + "\n}"
    assert "more lines" in scanner.parse("a.ts", long)["functions"][0]["code_snippet"]


def test_sources(spark, tmp_path):
    for p, t in {"src/service.ts": SERVICE, "src/utils.ts": "export function pad(a: string) { return a; }\n", "src/types.ts": "export interface User { id: string }\n", "index.ts": "import { pad } from './src/utils';\n", "src/x.d.ts": "", "node_modules/a/b.ts": "", ".hid/a.ts": "", "src/README.md": "# Hello", "src/bad.ts": "export function ("}.items():
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text(t)
    found = files.find_files(spark, str(tmp_path))
    assert sorted(r.path for r in found.collect()) == ["index.ts", "src/bad.ts", "src/service.ts", "src/types.ts", "src/utils.ts"]
    doc = files.extract(found)
    got = {r.path: r for r in doc.collect()}
    assert got["src/service.ts"].functions[0].name == "makeUser" and got["src/utils.ts"].error is None
    imps = doc.select(F.lit("r").alias("repo"), "path", F.explode("imports").alias("i")).select("repo", "path", "i.ord", "i.spec")
    nodes = doc.select(F.lit("r").alias("repo"), "path")
    edges = [(r.src, r.dst) for r in graph.import_edges(imps, nodes).collect()]
    assert sorted(edges) == [("src/service.ts", "src/types.ts"), ("src/service.ts", "src/utils.ts"), ("src/service.ts", "src/utils.ts")]
    loose = graph.resolve_imports(imps, nodes, "calls").where("path = 'index.ts'").collect()
    assert [r.target for r in loose] == ["src/utils.ts"]
    assert [(r.directory, r.text) for r in files.readmes(spark, str(tmp_path)).collect()] == [("src", "# Hello")]


def test_git_log_and_json(spark, tmp_path):
    (tmp_path / "log").write_text("\x1eabc\x1fa@x\x1f2024-01-02T00:00:00Z\x1fone, two\n\na.ts\nb.ts\n\x1edef\x1fb@x\x1f2024-01-01T00:00:00Z\x1ffirst\n\na.ts\n")
    assert sorted((r.hash, r.author, r.path, r.message) for r in files.git_log(spark, str(tmp_path / "log")).collect()) == [("abc", "a@x", "a.ts", "one, two"), ("abc", "a@x", "b.ts", "one, two"), ("def", "b@x", "a.ts", "first")]
    (tmp_path / "p.json").write_text(json.dumps({"name": "x", "version": 3, "scripts": {"a": 1}, "dependencies": {"b": "1"}}))
    (tmp_path / "bad.json").write_text("{")
    assert files.package_manifest(str(tmp_path / "p.json")) == {"name": "x", "dependencies": {"b": "1"}} and files.read_json(str(tmp_path / "bad.json")) is None and files.compiler_config(str(tmp_path / "none.json")) == {}
    assert files.settings(str(tmp_path / "none.json"), {"a": {"b": 1}}) == {"a": {"b": 1}}
