"""A small tree from files to edges, calls through a barrel, and prose."""

from loregraph.plans import pipeline

TREE = {
    "src/types.ts": "export interface User { id: string }\n",
    "src/util.ts": "export function pad(a: string) { return a; }\nexport default function main() { return pad('x'); }\n",
    "src/barrel.ts": "import { pad } from './util';\nexport { pad } from './util';\n",
    "src/service.ts": "import { pad } from './barrel';\nimport start from './util';\nimport type { User } from './types';\nexport function serve(u: User) {\n  start();\n  return pad(u.id);\n}\n",
    "src/service.test.ts": "import { serve } from './service';\nfunction check() { serve({ id: 'a' }); }\n",
}


def _tree(tmp_path):
    for p, t in TREE.items():
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text(t)
    return str(tmp_path)


def test_pipeline(spark, tmp_path):
    docs = pipeline.extract(spark, _tree(tmp_path), "r").cache()
    assert docs.count() == 5 and docs.where("error IS NOT NULL").count() == 0
    e = {(r.src, r.edge_type, r.dst) for r in pipeline.edges(docs).collect()}
    assert {("src/service.ts", "imports", "src/types.ts"), ("src/types.ts", "importedBy", "src/service.ts"), ("src", "contains", "src/util.ts"), ("src/util.ts", "contains", "src/util.ts:pad"), ("src/util.ts", "parent", "src"), ("src/service.ts", "testFile", "src/service.test.ts")} <= e
    calls = {(r.src, r.dst, r.imported_as) for r in pipeline.cross_calls(docs).collect()}
    assert calls == {("src/service.ts:serve", "src/util.ts:pad", None), ("src/service.ts:serve", "src/util.ts:main", "start"), ("src/service.test.ts:check", "src/service.ts:serve", None)}
    text = {r.id: r.summary for r in pipeline.prose(docs).collect()}
    assert text["src/util.ts"].startswith("src/util.ts provides pad") and "src" in text
    (tmp_path / "src/util.ts").write_text("export function pad(a: string) { return a + a; }\n")
    known = docs.select("path", "content_hash")
    assert [r.path for r in pipeline.extract(spark, str(tmp_path), "r", known).collect()] == ["src/util.ts"]
