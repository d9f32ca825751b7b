"""Grep of all paths and all tokens."""

from datetime import datetime, timezone

from loregraph.plans import catalog

T0 = datetime(2024, 1, 1, tzinfo=timezone.utc)


def test_grep_of_all_paths(spark, tmp_path):
    rows = [(i, "ash", p, "openSession", "openSession()", None, None, False, T0) for i, p in enumerate(["src/a.ts", "packages/x/src/b.ts", "c.ts"])]
    spark.createDataFrame(rows, "func_id long, repo string, path string, func_name string, signature string, code_snippet string, key_statements array<struct<line:int,text:string,category:string>>, is_exported boolean, extracted_at timestamp").write.parquet(f"{tmp_path}/function_data.parquet")
    got = {(r.path, r.kind, r.matches) for r in catalog.grep_union(spark, str(tmp_path)).collect()}
    assert got == {(p, k, 1) for p in ("src/a.ts", "packages/x/src/b.ts", "c.ts") for k in ("function", "signature")}


def test_all_tokens(spark, tmp_path):
    spark.createDataFrame([(1, "alpha betaGamma delta epsilon zeta 42 alpha theta"), (2, None), (3, "")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.all_tokens for r in catalog.tokenize_docs(spark, str(tmp_path)).collect()}
    assert got == {1: "alpha beta gamma delta epsilon zeta 42 theta", 2: None, 3: ""}
