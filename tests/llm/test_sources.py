"""Source text of documents: listings by label or by content, fenced blocks, and shares."""

import numpy as np

from loregraph.llm import language, q_language

EN, DE = "// we have to wait until the cache is ready", "// das gilt auch für leere Listen"
DOCS = [
    (1, f"{EN}\nconst a = 1;\n", "source_listing"),
    (2, f"{EN}\nconst a = 1;\n", None),
    (3, f"import {{ a }} from './b';\n\n{DE}\n", "design_note"),
    (4, f"Mirror of src/a/b.ts\n\n/**\n * We have to wait until the cache is ready.\n */\n{DE}\n", None),
    (5, f"# Usage\n\nIt's what we need for the cache, isn't it.\n\n```ts\n{EN}\n```\n\ntext\n\n~~~\n{DE}\n~~~\n", "readme"),
    (6, f"Prose about the cache.\n\n```ts\n{DE}\nconst a = 1;", None),
    (7, "We have to wait until the cache is ready, it's said.", None),
    (8, None, "source_listing"),
    (9, "odd " + EN, "source_listing"),
]


def folder(spark, tmp_path):
    spark.createDataFrame(DOCS, "doc_id long, text string, doc_kind string").write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)


def test_all_source_text_is_read(spark, tmp_path):
    got = sorted((r.doc_id, r.lang) for r in q_language.p3_sources(spark, folder(spark, tmp_path)).collect())
    assert got == [(1, "en"), (2, "en"), (3, "de"), (4, "de"), (4, "en"), (5, "de"), (5, "en"), (6, "de"), (9, "en")]


def test_shares(spark, tmp_path):
    d = folder(spark, tmp_path)
    pieces = {}
    for r in q_language.code_of(spark.read.parquet(f"{d}/documents.parquet")).collect():
        pieces.setdefault(r.doc_id, []).append(r)
    assert {k: [len(p.text) for p in v] for k, v in pieces.items() if k in (5, 6)} == {5: [len(EN) + 1, len(DE) + 1], 6: [len(DE) + 13]}
    for r in q_language.p3_sources(spark, d).collect():
        whole = sum(len(p.text) for p in pieces[r.doc_id])
        assert {p.chars for p in pieces[r.doc_id]} == {whole}
        assert r.share == round(r.letters / whole, 4) and 0 < r.share < 1


def test_a_long_text_is_as_if_uncut(monkeypatch):
    lines = [f"{(EN, DE)[i % 3 == 1]}, {'x' * (i % 7)} {i}\nconst a{i} = b(c);\n" for i in range(120)]
    texts = ["".join(lines), "/* " + " ".join(x[3:] for x in (EN, DE)) * 40 + " */", EN, "".join(lines[:70])]
    monkeypatch.setattr(language, "BLOCK", 1 << 30)
    whole = language.paths(texts, source=True)
    assert len({int(s) for s in whole[0]}) == 3
    for block in (64, 1000, 4096):
        monkeypatch.setattr(language, "BLOCK", block)
        for a, b in zip(language.paths(texts, source=True), whole, strict=True):
            assert np.array_equal(a, b)
