"""Calls of an application: each runs a plan and collects its small result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loregraph.errors import LoreError
from loregraph.functions.paths import is_test_file
from loregraph.operators import graph, history, search, targets, textops
from loregraph.operators.nodes import TEST_COMMAND, expanded
from loregraph.plans import catalog
from loregraph.prose import answers, model
from loregraph.render import markdown

#: Candidates that are looked at where the navigator names no place, and rows that an answer is made from.
FALLBACK, SHOWN = 5, 200


class NotFound(LoreError):
    """No such node; ``suggestions`` holds paths that may be meant."""

    def __init__(self, path: str, suggestions: list[str]) -> None:
        super().__init__(f"no node {path}", "missing", path=path)
        self.suggestions = suggestions


class Engine:
    """Answers on one data folder. ``index``: a folder with a kept keyword index, as ``build_index`` makes it."""

    def __init__(self, spark: SparkSession, folder: str, index: str | None = None, text_model: model.TextModel | None = None) -> None:
        self.spark, self.folder, self.index, self.model = spark, folder, index, text_model

    def _seed(self, repo: str, path: str) -> DataFrame:
        return self.spark.createDataFrame([(repo, path)], "repo string, node string")

    def _row(self, repo: str, path: str, fuzzy: bool = True):
        own = catalog._files(self.spark, self.folder).where(F.col("repo") == repo)
        row = own.where(F.col("path") == path).first()
        if row is None:
            asked = self.spark.createDataFrame([(path,)], "query string")
            best = search.fuzzy(asked, own, 4, many=False).orderBy("rank").collect() if fuzzy else []
            if not best or best[0].confidence < search.AUTO:
                raise NotFound(path, [b.path for b in best[:3]] if best and best[0].confidence >= search.SUGGEST else [])
            row = own.where(F.col("path") == best[0].path).first()
        return row

    def build_index(self, folder: str) -> None:
        """Keep the keyword index in ``folder``; questions read their tokens from it from then on."""
        search.write_index(catalog._index(self.spark, self.folder), folder)
        self.index = folder

    def node(self, repo: str, path: str) -> dict:
        """A file by its path; a misspelt one is answered if one path fits well, else suggested."""
        return self._row(repo, path).asDict(recursive=True)

    def _known(self, nodes: DataFrame) -> DataFrame:
        """What is known of nodes (repo, node): one row each."""
        s, d = self.spark, self.folder
        mine = lambda df, key="path": df.withColumnRenamed(key, "node").join(nodes.select("repo", "node"), ["repo", "node"], "left_semi")
        listed = lambda df, c, name: df.groupBy("repo", "node").agg(F.array_sort(F.collect_set(c)).alias(name))
        edges, f = catalog._edges(s, d), mine(catalog._functions(s, d))
        imports = edges.where("edge_type = 'imports'")
        fan = mine(catalog._fan(s, d))
        pats = mine(textops.patterns(catalog._functions(s, d, "repo", "path", "func_name", "key_statements", "code_snippet")))
        whole = expanded(f.withColumnRenamed("node", "path").withColumn("error_paths", F.filter(F.coalesce("key_statements", F.array().cast(f.schema["key_statements"].dataType)), lambda x: x["category"] == "error")), fan.withColumnRenamed("node", "path"), pats.withColumnRenamed("node", "path"))
        code = f.join(whole.withColumnRenamed("path", "node"), ["repo", "node", "func_name"]).select("repo", "node", "is_exported", F.struct("start_line", "func_name", "signature", "expanded", "key_statements", "code_snippet").alias("f"))
        e = mine(textops.error_statuses(catalog._functions(s, d, "repo", "path", "func_name", "key_statements")))
        calls = catalog._calls(s, d).select("repo", F.substring_index("src", ":", 1).alias("_from"), F.substring_index("dst", ":", 1).alias("_to"), "src", "dst")
        log = mine(history.recent(catalog._commits(s, d)))
        parts = [
            fan.select("repo", "node", "fan_in"),
            mine(catalog._prose(s, d)),
            pats.groupBy("repo", "node").agg(F.array_sort(F.collect_list(F.struct("pattern", "location"))).alias("patterns")),
            code.groupBy("repo", "node").agg(F.array_sort(F.collect_list("f")).alias("functions")),
            listed(code.where("is_exported"), F.col("f.func_name"), "exports"),
            e.groupBy("repo", "node").agg(F.array_sort(F.collect_list(F.struct("line", "status", "description"))).alias("errors")),
            listed(mine(imports, "src"), "dst", "imports"),
            listed(mine(imports, "dst"), "src", "dependents"),
            listed(mine(edges.where("edge_type = 'testFile'"), "src"), "dst", "tests"),
            listed(mine(calls.drop("_to"), "_from"), "dst", "calls"),
            listed(mine(calls.drop("_from"), "_to"), "src", "called_by"),
            log.groupBy("repo", "node").agg(F.array_sort(F.collect_list(F.struct("rank", F.concat_ws(" ", F.date_format("commit_date", "yyyy-MM-dd"), "author").alias("c")))).alias("_c")).select("repo", "node", F.transform("_c", lambda x: x["c"]).alias("commits")),
        ]
        out = nodes
        for p in parts:
            out = out.join(p, ["repo", "node"], "left")
        return out

    def context(self, repo: str, paths: list[str], form: str = "markdown") -> str | list[dict]:
        """The requested files and what is one hop away, their modules too. Misspelt paths are answered as by ``node``, or left out."""
        asked = [p.strip() for p in paths if p.strip()]
        if not asked:
            raise ValueError("no files asked for")
        found = []
        for p in asked:
            try:
                found.append(self._row(repo, p).path)
            except NotFound as e:
                if len(asked) == 1:
                    raise e
        seeds = self.spark.createDataFrame([(repo, p) for p in dict.fromkeys(found)], "repo string, node string")
        s, d = self.spark, self.folder
        b = graph.bundle(seeds, catalog._edges(s, d), catalog._paths(s, d), catalog._modules(s, d))
        modules = catalog._modules(s, d).select("repo", F.col("module").alias("node"), F.lit("module").alias("type"))
        rows = []
        for r in self._known(b.join(modules, ["repo", "node"], "left")).collect():
            n = {k: v for k, v in r.asDict(recursive=True).items() if v is not None} | {"path": r.node, "type": r.type or "file", "fan_in": r.fan_in or 0, "detail": r.hop == 0}
            if r.hop:
                n.pop("functions", None)
            rows.append(n | {"test_commands": {t: TEST_COMMAND + t for t in n.get("tests", [])}})
        return markdown.context(rows) if form == "markdown" else rows

    def impact(self, repo: str, path: str, form: str = "json", exports: list[str] | None = None) -> str | dict:
        """Who depends on a file, with the symbols used of it and, for ``exports``, the functions that name them; and the tests to run."""
        path = self._row(repo, path, fuzzy=False).path
        seed = self._seed(repo, path)
        s, d = self.spark, self.folder
        e = catalog._edges(s, d)
        hit = graph.impact(e.where("edge_type = 'imports'"), seed)
        tests = sorted(r.test for r in graph.tests_for(hit, seed, e.where("edge_type = 'testFile'")).collect())
        used = graph.used_symbols(catalog._symbols(s, d).where((F.col("repo") == repo) & (F.col("source_file") == path)), self.spark.createDataFrame([(repo, x) for x in exports], "repo string, symbol_name string") if exports else None)
        out = hit.join(used.select("repo", F.col("path").alias("node"), "symbols"), ["repo", "node"], "left")
        if exports:
            f = catalog._functions(s, d, "repo", "path", "func_name", "code_snippet").where(F.col("repo") == repo)
            words = f.select("repo", F.col("path").alias("node"), "func_name", F.regexp_extract_all(F.coalesce("code_snippet", F.lit("")), F.lit(r"\w+"), F.lit(0)).alias("_w"))
            named = words.where(F.arrays_overlap("_w", F.array(*map(F.lit, exports))))
            out = out.join(named.groupBy("repo", "node").agg(F.array_sort(F.collect_set("func_name")).alias("functions")), ["repo", "node"], "left")
        rows = [{k: v for k, v in r.asDict(recursive=True).items() if v is not None} for r in out.orderBy("depth", "node").collect()]
        return markdown.impact(path, rows, tests, {t: TEST_COMMAND + t for t in tests}) if form == "markdown" else {"source": path, "dependents": rows, "tests": tests}

    def consumers(self, repo: str, node_id: str) -> dict:
        """How often an exported function is called, and by whom: production apart from tests."""
        s, d = self.spark, self.folder
        f = catalog._functions(s, d, "repo", "node_id", "is_exported").where((F.col("repo") == repo) & (F.col("node_id") == node_id) & F.col("is_exported"))
        calls = catalog._calls(s, d).where((F.col("repo") == repo) & (F.col("dst") == node_id))
        row = graph.consumers(f, calls).first()
        if row is None:
            raise NotFound(node_id, [])
        by = calls.select("src", is_test_file(F.substring_index("src", ":", 1)).alias("test")).distinct().orderBy("src").collect()
        return row.asDict() | {"callers": [r.src for r in by if not r.test], "test_callers": [r.src for r in by if r.test]}

    def overview(self, repo: str) -> dict:
        """A project at a glance: README, listing, modules, entry points, connections, configuration files."""
        s, d = self.spark, self.folder
        of = lambda df: df.where(F.col("repo") == repo)
        f = of(catalog._functions(s, d, "repo", "path", "func_name", "is_exported"))
        files, fan, prose, modules = of(catalog._paths(s, d)), of(catalog._fan(s, d)), of(catalog._prose(s, d)), of(catalog._modules(s, d))
        names, entries = search.imported_names(of(catalog._symbols(s, d))), search.entry_points(fan, f)
        child = graph.parent_edges(files, modules).join(f.where("is_exported").withColumnRenamed("path", "src"), ["repo", "src"]).groupBy("repo", F.col("dst").alias("module")).agg(F.array_sort(F.collect_set("func_name")).alias("exports"))
        mods = modules.join(child, ["repo", "module"], "left").join(prose.withColumnRenamed("path", "module"), ["repo", "module"], "left").select(F.col("module").alias("path"), "summary", "exports")
        rows = lambda df, *by: [r.asDict(recursive=True) for r in df.orderBy(*by).collect()]
        readme = s.read.parquet(f"{d}/documents.parquet").where((F.col("source") == repo) & (F.col("doc_kind") == "readme")).select("doc_id", "text").orderBy(F.length("text"), "doc_id").first()
        return {
            "readme": readme.text if readme else None,
            "tree": rows(search.tree(files).select("directory", "names"), "directory"),
            "modules": rows(mods, "path"),
            "entry_points": rows(search.described_entry_points(entries, prose, names).select("path", "description"), "path"),
            "connections": rows(search.connections(entries, names, search.relationships(fan, f)).select("path", "names", "consumers"), F.col("consumers").isNotNull(), "path"),
            "configs": [r.path for r in search.config_files(files).orderBy("path").collect()],
        }

    def candidates(self, question: str) -> list[dict]:
        """The deterministic answer to a question: the candidates, best first."""
        s, d = self.spark, self.folder
        index = search.read_index(s, self.index, question) if self.index else catalog._index(s, d, question)
        found = search.prefilter(s, question, index, graph.parent_edges(catalog._paths(s, d), catalog._modules(s, d)), catalog._fan(s, d))
        return [r.asDict() for r in found.orderBy(F.desc("score"), "repo", "path").collect()]

    def query(self, question: str, repo: str | None = None) -> list[dict] | dict:
        """Candidates for a question; with a text model and a repository, an answer.

        The model names places on an overview, which are resolved, and answers from what is there. Where it names
        none, or none is found, the best candidates stand in.
        """
        if not question.strip():
            raise ValueError("no question")
        if self.model is None or repo is None:
            return self.candidates(question)
        reply = model.call(self.model, answers.navigator_prompt(question, self.overview(repo)))
        try:
            plan = targets.parse_targets(reply)
        except (ValueError, AttributeError) as e:
            raise LoreError(f"the navigator's reply can't be read: {e}", "model") from e
        s, d = self.spark, self.folder
        found = []
        if plan:
            of = lambda df: df.where(F.col("repo") == repo)
            rows = targets.resolve(plan, of(catalog._functions(s, d)), of(catalog._symbols(s, d)), of(catalog._calls(s, d)))
            found = [r.asDict() for r in rows.orderBy("ord", "path", "detail").limit(SHOWN).collect()]
        mode = "navigator"
        if not found:
            mode = "candidates"
            found = [{"type": "file", "path": c["path"], "detail": ", ".join(c["reasons"])} for c in self.candidates(question) if c["repo"] == repo][:FALLBACK]
        lost = [f"{t.type} {t.path or t.name or t.of or t.pattern}" for n, t in enumerate(plan) if not any(f.get("ord") == n for f in found)]
        answer = answers.parse_answer(model.call(self.model, answers.synthesis_prompt(question, found, lost)))
        return {"mode": mode, "reasoning": answers.reasoning_of(reply), "files": list(dict.fromkeys(f["path"] for f in found)), "not_found": lost, **answer}

    def describe(self, repo: str, path: str, store=None) -> dict:
        """Text about one node, generated on demand: of a file, or of a module from its files' summaries; kept in ``store`` if given."""
        s, d = self.spark, self.folder
        if self.model is None:
            raise LoreError("no text model", "model")
        f = catalog._functions(s, d, "repo", "path", "func_name", "is_exported", "key_statements").where(F.col("repo") == repo)
        module = catalog._modules(s, d).where((F.col("repo") == repo) & (F.col("module") == path)).first()
        if module is not None:
            child = graph.parent_edges(catalog._paths(s, d).where(F.col("repo") == repo), self.spark.createDataFrame([(repo, path)], "repo string, module string"))
            own = child.join(catalog._prose(s, d).withColumnRenamed("path", "src"), ["repo", "src"], "left").collect()
            prompt = model.module_prompt(path, {r.src: r.summary or "-" for r in own})
        else:
            row = self._row(repo, path, fuzzy=False)
            own = f.where(F.col("path") == path).orderBy("func_name").collect()
            prompt = model.file_prompt(path, row.line_count or 0, [r.func_name for r in own if r.is_exported], [f"line {k.line} {k.category}: {k.text}" for r in own for k in r.key_statements or []])
        text = model.generate(self.model, prompt)
        claims = self.spark.createDataFrame([(repo, path, str(i), g) for i, g in enumerate(text["gotchas"])], "repo string, path string, name string, text string")
        sure = textops.claim_confidence(claims, f.select("repo", "path", F.col("func_name").alias("known")), ["repo", "path"]).collect()
        text["gotcha_confidence"] = [r.confidence for r in sorted(sure, key=lambda r: int(r.name))]
        if store is not None:
            store.describe(self.spark.createDataFrame([(repo, path, text["summary"], text["purpose"])], "repo string, id string, summary string, purpose string").withColumn("generated_at", F.current_timestamp()))
        return text
