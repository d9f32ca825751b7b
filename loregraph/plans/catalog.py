"""Queries of the engine's own operators on the tables of a data folder, with equivalent SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loregraph.functions import paths as P
from loregraph.functions import text as T
from loregraph.operators import graph, history, nodes, search, textops
from loregraph.session import cut
from loregraph.sources.tables import latest, table

NOW = "2025-07-01 00:00:00"
QUESTION = "How does retryLoad keep the session token in cache when 404 errors happen?"
ASKED = ["src/cahce/badge.ts", "src/mail/types.ts", "src/search/acount-index.ts"]
EVERY = 50
GREP = "promise\\.all|session"


def _functions(s: SparkSession, d: str, *columns: str) -> DataFrame:
    return latest(table(s, d, "function_data"), "func_id", "extracted_at", columns)


def _files(s: SparkSession, d: str, *columns: str) -> DataFrame:
    return latest(table(s, d, "file_nodes"), "file_id", "extracted_at", columns)


def _paths(s: SparkSession, d: str) -> DataFrame:
    return _files(s, d, "repo", "path")


def _commits(s: SparkSession, d: str) -> DataFrame:
    return latest(table(s, d, "commits"), "commit_id", "ingested_at", ["commit_id", "repo", "path", "author", "commit_date"])


def _edges(s: SparkSession, d: str) -> DataFrame:
    e = latest(table(s, d, "edges"), "edge_id", "recorded_at", ["repo", "src_id", "edge_type", "edge_target"]).where("edge_target IS NOT NULL")
    return e.select("repo", F.col("src_id").alias("src"), "edge_type", F.regexp_replace("edge_target", r"^\./", "").alias("dst"))


def _imports(s: SparkSession, d: str) -> DataFrame:
    return _edges(s, d).where("edge_type = 'imports'")


def _modules(s, d):
    return graph.module_nodes(_paths(s, d))


def _fan(s, d):
    return graph.fan(_imports(s, d), _paths(s, d))


def _seed(s, d):
    """The file of the largest repository that most files import."""
    top = _imports(s, d).where("repo = 'meridian-hub'").groupBy("repo", F.col("dst").alias("node")).agg(F.count(F.lit(1)).alias("n"))
    return top.orderBy(F.desc("n"), "node").limit(1).select("repo", "node")


def _every(s, d):
    """The prescribed set of requests: the files of all rows whose id is divisible by EVERY, in every repository."""
    return table(s, d, "file_nodes").where(F.col("file_id") % EVERY == 0).select("repo", "path").distinct()


def _seeds(s, d):
    """(repo, seed, node): each file of the prescribed set as a request of its own."""
    return _every(s, d).select("repo", F.col("path").alias("seed"), F.col("path").alias("node"))


def _index(s, d, question=None):
    f = _functions(s, d, "repo", "path", "func_name", "is_exported", "key_statements", "code_snippet")
    prose = _prose(s, d)
    return search.keyword_index(f, _modules(s, d), textops.patterns(f), prose, question)


def _prose(s, d):
    """(repo, path, summary): the first documentation text of each file."""
    e = _files(s, d, "repo", "path", "jsdoc").select("repo", "path", F.explode("jsdoc").alias("name", "v")).select("repo", "path", "name", F.col("v.description").alias("summary")).where("trim(summary) <> ''")
    return e.groupBy("repo", "path").agg(F.min_by("summary", "name").alias("summary"))


def keyword_index(s, d):
    return _index(s, d)


def prefilter_topk(s, d):
    return search.prefilter(s, QUESTION, _index(s, d, QUESTION), graph.parent_edges(_paths(s, d), _modules(s, d)), _fan(s, d))


def candidate_lines(s, d):
    return search.candidate_lines(cut(prefilter_topk(s, d)), _prose(s, d), _imports(s, d))  # 25 rows, read twice


def tokenize_docs(s, d):
    """All search tokens of each document, in order of first appearance."""
    t = T.query_tokens(F.col("text"))
    return table(s, d, "documents").select("doc_id", F.size(t).cast("long").alias("tokens"), F.array_join(t, " ").alias("all_tokens"))


def summary_words_top(s, d):
    w = table(s, d, "documents").where("lower(lang) IN ('en', 'eng')").select(F.explode(T.summary_words(F.col("text"))).alias("word"))
    return w.groupBy("word").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "word").limit(50)


def statement_keywords(s, d):
    st = _functions(s, d, "key_statements").select(F.explode("key_statements").alias("s"))
    return st.select(F.explode(T.statement_keywords(F.col("s.text"))).alias("keyword")).groupBy("keyword").agg(F.count(F.lit(1)).alias("n"))


def fan_in_out(s, d):
    return _fan(s, d)


def age_recency(s, d):
    return graph.ages(_files(s, d, "repo", "path", "created_at", "last_modified"), NOW)


def commit_rollup(s, d):
    r = history.rollup(_commits(s, d))
    return r.select("repo", "path", "commit_count", "created_at", "last_modified", F.array_join("authors", "|").alias("authors"))


def primary_author(s, d):
    return history.primary_author(_commits(s, d))


def recent_commits(s, d):
    return history.recent(_commits(s, d)).select("repo", "path", "commit_id", F.col("rank").cast("long").alias("rank"))


def module_nodes(s, d):
    return _modules(s, d)


def contains_edges(s, d):
    return graph.contains_edges(_paths(s, d), _functions(s, d, "repo", "path", "node_id", "is_exported"), _modules(s, d))


def parent_edges(s, d):
    return graph.parent_edges(_paths(s, d), _modules(s, d))


def imports_resolved(s, d):
    """Relative forms of the recorded imports, resolved again by candidates."""
    i = _imports(s, d)
    up = F.when(F.col("src").contains("/"), F.concat(F.repeat(F.lit("../"), F.size(F.split("src", "/")) - 1), F.regexp_replace("dst", r"\.ts$", ""))).otherwise(F.concat(F.lit("./"), F.regexp_replace("dst", r"\.ts$", "")))
    spec = i.select("repo", F.col("src").alias("path"), up.alias("spec")).distinct().withColumn("ord", F.xxhash64("repo", "path", "spec"))
    return graph.resolve_imports(spec, _paths(s, d)).select("repo", "path", "spec", "target")


def import_counts(s, d):
    """Import edges that resolve, repeated statements counted."""
    return _imports(s, d).join(_paths(s, d).select("repo", F.col("path").alias("dst")).distinct(), ["repo", "dst"], "left_semi").groupBy("repo", "src", "dst").agg(F.count(F.lit(1)).alias("statements"))


def imported_by(s, d):
    return graph.reverse_edges(_imports(s, d))


def test_files(s, d):
    return graph.test_file_edges(_paths(s, d))


def impact_bfs(s, d):
    return graph.impact(_imports(s, d), _seed(s, d))


def impact_by_depth(s, d):
    return impact_bfs(s, d).groupBy("repo", "depth").agg(F.count(F.lit(1)).alias("nodes"))


def tests_for_impact(s, d):
    e = _edges(s, d)
    return graph.tests_for(impact_bfs(s, d), _seed(s, d), e.where("edge_type = 'testFile'"))


def context_bundle(s, d):
    """Files only, as in its SQL; ``context_bundle_every`` has the modules too."""
    return graph.bundle(_seed(s, d), _edges(s, d), _paths(s, d))


def impact_bfs_every(s, d):
    return graph.impact(_imports(s, d), _seeds(s, d))


def impact_by_depth_every(s, d):
    return impact_bfs_every(s, d).groupBy("repo", "seed", "depth").agg(F.count(F.lit(1)).alias("nodes"))


def tests_for_impact_every(s, d):
    return graph.tests_for(impact_bfs_every(s, d), _seeds(s, d), _edges(s, d).where("edge_type = 'testFile'"))


def context_bundle_every(s, d):
    return graph.bundle(_seeds(s, d), _edges(s, d), _paths(s, d), _modules(s, d))


def _calls(s, d):
    c = latest(table(s, d, "cross_file_calls"), "call_id", "recorded_at", ["repo", "caller", "callee", "imported_as"]).where("callee IS NOT NULL AND caller IS NOT NULL")
    return c.select("repo", F.col("caller").alias("src"), F.regexp_replace("callee", r"^\./", "").alias("dst"), "imported_as")


def function_consumers(s, d):
    return graph.consumers(_functions(s, d, "repo", "node_id", "is_exported").where("is_exported"), _calls(s, d))


def cross_calls(s, d):
    return _calls(s, d).groupBy("repo", F.col("src").alias("caller")).agg(F.array_join(F.array_sort(F.collect_set("dst")), "|").alias("callees"), F.count("imported_as").alias("renamed"))


def called_by(s, d):
    return graph.called_by(_functions(s, d, "repo", "path", "func_name", "calls")).withColumn("callers", F.array_join("callers", "|"))


def _symbols(s, d):
    y = latest(table(s, d, "resolved_symbols"), "symbol_id", "recorded_at", ["repo", "path", "local_name", "symbol_name", "source_file"]).where("source_file IS NOT NULL")
    return y.select("repo", "path", "local_name", "symbol_name", F.regexp_replace("source_file", r"^\./", "").alias("source_file"))


def importers(s, d):
    """Files that import each symbol, apart for tests."""
    y = _symbols(s, d)
    t = P.is_test_file(F.col("path"))
    return y.groupBy("repo", "source_file", "symbol_name").agg(F.count_if(~t).alias("production"), F.count_if(t).alias("tests"))


def reexport_chain(s, d):
    return graph.follow_chain(_symbols(s, d))


def suffix_join(s, d):
    refs = _symbols(s, d).select("repo", F.regexp_replace("source_file", r"^(?:src|packages/[^/]+/src)/", "").alias("ref"))
    return graph.suffix_join(refs, _paths(s, d)).groupBy("repo", "ref").agg(F.count(F.lit(1)).alias("files"))


def affected_functions(s, d):
    """Functions of dependents whose code names a function that the imported file exports; code is what the table holds, the head of a longer one."""
    f = _functions(s, d, "repo", "path", "func_name", "is_exported", "code_snippet")
    return graph.affected(f, _imports(s, d)).select("repo", "src", "func_name", "uses").distinct()


def entry_points(s, d):
    return search.entry_points(_fan(s, d), _functions(s, d, "repo", "path", "func_name", "is_exported"))


def overview_tree(s, d):
    return search.tree(_paths(s, d)).withColumn("names", F.array_join("names", "|"))


def relationships(s, d):
    return search.relationships(_fan(s, d), _functions(s, d, "repo", "path", "func_name", "is_exported")).withColumn("exports", F.array_join("exports", "|"))


def used_symbols(s, d):
    return graph.used_symbols(_symbols(s, d)).withColumn("symbols", F.array_join("symbols", "|"))


def uses_exports(s, d):
    """Import edges over which code of the dependent names an export."""
    f = _functions(s, d, "repo", "path", "func_name", "is_exported", "code_snippet")
    return graph.uses_exports(f, _imports(s, d))


def metadata(s, d):
    """Dependents, dependencies and days of each file together."""
    ages = graph.ages(_files(s, d, "repo", "path", "created_at", "last_modified"), NOW).groupBy("repo", "path").agg(F.max("age_days").alias("age_days"), F.min("recency_days").alias("recency_days"))
    return _fan(s, d).join(ages, ["repo", "path"])


def imported_names(s, d):
    return search.imported_names(_symbols(s, d)).withColumn("names", F.array_join("names", "|"))


def entry_descriptions(s, d):
    entries = search.entry_points(_fan(s, d), _functions(s, d, "repo", "path", "func_name", "is_exported"))
    return search.described_entry_points(entries, _prose(s, d), search.imported_names(_symbols(s, d)))


def connections(s, d):
    f, fan = _functions(s, d, "repo", "path", "func_name", "is_exported"), _fan(s, d)
    c = search.connections(search.entry_points(fan, f), search.imported_names(_symbols(s, d)), search.relationships(fan, f))
    return c.withColumn("names", F.array_join("names", "|"))


def module_exports(s, d):
    """Modules with what the files in them export."""
    f = _functions(s, d, "repo", "path", "func_name", "is_exported").where("is_exported").select("repo", F.col("path").alias("src"), "func_name")
    e = graph.parent_edges(_paths(s, d), _modules(s, d)).join(f, ["repo", "src"])
    return e.groupBy("repo", F.col("dst").alias("module")).agg(F.array_join(F.array_sort(F.collect_set("func_name")), "|").alias("exports"))


def expanded_functions(s, d):
    """Which functions are shown whole; error statements stand for error paths."""
    f = _functions(s, d, "repo", "path", "func_name", "key_statements", "code_snippet")
    own = f.withColumn("error_paths", F.filter("key_statements", lambda x: x["category"] == "error"))
    return nodes.expanded(own, _fan(s, d), textops.patterns(f))


def throws(s, d):
    """The throw statements of all functions' code, with the condition that they stand under and its status."""
    return _error_paths(s, d).where("type = 'throw'").select("func_id", "line", "condition", "http_status")


def early_returns(s, d):
    """The returns under a condition of all functions' code."""
    return _error_paths(s, d).where("type = 'early-return'").select("func_id", "line", "condition", "action")


def _error_paths(s, d):
    return textops.error_paths(_functions(s, d, "func_id", "code_snippet"), ["func_id"], "code_snippet")


def config_files(s, d):
    both = _paths(s, d).select("repo", "path").unionByName(table(s, d, "package_json").select("repo", "path"))
    return search.config_files(both)


def _asked(s):
    return s.createDataFrame([(q,) for q in ASKED], "query string")


def fuzzy_paths(s, d):
    return search.fuzzy(_asked(s), _paths(s, d)).select("query", "path", F.col("score").cast("long").alias("score"), "confidence", F.col("rank").cast("long").alias("rank"))


def fuzzy_match(s, d):
    return search.fuzzy_match(_asked(s), _paths(s, d)).withColumn("alternatives", F.array_join("alternatives", "|"))


def similar_paths(s, d):
    return search.similar_paths(_asked(s), _paths(s, d)).select("query", "path", F.col("score").cast("long").alias("score"), F.col("rank").cast("long").alias("rank"))


def _every_path(s, d):
    return _every(s, d).select(F.col("path").alias("query"))


def fuzzy_paths_every(s, d):
    return search.fuzzy(_every_path(s, d), _paths(s, d), many=True).select("query", "path", F.col("score").cast("long").alias("score"), "confidence", F.col("rank").cast("long").alias("rank"))


def fuzzy_match_every(s, d):
    return search.fuzzy_match(_every_path(s, d), _paths(s, d), many=True).withColumn("alternatives", F.array_join("alternatives", "|"))


def similar_paths_every(s, d):
    return search.similar_paths(_every_path(s, d), _paths(s, d), many=True).select("query", "path", F.col("score").cast("long").alias("score"), F.col("rank").cast("long").alias("rank"))


def grep_union(s, d):
    f = _functions(s, d, "repo", "path", "func_name", "signature", "code_snippet", "is_exported", "key_statements")
    return search.grep(f, GREP).groupBy("repo", "path", "kind").agg(F.count(F.lit(1)).alias("matches"))


def grep_scoped(s, d):
    """The same under one path, which the pattern may be limited to."""
    f = _functions(s, d, "repo", "path", "func_name", "signature", "code_snippet", "is_exported", "key_statements")
    return search.grep(f, GREP, "src/").groupBy("repo", "path", "kind").agg(F.count(F.lit(1)).alias("matches"))


def http_status(s, d):
    return textops.error_statuses(_functions(s, d, "repo", "path", "func_name", "key_statements")).select("repo", "path", "func_name", "line", "status")


def errors_by_status(s, d):
    e = textops.error_statuses(_functions(s, d, "repo", "path", "func_name", "key_statements")).where("status IS NOT NULL")
    return e.groupBy("status", "description").agg(F.count(F.lit(1)).alias("paths"))


def inline_comments(s, d):
    return textops.inline_comments(_functions(s, d, "func_id", "code_snippet"), ["func_id"], "code_snippet").select("func_id", F.col("n").cast("long").alias("n"), "comment")


def markers(s, d):
    docs = table(s, d, "documents").select("doc_id", "text")
    c = table(s, d, "doc_comments").where("text IS NOT NULL").select(F.col("comment_id").alias("doc_id"), F.concat(F.lit("// "), F.lit(""), "text").alias("text")).distinct()
    return textops.markers(docs.unionByName(c), ["doc_id"], "text").select("doc_id", F.col("n").cast("long").alias("n"), "marker", "note")


def key_statement_lines(s, d):
    return textops.key_statements(_functions(s, d, "func_id", "code_snippet"), ["func_id"], "code_snippet").groupBy("category").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("func_id").alias("functions"))


def comment_functions(s, d):
    c = table(s, d, "doc_comments").select("comment_id", "repo", "path", "line").distinct()
    return graph.nearest_function(c, _functions(s, d, "repo", "path", "func_name", "start_line", "end_line")).select("comment_id", "enclosing")


def pattern_files(s, d):
    return textops.patterns(_functions(s, d, "repo", "path", "func_name", "key_statements", "code_snippet"))


def content_hash(s, d):
    return table(s, d, "documents").groupBy(T.content_hash(F.col("text")).alias("content_hash")).agg(F.count(F.lit(1)).alias("documents"))


def changed_files(s, d):
    """Documents that a snapshot of the earlier half doesn't hold as they are."""
    docs = table(s, d, "documents").select("doc_id", "text", "ingested_at")
    old = docs.where("ingested_at < TIMESTAMP '2024-06-01 00:00:00'").select("doc_id", T.content_hash(F.col("text")).alias("content_hash"))
    return history.changed(docs, old, "doc_id", "text").select("doc_id", "content_hash")


def upsert_merge(s, d):
    """First version of each file, with the newest set over it."""
    f = table(s, d, "file_nodes").select("file_id", "line_count", "commit_count", "primary_author", "extracted_at")
    old = f.groupBy("file_id").agg(F.min_by(F.struct("line_count", "commit_count", "primary_author"), "extracted_at").alias("v")).select("file_id", "v.*")
    new = f.groupBy("file_id").agg(F.max_by(F.struct("commit_count", "primary_author"), "extracted_at").alias("v")).select("file_id", "v.*")
    return history.upsert(old, new, ["file_id"])


def stale_nodes(s, d):
    f = _files(s, d, "file_id", "last_modified", "extracted_at")
    return history.stale(f.select("file_id", "last_modified"), f.select("file_id", F.col("extracted_at").alias("generated_at")), ["file_id"]).select("file_id")


def claim_confidence(s, d):
    f = _files(s, d, "repo", "path", "jsdoc").select("repo", "path", F.explode("jsdoc").alias("name", "v"))
    claims = f.select("repo", "path", "name", F.col("v.description").alias("text")).where("text IS NOT NULL")
    return textops.claim_confidence(claims, _functions(s, d, "repo", "path", "func_name").select("repo", "path", F.col("func_name").alias("known")), ["repo", "path"])


def token_cost(s, d):
    return textops.token_cost(table(s, d, "documents"), "text")


def target_counts(s, d):
    return _edges(s, d).groupBy("edge_type").agg(F.count(F.lit(1)).alias("n"))


def deprecations(s, d):
    e = _files(s, d, "repo", "path", "jsdoc").select("repo", "path", F.explode("jsdoc").alias("name", "v"))
    return e.where("v.deprecated IS NOT NULL").select("repo", "path", "name", F.col("v.deprecated").alias("note"))


def manifest_dependencies(s, d):
    m = table(s, d, "package_json").select("package_id", F.explode("dependencies").alias("name", "version")).distinct()
    return m.groupBy("name").agg(F.count(F.lit(1)).alias("packages"))


def part_index(s, d):
    """The keyword index's shape on star-schema rows: tokens of part names, types and brands."""
    p = table(s, d, "part")
    each = F.explode(F.concat(F.transform(F.split(F.lower("p_name"), " "), lambda w: F.struct(F.lit("export").alias("kind"), w.alias("token"))), F.array(F.struct(F.lit("pattern").alias("kind"), F.lower("p_type").alias("token")))))
    return p.select("p_partkey", each.alias("e")).select("e.kind", "e.token", "p_partkey").distinct()


_NAMES = """keyword_index prefilter_topk candidate_lines tokenize_docs summary_words_top statement_keywords fan_in_out age_recency commit_rollup primary_author recent_commits module_nodes
contains_edges parent_edges imports_resolved import_counts imported_by test_files impact_bfs impact_by_depth tests_for_impact context_bundle function_consumers cross_calls called_by importers
reexport_chain suffix_join affected_functions entry_points overview_tree relationships config_files fuzzy_paths fuzzy_match similar_paths grep_union http_status errors_by_status inline_comments
markers key_statement_lines comment_functions pattern_files content_hash changed_files upsert_merge stale_nodes claim_confidence token_cost target_counts deprecations manifest_dependencies part_index
used_symbols uses_exports metadata imported_names entry_descriptions connections module_exports expanded_functions throws early_returns
fuzzy_paths_every fuzzy_match_every similar_paths_every impact_bfs_every impact_by_depth_every tests_for_impact_every context_bundle_every grep_scoped""".split()
QUERIES = {n: globals()[n] for n in _NAMES}

from loregraph.plans.oracle import ORACLES  # noqa: E402, F401
