"""From a source tree to the graph: extract, build, generate. Each step is a plan over the last one's rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loregraph.operators import graph, textops
from loregraph.prose import model
from loregraph.sources import files


def extract(spark: SparkSession, root: str, repo: str, known: DataFrame | None = None) -> DataFrame:
    """The extracted documents of a tree; with ``known`` (path, content_hash), only of files that are new or changed."""
    found = files.find_files(spark, root)
    if known is not None:
        old = known.select("path", F.col("content_hash").alias("_old"))
        now = F.concat(F.lit("sha256-"), F.sha2(F.col("content").cast("binary"), 256))
        found = found.join(old, "path", "left").where(~now.eqNullSafe(F.col("_old"))).drop("_old")
    return files.extract(found).withColumn("repo", F.lit(repo))


def functions(docs: DataFrame) -> DataFrame:
    """One row per function; of functions with the same name in a file, the last one."""
    f = docs.select("repo", "path", F.posexplode("functions").alias("ord", "f")).groupBy("repo", "path", F.col("f.name").alias("func_name")).agg(F.max_by("f", "ord").alias("f"))
    cols = ["signature", "code_snippet", "key_statements", "calls", "is_async", "is_exported", "is_default_export", "start_line", "end_line"]
    return f.select("repo", "path", F.concat_ws(":", "path", "func_name").alias("node_id"), "func_name", *[F.col(f"f.{c}").alias(c) for c in cols])


def edges(docs: DataFrame) -> DataFrame:
    """(repo, src, edge_type, dst) of the five kinds of edges."""
    nodes = docs.select("repo", "path")
    imports = graph.import_edges(docs.select("repo", "path", F.explode("imports").alias("i")).select("repo", "path", "i.ord", "i.spec"), nodes)
    modules = graph.module_nodes(nodes)
    kind = lambda df, k: df.select("repo", "src", F.lit(k).alias("edge_type"), "dst")
    return (
        kind(graph.contains_edges(nodes, functions(docs), modules), "contains").unionByName(imports).unionByName(kind(graph.parent_edges(nodes, modules), "parent"))
        .unionByName(kind(graph.test_file_edges(nodes), "testFile")).unionByName(kind(graph.reverse_edges(imports), "importedBy"))
    )


def symbol_map(docs: DataFrame, hops: int = 5) -> DataFrame:
    """(repo, path, local, target, symbol_name): what each imported name of a file is, and in which file.

    Named and default imports that are relative and not of types only; names that a file passes on are followed
    to where they come from, ``hops`` files at most. A name that is imported twice is what the later import says.
    """
    nodes = docs.select("repo", "path")
    imp = docs.select("repo", "path", F.explode("imports").alias("i")).select("repo", "path", "i.ord", "i.spec", "i.names", "i.default_name", "i.type_only")
    res = graph.resolve_imports(imp, nodes, "calls").where("target IS NOT NULL AND NOT type_only")
    named = res.select("repo", "path", F.explode("names").alias("local"), "target", "ord").withColumn("symbol_name", F.col("local"))
    default = res.where("default_name IS NOT NULL").select("repo", "path", F.col("default_name").alias("local"), "target", "ord").withColumn("symbol_name", F.lit("default"))
    passed = docs.select("repo", "path", F.explode("exports").alias("e")).where("e.reexport").select("repo", F.col("path").alias("target"), F.col("e.name").alias("symbol_name"))
    chain = named.join(passed, ["repo", "target", "symbol_name"], "left_semi").select("repo", F.col("target").alias("path"), "symbol_name").distinct()
    on = chain.join(named.select("repo", "path", "symbol_name", F.col("target").alias("source_file")), ["repo", "path", "symbol_name"])
    ends = graph.follow_chain(on, hops).select("repo", F.col("path").alias("target"), "symbol_name", F.col("origin").alias("_end"))
    uses = named.unionByName(default).join(ends, ["repo", "target", "symbol_name"], "left").withColumn("target", F.coalesce("_end", "target"))
    last = uses.groupBy("repo", "path", "local").agg(F.max_by(F.struct("target", "symbol_name"), "ord").alias("_s"))
    return last.select("repo", "path", "local", "_s.target", "_s.symbol_name")


def cross_calls(docs: DataFrame, hops: int = 5) -> DataFrame:
    """(repo, src, dst, imported_as): calls of imported functions, followed through files that pass them on.

    The called name must be in the function's code; a default import stands for the file's default function.
    """
    uses = symbol_map(docs, hops)
    f = functions(docs)
    main = f.where("is_default_export").groupBy("repo", F.col("path").alias("target")).agg(F.min("func_name").alias("_main"))
    called = f.select("repo", "path", "node_id", F.explode(F.array_distinct(F.regexp_extract_all("code_snippet", F.lit(r"(?<![\w.$])([\w$]+)\s*\("), F.lit(1)))).alias("local"))
    hit = called.join(uses, ["repo", "path", "local"]).join(main, ["repo", "target"], "left").withColumn("name", F.when(F.col("symbol_name") == "default", F.col("_main")).otherwise(F.col("symbol_name")))
    return hit.where("name IS NOT NULL").select("repo", F.col("node_id").alias("src"), F.concat_ws(":", "target", "name").alias("dst"), F.when(F.col("local") != F.col("name"), F.col("local")).alias("imported_as")).distinct()


def with_cross_calls(docs: DataFrame) -> DataFrame:
    """(repo, node_id, calls, called_by) of the functions that call into another file or are called from one, each list sorted."""
    c = cross_calls(docs)
    a = c.groupBy("repo", F.col("src").alias("node_id")).agg(F.array_sort(F.collect_list("dst")).alias("calls"))
    b = c.groupBy("repo", F.col("dst").alias("node_id")).agg(F.array_sort(F.collect_list("src")).alias("called_by"))
    return a.join(b, ["repo", "node_id"], "full_outer")


def patterns(docs: DataFrame) -> DataFrame:
    """(repo, path, pattern, location) of retry, cache, builder and singleton in documents.

    Top-level functions as in ``textops.patterns``; a file with an interface named after a cache has a cache,
    and a class with two methods or more that give ``this`` back is a builder.
    """
    f = docs.select("repo", "path", F.explode("functions").alias("f")).select("repo", "path", F.col("f.name").alias("func_name"), "f.owner", "f.code_snippet", "f.key_statements")
    cache = docs.where(F.exists("interfaces", lambda i: F.lower(i["name"]).contains("cache"))).select("repo", "path", F.lit("cache").alias("pattern"), F.col("path").alias("location"))
    chained = f.where("owner IS NOT NULL").where(F.col("code_snippet").contains("return this")).groupBy("repo", "path", "owner").agg(F.count(F.lit(1)).alias("_n")).where("_n >= 2")
    builder = chained.select("repo", "path", F.lit("builder").alias("pattern"), F.concat_ws(":", "path", "owner").alias("location"))
    return textops.patterns(f.where("owner IS NULL")).unionByName(cache).unionByName(builder).distinct()


def with_patterns(docs: DataFrame) -> DataFrame:
    """The documents with their ``patterns`` in the order retry, cache, builder, singleton; null where there are none."""
    rank = F.array_position(F.array(*map(F.lit, ("retry", "cache", "builder", "singleton"))), F.col("pattern"))
    own = patterns(docs).groupBy("repo", "path").agg(F.array_sort(F.collect_list(F.struct(rank.alias("rank"), "location", "pattern"))).alias("_p"))
    return docs.join(own.select("repo", "path", F.transform("_p", lambda p: F.struct(p["pattern"].alias("pattern"), p["location"].alias("location"))).alias("patterns")), ["repo", "path"], "left")


def with_confidence(text: DataFrame, functions: DataFrame) -> DataFrame:
    """Text (repo, id, gotchas, ...) of files with ``confidence``: for each gotcha, in order, how far its identifiers are names of the file's functions."""
    each = text.select("repo", F.col("id").alias("path"), F.posexplode("gotchas").alias("name", "text"))
    sure = textops.claim_confidence(each, functions.select("repo", "path", F.col("func_name").alias("known")), ["repo", "path"])
    own = sure.groupBy("repo", F.col("path").alias("id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("name", "confidence"))), lambda x: x["confidence"]).alias("confidence"))
    return text.join(own, ["repo", "id"], "left").withColumn("confidence", F.coalesce("confidence", F.array().cast("array<string>")))


def prose(docs: DataFrame, text_model: model.TextModel = model.offline, concurrency: int | None = 5) -> DataFrame:
    """Text of all files, then of all modules from their files' summaries."""
    exports = F.transform("exports", lambda e: e["name"])
    asked = docs.select("repo", F.col("path").alias("id"), F.concat_ws("\n", F.lit("Describe a source file."), F.concat(F.lit("Path: "), "path"), F.concat(F.lit("Lines: "), F.col("lines").cast("string")), F.concat(F.lit("Exports: "), F.array_join(exports, ", ")), F.lit("Reply with JSON: summary, purpose, gotchas.")).alias("prompt"))
    own = model.write_prose(asked, text_model, concurrency)
    parents = graph.parent_edges(docs.select("repo", "path"), graph.module_nodes(docs.select("repo", "path")))
    child = parents.join(own.select("repo", F.col("id").alias("src"), "summary"), ["repo", "src"]).groupBy("repo", F.col("dst").alias("id")).agg(F.array_sort(F.collect_list(F.concat_ws(": ", "src", "summary"))).alias("_c"))
    mods = child.select("repo", "id", F.concat_ws("\n", F.lit("Describe a directory of source files."), F.concat(F.lit("Path: "), "id"), F.lit("Exports: "), F.array_join("_c", "\n"), F.lit("Reply with JSON: summary, purpose, gotchas.")).alias("prompt"))
    return own.unionByName(model.write_prose(mods, text_model, concurrency))
