"""Nodes and edges of files, functions and modules, and the metrics on them.

Vertices are known by (repo, id): a file's id is its path, a function's is ``path:name``, a module's its
directory. Edges are rows (repo, src, edge_type, dst, ...); duplicates stay where they are counted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loregraph.functions.paths import basename, dirname, is_test_file, normalize
from loregraph.functions.text import days_between
from loregraph.session import cut


#: Lines of a block in which comments and functions are matched.
LINES = 64


def module_nodes(files: DataFrame, least: int = 3) -> DataFrame:
    """(repo, module, files) of the directories with an ``index.ts`` or at least ``least`` distinct files."""
    own = files.select("repo", "path").distinct().withColumn("module", dirname(F.col("path")))
    g = own.groupBy("repo", "module").agg(F.count(F.lit(1)).alias("files"), F.bool_or(basename(F.col("path")) == "index.ts").alias("_index"))
    return g.where(F.col("_index") | (F.col("files") >= least)).drop("_index")


def contains_edges(files: DataFrame, functions: DataFrame, modules: DataFrame) -> DataFrame:
    """Module to file by directory, file to exported function by path."""
    f = files.select("repo", "path").distinct()
    a = f.withColumn("module", dirname(F.col("path"))).join(modules.select("repo", "module"), ["repo", "module"]).select("repo", F.col("module").alias("src"), F.col("path").alias("dst"))
    g = functions.where("is_exported").select("repo", "path", "node_id").distinct()
    b = g.join(f, ["repo", "path"], "left_semi").select("repo", F.col("path").alias("src"), F.col("node_id").alias("dst"))
    return a.unionByName(b)


def parent_edges(files: DataFrame, modules: DataFrame) -> DataFrame:
    """(repo, src, dst): a file and the module it lies in, where that is a node."""
    f = files.select("repo", "path").distinct().withColumn("module", dirname(F.col("path")))
    return f.join(modules.select("repo", "module"), ["repo", "module"]).select("repo", F.col("path").alias("src"), F.col("module").alias("dst"))


def import_candidates(importer: Column, spec: Column, mode: str = "graph") -> Column:
    """Paths that a relative import may mean, in order of priority: with extension, as it stands, an index file.

    ``graph`` mode takes ``./`` and ``../`` only and joins to the importer's directory, which is empty for a root
    file, so that nothing matches there; ``calls`` mode normalises any specifier that starts with a dot.
    """
    if mode == "graph":
        ok = spec.startswith("./") | spec.startswith("../")
        base = F.when(importer.contains("/"), F.regexp_extract(importer, "^(.*)/[^/]*$", 1)).otherwise("")
        joined = F.when(importer.contains("/"), normalize(F.concat_ws("/", base, spec))).otherwise(F.concat(F.lit("/"), normalize(spec)))
    else:
        ok = spec.startswith(".")
        joined = normalize(F.concat_ws("/", dirname(importer), spec))
    bare = F.regexp_replace(joined, r"\.js$", "")
    return F.when(ok, F.array(F.concat(bare, F.lit(".ts")), joined, F.concat(bare, F.lit("/index.ts"))))


def resolve_imports(imports: DataFrame, files: DataFrame, mode: str = "graph") -> DataFrame:
    """``imports`` (repo, path, ord, spec, ...) with ``target``: the first candidate that is a file, by one equi-join."""
    each = imports.select("repo", "path", "ord", F.posexplode(import_candidates(F.col("path"), F.col("spec"), mode)).alias("_prio", "_cand"))
    hit = each.join(files.select("repo", F.col("path").alias("_cand")).distinct(), ["repo", "_cand"]).groupBy("repo", "path", "ord").agg(F.min_by("_cand", "_prio").alias("target"))
    return imports.join(hit, ["repo", "path", "ord"], "left")


def import_edges(imports: DataFrame, files: DataFrame) -> DataFrame:
    """One edge per import statement that resolves; repeated statements stay."""
    return resolve_imports(imports, files).where("target IS NOT NULL").select("repo", F.col("path").alias("src"), F.lit("imports").alias("edge_type"), F.col("target").alias("dst"))


def reverse_edges(edges: DataFrame) -> DataFrame:
    """(repo, src, dst) of ``importedBy``: each imported file and its importers, once, without itself."""
    return edges.where(F.col("src") != F.col("dst")).select("repo", F.col("dst").alias("src"), F.col("src").alias("dst")).distinct()


def test_file_edges(files: DataFrame) -> DataFrame:
    """(repo, src, dst): a source file and its test, by four patterns in order; at most one each."""
    f = files.select("repo", "path").distinct()
    src = f.where(~is_test_file(F.col("path")) & F.col("path").endswith(".ts"))
    stem = F.regexp_replace("path", r"\.ts$", "")
    nested = F.concat_ws("/", dirname(F.col("path")), F.lit("__tests__"), basename(stem))
    cands = F.array(F.concat(stem, F.lit(".test.ts")), F.concat(stem, F.lit(".spec.ts")), F.concat(nested, F.lit(".test.ts")), F.concat(nested, F.lit(".spec.ts")))
    each = src.select("repo", F.col("path").alias("src"), F.posexplode(cands).alias("_prio", "dst"))
    return each.join(f.withColumnRenamed("path", "dst"), ["repo", "dst"], "left_semi").groupBy("repo", "src").agg(F.min_by("dst", "_prio").alias("dst"))


def fan(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(repo, path, fan_in, fan_out): import edges into and out of each node, repeated ones counted, none as 0."""
    i = edges.groupBy("repo", F.col("dst").alias("path")).agg(F.count(F.lit(1)).alias("fan_in"))
    o = edges.groupBy("repo", F.col("src").alias("path")).agg(F.count(F.lit(1)).alias("fan_out"))
    return nodes.select("repo", "path").distinct().join(i, ["repo", "path"], "left").join(o, ["repo", "path"], "left").fillna(0, ["fan_in", "fan_out"])


def ages(nodes: DataFrame, now: str) -> DataFrame:
    """(repo, path, age_days, recency_days) against a given moment."""
    t = F.lit(now).cast("timestamp")
    return nodes.select("repo", "path", days_between(F.col("created_at"), t).alias("age_days"), days_between(F.col("last_modified"), t).alias("recency_days"))


def impact(edges: DataFrame, seeds: DataFrame, max_depth: int = 10) -> DataFrame:
    """(repo, node, depth): who depends on the seeds (repo, node), each at its least depth.

    Seeds with further columns, such as the request they belong to, are followed apart for each of these, and the
    columns are kept. Edges point from dependent to dependency. The frontier is joined with the edges, rid of what was visited,
    and goes on until it is empty; nodes at ``max_depth`` are reported but not followed. Seeds are left out,
    targets that are no nodes are in. Every round is a checkpoint in the shared folder.
    """
    back = cut(edges.where(F.col("src") != F.col("dst")).select("repo", F.col("dst").alias("node"), F.col("src").alias("next")).distinct())
    own = [c for c in seeds.columns if c != "node"]
    frontier = cut(seeds.select(*own, "node").distinct())
    seen = frontier.withColumn("depth", F.lit(0))
    for depth in range(1, max_depth + 1):
        step = frontier.join(back, ["repo", "node"]).select(*own, F.col("next").alias("node")).distinct()
        frontier = cut(step.join(seen, [*own, "node"], "left_anti"))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier.withColumn("depth", F.lit(depth)))
    return seen.where("depth > 0")


def tests_for(impacted: DataFrame, seeds: DataFrame, tests: DataFrame) -> DataFrame:
    """(repo, test) of the test files of the seeds and of all that depends on them, once; further columns of the seeds as in ``impact``."""
    own = [c for c in seeds.columns if c != "node"]
    nodes = impacted.select(*own, "node").unionByName(seeds.select(*own, "node")).distinct()
    return tests.join(nodes.withColumnRenamed("node", "src"), ["repo", "src"]).select(*own, F.col("dst").alias("test")).distinct()


def bundle(requested: DataFrame, edges: DataFrame, nodes: DataFrame, modules: DataFrame | None = None) -> DataFrame:
    """(repo, node, hop): the requested nodes and, one hop away, what they import, their module and their test.

    Recorded edges have no modules: these come out only with ``modules`` (repo, module). Further columns of
    ``requested`` as in ``impact``.
    """
    known = nodes.select("repo", F.col("path").alias("node"))
    if modules is not None:
        edges = edges.select("repo", "src", "edge_type", "dst").unionByName(parent_edges(nodes, modules).withColumn("edge_type", F.lit("parent")))
        known = known.unionByName(modules.select("repo", F.col("module").alias("node")))
    own = [c for c in requested.columns if c != "node"]
    out = edges.where(F.col("edge_type").isin("imports", "parent", "testFile")).join(requested.withColumnRenamed("node", "src").distinct(), ["repo", "src"])
    near = out.select(*own, F.col("dst").alias("node")).withColumn("hop", F.lit(1))
    both = requested.select(*own, "node").withColumn("hop", F.lit(0)).unionByName(near)
    return both.join(known.distinct(), ["repo", "node"], "left_semi").groupBy(*own, "node").agg(F.min("hop").alias("hop"))


def consumers(exported: DataFrame, calls: DataFrame) -> DataFrame:
    """(repo, node_id, production, tests) of each exported function: calling sites, apart for tests; 0 where none."""
    c = calls.select("repo", F.col("dst").alias("node_id"), is_test_file(F.substring_index("src", ":", 1)).alias("_test"))
    g = c.groupBy("repo", "node_id").agg(F.count_if(~F.col("_test")).alias("production"), F.count_if("_test").alias("tests"))
    return exported.select("repo", "node_id").distinct().join(g, ["repo", "node_id"], "left").fillna(0, ["production", "tests"])


def called_by(functions: DataFrame) -> DataFrame:
    """(repo, path, func_name, callers): the functions of the same file that call it, in alphabetical order."""
    f = functions.select("repo", "path", "func_name", "calls")
    calls = f.select("repo", "path", F.col("func_name").alias("caller"), F.explode("calls").alias("func_name"))
    return calls.join(f.select("repo", "path", "func_name").distinct(), ["repo", "path", "func_name"], "left_semi").groupBy("repo", "path", "func_name").agg(F.array_sort(F.collect_set("caller")).alias("callers"))


def follow_chain(symbols: DataFrame, hops: int = 5) -> DataFrame:
    """(repo, path, symbol_name, origin, hops): where a symbol comes from, through files that pass it on.

    ``symbols`` (repo, path, symbol_name, source_file) once per key; up to ``hops`` joins, and no further.
    """
    one = symbols.groupBy("repo", "path", "symbol_name").agg(F.min("source_file").alias("source_file"))
    step = one.select("repo", F.col("path").alias("origin"), "symbol_name", F.col("source_file").alias("_next"))
    out = one.select("repo", "path", "symbol_name", F.col("source_file").alias("origin"), F.lit(1).alias("hops"))
    for _ in range(hops - 1):
        out = out.join(step, ["repo", "origin", "symbol_name"], "left").select("repo", "path", "symbol_name", F.coalesce("_next", "origin").alias("origin"), (F.col("hops") + F.when(F.col("_next").isNotNull(), 1).otherwise(0)).alias("hops"))
    return out


def suffix_join(paths: DataFrame, files: DataFrame) -> DataFrame:
    """(repo, ref, path): a reference and the files that equal it or that it, or they, end with after a slash.

    Every tail of either side is matched with the whole of the other: two equi-joins instead of a nested loop.
    """
    from loregraph.functions.paths import suffixes, without_extension

    r = paths.select("repo", "ref", without_extension(F.col("ref")).alias("_r")).distinct()
    f = files.select("repo", "path", without_extension(F.col("path")).alias("_f")).distinct()
    a = r.join(f.select("repo", "path", F.explode(suffixes(F.col("_f"))).alias("_r")), ["repo", "_r"]).select("repo", "ref", "path")
    b = r.select("repo", "ref", F.explode(suffixes(F.col("_r"))).alias("_f")).join(f, ["repo", "_f"]).select("repo", "ref", "path")
    return a.unionByName(b).distinct()


def nearest_function(comments: DataFrame, functions: DataFrame) -> DataFrame:
    """Each comment (repo, path, line, ...) with the first function of its file whose lines hold it, or null.

    Functions are laid out over blocks of LINES lines, so that a comment meets those of its own block only.
    """
    block = lambda c: F.floor(F.col(c) / LINES)
    f = functions.select("repo", "path", "func_name", "start_line", "end_line").distinct()
    keys = ["repo", "path", "line"]
    c = comments.select(*keys).distinct()
    f = f.where("start_line <= end_line").withColumn("_block", F.explode(F.sequence(block("start_line"), block("end_line"))))
    hit = c.withColumn("_block", block("line")).join(f, ["repo", "path", "_block"]).where(F.col("line").between(F.col("start_line"), F.col("end_line"))).groupBy(*keys).agg(F.min_by("func_name", F.struct("start_line", "func_name")).alias("enclosing"))
    return comments.join(hit, keys, "left")


def used_symbols(symbols: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """(repo, source_file, path, symbols): what each dependent uses of a file, sorted; of ``names`` (repo, symbol_name) only, if given."""
    own = symbols if names is None else symbols.join(names.select("repo", "symbol_name").distinct(), ["repo", "symbol_name"], "left_semi")
    return own.groupBy("repo", "source_file", "path").agg(F.array_sort(F.collect_set("symbol_name")).alias("symbols"))


def affected(functions: DataFrame, imports: DataFrame) -> DataFrame:
    """(repo, src, func_name, dst, uses): functions of a dependent whose code names a function that the imported file exports.

    The code is what the table holds of it, which may be its head alone.
    """
    words = functions.select("repo", F.col("path").alias("src"), "func_name", F.explode(F.array_distinct(F.regexp_extract_all(F.coalesce("code_snippet", F.lit("")), F.lit(r"\w+"), F.lit(0)))).alias("uses"))
    exported = functions.where("is_exported").select("repo", F.col("path").alias("dst"), F.col("func_name").alias("uses")).distinct()
    return imports.select("repo", "src", "dst").distinct().join(exported, ["repo", "dst"]).join(words, ["repo", "src", "uses"]).select("repo", "src", "func_name", "dst", "uses").distinct()


def uses_exports(functions: DataFrame, imports: DataFrame) -> DataFrame:
    """(repo, src, dst): the import edges over which code of the dependent names an export."""
    return affected(functions, imports).select("repo", "src", "dst").distinct()


def first_per(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
