"""The extractor's operators on a small project of our own, with the rows that are expected.

The sources are the files of ``loregraph/samples/harbour`` and the log beside them. The SQL lists rows that the
extractor printed and that were then checked against the sources by reading. All files are read, whole.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loregraph import samples
from loregraph.functions.paths import usage_path
from loregraph.operators import graph, history, nodes, search
from loregraph.plans import pipeline
from loregraph.sources import files

HARBOUR = os.path.join(os.path.dirname(samples.__file__), "harbour")
LOG = HARBOUR + ".log"


def _docs(s: SparkSession) -> DataFrame:
    return pipeline.extract(s, HARBOUR, "harbour")


def _each(s: SparkSession, field: str) -> DataFrame:
    """The structs of one array of the documents, with their file."""
    return _docs(s).select("path", F.explode(field).alias("x")).select("path", "x.*")


def _functions(s: SparkSession) -> DataFrame:
    return _each(s, "functions")


def _joined(df: DataFrame, *arrays: str) -> DataFrame:
    """Arrays as text, so that their order is compared too."""
    return df.select(*[F.array_join(F.col(c).cast("array<string>"), ",").alias(c) if c in arrays else F.col(c) for c in df.columns])


def x_files(s, d):
    """The source files of a project: no declarations, no built ones; directories that start with an underscore are read too."""
    return files.find_files(s, HARBOUR).select("path", F.length("content").cast("long").alias("characters"))


def x_imports(s, d):
    return _joined(_each(s, "imports").withColumn("ord", F.col("ord").cast("long")), "names")


def x_exports(s, d):
    return _each(s, "exports").withColumn("ord", F.col("ord").cast("long"))


def x_functions(s, d):
    """Functions and methods."""
    f = _functions(s).select("path", "name", "owner", "signature", "is_async", "is_exported", "is_default_export", F.col("start_line").cast("long").alias("first"), F.col("end_line").cast("long").alias("last"), "calls")
    return _joined(f, "calls")


def x_types(s, d):
    """Classes with their methods and properties, interfaces with their properties."""
    c = _each(s, "classes").select("path", F.lit("class").alias("kind"), "name", F.array_join(F.concat("methods", "properties"), ",").alias("members"))
    return c.unionByName(_each(s, "interfaces").select("path", F.lit("interface").alias("kind"), "name", F.array_join("properties", ",").alias("members")))


def x_usages(s, d):
    return _joined(_each(s, "usages"), "lines")


def x_docs(s, d):
    p = F.array_join(F.transform("params", lambda x: F.concat_ws(" ", x["name"], x["description"])), "; ")
    return _each(s, "docs").select("path", "name", "description", p.alias("params"), "returns", F.array_join("throws", "; ").alias("throws"), "deprecated")


def x_comments(s, d):
    """Inline comments with the function they stand in, and markers."""
    c = _each(s, "comments").select("path", F.col("line").cast("long").alias("line"), F.lit("inline").alias("kind"), "text", "near_function")
    t = _each(s, "todos").select("path", F.col("line").cast("long").alias("line"), F.col("type").alias("kind"), "text", F.lit(None).cast("string").alias("near_function"))
    return c.unionByName(t)


def x_key_statements(s, d):
    return _functions(s).select("path", "name", F.explode("key_statements").alias("k")).select("path", "name", F.col("k.line").cast("long").alias("line"), "k.category", "k.text")


def x_error_paths(s, d):
    """Guards, early returns, throws and catches, with the status they stand for."""
    e = _functions(s).select("path", "name", F.explode("error_paths").alias("e"))
    return e.select("path", "name", F.col("e.line").cast("long").alias("line"), "e.type", "e.condition", "e.action", F.col("e.http_status").cast("long").alias("http_status"))


def x_patterns(s, d):
    return pipeline.patterns(_docs(s)).select("path", "pattern", "location")


def x_attached_patterns(s, d):
    """Files with their patterns in order, those without left out."""
    p = pipeline.with_patterns(_docs(s)).where("patterns IS NOT NULL")
    return p.select("path", F.array_join(F.transform("patterns", lambda x: x["pattern"]), ",").alias("patterns"))


def x_edges(s, d):
    """All five kinds of edges."""
    return pipeline.edges(_docs(s)).select("src", "edge_type", "dst")


def x_cross_calls(s, d):
    """Calls of imported functions, also through files that pass them on and under another name."""
    return pipeline.cross_calls(_docs(s)).select("src", "dst", "imported_as")


def x_calls_attached(s, d):
    """Each function with what it calls in other files, and what calls it from there."""
    return _joined(pipeline.with_cross_calls(_docs(s)).select("node_id", "calls", "called_by"), "calls", "called_by")


def x_symbol_map(s, d):
    """What each imported name is, and in which file."""
    return pipeline.symbol_map(_docs(s)).select("path", "local", "target", "symbol_name")


def x_usage_paths(s, d):
    """The path that each usage's specifier means beside its file; no file need be there."""
    return _each(s, "usages").select("path", "source", usage_path(F.col("path"), F.col("source")).alias("meant")).distinct()


def x_consumers(s, d):
    """Calls of each exported function from other files, production apart from tests; 0 where none."""
    docs = _docs(s)
    f = pipeline.functions(docs)
    return graph.consumers(f.where("is_exported"), pipeline.cross_calls(docs)).select("node_id", "production", "tests")


def x_fan(s, d):
    docs = _docs(s)
    return graph.fan(pipeline.edges(docs).where("edge_type = 'imports'"), docs).select("path", "fan_in", "fan_out")


def x_impact(s, d):
    """Who depends on ``src/types.ts`` and ``src/util/oil.ts``, each apart, and at what depth."""
    seeds = s.createDataFrame([("harbour", p, p) for p in ("src/types.ts", "src/util/oil.ts")], "repo string, seed string, node string")
    return graph.impact(pipeline.edges(_docs(s)).where("edge_type = 'imports'"), seeds).select("seed", "node", F.col("depth").cast("long").alias("depth"))


def x_used_symbols(s, d):
    """What each dependent uses of a file, by the path its import means."""
    docs = _docs(s)
    spec = docs.select("repo", "path", F.posexplode("usages").alias("ord", "u")).select("repo", "path", "ord", F.col("u.source").alias("spec"), F.col("u.symbol").alias("symbol_name"))
    own = graph.resolve_imports(spec, docs.select("repo", "path"), "calls").where("target IS NOT NULL").withColumnRenamed("target", "source_file")
    return _joined(graph.used_symbols(own).select("source_file", "path", "symbols"), "symbols")


def x_nodes(s, d):
    """Nodes of files, exported functions and modules, the last with their README."""
    docs = _docs(s)
    r = files.readmes(s, HARBOUR).withColumn("repo", F.lit("harbour"))
    n = nodes.file_nodes(docs, history.rollup(_log(s).withColumn("repo", F.lit("harbour"))), "2024-06-01 00:00:00").unionByName(nodes.function_nodes(pipeline.functions(docs))).unionByName(nodes.modules(docs, r))
    return n.select("type", "id", F.col("lines").cast("long").alias("lines"), "commits", F.array_join("authors", ",").alias("authors"), "test_command", F.regexp_extract("readme", r"^([^\n]*)", 1).alias("readme"))


def x_readmes(s, d):
    return files.readmes(s, HARBOUR).select("directory", F.regexp_extract("text", r"^([^\n]*)", 1).alias("title"))


def x_readme_choice(s, d):
    """The README that stands for the project: that of the module with the shortest path."""
    docs = _docs(s)
    r = files.readmes(s, HARBOUR).withColumn("repo", F.lit("harbour"))
    return nodes.readme_of(r, graph.module_nodes(docs)).select("directory", F.regexp_extract("text", r"^([^\n]*)", 1).alias("title"))


def x_expanded(s, d):
    """Which functions are shown whole."""
    docs = _docs(s)
    f = docs.select("repo", "path", F.explode("functions").alias("f")).select("repo", "path", F.col("f.name").alias("func_name"), "f.error_paths")
    fan = graph.fan(pipeline.edges(docs).where("edge_type = 'imports'"), docs)
    return nodes.expanded(f, fan, pipeline.patterns(docs)).select("path", "func_name", "expanded")


def x_configs(s, d):
    """Fields of the settings files that have the right type."""
    c = files.all_configs(HARBOUR)
    rows = [(kind, k, repr(v)) for kind, fields in c.items() for k, v in fields.items()]
    return s.createDataFrame(rows, "kind string, field string, value string")


def _log(s):
    log = files.follow_renames(files.git_log(s, LOG))
    return log.withColumn("commit_id", F.xxhash64("hash"))


def x_history(s, d):
    """Commits, dates and authors of each file, under its newest name."""
    r = history.rollup(_log(s).withColumn("repo", F.lit("harbour")))
    return r.select("path", "commit_count", F.date_format("created_at", "yyyy-MM-dd").alias("created"), F.date_format("last_modified", "yyyy-MM-dd").alias("modified"), F.array_join("authors", ",").alias("authors"))


def x_prose(s, d):
    """Text of files, then of modules from it, by the default model, which calls nothing."""
    return pipeline.prose(_docs(s)).select("id", "summary", "error")


def _warner(prompt: str) -> str:
    """A model that says the same three things of every file."""
    return '{"summary": "s", "purpose": "p", "gotchas": ["fill throws before refill runs", "litres rounds twice", "beware of the dog"]}'


def x_gotchas(s, d):
    """Gotchas of each file's text with what their identifiers are worth there."""
    docs = _docs(s).where("size(functions) > 0")
    text = pipeline.prose(docs, _warner).join(docs.select(F.col("path").alias("id")), "id", "left_semi")
    return _joined(pipeline.with_confidence(text, pipeline.functions(docs)).select("id", "confidence"), "confidence")


def x_index(s, d):
    """Entries of the keyword index that exported names and modules give."""
    docs = _docs(s)
    index = search.keyword_index(pipeline.functions(docs), graph.module_nodes(docs), pipeline.patterns(docs))
    return index.where("kind IN ('export', 'module', 'pattern', 'error')").select("kind", "token", "path")


def x_grep(s, d):
    return search.grep(pipeline.functions(_docs(s)), "lamp").select("path", "kind", "text").where("kind <> 'code'")


QUERIES = {n: f for n, f in list(globals().items()) if n.startswith("x_")}


def _cell(v) -> str:
    return "NULL" if v is None else str(v).upper() if isinstance(v, bool) else str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"


def _values(types: str, *rows: tuple) -> str:
    """SQL that lists rows; ``types``: name and type of each column."""
    cols = [c.split() for c in types.split(", ")]
    body = ",\n".join("(" + ", ".join(map(_cell, r)) + ")" for r in rows)
    return f"SELECT {', '.join(f'CAST({n} AS {t}) AS {n}' for n, t in cols)} FROM (VALUES {body}) t({', '.join(n for n, _ in cols)})"


# Printed by the extractor, then checked against the sources.
ORACLES = {
    "x_files": _values(
        "path VARCHAR, characters BIGINT",
        ('src/http/controller.ts', 755),
        ('src/index.ts', 145),
        ('src/lamps/__tests__/store.spec.ts', 139),
        ('src/lamps/service.test.ts', 106),
        ('src/lamps/service.ts', 1057),
        ('src/lamps/store.ts', 545),
        ('src/types.ts', 185),
        ('src/util/index.ts', 110),
        ('src/util/oil.ts', 203),
        ('src/util/retry.ts', 526),
    ),
    "x_imports": _values(
        "path VARCHAR, ord BIGINT, spec VARCHAR, names VARCHAR, default_name VARCHAR, namespace VARCHAR, type_only BOOLEAN",
        ('src/http/controller.ts', 0, '../lamps/service', 'fill,refill', 'lightUp', None, False),
        ('src/http/controller.ts', 1, '../util/retry', 'withRetry', None, None, False),
        ('src/http/controller.ts', 2, '../util', 'litres', None, None, False),
        ('src/http/controller.ts', 3, '../types', 'Keeper', None, None, True),
        ('src/http/controller.ts', 4, '../lamps/store', '', None, 'store', False),
        ('src/index.ts', 0, './lamps/service', 'fill', None, None, False),
        ('src/lamps/__tests__/store.spec.ts', 0, '../store', 'LampStore,getInstance', None, None, False),
        ('src/lamps/service.test.ts', 0, './service', 'fill', None, None, False),
        ('src/lamps/service.ts', 0, '../types', 'Lamp,LampId', None, None, True),
        ('src/lamps/service.ts', 1, '../util', 'half,litres', None, None, False),
        ('src/lamps/service.ts', 2, './store', 'LampStore', None, None, False),
        ('src/lamps/service.ts', 3, 'node:fs', '', 'fs', None, False),
        ('src/lamps/store.ts', 0, '../types', 'Lamp', None, None, True),
        ('src/util/index.ts', 0, './oil.js', 'litres,half', None, None, False),
    ),
    "x_exports": _values(
        "path VARCHAR, ord BIGINT, name VARCHAR, kind VARCHAR, reexport BOOLEAN",
        ('src/http/controller.ts', 0, 'postFill', 'function', False),
        ('src/http/controller.ts', 1, 'postRefill', 'function', False),
        ('src/http/controller.ts', 2, 'postLight', 'function', False),
        ('src/index.ts', 0, 'VERSION', 'const', False),
        ('src/index.ts', 1, 'fill', 'const', True),
        ('src/index.ts', 2, '*', 'star', True),
        ('src/lamps/__tests__/store.spec.ts', 0, 'makesAStore', 'function', False),
        ('src/lamps/service.test.ts', 0, 'fillsALamp', 'function', False),
        ('src/lamps/service.ts', 0, 'fill', 'function', False),
        ('src/lamps/service.ts', 1, 'refill', 'function', False),
        ('src/lamps/service.ts', 2, 'light', 'function', False),
        ('src/lamps/service.ts', 3, 'LIMIT', 'const', False),
        ('src/lamps/store.ts', 0, 'getInstance', 'function', False),
        ('src/lamps/store.ts', 1, 'LampStore', 'class', False),
        ('src/types.ts', 0, 'Lamp', 'interface', False),
        ('src/types.ts', 1, 'Keeper', 'interface', False),
        ('src/types.ts', 2, 'LampId', 'type', False),
        ('src/util/index.ts', 0, 'litres', 'const', True),
        ('src/util/index.ts', 1, 'half', 'const', True),
        ('src/util/index.ts', 2, '*', 'star', True),
        ('src/util/oil.ts', 0, 'litres', 'function', False),
        ('src/util/oil.ts', 1, 'half', 'function', False),
        ('src/util/retry.ts', 0, 'withRetry', 'function', False),
    ),
    "x_functions": _values(
        "path VARCHAR, name VARCHAR, owner VARCHAR, signature VARCHAR, is_async BOOLEAN, is_exported BOOLEAN, is_default_export BOOLEAN, first BIGINT, last BIGINT, calls VARCHAR",
        ('src/http/controller.ts', 'postFill', None, 'async function postFill(keeper: Keeper, id: string): Promise<number | null>', True, True, False, 7, 15, ''),
        ('src/http/controller.ts', 'postLight', None, 'function postLight(id: string): boolean', False, True, False, 23, 25, ''),
        ('src/http/controller.ts', 'postRefill', None, 'async function postRefill(id: string): Promise<unknown>', True, True, False, 17, 21, ''),
        ('src/lamps/__tests__/store.spec.ts', 'makesAStore', None, 'function makesAStore(): LampStore', False, True, False, 3, 5, ''),
        ('src/lamps/service.test.ts', 'fillsALamp', None, 'function fillsALamp(): boolean', False, True, False, 3, 5, ''),
        ('src/lamps/service.ts', 'fill', None, 'function fill(id: LampId, amount: number): number', False, True, False, 16, 23, ''),
        ('src/lamps/service.ts', 'light', None, 'function light(lamp: Lamp): boolean', False, True, True, 41, 43, 'refill'),
        ('src/lamps/service.ts', 'refill', None, 'function refill(id: LampId): number | null', False, True, False, 25, 34, 'status,fill'),
        ('src/lamps/service.ts', 'status', None, 'function status(id: LampId): number', False, False, False, 36, 39, ''),
        ('src/lamps/store.ts', 'clearCache', 'LampStore', 'clearCache(): void', False, False, False, 25, 27, ''),
        ('src/lamps/store.ts', 'getInstance', None, 'function getInstance(): LampStore', False, True, False, 30, 32, ''),
        ('src/lamps/store.ts', 'loadCache', 'LampStore', 'loadCache(): void', False, False, False, 21, 23, ''),
        ('src/lamps/store.ts', 'withRoom', 'LampStore', 'withRoom(room: string): this', False, False, False, 8, 10, ''),
        ('src/lamps/store.ts', 'withWick', 'LampStore', 'withWick(wick: number): this', False, False, False, 16, 19, ''),
        ('src/util/oil.ts', 'half', None, 'function half(n: number): number', False, True, False, 5, 7, ''),
        ('src/util/oil.ts', 'litres', None, 'function litres(n: number): number', False, True, False, 1, 3, 'round'),
        ('src/util/oil.ts', 'round', None, 'function round(n: number): number', False, False, False, 9, 11, ''),
        ('src/util/retry.ts', 'wait', None, 'function wait(ms: number): Promise<void>', False, False, False, 19, 21, ''),
        ('src/util/retry.ts', 'withRetry', None, 'async function withRetry(task: () => Promise<number>): Promise<number>', True, True, False, 7, 17, 'wait'),
    ),
    "x_types": _values(
        "path VARCHAR, kind VARCHAR, name VARCHAR, members VARCHAR",
        ('src/lamps/store.ts', 'class', 'LampStore', 'withRoom,withWick,loadCache,clearCache,cache'),
        ('src/types.ts', 'interface', 'Keeper', 'name'),
        ('src/types.ts', 'interface', 'Lamp', 'id,lit,oil'),
    ),
    "x_usages": _values(
        "path VARCHAR, symbol VARCHAR, source VARCHAR, lines VARCHAR, usage VARCHAR",
        ('src/http/controller.ts', 'Keeper', '../types', '7', 'type'),
        ('src/http/controller.ts', 'fill', '../lamps/service', '9', 'call'),
        ('src/http/controller.ts', 'lightUp', '../lamps/service', '24', 'call'),
        ('src/http/controller.ts', 'litres', '../util', '9', 'call'),
        ('src/http/controller.ts', 'refill', '../lamps/service', '18', 'call'),
        ('src/http/controller.ts', 'withRetry', '../util/retry', '18', 'call'),
        ('src/index.ts', 'fill', './lamps/service', '3', 'reference'),
        ('src/lamps/__tests__/store.spec.ts', 'LampStore', '../store', '3', 'reference'),
        ('src/lamps/__tests__/store.spec.ts', 'getInstance', '../store', '4', 'call'),
        ('src/lamps/service.test.ts', 'fill', './service', '4', 'call'),
        ('src/lamps/service.ts', 'Lamp', '../types', '41', 'type'),
        ('src/lamps/service.ts', 'LampId', '../types', '16,25,36', 'type'),
        ('src/lamps/service.ts', 'half', '../util', '21', 'call'),
        ('src/lamps/service.ts', 'litres', '../util', '22', 'call'),
        ('src/util/index.ts', 'half', './oil.js', '2', 'reference'),
        ('src/util/index.ts', 'litres', './oil.js', '2', 'reference'),
    ),
    "x_docs": _values(
        "path VARCHAR, name VARCHAR, description VARCHAR, params VARCHAR, returns VARCHAR, throws VARCHAR, deprecated VARCHAR",
        ('src/lamps/service.ts', 'fill', 'Fills a lamp.', 'id the lamp to fill; amount what to pour in, in litres', 'what it holds now', '', 'use refill'),
        ('src/lamps/store.ts', 'LampStore', 'Keeps lamps by their id.', '', None, '', None),
        ('src/lamps/store.ts', 'withRoom', 'Sets the room of the lamps.', '', None, '', None),
        ('src/lamps/store.ts', 'withWick', 'Sets the wick.', '', None, '', 'wicks are all alike'),
        ('src/util/retry.ts', 'withRetry', 'Runs a task again until it works.', 'task what to run', 'what the task gives', 'the last error', None),
    ),
    "x_comments": _values(
        "path VARCHAR, line BIGINT, kind VARCHAR, text VARCHAR, near_function VARCHAR",
        ('src/lamps/service.ts', 20, 'TODO', 'check the "{ gauge"', None),
        ('src/lamps/service.ts', 20, 'inline', 'TODO: check the "{ gauge"', 'fill'),
        ('src/lamps/service.ts', 21, 'inline', 'half is lost', 'fill'),
        ('src/lamps/service.ts', 33, 'inline', 'see http://lamps.example/limit', 'refill'),
        ('src/lamps/service.ts', 37, 'FIXME', 'measure it', None),
    ),
    "x_key_statements": _values(
        "path VARCHAR, name VARCHAR, line BIGINT, category VARCHAR, text VARCHAR",
        ('src/http/controller.ts', 'postRefill', 18, 'async-pattern', 'const all = await Promise.all([refill(id), withRetry(async () => 1)]);'),
        ('src/http/controller.ts', 'postRefill', 19, 'url', "const url = 'https://harbour.example/lamps';"),
        ('src/lamps/service.ts', 'refill', 26, 'config', 'const timeout = 30;'),
        ('src/lamps/service.ts', 'refill', 27, 'condition', 'if (status(id) === 503) return null;'),
        ('src/lamps/service.ts', 'refill', 30, 'error', '} catch (err) {'),
        ('src/util/retry.ts', 'withRetry', 8, 'config', 'const maxRetries = 4;'),
        ('src/util/retry.ts', 'withRetry', 9, 'config', 'for (let i = 0; i < maxRetries; i++) {'),
        ('src/util/retry.ts', 'withRetry', 11, 'async-pattern', '[sequential] await task()'),
        ('src/util/retry.ts', 'withRetry', 12, 'error', '} catch (err) {'),
        ('src/util/retry.ts', 'withRetry', 13, 'math', 'await wait(100 * Math.pow(2, i));'),
    ),
    "x_error_paths": _values(
        "path VARCHAR, name VARCHAR, line BIGINT, type VARCHAR, condition VARCHAR, action VARCHAR, http_status BIGINT",
        ('src/http/controller.ts', 'postFill', 8, 'early-return', '!keeper.name', 'return null', None),
        ('src/http/controller.ts', 'postFill', 8, 'guard', '!keeper.name', 'return null', None),
        ('src/http/controller.ts', 'postFill', 12, 'early-return', 'case 0', 'return null', None),
        ('src/lamps/service.ts', 'fill', 17, 'guard', '!id', "throw new Error('lamp not found')", 404),
        ('src/lamps/service.ts', 'fill', 18, 'throw', '!id', "throw new Error('lamp not found')", 404),
        ('src/lamps/service.ts', 'refill', 27, 'early-return', 'status(id) === 503', 'return null', 503),
        ('src/lamps/service.ts', 'refill', 27, 'guard', 'status(id) === 503', 'return null', 503),
        ('src/lamps/service.ts', 'refill', 30, 'catch', 'catch (err)', 'logs', None),
        ('src/lamps/store.ts', 'withWick', 17, 'early-return', 'wick < 0', 'return this', None),
        ('src/lamps/store.ts', 'withWick', 17, 'guard', 'wick < 0', 'return this', None),
        ('src/util/retry.ts', 'withRetry', 12, 'catch', 'catch (err)', 'handles', None),
        ('src/util/retry.ts', 'withRetry', 16, 'throw', None, "throw new Error('too many requests')", 429),
    ),
    "x_patterns": _values(
        "path VARCHAR, pattern VARCHAR, location VARCHAR",
        ('src/lamps/store.ts', 'builder', 'src/lamps/store.ts:LampStore'),
        ('src/lamps/store.ts', 'singleton', 'src/lamps/store.ts'),
        ('src/util/retry.ts', 'retry', 'src/util/retry.ts:withRetry'),
    ),
    "x_attached_patterns": _values(
        "path VARCHAR, patterns VARCHAR",
        ('src/lamps/store.ts', 'builder,singleton'),
        ('src/util/retry.ts', 'retry'),
    ),
    "x_edges": _values(
        "src VARCHAR, edge_type VARCHAR, dst VARCHAR",
        ('src', 'contains', 'src/index.ts'),
        ('src', 'contains', 'src/types.ts'),
        ('src/http/controller.ts', 'contains', 'src/http/controller.ts:postFill'),
        ('src/http/controller.ts', 'contains', 'src/http/controller.ts:postLight'),
        ('src/http/controller.ts', 'contains', 'src/http/controller.ts:postRefill'),
        ('src/http/controller.ts', 'imports', 'src/lamps/service.ts'),
        ('src/http/controller.ts', 'imports', 'src/lamps/store.ts'),
        ('src/http/controller.ts', 'imports', 'src/types.ts'),
        ('src/http/controller.ts', 'imports', 'src/util/index.ts'),
        ('src/http/controller.ts', 'imports', 'src/util/retry.ts'),
        ('src/index.ts', 'imports', 'src/lamps/service.ts'),
        ('src/index.ts', 'parent', 'src'),
        ('src/lamps', 'contains', 'src/lamps/service.test.ts'),
        ('src/lamps', 'contains', 'src/lamps/service.ts'),
        ('src/lamps', 'contains', 'src/lamps/store.ts'),
        ('src/lamps/__tests__/store.spec.ts', 'contains', 'src/lamps/__tests__/store.spec.ts:makesAStore'),
        ('src/lamps/__tests__/store.spec.ts', 'imports', 'src/lamps/store.ts'),
        ('src/lamps/service.test.ts', 'contains', 'src/lamps/service.test.ts:fillsALamp'),
        ('src/lamps/service.test.ts', 'imports', 'src/lamps/service.ts'),
        ('src/lamps/service.test.ts', 'parent', 'src/lamps'),
        ('src/lamps/service.ts', 'contains', 'src/lamps/service.ts:fill'),
        ('src/lamps/service.ts', 'contains', 'src/lamps/service.ts:light'),
        ('src/lamps/service.ts', 'contains', 'src/lamps/service.ts:refill'),
        ('src/lamps/service.ts', 'importedBy', 'src/http/controller.ts'),
        ('src/lamps/service.ts', 'importedBy', 'src/index.ts'),
        ('src/lamps/service.ts', 'importedBy', 'src/lamps/service.test.ts'),
        ('src/lamps/service.ts', 'imports', 'src/lamps/store.ts'),
        ('src/lamps/service.ts', 'imports', 'src/types.ts'),
        ('src/lamps/service.ts', 'imports', 'src/util/index.ts'),
        ('src/lamps/service.ts', 'parent', 'src/lamps'),
        ('src/lamps/service.ts', 'testFile', 'src/lamps/service.test.ts'),
        ('src/lamps/store.ts', 'contains', 'src/lamps/store.ts:getInstance'),
        ('src/lamps/store.ts', 'importedBy', 'src/http/controller.ts'),
        ('src/lamps/store.ts', 'importedBy', 'src/lamps/__tests__/store.spec.ts'),
        ('src/lamps/store.ts', 'importedBy', 'src/lamps/service.ts'),
        ('src/lamps/store.ts', 'imports', 'src/types.ts'),
        ('src/lamps/store.ts', 'parent', 'src/lamps'),
        ('src/lamps/store.ts', 'testFile', 'src/lamps/__tests__/store.spec.ts'),
        ('src/types.ts', 'importedBy', 'src/http/controller.ts'),
        ('src/types.ts', 'importedBy', 'src/lamps/service.ts'),
        ('src/types.ts', 'importedBy', 'src/lamps/store.ts'),
        ('src/types.ts', 'parent', 'src'),
        ('src/util', 'contains', 'src/util/index.ts'),
        ('src/util', 'contains', 'src/util/oil.ts'),
        ('src/util', 'contains', 'src/util/retry.ts'),
        ('src/util/index.ts', 'importedBy', 'src/http/controller.ts'),
        ('src/util/index.ts', 'importedBy', 'src/lamps/service.ts'),
        ('src/util/index.ts', 'imports', 'src/util/oil.ts'),
        ('src/util/index.ts', 'parent', 'src/util'),
        ('src/util/oil.ts', 'contains', 'src/util/oil.ts:half'),
        ('src/util/oil.ts', 'contains', 'src/util/oil.ts:litres'),
        ('src/util/oil.ts', 'importedBy', 'src/util/index.ts'),
        ('src/util/oil.ts', 'parent', 'src/util'),
        ('src/util/retry.ts', 'contains', 'src/util/retry.ts:withRetry'),
        ('src/util/retry.ts', 'importedBy', 'src/http/controller.ts'),
        ('src/util/retry.ts', 'parent', 'src/util'),
    ),
    "x_cross_calls": _values(
        "src VARCHAR, dst VARCHAR, imported_as VARCHAR",
        ('src/http/controller.ts:postFill', 'src/lamps/service.ts:fill', None),
        ('src/http/controller.ts:postFill', 'src/util/oil.ts:litres', None),
        ('src/http/controller.ts:postLight', 'src/lamps/service.ts:light', 'lightUp'),
        ('src/http/controller.ts:postRefill', 'src/lamps/service.ts:refill', None),
        ('src/http/controller.ts:postRefill', 'src/util/retry.ts:withRetry', None),
        ('src/lamps/__tests__/store.spec.ts:makesAStore', 'src/lamps/store.ts:getInstance', None),
        ('src/lamps/service.test.ts:fillsALamp', 'src/lamps/service.ts:fill', None),
        ('src/lamps/service.ts:fill', 'src/util/oil.ts:half', None),
        ('src/lamps/service.ts:fill', 'src/util/oil.ts:litres', None),
    ),
    "x_calls_attached": _values(
        "node_id VARCHAR, calls VARCHAR, called_by VARCHAR",
        ('src/http/controller.ts:postFill', 'src/lamps/service.ts:fill,src/util/oil.ts:litres', None),
        ('src/http/controller.ts:postLight', 'src/lamps/service.ts:light', None),
        ('src/http/controller.ts:postRefill', 'src/lamps/service.ts:refill,src/util/retry.ts:withRetry', None),
        ('src/lamps/__tests__/store.spec.ts:makesAStore', 'src/lamps/store.ts:getInstance', None),
        ('src/lamps/service.test.ts:fillsALamp', 'src/lamps/service.ts:fill', None),
        ('src/lamps/service.ts:fill', 'src/util/oil.ts:half,src/util/oil.ts:litres', 'src/http/controller.ts:postFill,src/lamps/service.test.ts:fillsALamp'),
        ('src/lamps/service.ts:light', None, 'src/http/controller.ts:postLight'),
        ('src/lamps/service.ts:refill', None, 'src/http/controller.ts:postRefill'),
        ('src/lamps/store.ts:getInstance', None, 'src/lamps/__tests__/store.spec.ts:makesAStore'),
        ('src/util/oil.ts:half', None, 'src/lamps/service.ts:fill'),
        ('src/util/oil.ts:litres', None, 'src/http/controller.ts:postFill,src/lamps/service.ts:fill'),
        ('src/util/retry.ts:withRetry', None, 'src/http/controller.ts:postRefill'),
    ),
    "x_symbol_map": _values(
        "path VARCHAR, local VARCHAR, target VARCHAR, symbol_name VARCHAR",
        ('src/http/controller.ts', 'fill', 'src/lamps/service.ts', 'fill'),
        ('src/http/controller.ts', 'lightUp', 'src/lamps/service.ts', 'default'),
        ('src/http/controller.ts', 'litres', 'src/util/oil.ts', 'litres'),
        ('src/http/controller.ts', 'refill', 'src/lamps/service.ts', 'refill'),
        ('src/http/controller.ts', 'withRetry', 'src/util/retry.ts', 'withRetry'),
        ('src/index.ts', 'fill', 'src/lamps/service.ts', 'fill'),
        ('src/lamps/__tests__/store.spec.ts', 'LampStore', 'src/lamps/store.ts', 'LampStore'),
        ('src/lamps/__tests__/store.spec.ts', 'getInstance', 'src/lamps/store.ts', 'getInstance'),
        ('src/lamps/service.test.ts', 'fill', 'src/lamps/service.ts', 'fill'),
        ('src/lamps/service.ts', 'LampStore', 'src/lamps/store.ts', 'LampStore'),
        ('src/lamps/service.ts', 'half', 'src/util/oil.ts', 'half'),
        ('src/lamps/service.ts', 'litres', 'src/util/oil.ts', 'litres'),
        ('src/util/index.ts', 'half', 'src/util/oil.ts', 'half'),
        ('src/util/index.ts', 'litres', 'src/util/oil.ts', 'litres'),
    ),
    "x_usage_paths": _values(
        "path VARCHAR, source VARCHAR, meant VARCHAR",
        ('src/http/controller.ts', '../lamps/service', 'src/lamps/service'),
        ('src/http/controller.ts', '../types', 'src/types'),
        ('src/http/controller.ts', '../util', 'src/util'),
        ('src/http/controller.ts', '../util/retry', 'src/util/retry'),
        ('src/index.ts', './lamps/service', 'src/lamps/service'),
        ('src/lamps/__tests__/store.spec.ts', '../store', 'src/lamps/store'),
        ('src/lamps/service.test.ts', './service', 'src/lamps/service'),
        ('src/lamps/service.ts', '../types', 'src/types'),
        ('src/lamps/service.ts', '../util', 'src/util'),
        ('src/util/index.ts', './oil.js', 'src/util/oil.js'),
    ),
    "x_consumers": _values(
        "node_id VARCHAR, production BIGINT, tests BIGINT",
        ('src/http/controller.ts:postFill', 0, 0),
        ('src/http/controller.ts:postLight', 0, 0),
        ('src/http/controller.ts:postRefill', 0, 0),
        ('src/lamps/__tests__/store.spec.ts:makesAStore', 0, 0),
        ('src/lamps/service.test.ts:fillsALamp', 0, 0),
        ('src/lamps/service.ts:fill', 1, 1),
        ('src/lamps/service.ts:light', 1, 0),
        ('src/lamps/service.ts:refill', 1, 0),
        ('src/lamps/store.ts:getInstance', 0, 1),
        ('src/util/oil.ts:half', 1, 0),
        ('src/util/oil.ts:litres', 2, 0),
        ('src/util/retry.ts:withRetry', 1, 0),
    ),
    "x_fan": _values(
        "path VARCHAR, fan_in BIGINT, fan_out BIGINT",
        ('src/http/controller.ts', 0, 5),
        ('src/index.ts', 0, 1),
        ('src/lamps/__tests__/store.spec.ts', 0, 1),
        ('src/lamps/service.test.ts', 0, 1),
        ('src/lamps/service.ts', 3, 3),
        ('src/lamps/store.ts', 3, 1),
        ('src/types.ts', 3, 0),
        ('src/util/index.ts', 2, 1),
        ('src/util/oil.ts', 1, 0),
        ('src/util/retry.ts', 1, 0),
    ),
    "x_impact": _values(
        "seed VARCHAR, node VARCHAR, depth BIGINT",
        ('src/types.ts', 'src/http/controller.ts', 1),
        ('src/types.ts', 'src/index.ts', 2),
        ('src/types.ts', 'src/lamps/__tests__/store.spec.ts', 2),
        ('src/types.ts', 'src/lamps/service.test.ts', 2),
        ('src/types.ts', 'src/lamps/service.ts', 1),
        ('src/types.ts', 'src/lamps/store.ts', 1),
        ('src/util/oil.ts', 'src/http/controller.ts', 2),
        ('src/util/oil.ts', 'src/index.ts', 3),
        ('src/util/oil.ts', 'src/lamps/service.test.ts', 3),
        ('src/util/oil.ts', 'src/lamps/service.ts', 2),
        ('src/util/oil.ts', 'src/util/index.ts', 1),
    ),
    "x_used_symbols": _values(
        "source_file VARCHAR, path VARCHAR, symbols VARCHAR",
        ('src/lamps/service.ts', 'src/http/controller.ts', 'fill,lightUp,refill'),
        ('src/lamps/service.ts', 'src/index.ts', 'fill'),
        ('src/lamps/service.ts', 'src/lamps/service.test.ts', 'fill'),
        ('src/lamps/store.ts', 'src/lamps/__tests__/store.spec.ts', 'LampStore,getInstance'),
        ('src/types.ts', 'src/http/controller.ts', 'Keeper'),
        ('src/types.ts', 'src/lamps/service.ts', 'Lamp,LampId'),
        ('src/util/index.ts', 'src/http/controller.ts', 'litres'),
        ('src/util/index.ts', 'src/lamps/service.ts', 'half,litres'),
        ('src/util/oil.ts', 'src/util/index.ts', 'half,litres'),
        ('src/util/retry.ts', 'src/http/controller.ts', 'withRetry'),
    ),
    "x_nodes": _values(
        "type VARCHAR, id VARCHAR, lines BIGINT, commits BIGINT, authors VARCHAR, test_command VARCHAR, readme VARCHAR",
        ('file', 'src/http/controller.ts', 26, 0, '', None, None),
        ('file', 'src/index.ts', 5, 0, '', None, None),
        ('file', 'src/lamps/__tests__/store.spec.ts', 6, 0, '', 'npm test -- src/lamps/__tests__/store.spec.ts', None),
        ('file', 'src/lamps/service.test.ts', 6, 0, '', 'npm test -- src/lamps/service.test.ts', None),
        ('file', 'src/lamps/service.ts', 46, 3, 'ada@harbour.example,ben@harbour.example', None, None),
        ('file', 'src/lamps/store.ts', 33, 0, '', None, None),
        ('file', 'src/types.ts', 13, 1, 'ada@harbour.example', None, None),
        ('file', 'src/util/index.ts', 4, 0, '', None, None),
        ('file', 'src/util/oil.ts', 12, 4, 'ada@harbour.example,ben@harbour.example,cyd@harbour.example', None, None),
        ('file', 'src/util/retry.ts', 22, 0, '', None, None),
        ('function', 'src/http/controller.ts:postFill', 9, None, None, None, None),
        ('function', 'src/http/controller.ts:postLight', 3, None, None, None, None),
        ('function', 'src/http/controller.ts:postRefill', 5, None, None, None, None),
        ('function', 'src/lamps/__tests__/store.spec.ts:makesAStore', 3, None, None, None, None),
        ('function', 'src/lamps/service.test.ts:fillsALamp', 3, None, None, None, None),
        ('function', 'src/lamps/service.ts:fill', 8, None, None, None, None),
        ('function', 'src/lamps/service.ts:light', 3, None, None, None, None),
        ('function', 'src/lamps/service.ts:refill', 10, None, None, None, None),
        ('function', 'src/lamps/store.ts:getInstance', 3, None, None, None, None),
        ('function', 'src/util/oil.ts:half', 3, None, None, None, None),
        ('function', 'src/util/oil.ts:litres', 3, None, None, None, None),
        ('function', 'src/util/retry.ts:withRetry', 11, None, None, None, None),
        ('module', 'src', 0, 0, '', None, None),
        ('module', 'src/lamps', 0, 0, '', None, '# Lamps'),
        ('module', 'src/util', 0, 0, '', None, None),
    ),
    "x_readmes": _values(
        "directory VARCHAR, title VARCHAR",
        ('.', '# Harbour'),
        ('src/lamps', '# Lamps'),
    ),
    "x_readme_choice": _values(
        "directory VARCHAR, title VARCHAR",
        ('src/lamps', '# Lamps'),
    ),
    "x_expanded": _values(
        "path VARCHAR, func_name VARCHAR, expanded BOOLEAN",
        ('src/http/controller.ts', 'postFill', True),
        ('src/http/controller.ts', 'postLight', True),
        ('src/http/controller.ts', 'postRefill', True),
        ('src/lamps/__tests__/store.spec.ts', 'makesAStore', True),
        ('src/lamps/service.test.ts', 'fillsALamp', True),
        ('src/lamps/service.ts', 'fill', True),
        ('src/lamps/service.ts', 'light', True),
        ('src/lamps/service.ts', 'refill', True),
        ('src/lamps/service.ts', 'status', True),
        ('src/lamps/store.ts', 'clearCache', False),
        ('src/lamps/store.ts', 'getInstance', False),
        ('src/lamps/store.ts', 'loadCache', False),
        ('src/lamps/store.ts', 'withRoom', False),
        ('src/lamps/store.ts', 'withWick', True),
        ('src/util/oil.ts', 'half', True),
        ('src/util/oil.ts', 'litres', True),
        ('src/util/oil.ts', 'round', True),
        ('src/util/retry.ts', 'wait', True),
        ('src/util/retry.ts', 'withRetry', True),
    ),
    "x_configs": _values(
        "kind VARCHAR, field VARCHAR, value VARCHAR",
        ('compiler', 'compilerOptions', "{'strict': True}"),
        ('compiler', 'include', "['src']"),
        ('package', 'devDependencies', "{'typescript': '^5'}"),
        ('package', 'name', "'harbour'"),
        ('package', 'scripts', "{'build': 'tsc'}"),
        ('package', 'version', "'1.0.0'"),
        ('tool', 'extraction', "{'include': ['**/*.ts']}"),
        ('tool', 'output', "{'directory': 'out'}"),
    ),
    "x_history": _values(
        "path VARCHAR, commit_count BIGINT, created VARCHAR, modified VARCHAR, authors VARCHAR",
        ('src/lamps/service.ts', 3, '2024-01-01', '2024-05-05', 'ada@harbour.example,ben@harbour.example'),
        ('src/types.ts', 1, '2024-03-03', '2024-03-03', 'ada@harbour.example'),
        ('src/util/oil.ts', 4, '2024-01-01', '2024-05-05', 'ada@harbour.example,ben@harbour.example,cyd@harbour.example'),
    ),
    "x_prose": _values(
        "id VARCHAR, summary VARCHAR, error VARCHAR",
        ('src', 'src provides internal code.', None),
        ('src/http/controller.ts', 'src/http/controller.ts provides postFill, postRefill, postLight.', None),
        ('src/index.ts', 'src/index.ts provides VERSION, fill, *.', None),
        ('src/lamps', 'src/lamps provides internal code.', None),
        ('src/lamps/__tests__/store.spec.ts', 'src/lamps/__tests__/store.spec.ts provides makesAStore.', None),
        ('src/lamps/service.test.ts', 'src/lamps/service.test.ts provides fillsALamp.', None),
        ('src/lamps/service.ts', 'src/lamps/service.ts provides fill, refill, light, LIMIT.', None),
        ('src/lamps/store.ts', 'src/lamps/store.ts provides getInstance, LampStore.', None),
        ('src/types.ts', 'src/types.ts provides Lamp, Keeper, LampId.', None),
        ('src/util', 'src/util provides internal code.', None),
        ('src/util/index.ts', 'src/util/index.ts provides litres, half, *.', None),
        ('src/util/oil.ts', 'src/util/oil.ts provides litres, half.', None),
        ('src/util/retry.ts', 'src/util/retry.ts provides withRetry.', None),
    ),
    "x_gotchas": _values(
        "id VARCHAR, confidence VARCHAR",
        ('src/http/controller.ts', 'low,low,low'),
        ('src/lamps/__tests__/store.spec.ts', 'low,low,low'),
        ('src/lamps/service.test.ts', 'low,low,low'),
        ('src/lamps/service.ts', 'medium,low,low'),
        ('src/lamps/store.ts', 'low,low,low'),
        ('src/util/oil.ts', 'low,medium,low'),
        ('src/util/retry.ts', 'low,low,low'),
    ),
    "x_index": _values(
        "kind VARCHAR, token VARCHAR, path VARCHAR",
        ('error', '503', 'src/lamps/service.ts'),
        ('export', 'fill', 'src/http/controller.ts'),
        ('export', 'fill', 'src/lamps/service.ts'),
        ('export', 'fills', 'src/lamps/service.test.ts'),
        ('export', 'fillsalamp', 'src/lamps/service.test.ts'),
        ('export', 'get', 'src/lamps/store.ts'),
        ('export', 'getinstance', 'src/lamps/store.ts'),
        ('export', 'half', 'src/util/oil.ts'),
        ('export', 'instance', 'src/lamps/store.ts'),
        ('export', 'lamp', 'src/lamps/service.test.ts'),
        ('export', 'light', 'src/http/controller.ts'),
        ('export', 'light', 'src/lamps/service.ts'),
        ('export', 'litres', 'src/util/oil.ts'),
        ('export', 'makes', 'src/lamps/__tests__/store.spec.ts'),
        ('export', 'makesastore', 'src/lamps/__tests__/store.spec.ts'),
        ('export', 'post', 'src/http/controller.ts'),
        ('export', 'postfill', 'src/http/controller.ts'),
        ('export', 'postlight', 'src/http/controller.ts'),
        ('export', 'postrefill', 'src/http/controller.ts'),
        ('export', 'refill', 'src/http/controller.ts'),
        ('export', 'refill', 'src/lamps/service.ts'),
        ('export', 'retry', 'src/util/retry.ts'),
        ('export', 'store', 'src/lamps/__tests__/store.spec.ts'),
        ('export', 'with', 'src/util/retry.ts'),
        ('export', 'withretry', 'src/util/retry.ts'),
        ('module', 'lamps', 'src/lamps'),
        ('module', 'src', 'src'),
        ('module', 'util', 'src/util'),
        ('pattern', 'builder', 'src/lamps/store.ts'),
        ('pattern', 'retry', 'src/util/retry.ts'),
        ('pattern', 'singleton', 'src/lamps/store.ts'),
    ),
    "x_grep": _values(
        "path VARCHAR, kind VARCHAR, text VARCHAR",
        ('src/http/controller.ts', 'keyStatement', "const url = 'https://harbour.example/lamps';"),
        ('src/lamps/__tests__/store.spec.ts', 'signature', 'function makesAStore(): LampStore'),
        ('src/lamps/service.test.ts', 'export', 'fillsALamp'),
        ('src/lamps/service.test.ts', 'function', 'fillsALamp'),
        ('src/lamps/service.test.ts', 'signature', 'function fillsALamp(): boolean'),
        ('src/lamps/service.ts', 'signature', 'function fill(id: LampId, amount: number): number'),
        ('src/lamps/service.ts', 'signature', 'function light(lamp: Lamp): boolean'),
        ('src/lamps/service.ts', 'signature', 'function refill(id: LampId): number | null'),
        ('src/lamps/service.ts', 'signature', 'function status(id: LampId): number'),
        ('src/lamps/store.ts', 'signature', 'function getInstance(): LampStore'),
    ),
}
