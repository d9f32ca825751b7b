"""Keyword index, weighted pre-filter, fuzzy paths, regular-expression search and overview."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loregraph.functions.paths import basename, confidence, dirname, full_parts, lower_parts, parts_similarity, segment_score
from loregraph.functions.text import camel_parts, http_status, query_tokens, statement_keywords, summary_words
from loregraph.session import cut

#: Weight of a hit by the kind of entry.
WEIGHTS = {"export": 10, "pattern": 8, "error": 7, "keyStatement": 5, "summary": 3, "module": 2}
CANDIDATES, HIGH_FAN_IN, BONUS_FILES = 25, 5, 5
AUTO, SUGGEST = 0.7, 0.4
MAX_PATTERN = 200
#: Paths and queries of a block, where there are many queries: a task scores one block of each against the other.
PATHS, QUERIES = 500, 1000
#: Queries that are broadcast at most.
FEW = 200
#: Folders of a kept index.
BUCKETS = 64
# Names of configuration files.
CONFIG_FILES = ["package.json", "tsconfig.json", ".env", ".env.example", "jest.config.js", "jest.config.ts", "vitest.config.ts", "vitest.config.js", "eslint.config.js", ".eslintrc.json", ".eslintrc.js", "prettier.config.js", ".prettierrc", ".prettierrc.json", "tsup.config.ts", "tsup.config.js", "vite.config.ts", "vite.config.js", "webpack.config.js", "rollup.config.js", "babel.config.js", ".babelrc"]


def tokens_of(spark: SparkSession, question: str) -> list[str]:
    """A question's tokens, by the same expression that the index is looked up with."""
    return spark.range(1, numPartitions=1).select(query_tokens(F.lit(question)).alias("t")).first().t


def keyword_index(functions: DataFrame, modules: DataFrame, patterns: DataFrame | None = None, prose: DataFrame | None = None, question: str | None = None) -> DataFrame:
    """(kind, token, repo, path), each once: exported names with their parts, key statements, error statuses, modules, patterns and summaries.

    With a ``question`` only the entries of its tokens, filtered where they arise, before anything is shuffled.
    """
    asked = None if question is None else tokens_of(functions.sparkSession, question)
    wanted = (lambda t: F.lit(True)) if asked is None else (lambda t: F.lower(t).isin(asked))
    entry = lambda kind: lambda token: F.struct(F.lit(kind).alias("kind"), F.lower(token).alias("token"))
    none = F.expr("array()").cast("array<struct<kind:string,token:string>>")
    names = F.when(F.col("is_exported"), F.transform(F.concat(F.array("func_name"), F.filter(camel_parts(F.col("func_name")), lambda p: F.length(p) > 2)), entry("export"))).otherwise(none)
    keys = F.flatten(F.transform("key_statements", lambda s: F.transform(statement_keywords(s["text"]), entry("keyStatement"))))
    status = F.transform(F.filter("key_statements", lambda s: s["category"].isin("error", "condition")), lambda s: http_status(s["text"], F.lit("")).cast("string"))
    errors = F.transform(F.array_compact(status), entry("error"))
    every = F.array_distinct(F.concat(names, F.coalesce(keys, none), F.coalesce(errors, none)))
    every = every if asked is None else F.filter(every, lambda e: wanted(e["token"]))
    out = functions.select("repo", "path", F.explode(every).alias("e")).select("repo", "path", "e.token", "e.kind")
    out = out.unionByName(modules.select("repo", F.col("module").alias("path"), basename(F.col("module")).alias("token")).withColumn("kind", F.lit("module")))
    if patterns is not None:
        out = out.unionByName(patterns.select("repo", "path", F.col("pattern").alias("token")).withColumn("kind", F.lit("pattern")))
    if prose is not None:
        out = out.unionByName(prose.select("repo", "path", F.explode(summary_words(F.col("summary"))).alias("token")).withColumn("kind", F.lit("summary")))
    return out.where(wanted(F.col("token"))).select("kind", F.lower("token").alias("token"), "repo", "path").distinct()


def write_index(index: DataFrame, folder: str, buckets: int = BUCKETS) -> None:
    """Keep an index as a table in ``buckets`` folders by token, sorted by it: a question reads its tokens' folders only."""
    bucket = F.pmod(F.xxhash64("token"), F.lit(buckets)).cast("int")
    index.withColumn("bucket", bucket).repartition("bucket").sortWithinPartitions("bucket", "token").write.mode("overwrite").partitionBy("bucket").parquet(folder)


def read_index(spark: SparkSession, folder: str, question: str, buckets: int = BUCKETS) -> DataFrame:
    """The entries of a question's tokens in an index kept by ``write_index``: folders are pruned by bucket, row groups by token."""
    tokens = tokens_of(spark, question)
    bucket = spark.createDataFrame([(t,) for t in tokens], "token string").select(F.pmod(F.xxhash64("token"), F.lit(buckets)).cast("int").alias("b")).distinct()
    kept = spark.read.parquet(folder)
    return kept.where(F.col("bucket").isin([r.b for r in bucket.collect()]) & F.col("token").isin(tokens)).drop("bucket")


def prefilter(spark: SparkSession, query: str, index: DataFrame, parents: DataFrame, fan: DataFrame) -> DataFrame:
    """(repo, path, score, reasons, is_module): at most CANDIDATES nodes, best first; ties by path.

    Hits of the query's tokens add up by kind; each absent module of a hit file enters once with 1; the
    BONUS_FILES files of highest fan-in of all (HIGH_FAN_IN at least) get 1 more. The query's tokens and the
    weights are a few rows and broadcast. ``index`` may be the whole, or what ``keyword_index`` makes for the
    question or ``read_index`` reads for it.
    """
    tokens = spark.range(1).select(F.posexplode(query_tokens(F.lit(query))).alias("pos", "token"))
    weights = spark.createDataFrame([(k, w, i) for i, (k, w) in enumerate(WEIGHTS.items())], "kind string, weight int, rank int")
    hits = index.join(F.broadcast(tokens), "token").join(F.broadcast(weights), "kind")
    found = hits.groupBy("repo", "path").agg(F.sum("weight").cast("long").alias("score"), F.array_sort(F.collect_set(F.concat_ws(": ", "kind", "token"))).alias("reasons"), F.bool_or(F.col("kind") == "module").alias("is_module"))
    found = cut(found)  # a few rows, read four times below
    above = found.where("NOT is_module").join(parents.select("repo", F.col("src").alias("path"), "dst"), ["repo", "path"]).select("repo", F.col("dst").alias("path")).distinct().join(found, ["repo", "path"], "left_anti")
    mods = above.select("repo", "path", F.lit(1).cast("long").alias("score"), F.array(F.lit("parent of matched file")).alias("reasons"), F.lit(True).alias("is_module"))
    top = fan.where(F.col("fan_in") >= HIGH_FAN_IN).orderBy(F.desc("fan_in"), "repo", "path").limit(BONUS_FILES).select("repo", "path", F.lit(1).cast("long").alias("score"), F.array(F.lit("high fanIn")).alias("reasons"), F.lit(False).alias("is_module"))
    new = top.join(found.unionByName(mods).select("repo", "path").withColumn("_in", F.lit(True)), ["repo", "path"], "left")
    bonus = new.select("repo", "path", "score", F.when(F.col("_in"), F.array().cast("array<string>")).otherwise(F.col("reasons")).alias("reasons"), "is_module")
    every = found.unionByName(mods).unionByName(bonus).groupBy("repo", "path").agg(F.sum("score").alias("score"), F.array_sort(F.flatten(F.collect_list("reasons"))).alias("reasons"), F.bool_or("is_module").alias("is_module"))
    return every.orderBy(F.desc("score"), "repo", "path").limit(CANDIDATES)


def candidate_lines(candidates: DataFrame, prose: DataFrame, imports: DataFrame | None = None) -> DataFrame:
    """``path: summary [Uses: …] [Matched: …]`` of each candidate; uses are its imports (repo, src, dst) that are candidates too."""
    own = candidates.join(prose.select("repo", "path", "summary"), ["repo", "path"], "left")
    uses = F.lit("")
    if imports is not None:
        both = candidates.select("repo", F.col("path").alias("dst"))
        named = imports.select("repo", F.col("src").alias("path"), "dst").join(F.broadcast(both), ["repo", "dst"], "left_semi").groupBy("repo", "path").agg(F.array_sort(F.collect_set("dst")).alias("_uses"))
        own = own.join(named, ["repo", "path"], "left")
        uses = F.when(F.size("_uses") > 0, F.concat(F.lit(" [Uses: "), F.array_join("_uses", ", "), F.lit("]"))).otherwise("")
    matched = F.when(F.size("reasons") > 0, F.concat(F.lit(" [Matched: "), F.array_join(F.transform("reasons", lambda r: F.regexp_replace(r, ": ", ":")), ", "), F.lit("]"))).otherwise("")
    return own.select("repo", "path", F.concat("path", F.lit(": "), F.coalesce("summary", F.lit("(no summary)")), uses, matched).alias("line"))


def _ranked(queries: DataFrame, files: DataFrame, parts: Callable[[Column], Column], score: Callable[[Column, Column], Column], k: int, many: bool | None) -> DataFrame:
    """(query, path, score, rank): the best ``k`` paths with a positive score for each query; ties by path.

    At most FEW queries, which is looked up unless ``many`` tells it, are broadcast. More are searched block by
    block, every block of them against every block of paths, without a broadcast; a task keeps the best ``k`` of
    its pairs, so little is shuffled.
    """
    p, q = files.select("path").distinct(), queries.select("query").distinct()
    if many is None:
        many = q.limit(FEW + 1).count() > FEW
    if many:
        p, q = cut(p), cut(q)
        p, q = p.repartition(p.count() // PATHS + 1, "path"), q.repartition(q.count() // QUERIES + 1, "query")
    p, q = p.withColumn("_p", parts(F.col("path"))), q.withColumn("_q", parts(F.col("query")))
    pairs = p.hint("shuffle_replicate_nl").crossJoin(q) if many else p.crossJoin(F.broadcast(q))
    w = Window.partitionBy("query").orderBy(F.desc("score"), "path")
    best = pairs.select("query", "path", score(F.col("_q"), F.col("_p")).alias("score")).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return best.where("score > 0")  # after the rank: before it, each pair would be scored once for the filter and once more


def fuzzy(queries: DataFrame, files: DataFrame, k: int = 3, many: bool | None = None) -> DataFrame:
    """(query, path, score, rank, confidence): the best ``k`` paths with a positive score for each query.

    Each path is scored once per query.
    """
    return _ranked(queries, files, lower_parts, parts_similarity, k, many).withColumn("confidence", confidence(F.col("score")))


def fuzzy_match(queries: DataFrame, files: DataFrame, many: bool | None = None) -> DataFrame:
    """(query, matched, alternatives): the best path if it is good enough, and what else may be meant."""
    best = fuzzy(queries, files, 5, many).groupBy("query").agg(F.array_sort(F.collect_list(F.struct("rank", "path", "confidence"))).alias("b"))
    top = F.get("b", F.lit(0))
    paths = F.transform("b", lambda x: x["path"])
    return best.select("query", F.when(top["confidence"] >= SUGGEST, top["path"]).alias("matched"), F.when(top["confidence"] >= AUTO, F.slice(paths, 2, 3)).otherwise(F.slice(paths, 1, 3)).alias("alternatives"))


def similar_paths(queries: DataFrame, files: DataFrame, k: int = 3, many: bool | None = None) -> DataFrame:
    """(query, path, score, rank) by shared segments."""
    return _ranked(queries, files, full_parts, segment_score, k, many)


def check_pattern(pattern: str) -> str | None:
    """Why a pattern isn't run: too long, or of a shape that backtracks without end."""
    if len(pattern) > MAX_PATTERN:
        return f"pattern longer than {MAX_PATTERN} characters"
    if re.search(r"[*+?]\+|[+*]\*|\(\?:.*\)\*.*\(\?:.*\)\*", pattern):
        return "pattern with nested repetition"
    return None


def grep(functions: DataFrame, pattern: str, scope: str | None = None) -> DataFrame:
    """(repo, path, kind, text): matches of a case-insensitive pattern in names, signatures, snippets and key statements.

    ``scope`` is a path prefix; as ``startswith`` it reaches the scan.
    """
    if why := check_pattern(pattern):
        raise ValueError(why)
    f = functions if scope is None else functions.where(F.col("path").startswith(scope))
    p = f"(?i){pattern}"
    cols = ["repo", "path"]
    parts = [f.where(F.col(c).rlike(p)).select(*cols, F.lit(kind).alias("kind"), F.col(c).alias("text")) for kind, c in (("function", "func_name"), ("signature", "signature"), ("code", "code_snippet"))]
    parts.append(f.where("is_exported").where(F.col("func_name").rlike(p)).select(*cols, F.lit("export").alias("kind"), F.col("func_name").alias("text")))
    parts.append(f.select(*cols, F.explode("key_statements").alias("s")).where(F.col("s.text").rlike(p)).select(*cols, F.lit("keyStatement").alias("kind"), F.col("s.text").alias("text")))
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out


def tree(files: DataFrame) -> DataFrame:
    """(repo, directory, names): the sorted listing of each directory."""
    return files.select("repo", "path").distinct().groupBy("repo", dirname(F.col("path")).alias("directory")).agg(F.array_sort(F.collect_list(basename(F.col("path")))).alias("names"))


def entry_points(fan: DataFrame, functions: DataFrame) -> DataFrame:
    """(repo, path, exports): files that nothing imports and that export one thing at most."""
    e = functions.where("is_exported").select("repo", "path", "func_name").distinct().groupBy("repo", "path").agg(F.count(F.lit(1)).alias("exports"))
    return fan.where("fan_in = 0").join(e, ["repo", "path"], "left").fillna(0, ["exports"]).where("exports <= 1").select("repo", "path", "exports")


def relationships(fan: DataFrame, functions: DataFrame) -> DataFrame:
    """(repo, path, consumers, exports): files with HIGH_FAN_IN importers or more, and what they export."""
    e = functions.where("is_exported").groupBy("repo", "path").agg(F.array_sort(F.collect_set("func_name")).alias("exports"))
    return fan.where(F.col("fan_in") >= HIGH_FAN_IN).join(e, ["repo", "path"], "left").select("repo", "path", F.col("fan_in").alias("consumers"), F.coalesce("exports", F.array().cast("array<string>")).alias("exports"))


def imported_names(symbols: DataFrame, k: int = 5) -> DataFrame:
    """(repo, path, names): the first ``k`` names, by alphabet, that each file (repo, path, source_file, symbol_name) imports.

    Where an import names nothing, the name of the file it comes from stands in.
    """
    name = F.coalesce(F.nullif("symbol_name", F.lit("")), F.regexp_replace(basename(F.col("source_file")), r"\.(?:ts|js|tsx|jsx)$", ""))
    each = symbols.select("repo", "path", name.alias("name")).where("name IS NOT NULL").distinct()
    w = Window.partitionBy("repo", "path").orderBy("name")
    few = each.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= k)
    return few.groupBy("repo", "path").agg(F.array_sort(F.collect_list("name")).alias("names"))


def described_entry_points(entries: DataFrame, prose: DataFrame, names: DataFrame) -> DataFrame:
    """(repo, path, description) of entry points: their summary, else what they use, else that they are one."""
    own = entries.select("repo", "path").join(prose.select("repo", "path", "summary"), ["repo", "path"], "left").join(names, ["repo", "path"], "left")
    uses = F.when(F.size("names") > 0, F.concat(F.lit("uses: "), F.array_join("names", ", ")))
    return own.select("repo", "path", F.coalesce("summary", uses, F.lit("entry point")).alias("description"))


def connections(entries: DataFrame, names: DataFrame, related: DataFrame) -> DataFrame:
    """(repo, path, names, consumers): entry points with what they import, then other files of ``relationships`` with what they export."""
    first = entries.select("repo", "path").join(names, ["repo", "path"]).select("repo", "path", "names", F.lit(None).cast("long").alias("consumers"))
    rest = related.join(first.select("repo", "path"), ["repo", "path"], "left_anti").select("repo", "path", F.col("exports").alias("names"), F.col("consumers").cast("long").alias("consumers"))
    return first.unionByName(rest)


def config_files(files: DataFrame, extra: list[str] | None = None) -> DataFrame:
    return files.where(basename(F.col("path")).isin(*CONFIG_FILES, *(extra or []))).select("repo", "path").distinct()
