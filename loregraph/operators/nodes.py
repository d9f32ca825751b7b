"""Nodes of files, functions and modules as one table, and their text: built, set over what is kept, looked up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loregraph.functions.paths import basename, is_test_file
from loregraph.operators.graph import module_nodes

#: Command that runs one test file.
TEST_COMMAND = "npm test -- "
#: A file with fewer functions, or more dependents, shows all its code.
FEW_FUNCTIONS, MANY_DEPENDENTS = 5, 5
COLUMNS = ["repo", "id", "type", "path", "name", "lines", "commits", "authors", "created_at", "last_modified", "test_command", "readme"]


def _node(df: DataFrame, kind: str, **values: Column) -> DataFrame:
    none = {"lines": "int", "commits": "long", "authors": "array<string>", "created_at": "timestamp", "last_modified": "timestamp", "test_command": "string", "readme": "string"}
    cells = {"type": F.lit(kind), **{k: F.lit(None).cast(t) for k, t in none.items()}, **values}
    return df.select("repo", *[cells[c].alias(c) for c in COLUMNS[1:]])


def file_nodes(docs: DataFrame, history: DataFrame | None = None, now: str | None = None) -> DataFrame:
    """A node per document. ``history`` as ``history.rollup`` makes it; a file it doesn't know has no commits and the time ``now``."""
    at = F.lit(now).cast("timestamp")
    test = F.when(is_test_file(F.col("path")), F.concat(F.lit(TEST_COMMAND), "path"))
    if history is None:
        return _node(docs, "file", id=F.col("path"), path=F.col("path"), name=basename(F.col("path")), lines=F.col("lines"), test_command=test)
    own = docs.select("repo", "path", "lines").join(history, ["repo", "path"], "left")
    return _node(
        own, "file", id=F.col("path"), path=F.col("path"), name=basename(F.col("path")), lines=F.col("lines"), test_command=test, commits=F.coalesce("commit_count", F.lit(0).cast("long")),
        authors=F.coalesce("authors", F.array().cast("array<string>")), created_at=F.coalesce("created_at", at), last_modified=F.coalesce("last_modified", at),
    )


def function_nodes(functions: DataFrame) -> DataFrame:
    """A node per exported function (repo, path, func_name, start_line, end_line, is_exported)."""
    lines = (F.col("end_line") - F.col("start_line") + 1).cast("int")
    return _node(functions.where("is_exported"), "function", id=F.concat_ws(":", "path", "func_name"), path=F.col("path"), name=F.col("func_name"), lines=lines)


def modules(files: DataFrame, readmes: DataFrame | None = None) -> DataFrame:
    """A node per directory that is a module, with the text of its README (repo, directory, text) if there is one."""
    own = module_nodes(files)
    if readmes is not None:
        own = own.join(readmes.select("repo", F.col("directory").alias("module"), F.col("text").alias("readme")), ["repo", "module"], "left")
    zero = {"lines": F.lit(0), "commits": F.lit(0).cast("long"), "authors": F.array().cast("array<string>")}
    return _node(own, "module", id=F.col("module"), path=F.col("module"), name=basename(F.col("module")), **zero, **({"readme": F.col("readme")} if readmes is not None else {}))


def expanded(functions: DataFrame, fan: DataFrame, patterns: DataFrame) -> DataFrame:
    """(repo, path, func_name, expanded): whether a function's code is shown whole.

    It is in a file of fewer than FEW_FUNCTIONS functions or with more than MANY_DEPENDENTS dependents, if a
    pattern lies in it, or if it has error paths (``error_paths``, an array, may be null).
    """
    own = functions.select("repo", "path", "func_name", F.coalesce(F.size("error_paths") > 0, F.lit(False)).alias("_paths"))
    count = own.groupBy("repo", "path").agg(F.count(F.lit(1)).alias("_n"))
    held = patterns.where(F.col("location").contains(":")).select("repo", "path", F.substring_index("location", ":", -1).alias("func_name"), F.lit(True).alias("_held")).distinct()
    all_ = own.join(count, ["repo", "path"]).join(fan.select("repo", "path", "fan_in"), ["repo", "path"], "left").join(held, ["repo", "path", "func_name"], "left")
    yes = (F.col("_n") < FEW_FUNCTIONS) | (F.coalesce("fan_in", F.lit(0)) > MANY_DEPENDENTS) | F.coalesce("_held", F.lit(False)) | F.col("_paths")
    return all_.select("repo", "path", "func_name", yes.alias("expanded"))


def readme_of(readmes: DataFrame, directories: DataFrame) -> DataFrame:
    """(repo, directory, text): of each repository, the README of the module with the shortest path; of equals, the first by name."""
    own = readmes.join(directories.select("repo", F.col("module").alias("directory")), ["repo", "directory"], "left_semi")
    best = own.groupBy("repo").agg(F.min_by(F.struct("directory", "text"), F.struct(F.length("directory"), "directory")).alias("_r"))
    return best.select("repo", "_r.directory", "_r.text")


class Store:
    """Nodes and their text under one folder, in versions as in ``streaming.incremental``: each write is a new version."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        from loregraph.streaming.incremental import State

        self.spark = spark
        self.nodes, self.prose = State(spark, f"{folder.rstrip('/')}/nodes"), State(spark, f"{folder.rstrip('/')}/prose")

    @staticmethod
    def _set(state, rows: DataFrame, keys: list[str]) -> None:
        from loregraph.operators.history import upsert

        old, now = state.read(), state.version()
        state.write(rows if old is None else upsert(old, rows, keys), 0 if now is None else now + 1)

    def put(self, nodes: DataFrame) -> None:
        """Set nodes (repo, id, ...) over those kept, field by field; text that is kept stays."""
        self._set(self.nodes, nodes, ["repo", "id"])

    def describe(self, prose: DataFrame) -> int:
        """Set text (repo, id, summary, ..., generated_at) of nodes that are kept; how many there are of them."""
        known = self.nodes.read()
        if known is None:
            return 0
        own = prose.join(known.select("repo", "id"), ["repo", "id"], "left_semi").withColumn("stale", F.lit(False))
        n = own.count()
        if n:
            self._set(self.prose, own, ["repo", "id"])
        return n

    def mark_stale(self) -> int:
        """Mark text that was generated before its node was last modified; how many are marked in all."""
        text, nodes = self.prose.read(), self.nodes.read()
        if text is None or nodes is None:
            return 0
        at = nodes.select("repo", "id", F.col("last_modified").alias("_at"))
        marked = text.join(at, ["repo", "id"], "left").withColumn("stale", F.coalesce(F.col("_at") > F.col("generated_at"), F.lit(False))).drop("_at")
        self.prose.write(marked, self.prose.version() + 1)
        return self.prose.read().where("stale").count()

    def find(self, kind: str | None = None, without_text: bool = False, ids: list[str] | None = None) -> DataFrame:
        """Nodes with their text: of one type, those without text, or those asked for."""
        nodes, text = self.nodes.read(), self.prose.read()
        if nodes is None:
            return self.spark.createDataFrame([], "repo string, id string, type string, path string, summary string, stale boolean")
        text = self.spark.createDataFrame([], "repo string, id string, summary string, stale boolean") if text is None else text
        out = nodes.join(text, ["repo", "id"], "left")
        out = out if kind is None else out.where(F.col("type") == kind)
        out = out.where("summary IS NULL") if without_text else out
        return out if ids is None else out.where(F.col("id").isin(ids))


