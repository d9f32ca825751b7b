"""Source trees and history dumps as DataFrames."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loregraph.extract.scanner import parse
from loregraph.schemas import EXTRACTED

COLUMNS = ["path", "lines", "content_hash", "imports", "exports", "functions", "classes", "interfaces", "usages", "docs", "comments", "todos", "error"]
INCLUDE, EXCLUDE = ("**/*.ts",), ("node_modules/**", "**/*.d.ts", "dist/**", "build/**")


def glob_pattern(glob: str) -> str:
    """A glob as a pattern for whole relative paths: ``**/`` is any directories, ``*`` and ``?`` stay inside one."""
    out, i = "", 0
    while i < len(glob):
        if glob.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif glob.startswith("**", i):
            out, i = out + ".*", i + 2
        else:
            out, i = out + {"*": "[^/]*", "?": "[^/]"}.get(glob[i], re.escape(glob[i])), i + 1
    return f"^{out}$"


def _unseen(spark: SparkSession, base: str) -> list[str]:
    """The directories under ``base`` that file sources pass by, as their names start with an underscore (``__tests__``)."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(base).getFileSystem(spark._jsc.hadoopConfiguration())
    out, todo = [], [path(base)]
    while todo:
        for s in fs.listStatus(todo.pop()):
            name = s.getPath().getName()
            if s.isDirectory() and not name.startswith(".") and name != "node_modules":
                todo.append(s.getPath())
                if name.startswith("_"):
                    out.append(s.getPath().toString())
    return out


def find_files(spark: SparkSession, root: str, include: tuple[str, ...] = INCLUDE, exclude: tuple[str, ...] = EXCLUDE, suffix: str = ".ts") -> DataFrame:
    """(path, content) of the files under ``root``: no dot directories, at least one ``include``, no ``exclude``."""
    base = root.rstrip("/")
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", f"*{suffix}").load([base, *_unseen(spark, base)])
    rel = raw.withColumn("path", F.regexp_replace("path", "^.*?" + re.escape(re.sub(r"^\w+:/+", "/", base)) + "/", ""))
    wanted = F.col("path").rlike("|".join(map(glob_pattern, include))) & ~F.col("path").rlike(r"(?:^|/)\.[^/]+/|(?:^|/)node_modules/")
    if exclude:
        wanted &= ~F.col("path").rlike("|".join(map(glob_pattern, exclude)))
    return rel.where(wanted).select("path", F.decode("content", "UTF-8").alias("content"))


def extract(files: DataFrame) -> DataFrame:
    """What the scanner reads from (path, content): a narrow map. A file that fails is a row with an ``error``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for p, t in zip(pdf["path"], pdf["content"], strict=True):
                try:
                    rows.append(parse(p, t or ""))
                except Exception as e:  # noqa: BLE001 - one bad file must not end the job
                    rows.append({"path": p, "error": f"failed to parse {p}: {e}"})
            yield pd.DataFrame(rows, columns=COLUMNS).astype(object).where(lambda x: x.notna(), None)

    return files.select("path", "content").mapInPandas(run, EXTRACTED)


def readmes(spark: SparkSession, root: str) -> DataFrame:
    """(directory, text) of each ``readme.md`` in any case."""
    base = re.sub(r"^\w+:/+", "/", root.rstrip("/"))
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root.rstrip("/")).where(F.lower(F.substring_index("path", "/", -1)) == "readme.md")
    rel = F.regexp_replace("path", "^.*?" + re.escape(base) + "/", "")
    return raw.select(F.when(rel.contains("/"), F.regexp_extract(rel, "^(.*)/[^/]*$", 1)).otherwise(".").alias("directory"), F.decode("content", "UTF-8").alias("text"))


def git_log(spark: SparkSession, dump: str) -> DataFrame:
    """(hash, author, commit_date, message, path, ord, old_path) of one dump: ``git log --name-status -M --format='%x1e%H%x1f%ae%x1f%aI%x1f%s'``.

    With ``--name-only`` instead, lines are paths alone and no file is renamed. ``old_path`` is what a renamed file was called before.
    """
    raw = spark.read.option("lineSep", "\x1e").text(dump).where(F.trim("value") != "")
    part = F.split(F.regexp_extract("value", r"^([^\n]*)", 1), "\x1f")
    names = F.filter(F.split(F.regexp_extract("value", r"^[^\n]*\n([\s\S]*)$", 1), "\n"), lambda x: x != "")
    each = raw.select(part[0].alias("hash"), part[1].alias("author"), part[2].try_cast("timestamp").alias("commit_date"), part[3].alias("message"), F.posexplode(names).alias("ord", "_line"))
    cell = F.split("_line", "\t")
    return each.withColumn("path", F.element_at(cell, -1)).withColumn("old_path", F.when(F.col("_line").rlike("^[RC]\\d*\t"), F.get(cell, F.lit(1)))).drop("_line")


def follow_renames(log: DataFrame, hops: int = 10) -> DataFrame:
    """The log with each file under its newest path: renames later than the commit are followed, ``hops`` of them at most.

    What a file was called is worked out on the renames alone, which are few; the log is joined with them once.
    """
    moved = log.where("old_path IS NOT NULL").select(F.col("old_path").alias("path"), F.col("commit_date").alias("at"), F.col("path").alias("new")).distinct()
    ends = moved.withColumn("_last", F.col("at"))
    step = moved.select(F.col("path").alias("new"), F.col("at").alias("_then"), F.col("new").alias("_to"))
    for _ in range(hops - 1):
        met = ends.join(step, "new", "left").groupBy("path", "at", "new", "_last").agg(F.min_by("_to", F.when(F.col("_then") > F.col("_last"), F.col("_then"))).alias("_to"), F.min(F.when(F.col("_then") > F.col("_last"), F.col("_then"))).alias("_then"))
        ends = met.select("path", "at", F.when(F.col("_then").isNotNull(), F.col("_to")).otherwise(F.col("new")).alias("new"), F.coalesce("_then", "_last").alias("_last"))
    life = ends.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("at", "new"))).alias("_moves"))  # the renames away from one path
    after = lambda c: F.filter("_moves", lambda m: m["at"] > c)
    return log.join(life, "path", "left").withColumn("path", F.coalesce(F.get(after(F.col("commit_date")), F.lit(0))["new"], F.col("path"))).select(*log.columns)


def read_json(path: str) -> dict | None:
    """A JSON object from a file; None if it is missing or isn't one."""
    try:
        with open(path, encoding="utf-8") as f:
            v = json.load(f)
    except (OSError, ValueError):
        return None
    return v if isinstance(v, dict) else None


def _strings(v: object) -> bool:
    return isinstance(v, list) and all(isinstance(x, str) for x in v)


def _string_map(v: object) -> bool:
    return isinstance(v, dict) and all(isinstance(x, str) for x in v.values())


def package_manifest(path: str) -> dict:
    """The fields of a package manifest that have the right type; a map with any other value is dropped whole."""
    raw = read_json(path) or {}
    kinds = {"name": lambda v: isinstance(v, str), "version": lambda v: isinstance(v, str), "type": lambda v: isinstance(v, str), "scripts": _string_map, "dependencies": _string_map, "devDependencies": _string_map, "engines": _string_map}
    return {k: raw[k] for k, ok in kinds.items() if k in raw and ok(raw[k])}


def compiler_config(path: str) -> dict:
    raw = read_json(path) or {}
    kinds = {"compilerOptions": lambda v: isinstance(v, dict), "include": _strings, "exclude": _strings}
    return {k: raw[k] for k, ok in kinds.items() if k in raw and ok(raw[k])}


def tool_config(path: str) -> dict:
    """The sections of a tool's settings file that are right throughout: one with any field of a wrong type is dropped whole."""
    raw = read_json(path) or {}
    text, number = lambda v: isinstance(v, str), lambda v: isinstance(v, (int, float)) and not isinstance(v, bool)
    kinds = {
        "extraction": {"include": _strings, "exclude": _strings},
        "llm": {"provider": text, "model": text, "temperature": number, "maxTokens": number},
        "output": {"directory": text, "format": text},
    }
    good = lambda v, fields: isinstance(v, dict) and all(fields[k](x) for k, x in v.items() if k in fields)
    return {k: raw[k] for k, fields in kinds.items() if k in raw and good(raw[k], fields)}


def all_configs(root: str) -> dict:
    """The package manifest, compiler config and tool config of a project, each {} where there is none."""
    base = root.rstrip("/")
    return {"package": package_manifest(f"{base}/package.json"), "compiler": compiler_config(f"{base}/tsconfig.json"), "tool": tool_config(f"{base}/loregraph.json")}


def settings(path: str, defaults: dict) -> dict:
    """User settings over defaults, section by section: a missing file gives the defaults, a bad one an error."""
    try:
        with open(path, encoding="utf-8") as f:
            own = json.load(f)
    except FileNotFoundError:
        return defaults
    if not isinstance(own, dict):
        raise ValueError(f"{path} holds no settings")
    return {k: {**v, **{a: b for a, b in (own.get(k) or {}).items() if b is not None}} if isinstance(v, dict) else own.get(k, v) for k, v in defaults.items()}
