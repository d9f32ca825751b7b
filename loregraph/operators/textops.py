"""Operators on rows of text: comments and markers, key statements, patterns, claims, cost estimate."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loregraph.functions.text import HTTP_STATUS, http_status, identifiers

CACHE_OPERATIONS = "load save get set has clear invalidate".split()


def lines(rows: DataFrame, keys: list[str], text: str) -> DataFrame:
    """(*keys, n, line): the lines of a text, from 1."""
    return rows.select(*keys, F.posexplode(F.split(text, "\n")).alias("_i", "line")).select(*keys, (F.col("_i") + 1).alias("n"), "line")


def inline_comments(rows: DataFrame, keys: list[str], text: str) -> DataFrame:
    """(*keys, n, comment): what follows ``//`` on each line, unless a colon stands before it (addresses)."""
    each = lines(rows, keys, text).withColumn("comment", F.regexp_extract("line", r"(?<!:)//\s*(.+)", 1))
    return each.where("comment <> ''").drop("line")


def markers(rows: DataFrame, keys: list[str], text: str) -> DataFrame:
    """(*keys, n, marker, note): TODO, FIXME, HACK and XXX in comments, in capitals, with what follows."""
    p = r"(?i)(?://|/\*).*?\b(TODO|FIXME|HACK|XXX):?\s*(.*)$"
    each = lines(rows, keys, text).where(F.col("line").rlike(p))
    note = F.trim(F.regexp_replace(F.regexp_extract("line", p, 2), r"\*/\s*$", ""))
    return each.select(*keys, "n", F.upper(F.regexp_extract("line", p, 1)).alias("marker"), note.alias("note"))


def statement_category(line):
    """Category of a source line, or null; the first rule that applies wins."""
    return (
        F.when(line.rlike(r"(?:const|let|var)\s+\w+\s*(?::[^=]+)?=\s*-?\d+(?:\.\d+)?\s*;?\s*$|(?:\?\?|\|\|)\s*\d+"), "config")
        .when(line.rlike("['\"`](?:https?|wss?)://"), "url")
        .when(line.rlike(r"Math\.pow|\*\*"), "math")
        .when(line.rlike(r"\bif\s*\(.*status.*\b\d{3}\b"), "condition")
        .when(line.rlike(r"\bcatch\s*\("), "error")
        .when(line.rlike(r"\b(?:for|while)\s*\("), "loop")
        .when(line.rlike(r"Promise\.(?:all|allSettled|race|any)\s*\("), "async-pattern")
    )


def key_statements(rows: DataFrame, keys: list[str], text: str) -> DataFrame:
    """(*keys, n, category, line): a row per line that has a category."""
    return lines(rows, keys, text).withColumn("category", statement_category(F.col("line"))).where("category IS NOT NULL").withColumn("line", F.trim("line"))


def error_statuses(functions: DataFrame) -> DataFrame:
    """(repo, path, func_name, line, status, description) of the error and condition statements; the status may be null."""
    s = functions.select("repo", "path", "func_name", F.explode("key_statements").alias("s")).where(F.col("s.category").isin("error", "condition"))
    e = s.select("repo", "path", "func_name", F.col("s.line").alias("line"), http_status(F.col("s.text"), F.lit("")).alias("status"))
    names = F.create_map(*[x for k, v in HTTP_STATUS.items() for x in (F.lit(k), F.lit(v))])
    return e.withColumn("description", F.when(F.col("status").isNotNull(), F.coalesce(F.try_element_at(names, "status"), F.concat(F.lit("HTTP "), F.col("status").cast("string")))))


def patterns(functions: DataFrame) -> DataFrame:
    """(repo, path, pattern, location), each once, from one pass over the functions.

    ``retry``: a function that loops, catches and either backs off or counts its retries (the loop may be told
    from the last two). ``cache``: a file with two functions or more that work on a cache, by name or code.
    ``singleton``: a file with code that keeps one instance, or a function named so.
    """
    s = F.coalesce("key_statements", F.expr("array()").cast(functions.schema["key_statements"].dataType))
    has = lambda category, text: F.exists(s, lambda x: (x["category"] == category) & x["text"].rlike(text))
    counted, backoff, caught = has("config", "retry|attempt"), has("math", r"Math\.pow|\*\*"), F.exists(s, lambda x: x["category"] == "error")
    code, name = F.lower(F.coalesce("code_snippet", F.lit(""))), F.lower("func_name")
    loop = code.rlike(r"\b(?:for|while)\s*\(") | (counted & caught)
    cache = (name.contains("cache") & name.rlike("|".join(CACHE_OPERATIONS))) | code.contains("cache")
    single = (code.contains("instance") & code.rlike("null|undefined") & code.rlike(r"\bnew\b|create")) | (name.contains("get") & name.contains("instance"))
    mark = lambda on, what, where: F.when(F.coalesce(on, F.lit(False)), F.struct(F.lit(what).alias("pattern"), where.alias("location")))
    marks = F.array_compact(F.array(mark(loop & caught & (backoff | counted), "retry", F.concat_ws(":", "path", "func_name")), mark(cache, "cache", F.col("path")), mark(single, "singleton", F.col("path"))))
    each = functions.select("repo", "path", "func_name", F.explode(marks).alias("m")).select("repo", "path", "func_name", "m.pattern", "m.location").distinct()
    g = each.groupBy("repo", "path", "pattern", "location").agg(F.count(F.lit(1)).alias("_n"))
    return g.where((F.col("pattern") != "cache") | (F.col("_n") >= 2)).drop("_n")


def error_paths(rows: DataFrame, keys: list[str], text: str) -> DataFrame:
    """(*keys, line, type, condition, action, http_status) of the error paths in a text with one function's code: a narrow map.

    Null and blank texts, and those without a body, have none.
    """
    from loregraph.extract import scanner

    schema = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keys) + ", line int, type string, condition string, action string, http_status int"
    asked = rows.select(*keys, F.col(text).alias("_text")).where(F.col("_text").rlike(r"\b(?:if|throw|catch|return)\b"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            at, got = [], []
            for i, t in enumerate(pdf["_text"]):
                for e in scanner.error_paths(t, 1):
                    at.append(i), got.append((e["line"], e["type"], e["condition"], e["action"], e["http_status"]))
            own = pd.DataFrame(got, columns=["line", "type", "condition", "action", "http_status"]).astype({"http_status": "Int64"})
            yield pd.concat([pdf[keys].iloc[at].reset_index(drop=True), own], axis=1)

    return asked.mapInPandas(run, schema)


def claim_confidence(claims: DataFrame, names: DataFrame, keys: list[str]) -> DataFrame:
    """(*keys, name, found, asked, confidence): of the identifiers of a claim, how many are names of its file.

    All: high; some: medium; none, or no identifiers: low. ``claims`` (*keys, name, text), ``names`` (*keys, known).
    """
    ids = claims.select(*keys, "name", F.explode_outer(identifiers(F.col("text"))).alias("known"))
    ok = ids.join(names.select(*keys, "known").distinct().withColumn("_ok", F.lit(1)), [*keys, "known"], "left")
    g = ok.groupBy(*keys, "name").agg(F.count("_ok").alias("found"), F.count("known").alias("asked"))
    return g.withColumn("confidence", F.when((F.col("asked") > 0) & (F.col("found") == F.col("asked")), "high").when(F.col("found") > 0, "medium").otherwise("low"))


def token_cost(rows: DataFrame, text: str, out_tokens: int = 500, rates: tuple[float, float] = (0.003, 0.015)) -> DataFrame:
    """(rows, input_tokens, output_tokens, cost): estimate of generating text for every row: a token per 4 characters, 500 characters of frame."""
    g = rows.agg(F.count(F.lit(1)).alias("rows"), F.sum(F.ceil((F.coalesce(F.length(text), F.lit(0)) + 500) / 4)).cast("long").alias("input_tokens"))
    return g.withColumn("output_tokens", F.col("rows") * out_tokens).withColumn("cost", F.round(F.col("input_tokens") / 1000 * rates[0] + F.col("output_tokens") / 1000 * rates[1], 4))
