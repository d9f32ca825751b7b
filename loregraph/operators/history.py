"""Commit history per file, incremental refresh, upserts and staleness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loregraph.functions.text import content_hash


def rollup(commits: DataFrame) -> DataFrame:
    """(repo, path, commit_count, created_at, last_modified, authors) of each file; authors newest first, each once.

    ``commits`` has one row per commit and file.
    """
    g = commits.groupBy("repo", "path").agg(F.count(F.lit(1)).alias("commit_count"), F.min("commit_date").alias("created_at"), F.max("commit_date").alias("last_modified"))
    a = commits.where("author IS NOT NULL").groupBy("repo", "path", "author").agg(F.max(F.struct("commit_date", "commit_id")).alias("_at"))
    names = a.groupBy("repo", "path").agg(F.array_sort(F.collect_list(F.struct((-F.unix_micros("_at.commit_date")).alias("o"), (-F.col("_at.commit_id")).alias("i"), "author"))).alias("_a"))
    return g.join(names, ["repo", "path"], "left").select("repo", "path", "commit_count", "created_at", "last_modified", F.coalesce(F.transform("_a", lambda x: x["author"]), F.array().cast("array<string>")).alias("authors"))


def primary_author(commits: DataFrame) -> DataFrame:
    """(repo, path, author, n): the author of most commits; of equals, the one seen first in a newest-first log."""
    a = commits.where("author IS NOT NULL").groupBy("repo", "path", "author").agg(F.count(F.lit(1)).alias("n"), F.max(F.struct("commit_date", "commit_id")).alias("_at"))
    return a.groupBy("repo", "path").agg(F.max_by(F.struct("author", "n"), F.struct("n", "_at")).alias("_b")).select("repo", "path", "_b.author", "_b.n")


def recent(commits: DataFrame, k: int = 5) -> DataFrame:
    """The ``k`` newest commits of each file with their rank."""
    w = Window.partitionBy("repo", "path").orderBy(F.desc("commit_date"), F.desc("commit_id"))
    return commits.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def changed(now: DataFrame, before: DataFrame, key: str, text: str) -> DataFrame:
    """Rows of ``now`` that are new or whose content hash differs from that in ``before`` (key, content_hash)."""
    own = now.withColumn("content_hash", content_hash(F.col(text)))
    old = before.select(key, F.col("content_hash").alias("_old"))
    return own.join(old, key, "left").where(~F.col("content_hash").eqNullSafe(F.col("_old"))).drop("_old")


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``old`` with the rows of ``new`` set field by field: what ``new`` leaves null or doesn't have survives."""
    fields = [c for c in dict.fromkeys([*old.columns, *new.columns]) if c not in keys]

    def field(c: str) -> Column:
        sides = ([F.col(f"n.{c}")] if c in new.columns else []) + ([F.col(f"o.{c}")] if c in old.columns else [])
        return F.coalesce(*sides).alias(c)

    j = old.alias("o").join(new.alias("n"), keys, "full_outer")
    return j.select(*keys, *[field(c) for c in fields])


def stale(nodes: DataFrame, prose: DataFrame, key: list[str]) -> DataFrame:
    """Nodes whose text was generated before they were last modified."""
    return nodes.join(prose, key).where(F.col("last_modified") > F.col("generated_at"))
