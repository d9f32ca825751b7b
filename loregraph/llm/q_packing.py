"""Queries of problem 6: filling fixed-capacity containers with documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loregraph.llm import packing
from loregraph.session import cut
from loregraph.sources.tables import table


def p6_packing(spark: SparkSession, folder: str) -> DataFrame:
    """(capacity_id, container_id, position, doc_id, piece, first_token, tokens): where each document is, for each capacity."""
    counts = cut(packing.token_counts(table(spark, folder, "documents").select("doc_id", "text")))
    return packing.packed(counts, table(spark, folder, "pack_capacity"))


def p6_use(spark: SparkSession, folder: str) -> DataFrame:
    """(capacity_id, containers, tokens, used): containers per capacity and the share of their room that is used."""
    caps = table(spark, folder, "pack_capacity").select("capacity_id", "capacity_tokens").distinct()
    p = p6_packing(spark, folder).groupBy("capacity_id").agg(F.countDistinct("container_id").alias("containers"), F.sum("tokens").alias("tokens"))
    return p.join(F.broadcast(caps), "capacity_id").select("capacity_id", "containers", "tokens", F.round(F.col("tokens") / (F.col("containers") * F.col("capacity_tokens")), 4).alias("used"))


def p6_check(spark: SparkSession, folder: str) -> DataFrame:
    """What a packing must hold to, counted per capacity: every document placed, whole, at a place of its own; nothing overfull or cut without need.

    (capacity_id, documents, overfull, cut, uneven, lost): documents placed; containers beyond their capacity;
    documents cut that would fit; containers whose positions aren't 0, 1, 2, ...; tokens that are missing or twice there.
    """
    counts = cut(packing.token_counts(table(spark, folder, "documents").select("doc_id", "text")))
    p = cut(packing.packed(counts, table(spark, folder, "pack_capacity")))
    room = table(spark, folder, "pack_capacity").select("capacity_id", "capacity_tokens").distinct()
    one = p.groupBy("capacity_id", "container_id").agg(F.sum("tokens").alias("t"), F.count(F.lit(1)).alias("n"), F.max("position").alias("last"), F.countDistinct("position").alias("places"))
    full = one.join(room, "capacity_id").groupBy("capacity_id").agg(F.count_if(F.col("t") > F.col("capacity_tokens")).alias("overfull"), F.count_if((F.col("last") != F.col("n") - 1) | (F.col("places") != F.col("n"))).alias("uneven"))
    docs = p.groupBy("capacity_id", "doc_id").agg(F.sum("tokens").alias("t"), F.count(F.lit(1)).alias("pieces")).join(counts.where("tokens IS NOT NULL").distinct(), "doc_id").join(room, "capacity_id")
    own = docs.groupBy("capacity_id").agg(F.count(F.lit(1)).alias("documents"), F.count_if((F.col("pieces") > 1) & (F.col("tokens") <= F.col("capacity_tokens"))).alias("cut"), F.sum(F.abs(F.col("t") - F.col("tokens"))).alias("lost"))
    return own.join(full, "capacity_id").select("capacity_id", "documents", "overfull", "cut", "uneven", F.col("lost").cast("long").alias("lost"))


def p6_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, tokens) of each document."""
    return packing.token_counts(table(spark, folder, "documents").select("doc_id", "text"))


QUERIES = {"p6_packing": p6_packing, "p6_use": p6_use, "p6_check": p6_check, "p6_tokens": p6_tokens}
ORACLES: dict[str, str] = {
    "p6_check": "SELECT c.capacity_id, d.n AS documents, CAST(0 AS BIGINT) AS overfull, CAST(0 AS BIGINT) AS cut, CAST(0 AS BIGINT) AS uneven, CAST(0 AS BIGINT) AS lost FROM (SELECT DISTINCT capacity_id FROM pack_capacity WHERE capacity_tokens > 0) c, (SELECT count(*) AS n FROM documents WHERE text IS NOT NULL) d"
}
