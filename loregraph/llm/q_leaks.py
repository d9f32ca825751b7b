"""Queries of problem 7: evaluation texts leaking into training text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loregraph.llm import leaks
from loregraph.sources.tables import table


def _leaked(spark: SparkSession, folder: str) -> DataFrame:
    return leaks.leaked(table(spark, folder, "documents").select("doc_id", "text"), table(spark, folder, "eval_items"))


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, item_id) of the documents that hold a passage of an item."""
    return _leaked(spark, folder).select("doc_id", "item_id").distinct()


def p7_items(spark: SparkSession, folder: str) -> DataFrame:
    """(item_id, documents, longest): how many documents each leaked item is in, and its longest passage in words."""
    return _leaked(spark, folder).groupBy("item_id").agg(F.countDistinct("doc_id").alias("documents"), F.max("spanned").alias("longest"))


def p7_whole(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, item_id) of the documents that hold all words of an item as they stand."""
    return _leaked(spark, folder).where("whole").select("doc_id", "item_id").distinct()


def p7_clean(spark: SparkSession, folder: str) -> DataFrame:
    """The ids of the documents that stay when the affected ones are removed."""
    return table(spark, folder, "documents").select("doc_id").join(p7_found(spark, folder).select("doc_id"), "doc_id", "left_anti")


QUERIES = {"p7_found": p7_found, "p7_items": p7_items, "p7_whole": p7_whole, "p7_clean": p7_clean}
_PLAIN = r"""' ' || trim(regexp_replace(lower(regexp_replace(regexp_replace(text, '[\x{00AD}\x{200B}-\x{200F}\x{2060}\x{FEFF}]', '', 'g'), '</?[a-zA-Z][^<>\n]*>|&[a-z]{2,6};', ' ', 'g')), '[^\p{L}\p{N}]+', ' ', 'g')) || ' '"""
ORACLES: dict[str, str] = {
    "p7_whole": f"WITH d AS (SELECT doc_id, {_PLAIN} AS t FROM documents WHERE text <> ''), i AS (SELECT item_id, {_PLAIN} AS t FROM eval_items WHERE text <> '') SELECT DISTINCT doc_id, item_id FROM d JOIN i ON contains(d.t, i.t) WHERE i.t <> '  '"
}
