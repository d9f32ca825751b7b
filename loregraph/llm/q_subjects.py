"""Queries of problem 8: subject area of each document."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loregraph.llm import subjects
from loregraph.sources.tables import table


def p8_shares(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, subject, share): share of a document's sentences that each of its subjects takes."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    found = subjects.subjects_of(docs, table(spark, folder, "doc_labels"), table(spark, folder, "subject_areas"), table(spark, folder, "eval_items"))
    return found.select("doc_id", "subject", F.round("share", 4).alias("share"))


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, subject) for each area that a document is about."""
    return p8_shares(spark, folder).select("doc_id", "subject").distinct()


def p8_composition(spark: SparkSession, folder: str) -> DataFrame:
    """(subject, documents, sentence_share): the corpus summed up by area."""
    return p8_shares(spark, folder).groupBy("subject").agg(F.countDistinct("doc_id").alias("documents"), F.round(F.sum("share"), 2).alias("sentence_share"))


def p8_labels(spark: SparkSession, folder: str) -> DataFrame:
    """(subject, documents): labelled documents per area, after spelling and repetition are put right."""
    own = subjects.clean_labels(table(spark, folder, "doc_labels"), table(spark, folder, "subject_areas"))
    return own.select("doc_id", F.explode("subjects").alias("subject")).groupBy("subject").agg(F.count(F.lit(1)).alias("documents"))


QUERIES = {"p8_found": p8_found, "p8_shares": p8_shares, "p8_composition": p8_composition, "p8_labels": p8_labels}
ORACLES = {
    "p8_labels": """SELECT a.subject, count(DISTINCT l.doc_id) AS documents FROM doc_labels l JOIN (SELECT DISTINCT lower(trim(subject)) AS subject FROM subject_areas) a
        ON lower(trim(l.subject)) = a.subject GROUP BY a.subject"""
}
