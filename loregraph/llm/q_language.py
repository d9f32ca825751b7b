"""Queries of problem 3: natural language hidden inside code."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loregraph.llm import language
from loregraph.sources.tables import table


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """(comment_id, lang) for each language in which a comment holds a clause."""
    comments = table(spark, folder, "doc_comments").select("comment_id", "text")
    return language.spoken(comments, ["comment_id"]).select("comment_id", "lang").distinct()


def p3_shares(spark: SparkSession, folder: str) -> DataFrame:
    """(repo, path, lang, letters, share): letters of each language's clauses and their share of the file's comment text.

    Redelivered comments count once. Files without a clause have no row.
    """
    comments = table(spark, folder, "doc_comments").select("repo", "path", "comment_id", "text").where(F.col("text").isNotNull()).distinct()
    found = language.spoken(comments, ["repo", "path", "comment_id"]).groupBy("repo", "path", "lang").agg(F.sum("letters").alias("letters"))
    whole = comments.groupBy("repo", "path").agg(F.sum(F.length("text")).alias("_all"))
    return found.join(whole, ["repo", "path"]).select("repo", "path", "lang", "letters", F.round(F.col("letters") / F.greatest(F.col("_all"), F.lit(1)), 4).alias("share"))


#: How a source listing opens: a comment, an import, an export or a declaration, after one line at most that names a file.
OPENS = (
    r"^[\s\uFEFF]*(?:[^\n]{0,200}[\w-]\.[a-zA-Z]{1,4}[^\n]{0,200}\n\s*)?(?://|/\*|import\b[^\n]*(?:from\b|['\"(;])|export\s+(?:default|async|function|const|let|class|type|interface|enum|abstract|\{|\*)"
    r"|(?:const|let|var)\s+[\w{\[][^\n=]*=|(?:async\s+)?function\b\s*\*?\s*\w+\s*\(|class\s+\w+[^\n]*\{)"
)
#: A fenced block; one that isn't closed reaches to the end.
FENCED = r"(?ms)^[ \t]*(```+|~~~+)[^\n`]*\n(.*?)(?:^[ \t]*\1|\z)"


def code_of(docs: DataFrame) -> DataFrame:
    """(doc_id, chars, text): the source text in each document (doc_id, text, doc_kind), a row per piece; chars of all pieces.

    A listing, by how it opens or by its label, is one piece whole; of other documents each fenced block is
    one. The label is null or wrong at times, so that it only adds to what the text tells.
    """
    listing = F.col("text").rlike(OPENS) | F.coalesce(F.col("doc_kind") == "source_listing", F.lit(False))
    pieces = F.when(listing, F.array("text")).otherwise(F.regexp_extract_all("text", F.lit(FENCED), F.lit(2)))
    chars = F.aggregate("_pieces", F.lit(0).cast("long"), lambda s, x: s + F.length(x))
    own = docs.where(F.col("text").isNotNull()).select("doc_id", pieces.alias("_pieces"))
    return own.select("doc_id", chars.alias("chars"), F.explode("_pieces").alias("text"))


def p3_sources(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, lang, letters, share): languages in the comments and literals of the source text of all documents.

    Each listing or fenced block is segmented as a whole; share is that of the document's source text.
    """
    docs = table(spark, folder, "documents").select("doc_id", "text", "doc_kind")
    found = language.spoken(code_of(docs), ["doc_id", "chars"], source=True).groupBy("doc_id", "chars", "lang").agg(F.sum("letters").alias("letters"))
    return found.select("doc_id", "lang", "letters", F.round(F.col("letters") / F.greatest("chars", F.lit(1)), 4).alias("share"))


QUERIES = {"p3_found": p3_found, "p3_shares": p3_shares, "p3_sources": p3_sources}
ORACLES: dict[str, str] = {}
