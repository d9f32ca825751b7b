"""Queries of problem 4: functions paired with their documentation."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loregraph.llm import pairs
from loregraph.sources.tables import table


def _pairs(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    return pairs.newest(pairs.paired(table(spark, folder, "function_data"), table(spark, folder, "file_nodes"), *columns), "kept", *columns)


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """(func_id) of the functions with code whose description tells something beyond the name."""
    return _pairs(spark, folder).where("kept").select("func_id")


def p4_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """(func_id, signature, code, comment, description) worth keeping; comment is what stands beside the signature in the code itself."""
    return _pairs(spark, folder, "signature", "code", "comment", "description").where("kept").drop("kept")


def p4_signatures(spark: SparkSession, folder: str) -> DataFrame:
    """(func_id, name, signature) as read from each function's code, without the words that export it."""
    rows = pairs.parsed(table(spark, folder, "function_data"), "signature")
    return rows.select("func_id", "name", F.regexp_replace("signature", r"^(?:export\s+)?(?:default\s+)?", "").alias("signature")).distinct()


def p4_listings(spark: SparkSession, folder: str) -> DataFrame:
    """The functions of every document's source text with their attached comments, one row each."""
    docs = table(spark, folder, "documents").where(F.col("text").isNotNull()).select("doc_id", "text")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            got = [(d, f.start_line, f.name, f.signature, f.body, f.description) for d, t in zip(pdf["doc_id"], pdf["text"], strict=True) for f in pairs.functions_of(t) if pairs.informative(f.description, f.name)]
            yield pd.DataFrame(got, columns=["doc_id", "line", "name", "signature", "code", "description"])

    return docs.mapInPandas(run, "doc_id long, line int, name string, signature string, code string, description string")


QUERIES = {"p4_found": p4_found, "p4_pairs": p4_pairs, "p4_signatures": p4_signatures, "p4_listings": p4_listings}
ORACLES: dict[str, str] = {
    "p4_signatures": "SELECT DISTINCT func_id, func_name AS name, trim(regexp_replace(signature, '\\s+', ' ', 'g')) AS signature FROM function_data WHERE trim(code_snippet) <> ''"
}
