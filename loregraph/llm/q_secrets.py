"""Queries of problem 1: credentials embedded in source code."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loregraph.llm import secrets
from loregraph.sources.tables import table

KEYS = ["field", "record_id", "slot"]


def _scanned(spark: SparkSession, folder: str) -> DataFrame:
    functions = table(spark, folder, "function_data").select("func_id", "code_snippet", "key_statements")
    packages = table(spark, folder, "package_json").select("package_id", "scripts")
    return secrets.scan(secrets.places(functions, packages), KEYS)


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """(field, record_id, slot) of each text value that holds a secret."""
    return _scanned(spark, folder).select(*KEYS).distinct()


def p1_redacted(spark: SparkSession, folder: str) -> DataFrame:
    """The same places with their number of secrets and the text in which these are masked."""
    return _scanned(spark, folder).distinct()


def p1_per_field(spark: SparkSession, folder: str) -> DataFrame:
    """Places and secrets per field."""
    return p1_redacted(spark, folder).groupBy("field").agg(F.count(F.lit(1)).alias("places"), F.sum("secrets").alias("secrets"))


QUERIES = {"p1_found": p1_found, "p1_redacted": p1_redacted, "p1_per_field": p1_per_field}
ORACLES: dict[str, str] = {}
