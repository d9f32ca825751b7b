"""Queries of problem 5: references to records that do not exist."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loregraph.operators import orphans
from loregraph.sources.tables import table

#: Table, its id and its reference.
REFERENCES = (("edges", "edge_id", "edge_target"), ("cross_file_calls", "call_id", "callee"), ("resolved_symbols", "symbol_id", "source_file"))


def references(spark: SparkSession, folder: str) -> DataFrame:
    """(ref_table, ref_id, repo, target, recorded_at) of the three tables."""
    out = None
    for name, key, ref in REFERENCES:
        one = table(spark, folder, name).select(F.lit(name).alias("ref_table"), F.col(key).alias("ref_id"), "repo", orphans.clean_ref(F.col(ref)).alias("target"), "recorded_at")
        out = one if out is None else out.unionByName(one)
    return out


def parents(spark: SparkSession, folder: str) -> DataFrame:
    cols = ["repo", "node_id", "extracted_at", "deleted_at"]
    return table(spark, folder, "file_nodes").select(*cols).unionByName(table(spark, folder, "function_data").select(*cols))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """(ref_table, ref_id, ref_period, reason) of each orphan; redelivered rows count once."""
    lost = orphans.lifetime_orphans(references(spark, folder), parents(spark, folder))
    return lost.select("ref_table", "ref_id", F.date_format("recorded_at", "yyyy-MM").alias("ref_period"), "reason").distinct()


def p5_report(spark: SparkSession, folder: str) -> DataFrame:
    """Orphans per table, month and reason."""
    return p5_found(spark, folder).groupBy("ref_table", "ref_period", "reason").agg(F.count(F.lit(1)).alias("orphans"))


def p5_open_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Integer keys: order lines whose order isn't among the finished ones, per month."""
    orders = table(spark, folder, "orders").where("o_orderstatus = 'F'")
    lines = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate")
    lost = orphans.integer_orphans(lines, "l_orderkey", orders, "o_orderkey")
    return lost.groupBy(F.date_format("l_shipdate", "yyyy-MM").alias("ship_month")).agg(F.count(F.lit(1)).alias("orphans"))


def p5_order_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Integer keys: order lines whose order isn't among all orders, per month; no rows where every line has its order."""
    lines = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate")
    lost = orphans.integer_orphans(lines, "l_orderkey", table(spark, folder, "orders"), "o_orderkey")
    return lost.groupBy(F.date_format("l_shipdate", "yyyy-MM").alias("ship_month")).agg(F.count(F.lit(1)).alias("orphans"))


def p5_key_runs(spark: SparkSession, folder: str) -> DataFrame:
    """The contiguous runs of order keys that have order lines."""
    return orphans.contiguous_runs(table(spark, folder, "lineitem"), "l_orderkey", block=1 << 16).select(F.col("first").alias("first_key"), (F.col("end") - 1).alias("last_key"))


QUERIES = {"p5_found": p5_found, "p5_report": p5_report, "p5_open_lines": p5_open_lines, "p5_order_lines": p5_order_lines, "p5_key_runs": p5_key_runs}

_FOUND = """
WITH r AS (
  SELECT 'edges' AS ref_table, edge_id AS ref_id, repo, edge_target AS t0, recorded_at AS t FROM edges
  UNION ALL SELECT 'cross_file_calls', call_id, repo, callee, recorded_at FROM cross_file_calls
  UNION ALL SELECT 'resolved_symbols', symbol_id, repo, source_file, recorded_at FROM resolved_symbols),
q AS (SELECT DISTINCT ref_table, ref_id, repo, CASE WHEN t0 LIKE './%' THEN substr(t0, 3) ELSE t0 END AS target, t FROM r WHERE t0 IS NOT NULL),
p AS (SELECT repo, node_id, extracted_at, deleted_at FROM file_nodes UNION ALL SELECT repo, node_id, extracted_at, deleted_at FROM function_data),
j AS (SELECT q.ref_table, q.ref_id, q.t, count(p.node_id) AS n,
        coalesce(bool_or(p.extracted_at <= q.t AND (p.deleted_at IS NULL OR p.deleted_at > q.t)), false) AS alive,
        coalesce(bool_and(p.extracted_at > q.t), false) AS late
      FROM q LEFT JOIN p ON q.repo = p.repo AND q.target = p.node_id GROUP BY q.ref_table, q.ref_id, q.target, q.repo, q.t)
SELECT DISTINCT ref_table, ref_id, strftime(t AT TIME ZONE 'UTC', '%Y-%m') AS ref_period,
  CASE WHEN n = 0 THEN 'missing' WHEN late THEN 'late' ELSE 'deleted' END AS reason
FROM j WHERE NOT alive
"""

ORACLES = {
    "p5_found": _FOUND,
    "p5_report": f"SELECT ref_table, ref_period, reason, count(*) AS orphans FROM ({_FOUND}) x GROUP BY ALL",
    "p5_open_lines": """SELECT strftime(l_shipdate, '%Y-%m') AS ship_month, count(*) AS orphans FROM lineitem
        WHERE l_orderkey IS NOT NULL AND l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_orderkey IS NOT NULL) GROUP BY 1""",
    "p5_order_lines": """SELECT strftime(l_shipdate, '%Y-%m') AS ship_month, count(*) AS orphans FROM lineitem
        WHERE l_orderkey IS NOT NULL AND l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderkey IS NOT NULL) GROUP BY 1""",
    "p5_key_runs": """WITH d AS (SELECT DISTINCT l_orderkey AS k FROM lineitem WHERE l_orderkey IS NOT NULL), g AS (SELECT k, k - row_number() OVER (ORDER BY k) AS r FROM d)
        SELECT min(k) AS first_key, max(k) AS last_key FROM g GROUP BY r""",
}
