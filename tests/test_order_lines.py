"""Order lines against all orders, some keys missing."""

from datetime import date

from loregraph.plans import orphans


def test_order_lines(spark, tmp_path):
    spark.createDataFrame([(1, 1), (2, 2), (3, 3), (7, 4)], "o_orderkey long, o_custkey long").write.parquet(f"{tmp_path}/orders.parquet")
    lines = [(1, 1, date(1995, 1, 2)), (3, 1, date(1995, 1, 3)), (4, 1, date(1995, 1, 4)), (4, 2, date(1995, 2, 4)), (7, 1, date(1995, 2, 1)), (8, 1, date(1995, 2, 2)), (None, 1, date(1995, 2, 2))]
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_shipdate date").write.parquet(f"{tmp_path}/lineitem.parquet")
    assert {tuple(r) for r in orphans.p5_order_lines(spark, str(tmp_path)).collect()} == {("1995-01", 1), ("1995-02", 2)}
