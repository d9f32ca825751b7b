"""The SQL of this package's queries, on the smallest tables."""

import os

import pytest

from loregraph.llm import queries

DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no tables")


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query(spark, name):
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    for f in os.listdir(DIR):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{DIR}/{f}'")
    df = queries.QUERIES[name](spark, DIR)
    cols = sorted(df.columns)
    got = sorted(repr([r[x] for x in cols]) for r in df.collect())
    res = c.execute(queries.ORACLES[name])
    names = [d[0] for d in res.description]
    assert sorted(names) == cols
    assert got == sorted(repr([r[names.index(x)] for x in cols]) for r in res.fetchall())


def test_every_module_is_there():
    assert {n.split("_")[0] for n in queries.QUERIES} == {"p1", "p2", "p3", "p4", "p6", "p7", "p8"}
