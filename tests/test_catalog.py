"""Every query that has SQL, against DuckDB on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry

DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no tables")


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for f in os.listdir(DIR):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{DIR}/{f}'")
    return c


def plain(v):
    if isinstance(v, float):
        return round(v, 6)
    if isinstance(v, list):
        return [plain(x) for x in v]
    return v.isoformat()[:19] if hasattr(v, "isoformat") else v


@pytest.mark.parametrize("name", sorted(n for n in entry.oracle_sql() if not n.startswith(("p1_", "p2_", "p3_", "p4_", "p6_", "p7_", "p8_"))))
def test_query(spark, duck, name):
    df = entry.queries()[name](spark, DIR)
    cols = sorted(df.columns)
    got = sorted(repr([plain(r[c]) for c in cols]) for r in df.collect())
    res = duck.execute(entry.oracle_sql()[name])
    names = [d[0] for d in res.description]
    assert sorted(names) == cols
    assert got == sorted(repr([plain(r[names.index(c)]) for c in cols]) for r in res.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
