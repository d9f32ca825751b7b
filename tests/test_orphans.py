"""References to missing records: runs, as-of match and reasons, against brute force."""

import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from loregraph.operators import orphans

T0 = datetime(2024, 1, 1, tzinfo=timezone.utc)
PARENT = "repo string, node_id string, extracted_at timestamp, deleted_at timestamp"
REF = "ref_id long, repo string, target string, recorded_at timestamp, runs string, _run string"


def test_integer_runs_and_borders(spark):
    keys = [1, 2, 3, 7, 8, 15, 16, 17, 40, None, 3, -5, -4]
    df = spark.createDataFrame([(k,) for k in keys], "k long")
    got = sorted((r["first"], r["end"]) for r in orphans.contiguous_runs(df, "k", block=8).collect())
    assert got == [(-5, -3), (1, 4), (7, 9), (15, 18), (40, 41)]


@pytest.mark.parametrize("block", [4, 1 << 20])
def test_integer_orphans_against_sets(spark, block):
    rng = random.Random(3)
    have = [rng.randrange(-50, 200) for _ in range(120)] + [None]
    refs = [(i, rng.choice([None, *range(-60, 220)])) for i in range(400)] + [(0, 500), (0, 500)]
    got = orphans.integer_orphans(spark.createDataFrame(refs, "id long, ref long"), "ref", spark.createDataFrame([(k,) for k in have], "k long"), "k", block)
    assert sorted(map(tuple, got.collect())) == sorted(r for r in refs if r[1] is not None and r[1] not in set(have))


def test_integer_orphans_empty_tables(spark):
    none = spark.createDataFrame([], "k long")
    some = spark.createDataFrame([(1,), (None,)], "k long")
    assert [r.k for r in orphans.integer_orphans(some, "k", none, "k").collect()] == [1]
    assert orphans.integer_orphans(none, "k", some, "k").count() == 0


def test_lifetimes_against_brute_force(spark):
    rng = random.Random(5)
    day = lambda n: T0 + timedelta(days=n)
    parents = [("r", f"n{rng.randrange(12)}", day(rng.randrange(0, 300)), rng.choice([None, day(rng.randrange(0, 400))])) for _ in range(60)]
    parents += [(None, "n1", day(0), None), ("r", None, day(0), None), ("r", "dead", None, None), ("r", "late", day(200), None), parents[0]]
    refs = [(i, "r", rng.choice([f"n{rng.randrange(14)}", "dead", "late", None]), day(rng.randrange(0, 420)), "x", "y") for i in range(500)]
    refs += [(1000, None, "n1", day(3), "x", "y"), (1001, "r", "gone", None, "x", "y"), (1002, "r", "n1", None, "x", "y")]
    got = {r.ref_id: r.reason for r in orphans.lifetime_orphans(spark.createDataFrame(refs, REF).drop("runs", "_run"), spark.createDataFrame(parents, PARENT)).collect()}
    want = {}
    for i, repo, target, at, *_ in refs:
        if repo is None or target is None:
            continue
        own = [p for p in parents if p[:2] == (repo, target)]
        if not own:
            want[i] = "missing"
        elif at is not None and not any(p[2] and p[2] <= at and (p[3] is None or p[3] > at) for p in own):
            want[i] = "late" if all(p[2] and p[2] > at for p in own) else "deleted"
    assert got == want and set(want.values()) == {"missing", "late", "deleted"}


def test_hot_target_is_split_and_whole(spark):
    refs = spark.range(3000).select(F.col("id").alias("ref_id"), F.lit("r").alias("repo"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("target"), F.lit(T0).alias("recorded_at"))
    parents = spark.createDataFrame([("r", "hot", T0 + timedelta(days=1), None)], PARENT)
    got = orphans.lifetime_orphans(refs, parents).groupBy("reason").count().collect()
    assert {r.reason: r["count"] for r in got} == {"late": 1000, "missing": 2000}
    assert [r[0] for r in orphans.hot_keys(refs, "target", 0.1).collect()] == ["hot"]


def test_clean_ref(spark):
    df = spark.createDataFrame([("./a",), ("././a",), ("A/b",), (None,), ("",)], "t string")
    assert [r[0] for r in df.select(orphans.clean_ref(F.col("t"))).collect()] == ["a", "./a", "A/b", None, ""]


def test_runs_across_ranges_of_blocks(spark, monkeypatch):
    import random

    monkeypatch.setattr(orphans, "WIDER", 2)
    rng = random.Random(5)
    keys = sorted({k for _ in range(12) for a in [rng.randrange(-60, 200)] for k in range(a, a + rng.randrange(1, 40))})
    want, i = [], 0
    while i < len(keys):
        j = i
        while j + 1 < len(keys) and keys[j + 1] == keys[j] + 1:
            j += 1
        want.append((keys[i], keys[j] + 1))
        i = j + 1
    got = orphans.contiguous_runs(spark.createDataFrame([(k,) for k in keys], "k long"), "k", block=4)
    assert sorted((r["first"], r["end"]) for r in got.collect()) == want and len(want) > 3
