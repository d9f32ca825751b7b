"""References to records that do not exist.

The keys that a parent table holds are compressed into contiguous runs: a sorted sequence of integer
intervals ``[first, end)`` in which every integer is held. A reference is matched as of its own
integer to the preceding run start; it is an orphan when there is no such run, or when it lies at or
beyond that run's end.

Two uses:

* ``integer_orphans``: the integers are the parent's keys themselves (1, 2, 3, 7 -> [1, 4), [7, 8)).
* ``lifetime_orphans``: the integers are the microseconds at which a parent is alive, so a parent that
  was extracted, deleted and extracted again has two runs, and a reference recorded in the gap is an
  orphan although the key exists.

Neither sorts a whole table in one task: runs are first made inside ranges of fixed width (a block of
integers, a month of a parent's life), and only those few runs are put together afterwards.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Integers per range in which runs are made; also the range in which references are matched.
BLOCK = 1 << 20
#: Blocks whose border runs are put together at a time.
WIDER = 1 << 10
#: A reference key with more than this share of all references is salted; there are at most 1/HOT such keys.
HOT = 0.002
#: Parts into which the references of such a key are split.
SALTS = 16
#: Later than any timestamp: the end of a life that hasn't ended.
FOREVER = (1 << 63) - 1


def runs(df: DataFrame, by: list[str], first: str, end: str) -> DataFrame:
    """Overlapping or touching intervals ``[first, end)`` of each group put together: (*by, first, end).

    Intervals with a null bound or ``end < first`` are left out; an empty one (``end = first``) outside all
    others stays as an empty run. Ordered by ``first``, an interval opens a run when it starts beyond every
    end before it.
    """
    w = Window.partitionBy(*by).orderBy(first, end)
    reach = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    opened = (
        df.where(F.col(first) <= F.col(end))
        .select(*by, first, end)
        .withColumn("_new", F.when(reach.isNull() | (F.col(first) > reach), 1).otherwise(0))
        .withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    )
    return opened.groupBy(*by, "_run").agg(F.min(first).alias(first), F.max(end).alias(end)).drop("_run")


def integer_runs(parents: DataFrame, key: str, block: int = BLOCK) -> DataFrame:
    """(block, first, end) for the integers in ``key``; runs end at block borders. Nulls hold no key.

    Duplicates fall together on the map side, before the shuffle. A group of the window holds at most
    ``block`` distinct integers, whatever the size or skew of the table.
    """
    k = F.col(key).cast("long")
    distinct = parents.where(k.isNotNull()).select(k.alias("first")).distinct()
    cells = distinct.select(F.floor(F.col("first") / F.lit(block)).cast("long").alias("block"), "first", (F.col("first") + 1).alias("end"))
    return runs(cells, ["block"], "first", "end")


def contiguous_runs(parents: DataFrame, key: str, block: int = BLOCK) -> DataFrame:
    """(first, end) over the whole key space: runs that touch at a block border are put together.

    Only runs that reach a border go on, at most two per block: first inside ranges of WIDER blocks, then those
    that reach the border of such a range, so that the last step sees two runs per WIDER * ``block`` integers.
    """
    done = None
    r = integer_runs(parents, key, block).select("first", "end")
    for width in (block, block * WIDER):
        edge = (F.pmod(F.col("first"), F.lit(width)) == 0) | (F.pmod(F.col("end"), F.lit(width)) == 0)
        inner = r.where(~edge)
        done = inner if done is None else done.unionByName(inner)
        by = F.floor(F.col("first") / F.lit(width * WIDER)) if width == block else F.lit(0)
        r = runs(r.where(edge).withColumn("_by", by.cast("long")), ["_by"], "first", "end").drop("_by")
    return done.unionByName(r)


def integer_orphans(refs: DataFrame, ref_key: str, parents: DataFrame, key: str, block: int = BLOCK) -> DataFrame:
    """The rows of ``refs`` whose non-null integer key no row of ``parents`` has, with all their columns.

    The match as of the preceding run start is a window over run starts and distinct references inside
    one block, so no window holds more than twice ``block`` rows, however large or skewed the tables.
    Repeated rows stay repeated; null references aren't orphans; with no parents every non-null
    reference is an orphan.
    """
    k = F.col(f"`{ref_key}`").cast("long")
    own = refs.where(k.isNotNull()).withColumn("_key", k)
    asked = own.select("_key").distinct().select(F.floor(F.col("_key") / F.lit(block)).cast("long").alias("block"), F.col("_key").alias("first"), F.lit(None).cast("long").alias("end"))
    both = integer_runs(parents, key, block).unionByName(asked).withColumn("_asked", F.col("end").isNull())
    w = Window.partitionBy("block").orderBy("first", "_asked").rowsBetween(Window.unboundedPreceding, 0)
    met = both.withColumn("_end", F.last("end", ignorenulls=True).over(w)).where("_asked")
    lost = met.where(F.col("_end").isNull() | (F.col("first") >= F.col("_end"))).select(F.col("first").alias("_key"))
    return own.join(lost, "_key", "left_semi").drop("_key")


def preceding(sorted_runs: Column, at: Column) -> Column:
    """The last struct of a sorted array whose ``first`` is at most ``at``, or null."""
    return F.try_element_at(F.filter(sorted_runs, lambda r: r["first"] <= at), F.lit(-1))


def clean_ref(ref: Column) -> Column:
    """A reference without one leading ``./``; case stays."""
    return F.when(ref.startswith("./"), F.substring(ref, 3, 1 << 30)).otherwise(ref)


def lifetimes(parents: DataFrame, keys: list[str], since: str = "extracted_at", until: str = "deleted_at") -> DataFrame:
    """(*keys, runs array<struct<first, end>>): the microseconds at which each parent is alive, in order.

    A row is alive from ``since`` until just before ``until``, or for good if that is null. A row that
    is deleted no later than it was extracted leaves an empty run, and one with a null ``since`` an empty
    run before all time: it is known, but never alive. Rows with a null key are left out.

    Runs are made per key and month of ``since`` first, then over those, so that a key with a huge history
    is no single task.
    """
    first = F.coalesce(F.unix_micros(F.col(since).cast("timestamp")), F.lit(-FOREVER))
    end = F.coalesce(F.unix_micros(F.col(until).cast("timestamp")), F.lit(FOREVER))
    rows = parents.select(
        *keys,
        F.date_trunc("month", F.col(since).cast("timestamp")).alias("_month"),
        first.alias("first"),
        F.when(F.col(since).isNull(), F.lit(-FOREVER)).otherwise(F.greatest(first, end)).alias("end"),
    ).dropna(subset=keys)
    alive = runs(runs(rows, [*keys, "_month"], "first", "end"), keys, "first", "end")
    return alive.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("first", "end"))).alias("runs"))


def hot_keys(refs: DataFrame, key: str, share: float = HOT) -> DataFrame:
    """At most ``1/share`` keys that may be hot, from a sketch of frequent items (no sort, no full count)."""
    k = round(1 / share)
    top = refs.agg(F.expr(f"approx_top_k(`{key}`, {k}, {8 * k})").alias("t"), F.count(F.lit(1)).alias("n"))
    each = top.select(F.explode("t").alias("e"), "n").select(F.col("e.item").alias(key), F.col("e.count").alias("c"), "n")
    return each.where(F.col("c") > F.lit(share) * F.col("n")).select(key)


def lifetime_orphans(refs: DataFrame, parents: DataFrame, at: str = "recorded_at") -> DataFrame:
    """The rows of ``refs`` (repo, target, ``at``, ...) whose target isn't alive then, with a ``reason``.

    ``parents``: (repo, node_id, extracted_at, deleted_at). ``missing``: no row of the target at all;
    ``late``: its first row is extracted after the reference; ``deleted``: otherwise. References with a
    null repo or target are none. A reference with a null time is an orphan only if its target is missing.

    References crowd on few targets, so the frequent ones (from a sketch) are split by a hash of the row
    and their runs, one row each, are repeated for each part. The list of frequent targets has at most
    ``1/HOT`` rows, whatever the input, and is broadcast.
    """
    own = refs.where(F.col("repo").isNotNull() & F.col("target").isNotNull()).withColumn("_at", F.unix_micros(F.col(at).cast("timestamp")))
    own = own.withColumn("_key", F.concat_ws("\n", "repo", "target"))
    hot = hot_keys(own, "_key").withColumn("_hot", F.lit(True))
    plain = [c for c, t in own.dtypes if "map<" not in t]
    part = F.when(F.col("_hot"), F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in plain]), F.lit(SALTS))).otherwise(0).cast("int")
    own = own.join(F.broadcast(hot), "_key", "left").withColumn("_part", part).drop("_hot")
    lives = lifetimes(parents, ["repo", "node_id"]).select(F.concat_ws("\n", "repo", "node_id").alias("_key"), "runs")
    parts = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    lives = lives.join(F.broadcast(hot), "_key", "left").withColumn("_part", F.explode(parts)).drop("_hot")
    met = own.join(lives, ["_key", "_part"], "left").withColumn("_run", preceding(F.col("runs"), F.col("_at")))
    reason = (
        F.when(F.col("runs").isNull(), "missing")
        .when(F.col("_at").isNull(), None)
        .when(F.col("_run").isNull(), "late")
        .when(F.col("_at") >= F.col("_run.end"), "deleted")
    )
    return met.withColumn("reason", reason).where(F.col("reason").isNotNull()).drop("_key", "_part", "_at", "runs", "_run")
