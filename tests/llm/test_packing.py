"""Packing: nothing lost or cut without need, containers never over-full, and close to the optimum."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from loregraph.llm import packing


def optimum(sizes, capacity):
    """Fewest containers, by trying every item in every open container."""
    best = len(sizes)
    sizes = sorted(sizes, reverse=True)

    def go(i, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if i == len(sizes):
            best = len(rooms)
            return
        for r in sorted({r for r in rooms if r >= sizes[i]}):
            k = rooms.index(r)
            go(i + 1, [*rooms[:k], r - sizes[i], *rooms[k + 1 :]])
        go(i + 1, [*rooms, capacity - sizes[i]])

    go(0, [])
    return best


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 100), max_size=120))
def test_no_container_is_over_full(sizes):
    where, place = packing.pack(np.array(sizes, np.int64), 100)
    assert all(w >= 0 for w in where)
    for c in set(where.tolist()):
        own = np.flatnonzero(where == c)
        assert sum(sizes[i] for i in own) <= 100 and sorted(place[own].tolist()) == list(range(len(own)))


def test_against_the_optimum():
    rng = random.Random(3)
    for _ in range(25):
        sizes = [rng.randrange(5, 70) for _ in range(10)]
        where, _ = packing.pack(np.array(sizes, np.int64), 100)
        assert len(set(where.tolist())) <= optimum(sizes, 100) + 1


def test_close_to_the_lower_bound():
    rng = np.random.default_rng(1)
    sizes = np.minimum(rng.lognormal(5.5, 1.0, 15000).astype(np.int64) + 1, 2048)
    where, _ = packing.pack(sizes, 2048)
    assert sizes.sum() / (2048 * (where.max() + 1)) > 0.99


def test_configuration_fills_best():
    rng = random.Random(5)
    for _ in range(50):
        size = sorted({rng.randrange(13, 100) for _ in range(5)}, reverse=True)
        left = [rng.randrange(1, 5) for _ in size]
        got = packing.configuration(size, left, 100)
        sums = {0}
        for s, k in zip(size, left):
            sums = {a + s * j for a in sums for j in range(k + 1) if a + s * j <= 100}
        assert all(0 <= a <= k for a, k in zip(got, left)) and sum(a * s for a, s in zip(got, size)) == max(sums)


def test_token_counts_are_those_of_the_whole_text(spark, tmp_path):
    tiktoken = pytest.importorskip("tiktoken")
    import base64

    ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in open(packing.TOKENIZER, "rb"))}
    enc = tiktoken.Encoding("t", pat_str=packing.PATTERN, mergeable_ranks=ranks, special_tokens={})
    long = ("The lamp isn't lit,  yet\n\n  it <|endoftext|> burns ünd 12345 🙂 " * 9000)[:-3]
    rows = [(1, "Hello there"), (2, ""), (3, None), (4, long), (None, "x y")]
    got = {r.doc_id: r.tokens for r in packing.token_counts(spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, tokens int")).collect()}
    assert got == {i: len(enc.encode_ordinary(t or "")) for i, t in rows} and len(packing.chunks(long)) > 2 and "".join(packing.chunks(long)) == long


def test_table_round_trip(spark):
    rng = random.Random(9)
    items = [(i, rng.choice([0, 1, 40, 100, 101, 250, 1000, rng.randrange(1, 90)])) for i in range(400)]
    df = spark.createDataFrame([*items, items[0], (None, 30), (7777, None)], "doc_id long, tokens long")
    caps = spark.createDataFrame([(1, 100), (2, 700), (3, None), (4, 0)], "capacity_id long, capacity_tokens int")
    out = packing.packed(df, caps, block=100).collect()
    for cid, cap in ((1, 100), (2, 700)):
        own = [r for r in out if r.capacity_id == cid]
        pieces = {}
        for r in own:
            pieces.setdefault(r.doc_id, []).append((r.first_token, r.tokens))
        assert set(pieces) == {i for i, _ in items} | {None}
        for i, n in [*items, (None, 30)]:
            p = sorted(pieces[i])
            assert sum(t for _, t in p) == n and [a for a, _ in p] == [sum(t for _, t in p[:k]) for k in range(len(p))] and (len(p) == 1 or n > cap)
        fill, spots = {}, {}
        for r in own:
            fill[r.container_id] = fill.get(r.container_id, 0) + r.tokens
            spots.setdefault(r.container_id, []).append(r.position)
        assert max(fill.values()) <= cap and all(sorted(s) == list(range(len(s))) for s in spots.values())
    assert {r.capacity_id for r in out} == {1, 2} and len({r.container_id.split("-")[0] for r in out}) > 1
    assert packing.packed(df.limit(0), caps).count() == 0 and packing.packed(df, caps.limit(0)).count() == 0
