"""Leaks: suffix arrays and matches against brute force, passages with changes, and common wording."""

import random

import numpy as np

from loregraph.llm import leaks

ITEM = "Name the lamp that must be moved before the cellar door of HouseKeeper can be sealed, knowing that 412 callers still expect a green ladder with handle attached. Reviewers accept openDoor or its wrapper if the ladder limit of 4 is stated."
CLOSING = " Answer with the file path and the name of the exported function only."


def test_suffix_array_against_sorting():
    rng = random.Random(2)
    for n in (1, 2, 50, 300):
        text = np.array([rng.randrange(4) for _ in range(n)], np.int64)
        sa = leaks.suffix_array(text, 1 << 10)
        assert [tuple(text[i:]) for i in sa] == sorted(tuple(text[i:]) for i in range(n))


def test_matches_against_brute_force():
    rng = random.Random(4)
    docs = [np.array([rng.randrange(1, 6) for _ in range(rng.randrange(0, 60))], np.int64) for _ in range(12)]
    texts = [np.array([rng.randrange(1, 7) for _ in range(25)], np.int64) for _ in range(3)]
    items = leaks.Items([1, 2, 3], texts)
    common = leaks.common_wording(texts)
    want = set()
    for d, doc in enumerate(docs):
        for k, t in enumerate(texts):
            for p in range(len(t)):
                for q in range(len(doc)):
                    n = 0
                    while p + n < len(t) and q + n < len(doc) and t[p + n] == doc[q + n]:
                        n += 1
                    goes_left = p > 0 and q > 0 and t[p - 1] == doc[q - 1]
                    if not goes_left and n >= leaks.SEED and not common[k][p : p + n - leaks.SEED + 1].all():
                        want.add((d, k, p, q, n))
    got = list(zip(*(x.tolist() for x in leaks.matches(docs, items)), strict=True))
    assert set(got) == want and want and len(got) == len(want)


def test_matches_with_common_wording_and_short_items(monkeypatch):
    rng = random.Random(9)
    shared = [rng.randrange(1, 50) for _ in range(7)]
    texts = [np.array([*(rng.randrange(1, 50) for _ in range(9)), *shared, *(rng.randrange(1, 50) for _ in range(5))], np.int64) for _ in range(4)]
    texts += [np.array([7, 8], np.int64), np.array(shared, np.int64), np.array(shared, np.int64)]
    items = leaks.Items(list(range(7)), texts)
    docs = [texts[0][3:], np.array(shared, np.int64), texts[1][:12], np.array([1, 7, 8, 2], np.int64)] * 3
    got = set(zip(*(x.tolist() for x in leaks.matches(docs, items)), strict=True))
    assert (0, 0, 3, 0, 18) in got and (2, 1, 0, 0, 12) in got and (3, 4, 0, 1, 2) in got
    assert (1, 5, 0, 0, 7) in got and not any(d == 1 and k < 4 for d, k, *_ in got)  # common wording counts only as a whole item
    assert items.counts[0][-1] == 14 + 6  # of the shared seven words, three on either side stand in wording of its own
    monkeypatch.setattr(leaks, "CHUNK", 2)
    assert set(zip(*(x.tolist() for x in leaks.matches(docs, items)), strict=True)) == got


def test_common_wording_over_all_blocks(spark, monkeypatch):
    items = spark.createDataFrame([(i, f"alpha{i} beta{i} gamma{i} delta{i} one two three four five") for i in range(4)] + [(9, "")], "item_id long, text string")
    rows = {r.item_id: sorted(r.common) for r in leaks.read_items(items).collect()}
    assert rows == {0: [4, 5], 1: [4, 5], 2: [4, 5], 3: [4, 5], 9: []}
    monkeypatch.setattr(leaks, "ITEM_BLOCK", 10)
    assert [len(b.ids) for b in leaks._blocks(leaks.read_items(items))] == [1, 1, 1, 2]
    docs = spark.createDataFrame([(1, "x alpha2 beta2 gamma2 delta2 one y"), (2, "one two three four five")], "doc_id long, text string")
    assert [(r.doc_id, r.item_id) for r in leaks.leaked(docs, items).collect()] == [(1, 2)]


def test_a_long_tag_is_markup(spark):
    tagged = ITEM.replace(" lamp ", " lamp <a href='" + "x/" * 100 + "'>", 1)
    df = spark.createDataFrame([(1, " ".join(tagged.split()[:22]))], "doc_id long, text string")
    got = leaks.leaked(df, spark.createDataFrame([(1, ITEM)], "item_id long, text string")).collect()
    assert [r.matched for r in got] == [got[0].spanned]


def _words(text):
    return text.split()


def test_table(spark):
    w = ITEM.split()
    part = " ".join(w[: int(0.6 * len(w))])
    changed = " ".join(x if i % 9 else f"{x} really" for i, x in enumerate(w))
    loud = "> * " + "\n> ".join(f"<b>{x.upper()}</b>" for x in w)
    docs = [
        (1, "Before. " + ITEM + CLOSING + " After."), (2, "x " * 30 + part + " y" * 30), (3, changed), (4, loud), (5, " ".join(w[:6]) + " and so on"), (6, "Something." + CLOSING), (7, None), (8, ""), (9, "lamp " * 20000 + ITEM), (1, "Before. " + ITEM + " After."),
    ]
    items = [(10, ITEM + CLOSING), (11, "Quite another question on garden gates and how they rust in wet weather near the sea." + CLOSING), (12, "A third one, about boats that leak while nobody looks after their planks." + CLOSING), (13, None), (14, ""), (10, ITEM + CLOSING)]
    df = spark.createDataFrame([(*d, "clash") for d in docs], "doc_id long, text string, item_id string")
    got = leaks.leaked(df, spark.createDataFrame(items, "item_id long, text string"))
    assert {(r.doc_id, r.item_id) for r in got.collect()} == {(d, 10) for d in (1, 2, 3, 4, 9)}
    assert leaks.leaked(df.limit(0), spark.createDataFrame(items, "item_id long, text string")).count() == 0
    assert leaks.leaked(df, spark.createDataFrame([], "item_id long, text string")).count() == 0


def test_passages_follow_both_texts():
    assert leaks.passages([(0, 100, 5), (6, 107, 6), (40, 0, 9)], 60)[:2] == (12, 11)
    assert leaks.passages([(0, 100, 5), (6, 300, 6)], 60)[:2] == (6, 6)
    assert leaks.passages([], 60) == (0, 0, 0, 0)
