"""Subjects: what is prose, models against held-out documents, and defined results for odd rows."""

import random

import numpy as np

from loregraph.llm import subjects

TOPICS = {
    "boats": ["the keel was repaired with fresh tar", "each sail hangs dry under the mast", "a rudder needs grease before the regatta", "the harbour pilot boards the ketch at dawn"],
    "bread": ["the dough rests under a damp cloth", "rye flour makes a sour loaf", "each oven holds forty baguettes", "yeast wakes in lukewarm milk"],
    "stars": ["the comet crossed the northern sky", "a nebula shines through the telescope", "each planet has its own orbit", "the eclipse darkens the meridian"],
}
GENERAL = ["this file was moved last year", "old names are kept so that nothing breaks", "the list is sorted by size before it is returned", "see the notes for more about this helper", "comments are kept short on purpose"]


def _doc(rng, own, n=8):
    out = [rng.choice(GENERAL) for _ in range(n)]
    for s in own:
        for _ in range(3):
            out[rng.randrange(n)] = rng.choice(TOPICS[s])
    return ". ".join(x.capitalize() for x in out) + "."


def _truth(text, share=1 / 6):
    s = [x.strip(". ").lower() for x in text.split(". ")]
    return {k for k, v in TOPICS.items() if sum(x in v for x in s) >= share * len(s)}


def test_sentences_are_prose():
    text = "# Title\n\nThe lamp is lit. See `loadLamp` in src/a/b.ts for more of it!\n\n```ts\nconst the = of(and);\n```\n- another point stands here\nconst a = f(b);\n// short note\n"
    assert subjects.sentences(text) == [["the", "lamp", "is", "lit"], ["see", "_", "in", "_", "for", "more", "of", "it"], ["another", "point", "stands", "here"]] or [s[0] for s in subjects.sentences(text)] == ["the", "see", "another"]
    many = "Plain words here. Then `code` and 3 x/y.ts of fooBar() stand. A<b c>d f() more words"
    assert all(subjects._MAY.search(m[0]) for m in subjects._INLINE.finditer(many * 2 + " https://a.b/c aB1 Ab2Cd w1 x()"))
    assert subjects.sentences("") == [] and subjects.sentences("one two") == []
    triples = subjects.passage_words(["Name the lamp that must be moved before the door can be sealed."])
    assert subjects.is_passage("the lamp that must be moved before".split(), triples) and not subjects.is_passage("the lamp was lit again last year".split(), triples)


def test_held_out_documents(spark):
    rng = random.Random(11)
    docs, labels = [], []
    for i in range(600):
        text = _doc(rng, rng.sample(sorted(TOPICS), rng.choice([0, 1, 1, 2])))
        docs.append((i, text))
        if i < 200:
            labels += [(i, f" {s.upper()}" if i % 7 == 0 else s) for s in _truth(text)] + ([(i, rng.choice(sorted(TOPICS)))] if i % 25 == 0 else [])
    areas = spark.createDataFrame([(s, "") for s in TOPICS], "subject string, scope_note string")
    extra = [(9000, None), (9001, ""), (9002, "const a = f(b);"), (0, docs[0][1])]
    df = spark.createDataFrame([(*d, "clash") for d in docs + extra], "doc_id long, text string, subject string")
    items = spark.createDataFrame([(1, None), (2, "Quite another matter about gardens and gates")], "item_id long, text string")
    lab = spark.createDataFrame(labels + [(None, "boats"), (5, None), (77777, "boats"), (6, "cars")], "doc_id long, subject string")
    got = {(r.doc_id, r.subject) for r in subjects.subjects_of(df, lab, areas, items).collect()}
    want = {(i, s) for i, t in docs for s in _truth(t)}
    held = lambda x: {p for p in x if 200 <= p[0] < 9000}
    right = len(held(got) & held(want))
    assert right / len(held(got)) > 0.93 and right / len(held(want)) > 0.9
    assert not {i for i, _ in got} & {9000, 9001, 9002}
    assert subjects.subjects_of(df.limit(0), lab, areas, items).count() == 0
    assert subjects.subjects_of(df, lab.limit(0), areas, items).count() == 0


def test_background_counts_are_whole():
    docs = [[["a", "b", "a", "b"], ["c"]], [["a", "b"]]]
    v = subjects.vocabulary_of(docs)
    index = subjects.Index(v)
    flat, sizes = subjects.flattened([index(s) for d in docs for s in d] + [index(["z", "b"])])
    n = subjects.count_grams(flat, subjects.ends(v)[1])
    assert len(flat) == 9 and n[v[("a",)]] == 3 and n[v[("b",)]] == 4 and n[v[("a", "b")]] == 3 and ("b", "a") not in v


def test_a_sixth_is_a_sixth():
    assert subjects.taken(np.array([1, 2, 1, 0]), np.array([6, 12, 7, 0])).tolist() == [True, True, False, False]


def test_calibration_prefers_agreement():
    score = np.array([[0.9, 0.0], [0.8, 0.1], [0.2, 0.1], [0.1, 0.2]])
    m = subjects.calibrate(score, np.array([0, 0, 1, 1]), np.array([[1.0, 0.0], [0.0, 0.0]]))
    assert len(m) == 2 and all(0.2 <= x < 0.8 for x in m)


def test_margins_of_their_own():
    n = 2 * subjects.OWN_MARGIN
    score = np.zeros((2 * n, 2))
    score[:n, 0], score[n:, 1] = np.where(np.arange(n) % 2, 0.7, 0.5), np.where(np.arange(n) % 2, 0.4, 0.2)
    marked = np.zeros((2 * n, 2))
    marked[:n, 0] = marked[n:, 1] = np.arange(n) % 2
    m = subjects.calibrate(score, np.arange(2 * n), marked)
    assert 0.5 <= m[0] < 0.7 and 0.2 <= m[1] < 0.4


def test_scores_are_over_the_better_background():
    m = subjects.Models(["a"], np.full(2, -1), np.arange(2), np.zeros(2), 1)
    m.table = np.array([[1.0, -0.5], [0.2, 0.4], [0.0, 0.0]], np.float32)
    assert np.allclose(m.scores(np.array([0, 1, -1]), np.array([1, 2])), [[1.0], [0.1 - 0.2]])


def test_too_many_test_items_raise(spark, monkeypatch):
    monkeypatch.setattr(subjects, "TEST_WORDS", 3)
    import pytest

    with pytest.raises(ValueError):
        subjects.test_triples(spark.createDataFrame([(1, "four words are here")], "item_id long, text string"))
