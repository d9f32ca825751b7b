"""Subject areas of documents.

One interpolated word n-gram model per subject, trained on documents with labels, against two background
models: one counted over all documents, and one of the labelled documents' sentences about no subject. A
sentence is about the subject whose per-token cross-entropy is lowest, if it lies below that of the better
background by a margin, calibrated for each subject on documents that weren't fitted to; a document has every
subject that a sixth of its sentences are about.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loregraph.session import cut

#: Labelled documents that the subject models are fitted to, at most; the choice is by a hash of the id.
TRAIN_DOCS = 4000
#: Share of a document's sentences that a subject takes.
SHARE = 1 / 6
#: Weights of a subject's own bigram and unigram estimates; the rest is the background's.
OWN2, OWN1 = 0.40, 0.45
#: Occurrences of a word at which half of the bigram's weight goes to what followed it.
HELD = 1.0
#: Weight of the background's bigram estimate against its unigram estimate.
BACK2 = 0.5
#: Rounds in which the sentences of labelled documents are assigned and the models fitted anew.
ROUNDS = 4
#: Bonus, per token, of a subject that the document is labelled with.
LABELLED = 0.10
#: Margin, per token, beyond which a labelled document's sentence is assigned to a subject in fitting.
ASSIGN = 0.2
#: Margins among which calibration chooses, and labelled documents that a subject must have for one of its own.
MARGINS = np.round(np.arange(0.0, 0.95, 0.05), 2)
OWN_MARGIN = 60
#: Words of test items that are broadcast at most, to tell their passages.
TEST_WORDS = 4_000_000

_FENCE = re.compile(r"```[\s\S]*?(?:```|\Z)")
_CODE_LINE = re.compile(r"^\s*+(?:(?:export|import|const|let|var|return|throw|for|while|if|else|switch|case|function|async|class|interface|type|await|void)\b.*[{};()=]|(?:[\w.\[\]$][\w\[\]$]*+\.|[\w.\[\]$]++\s*[(=]).*[;{(]\s*$|[{}()\[\];,]+\s*$|@\w|[\w./-]+\.(?:ts|js|tsx|jsx|json|md)\s*$)")
_INLINE = re.compile(r"`[^`\n]*`|<[^<>\n]+>|\bhttps?://\S+|(?<![\w.-])(?:[\w.-]+/)+[\w.-]+|\b[a-z]+[A-Z]\w*(?:\(\))?|\b[A-Z][a-z]+[A-Z]\w*|\b\w+\(\)|\b\w*\d\w*\b")
_BREAK = re.compile(r"(?<=[.!?;:])\s+(?=[^\sa-zß-öø-ÿ])|\n\s*(?:\n|[-*+>#]|\d+[.)]|/\*+|//|\*)\s*|(?<=[.!?])\s+")
_SHORT_NOTE = re.compile(r"^\s*(?://|#)\s*\S+(?:\s+\S+){0,4}\s*$")
_PREFIX = re.compile(r"^\s*(?:[-*+>#]+|//+|/\*+)\s*")
#: What every match of _INLINE holds: sentences without it needn't be searched.
_MAY = re.compile(r"[`</\d]|[a-z][A-Z]|\(\)")
_WORD = re.compile(r"[^\W\d_]+(?:[-'’][^\W\d_]+)*")
#: Words a sentence has at least.
LEAST = 3


def sentences(text: str) -> list[list[str]]:
    """The prose sentences of a document as lower-case words: no code, identifiers, paths or headings of one or two words."""
    prose = "\n".join(x for x in _FENCE.sub("\n\n", text).split("\n") if not x or not _SHORT_NOTE.match(x) and not _CODE_LINE.match(_PREFIX.sub("", x)))
    out = []
    for s in _BREAK.split(prose):
        w = _WORD.findall((_INLINE.sub(" _ ", s) if _MAY.search(s) else s).lower())
        if len(w) >= LEAST:
            out.append(w)
    return out


def passage_words(texts: Iterable[str]) -> set[tuple[str, ...]]:
    """Word triples of test items, by which their passages are told in documents."""
    return {tuple(w[i : i + 3]) for t in texts for w in [re.findall(r"[^\W_]+", t.lower())] for i in range(len(w) - 2)}


def is_passage(s: list[str], triples: set[tuple[str, ...]]) -> bool:
    """Whether a sentence is mostly made of a test item's wording."""
    n = len(s) - 2
    return n > 0 and sum(map(triples.__contains__, zip(s, s[1:], s[2:], strict=False))) >= max(2, 0.4 * n)


class Models:
    """Subject models and background over the n-grams of the labelled sentences.

    ``tail`` and ``head``: the last and the first word of each n-gram, as numbers; a word has no head.
    """

    def __init__(self, subjects: list[str], head: np.ndarray, tail: np.ndarray, back: np.ndarray, back_total: int) -> None:
        self.subjects, self.head, self.tail = subjects, head, tail
        self.counts = np.zeros((len(tail), len(subjects) + 1))  # the last column: sentences about no subject
        self.back, self.back_total = back.astype(float), float(max(back_total, 1))
        self.table: np.ndarray | None = None
        self.margin = np.full(len(subjects), 0.3)

    def fit(self) -> None:
        """Log-ratio tables: per n-gram, each subject's interpolated probability over the background's."""
        uni = self.head < 0
        n_uni = max(int(uni.sum()), 1)
        b1 = (self.back + 0.5) / (self.back_total + 0.5 * n_uni)
        head, tail = np.where(uni, 0, self.head), self.tail
        own = self.counts[uni].sum(0)
        s1 = np.where(uni[:, None], self.counts, 0) / np.maximum(own, 1)
        bg = np.where(uni, b1, BACK2 * self.back / np.maximum(self.back[head], 1) + (1 - BACK2) * b1[tail])
        held = self.counts[head]
        s2 = self.counts / np.maximum(held, 1)
        w2 = np.where(uni[:, None], 0, OWN2 * held / (held + HELD))
        mix = w2 * s2 + OWN1 * s1[tail] + (1 - OWN1 - w2) * bg[:, None]
        self.table = np.zeros((len(mix) + 1, mix.shape[1]), np.float32)  # the last row: words that aren't known
        self.table[:-1] = np.log(mix) - np.log(bg)[:, None]
        if own[-1] == 0:  # before any sentence is assigned, the background stands in for no subject
            self.table[:, -1] = 0

    def scores(self, flat: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """(sentence, subject): per-token cross-entropy of the better background model less the subject's.

        ``flat`` has the sentences' numbers one after another, ``sizes`` how many each has, one at least.
        """
        if not len(sizes):
            return np.zeros((0, len(self.subjects)))
        out = np.add.reduceat(self.table[flat], np.cumsum(sizes) - sizes, axis=0) / sizes[:, None]
        return out[:, :-1] - np.maximum(out[:, -1:], 0)  # the table is over the background of all documents, which is 0 in it


class Index:
    """Numbers of the n-grams of sentences."""

    def __init__(self, vocabulary: dict[tuple[str, ...], int]) -> None:
        self.one = {g[0]: i for g, i in vocabulary.items() if len(g) == 1}
        self.two = {g: i for g, i in vocabulary.items() if len(g) == 2}

    def __call__(self, s: list[str]) -> list[int]:
        """For each token its bigram if known, else its unigram, else nothing (-1): unknown words tell the models apart by nothing."""
        one, two = self.one.get, self.two.get
        words = [one(w, -1) for w in s]
        return [words[0], *[two(p, w) for p, w in zip(zip(s, s[1:], strict=False), words[1:], strict=True)]] if s else []


def vocabulary_of(docs: Iterable[list[list[str]]]) -> dict[tuple[str, ...], int]:
    """Numbers of the words of labelled documents, and of the word pairs that occur twice."""
    uni: Counter = Counter()
    bi: Counter = Counter()
    for d in docs:
        for s in d:
            uni.update((w,) for w in s)
            bi.update(zip(s, s[1:], strict=False))
    grams = [*sorted(uni), *sorted(g for g, n in bi.items() if n > 1)]
    return {g: i for i, g in enumerate(grams)}


def count_grams(flat: np.ndarray, tail: np.ndarray) -> np.ndarray:
    """Occurrences of each n-gram, from the numbers that ``index`` gives: a known pair is one of its last word too."""
    seen = flat[flat >= 0]
    words = tail[seen]
    return np.bincount(words, minlength=len(tail)) + np.bincount(seen[seen != words], minlength=len(tail))


def ends(vocabulary: dict[tuple[str, ...], int]) -> tuple[np.ndarray, np.ndarray]:
    """(head, tail): for each n-gram the number of its first word, -1 where it is one, and of its last."""
    head, tail = np.full(len(vocabulary), -1, np.int64), np.zeros(len(vocabulary), np.int64)
    for g, i in vocabulary.items():
        tail[i] = vocabulary[g[-1:]]
        if len(g) == 2:
            head[i] = vocabulary[g[:1]]
    return head, tail


def flattened(sentences: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    return np.fromiter((i for s in sentences for i in s), np.int64), np.array([len(s) for s in sentences], np.int64)


def train(docs: list[list[list[str]]], labels: list[set[str]], subjects: list[str], vocabulary: dict, back: np.ndarray, back_total: int) -> Models:
    """Fit the subject models to labelled documents whose sentences aren't labelled one by one.

    The margins are chosen by how well the labels of documents are given back by models that were fitted to
    the other half of them.
    """
    marked = np.zeros((len(docs), len(subjects)))
    for k, own in enumerate(labels):
        for j, s in enumerate(subjects):
            marked[k, j] = s in own
    index = Index(vocabulary)
    flat, sizes = flattened([index(s) for d in docs for s in d])
    owner = np.repeat(np.arange(len(docs)), [len(d) for d in docs])
    head, tail = ends(vocabulary)
    fit = lambda f, n, o: _fit(f, n, o, marked, Models(subjects, head, tail, back, back_total))
    m = fit(flat, sizes, owner)
    score = np.zeros((len(owner), len(subjects)))
    for own in (owner % 2 == 0, owner % 2 == 1):
        words = np.repeat(own, sizes)
        score[~own] = fit(flat[words], sizes[own], owner[own]).scores(flat[~words], sizes[~own])
    if len(owner):
        m.margin = calibrate(score, owner, marked)
    return m


def _fit(flat: np.ndarray, sizes: np.ndarray, owner: np.ndarray, marked: np.ndarray, m: Models) -> Models:
    """Fit models to sentences, ``sizes`` of ``flat`` one after another, of the documents ``owner``, marked with subjects.

    Sentences start shared out among their document's labels; then each goes to the subject it scores best for
    (labels of its document favoured), or to the model of no subject, and all are fitted anew.
    """
    subjects = m.subjects
    which = np.repeat(np.arange(len(sizes)), sizes)
    ok = flat >= 0
    words = m.tail[flat[ok]]
    pair = flat[ok] != words
    grams, which = np.concatenate([words, flat[ok][pair]]), np.concatenate([which[ok], which[ok][pair]])
    weight = np.zeros((len(owner), len(subjects) + 1))
    weight[:, :-1] = (marked / np.maximum(marked.sum(1, keepdims=True), 1))[owner]
    for r in range(ROUNDS):
        for j in range(len(subjects) + 1):
            m.counts[:, j] = np.bincount(grams, weights=weight[which, j], minlength=len(m.tail))
        m.fit()
        if r == ROUNDS - 1 or not len(owner):
            break
        score = m.scores(flat, sizes) + LABELLED * marked[owner]
        best = score.argmax(1)
        weight = np.zeros_like(weight)
        good = score[np.arange(len(best)), best] > ASSIGN
        weight[np.flatnonzero(good), best[good]] = 1
        weight[np.flatnonzero(~good), -1] = 1
    return m


def calibrate(score: np.ndarray, owner: np.ndarray, marked: np.ndarray) -> np.ndarray:
    """For each subject the margin with the best agreement (F1) between the documents that get it and those labelled with it.

    Subjects with fewer than OWN_MARGIN labelled documents take the margin that is best for all together.
    """
    best, top = score.argmax(1), score.max(1)
    size = np.maximum(np.bincount(owner, minlength=len(marked)), 1)
    right, got = [], []
    for margin in MARGINS:
        hit = np.zeros_like(marked)
        np.add.at(hit, (owner[top > margin], best[top > margin]), 1)
        one = taken(hit, size[:, None])
        right.append((one & (marked > 0)).sum(0)), got.append(one.sum(0))
    right, got, want = np.array(right), np.array(got), (marked > 0).sum(0)

    def choice(r: np.ndarray, g: np.ndarray, w: int) -> float:
        f = 2 * r / np.maximum(g + w, 1)
        return float(np.median(MARGINS[f >= f.max() - 0.002]))

    common = choice(right.sum(1), got.sum(1), want.sum())
    return np.array([choice(right[:, j], got[:, j], want[j]) if want[j] >= OWN_MARGIN else common for j in range(marked.shape[1])])


def taken(hits: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether so many of a document's sentences make a subject its own."""
    return (hits > 0) & (hits >= SHARE * size - 1e-9)


def accepted(m: Models, flat: np.ndarray, sizes: np.ndarray, owner: np.ndarray, docs: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, subject, share) of the subjects accepted; ``owner``: the document of each sentence, of ``docs`` in all."""
    score = m.scores(flat, sizes)
    hit = np.zeros((docs, len(m.subjects)))
    size = np.maximum(np.bincount(owner, minlength=docs), 1)
    if len(score):
        best, top = score.argmax(1), score.max(1)
        good = top > m.margin[best]
        np.add.at(hit, (owner[good], best[good]), 1)
    d, j = np.nonzero(taken(hit, size[:, None]))
    return d, j, hit[d, j] / size[d]


def test_triples(items: DataFrame) -> set[tuple[str, ...]]:
    """Word triples of the test items, a set of bounded size: beyond TEST_WORDS words it isn't sent, and an error raised."""
    texts = items.where(F.col("text").isNotNull()).select("text").distinct()
    if (texts.agg(F.sum(F.size(F.split("text", r"\s+")))).first()[0] or 0) > TEST_WORDS:
        raise ValueError(f"test items of more than {TEST_WORDS} words: give a smaller set")
    return passage_words(r.text for r in texts.toLocalIterator())


def clean_labels(labels: DataFrame, areas: DataFrame) -> DataFrame:
    """(doc_id, subjects): the distinct labels of each document that name an area, whatever their case and blanks."""
    known = areas.select(F.lower(F.trim("subject")).alias("subject")).where("subject <> ''").distinct()
    own = labels.where(F.col("doc_id").isNotNull()).select("doc_id", F.lower(F.trim("subject")).alias("subject"))
    return own.join(known, "subject").groupBy("doc_id").agg(F.array_sort(F.collect_set("subject")).alias("subjects"))


def subjects_of(documents: DataFrame, labels: DataFrame, areas: DataFrame, items: DataFrame, train_docs: int = TRAIN_DOCS) -> DataFrame:
    """(doc_id, subject, share) of the subjects that each document is about.

    The subject models are fitted on the driver to at most ``train_docs`` labelled documents. One pass over all
    documents reads their sentences into numbers of these documents' words and word pairs, which is cut by a
    checkpoint; the background is counted over all of it, and then it is scored, both on whole arrays. Models
    and vocabulary are bounded by the sample, not by the corpus. Documents without prose have no subject;
    without labels none has. A document that is repeated gives repeated rows.
    """
    spark = documents.sparkSession
    kind = documents.schema["doc_id"].dataType.simpleString()
    texts = documents.where(F.col("doc_id").isNotNull() & (F.length("text") > 0)).select("doc_id", "text")
    names = sorted({r.subject for r in areas.select(F.lower(F.trim("subject")).alias("subject")).where("subject <> ''").distinct().toLocalIterator()})
    tests = spark.sparkContext.broadcast(test_triples(items))
    chosen = clean_labels(labels, areas).orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_docs)
    rows = texts.join(F.broadcast(chosen), "doc_id").dropDuplicates(["doc_id"]).orderBy(F.xxhash64("doc_id"), "doc_id").collect()  # train_docs at most
    sample = [(own, r.subjects) for r in rows if (own := [s for s in sentences(r.text) if not is_passage(s, tests.value)])]
    docs = [d for d, _ in sample]
    vocabulary = vocabulary_of(docs)
    schema = f"doc_id {kind}, subject string, share double"
    if not vocabulary or not names:
        return spark.createDataFrame([], schema)
    sent = spark.sparkContext.broadcast(vocabulary)

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index, triples = Index(sent.value), tests.value
        for pdf in batches:
            grams, sizes = [], []
            for t in pdf["text"]:
                own = [s for s in sentences(t) if not is_passage(s, triples)]
                grams.append([i for s in own for i in index(s)]), sizes.append([len(s) for s in own])
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "grams": grams, "sizes": sizes})

    own = cut(texts.mapInPandas(read, f"doc_id {kind}, grams array<int>, sizes array<int>").where(F.size("sizes") > 0))
    tail = spark.sparkContext.broadcast(ends(vocabulary)[1])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = np.zeros(len(tail.value), np.int64), 0
        for b in batches:
            flat = b.column("grams").flatten().to_numpy()
            n += count_grams(flat, tail.value)
            total += len(flat)
        seen = np.flatnonzero(n)
        yield pa.RecordBatch.from_pydict({"gram": np.append(seen, -1), "n": np.append(n[seen], total)})

    back = np.zeros(len(vocabulary), np.int64)
    back_total = 0
    for r in own.select("grams").mapInArrow(count, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).collect():
        if r.gram < 0:
            back_total = r.n
        else:
            back[r.gram] = r.n
    fitted = spark.sparkContext.broadcast(train(docs, [set(x) for _, x in sample], names, vocabulary, back, back_total))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = fitted.value
        for whole in batches:
            for at in range(0, len(whole), 1000):
                b = whole.slice(at, 1000)
                flat, sizes = b.column("grams").flatten().to_numpy(), b.column("sizes").flatten().to_numpy().astype(np.int64)
                owner = np.repeat(np.arange(len(b)), b.column("sizes").value_lengths().to_numpy())
                d, j, share = accepted(m, flat, sizes, owner, len(b))
                yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(d)), pa.array([m.subjects[k] for k in j], pa.string()), pa.array(share)], ["doc_id", "subject", "share"])

    return own.mapInArrow(score, schema)
