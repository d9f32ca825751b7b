"""Evaluation texts leaking into training text.

The corpus is taken in shards of whole documents. Each shard's words get a suffix array; every suffix of
every test item is looked up in it by binary search, by as many words as it takes to reach past wording that is
common to several items; all occurrences are extended to longest verbatim matches, and matches that follow one
another in both texts, but for a few changed or inserted words, are chained into passages. Only words outside
common wording count, in a passage as in its item.

Words are what is left of a text without layout, markup, letter case and punctuation, as 64-bit hashes made
by the JVM; the suffix arrays hold integers only.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words that a verbatim match has at least; all of them, of an item that has fewer.
SEED = 4
#: Wording that stands in more items than this is common and doesn't count.
COMMON = 2
#: Words of either text that may lie between two matches of a passage.
GAP = 6
#: The same where both texts skip about as many (common wording by itself, which is no match), and what "about" means.
WIDE, DRIFT = 20, 5
#: Share of an item's words that a passage spans, and share of the passage's words that match verbatim.
SPAN, DENSE = 0.4, 0.5
#: Words of a shard.
SHARD = 600_000
#: Words of test items that are broadcast and looked up at a time: 8 bytes a word, and as much again for their numbering.
ITEM_BLOCK = 4_000_000
#: Occurrences that are extended at a time.
CHUNK = 4_000_000


def words(text: Column) -> Column:
    """Hashes of the words of a text: letters and digits, lower case, without tags and invisible characters."""
    bare = F.regexp_replace(F.regexp_replace(text, "[\\u00ad\\u200b-\\u200f\\u2060\\ufeff]", ""), "</?[a-zA-Z][^<>\\n]*>|&[a-z]{2,6};", " ")
    return F.transform(F.regexp_extract_all(F.lower(bare), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)), lambda w: F.xxhash64(w))


def suffix_array(text: np.ndarray, depth: int) -> np.ndarray:
    """Positions of ``text`` in the order of the suffixes that start there, told apart by ``depth`` symbols.

    Prefix doubling: ranks by one symbol, then by two, four and so on; only suffixes that still tie are ranked anew.
    """
    n = len(text)
    rank = np.unique(text, return_inverse=True)[1].astype(np.int64)
    order = np.argsort(rank, kind="stable")
    first = np.searchsorted(rank[order], rank[order])  # each suffix is ranked by the place of the first of its equals
    rank[order] = first
    span = 1
    while span < depth and n > 1:
        own = rank[order]
        tie = np.zeros(n, bool)
        tie[1:] = own[1:] == own[:-1]
        tie[:-1] |= tie[1:]
        at = np.flatnonzero(tie)
        if not len(at):
            break
        who = order[at]
        after = np.where(who + span < n, rank[np.minimum(who + span, n - 1)], -1)
        by = np.lexsort((after, own[at]))
        who, after, group = who[by], after[by], own[at]  # groups keep their places, as lexsort sorts inside them
        order[at] = who
        new = np.concatenate([[True], (group[1:] != group[:-1]) | (after[1:] != after[:-1])])
        rank[who] = at[np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))]
        span *= 2
    return order


def _below(text: np.ndarray, sa: np.ndarray, asked: np.ndarray, starts: np.ndarray, length: np.ndarray, lo: np.ndarray, hi: np.ndarray, upper: bool) -> np.ndarray:
    """Binary search of all asked suffixes at once: how many suffixes of ``text`` are less (or, ``upper``, not greater) by their first ``length`` symbols; it lies in [lo, hi]."""
    n = len(text)
    lo, hi = lo.copy(), hi.copy()
    while True:
        live = np.flatnonzero(lo < hi)
        if not len(live):
            return lo
        mid = (lo[live] + hi[live]) // 2
        at, own, need = sa[mid], starts[live], length[live]
        sign = np.zeros(len(live), np.int8)
        todo = np.arange(len(live))
        d = 0
        while len(todo):
            a = np.where(at[todo] + d < n, text[np.minimum(at[todo] + d, n - 1)], -1)
            c = np.sign(a - asked[own[todo] + d])
            sign[todo[c != 0]] = c[c != 0]
            d += 1
            todo = todo[(c == 0) & (need[todo] > d)]
        right = (sign < 0) | (upper & (sign == 0))
        lo[live[right]] = mid[right] + 1
        hi[live[~right]] = mid[~right]


def common_wording(texts: list[np.ndarray]) -> list[np.ndarray]:
    """For each text, whether the SEED words (or all, of a shorter one) from each place on stand in more than COMMON of the texts."""
    held = defaultdict(set)
    size = lambda t: min(SEED, len(t))
    for k, t in enumerate(texts):
        for i in range(len(t) - size(t) + 1 if len(t) else 0):
            held[t[i : i + size(t)].tobytes()].add(k)
    return [np.array([len(held[t[i : i + size(t)].tobytes()]) > COMMON for i in range(len(t) - size(t) + 1)] if len(t) else [], bool) for t in texts]


class Items:
    """Test items as one array of word hashes, with all their suffixes and how many words of each must be found.

    ``common``: for each item, whether the wording from each place on is common. A suffix must match as far as
    the end of the first wording from its start on that isn't. ``counts[k]`` has, for each place of an item,
    the words before it that count. An item that is common wording throughout counts only whole.
    """

    def __init__(self, ids: list[int], texts: list[np.ndarray], common: list[np.ndarray] | None = None) -> None:
        common = common_wording(texts) if common is None else common
        self.ids = ids
        self.first = np.cumsum([0, *(len(t) + 1 for t in texts)])[:-1]
        self.size = np.array([len(t) for t in texts], np.int64)
        parts = [np.concatenate([t, [np.int64(-i - 2)]]) for i, t in enumerate(texts)]
        self.text = np.concatenate(parts) if parts else np.zeros(0, np.int64)
        self.item = np.repeat(np.arange(len(texts)), self.size + 1) if len(texts) else np.zeros(0, np.int64)
        starts, need = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        self.counts: list[np.ndarray] = []
        for k, (t, c) in enumerate(zip(texts, common, strict=True)):
            seed, own = min(SEED, len(t)), np.flatnonzero(~c)
            weight = np.zeros(len(t), np.int64)
            if not len(own):
                weight[:] = 1
                starts.append(self.first[k : k + 1]), need.append(self.size[k : k + 1])
            else:
                for d in range(seed):
                    weight[own + d] = 1
                from_ = np.arange(own[-1] + 1)
                starts.append(self.first[k] + from_), need.append(own[np.searchsorted(own, from_)] - from_ + seed)
            self.counts.append(np.concatenate([[0], np.cumsum(weight)]))
        self.starts, self.need = np.concatenate(starts), np.concatenate(need)
        ok = self.need > 0
        self.starts, self.need = self.starts[ok], self.need[ok]


def matches(docs: list[np.ndarray], items: Items) -> tuple[np.ndarray, ...]:
    """(document, item, place in the item, place in the document, words) of the longest verbatim matches in one shard.

    Those that hold SEED words of wording that isn't common, each from where it starts.
    """
    none = tuple(np.zeros(0, np.int64) for _ in range(5))
    total = sum(map(len, docs))
    if not total or not len(items.starts):
        return none
    first = np.cumsum([0, *(len(d) + 1 for d in docs)])
    raw = np.concatenate([np.concatenate([d, [0]]) for d in docs])
    is_end = np.zeros(len(raw), bool)
    is_end[first[1:] - 1] = True
    # one numbering for the words of both sides; a word that only items have is no word of the shard
    known, text = np.unique(raw[~is_end], return_inverse=True)
    numbered = np.zeros(len(raw), np.int64)
    numbered[~is_end] = text + 1
    text = numbered
    at = np.minimum(np.searchsorted(known, items.text), len(known) - 1)
    asked = np.where(known[at] == items.text, at + 1, -1)
    missing = np.concatenate([[0], np.cumsum(asked < 0)])
    inside = missing[items.starts + items.need] == missing[items.starts]
    starts, need = items.starts[inside], items.need[inside]
    if not len(starts):
        return none
    sa = suffix_array(text, int(items.size.max()))
    bucket = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=len(known) + 1))])
    lo, hi = bucket[asked[starts]], bucket[asked[starts] + 1]
    lo, hi = _below(text, sa, asked, starts, need, lo, hi, False), _below(text, sa, asked, starts, need, lo, hi, True)
    some = hi > lo
    starts, need, lo, n = starts[some], need[some], lo[some], (hi - lo)[some]
    out = []
    ends = np.cumsum(n)
    at = 0
    while at < len(starts):  # so many occurrences at a time, one suffix at least
        stop = max(int(np.searchsorted(ends, (ends[at - 1] if at else 0) + CHUNK, side="right")), at + 1)
        k = n[at:stop]
        own = np.repeat(starts[at:stop], k)
        place = sa[np.repeat(lo[at:stop], k) + (np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k))]
        length = np.repeat(need[at:stop], k)
        at = stop
        left = (own > 0) & (place > 0)
        left[left] = (asked[own[left] - 1] == text[place[left] - 1]) & (text[place[left] - 1] > 0)  # found from further left
        own, place, length = own[~left], place[~left], length[~left]
        live = np.arange(len(own))
        while len(live):
            a, b = own[live] + length[live], place[live] + length[live]
            ok = (a < len(asked)) & (b < len(text))
            a, b, live = a[ok], b[ok], live[ok]
            live = live[(asked[a] == text[b]) & (text[b] > 0)]
            length[live] += 1
        doc = np.searchsorted(first, place, side="right") - 1
        item = items.item[own]
        out.append((doc, item, own - items.first[item], place - first[doc], length))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else none


def passages(hits: list[tuple[int, int, int]], size: int, counts: Sequence[int] | None = None) -> tuple[int, int, int, int]:
    """The passage that spans most words of an item that count: (words spanned, words matched, start and end in the document).

    ``hits``: (place in the item, place in the document, words); ``counts``: the words that count before each
    place of the item, all without it. A chain goes on in both texts with at most GAP words between, or WIDE if
    the texts skip about as many; only the matches that end near enough are tried, so a long document costs no
    more a word.
    """
    hits = sorted(hits, key=lambda h: (h[1], h[0]))
    c = counts if counts is not None else range(size + 1)
    best = (0, 0, 0, 0)
    state: list[tuple[int, int, int, int, int]] = []  # first in the item, matched, start in the document, end in the item, end in the document
    back = 0
    for i, (p, q, n) in enumerate(hits):
        own = (p, c[p + n] - c[p], q, p + n, q + n)
        while back < i and state[back][4] + WIDE + size < q:
            back += 1
        for first, matched, start, e, f in state[back:]:
            over = max(0, e - p, f - q)
            i_gap, d_gap = p - e, q - f
            near = i_gap <= GAP and d_gap <= GAP or i_gap <= WIDE and d_gap <= WIDE and abs(i_gap - d_gap) <= DRIFT
            if over < n and near and p + n > e and q + n > f and over <= n // 2:
                more = (first, matched + c[p + n] - c[p + over], start, p + n, q + n)
                if (c[more[3]] - c[more[0]], more[1]) > (c[own[3]] - c[own[0]], own[1]):
                    own = more
        state.append(own)
        got = (int(c[own[3]] - c[own[0]]), int(own[1]), own[2], own[4])
        if got > best:
            best = got
    return best


def _shards(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[list, list[np.ndarray]]]:
    ids, docs, size = [], [], 0
    for pdf in batches:
        for i, w in zip(pdf["doc_id"], pdf["_words"], strict=True):
            w = np.asarray(w, np.int64)
            if size and size + len(w) > SHARD:
                yield ids, docs
                ids, docs, size = [], [], 0
            ids.append(i), docs.append(w)
            size += len(w) + 1
    if ids:
        yield ids, docs


def read_items(items: DataFrame) -> DataFrame:
    """(item_id, w, common): the words of each distinct test item, and the places from which its wording is common."""
    own = items.where(F.col("item_id").isNotNull() & F.col("text").isNotNull()).select("item_id", words(F.col("text")).alias("w")).distinct().withColumn("_k", F.xxhash64("item_id", "w"))
    seed = F.least(F.size("w"), F.lit(SEED))
    grams = F.when(F.size("w") > 0, F.transform(F.sequence(F.lit(1), F.size("w") - seed + 1), lambda i: F.xxhash64(F.slice("w", i, seed))))
    each = own.select("_k", F.posexplode(grams).alias("_at", "_g"))
    held = each.select("_k", "_g").distinct().groupBy("_g").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > COMMON)
    common = each.join(held.select("_g"), "_g", "left_semi").groupBy("_k").agg(F.collect_list("_at").alias("common"))
    return own.join(common, "_k", "left").select("item_id", "w", F.coalesce("common", F.array().cast("array<int>")).alias("common"))


def leaked(documents: DataFrame, items: DataFrame, span: float = SPAN) -> DataFrame:
    """(doc_id, item_id, spanned, matched, first_word, last_word, whole) of each document with a passage of an item.

    ``whole`` tells whether the document holds all words of the item as they stand.

    ``items`` is a test set: it is read in blocks of ITEM_BLOCK words, one of which is on the driver at a time,
    and each block makes one pass over the corpus. Which wording is common is counted over all items, by Spark.
    Null and empty texts hold nothing; a document that is repeated gives repeated rows.
    """
    kind = documents.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, item_id {items.schema['item_id'].dataType.simpleString()}, spanned int, matched int, first_word int, last_word int, whole boolean"
    texts = documents.where(F.length("text") > 0).select("doc_id", words(F.col("text")).alias("_words"))
    parts = [_pass(texts, block, schema, span) for block in _blocks(read_items(items))]
    out = parts[0]
    for one in parts[1:]:
        out = out.unionByName(one)
    return out


def _blocks(items: DataFrame) -> Iterator[Items]:
    """At least one block, each of at most ITEM_BLOCK words but for an item that has more by itself."""
    ids, texts, common, size = [], [], [], 0
    for r in items.orderBy("item_id").toLocalIterator():
        if size and size + len(r.w) > ITEM_BLOCK:
            yield Items(ids, texts, common)
            ids, texts, common, size = [], [], [], 0
        flags = np.zeros(len(r.w) - min(SEED, len(r.w)) + 1 if r.w else 0, bool)
        flags[np.array(r.common, np.int64)] = True
        ids.append(r.item_id), texts.append(np.array(r.w, np.int64)), common.append(flags)
        size += len(r.w)
    yield Items(ids, texts, common)


def _pass(texts: DataFrame, items: Items, schema: str, span: float) -> DataFrame:
    sent = texts.sparkSession.sparkContext.broadcast(items)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = sent.value
        for ids, docs in _shards(batches):
            groups = defaultdict(list)
            for d, k, p, q, n in zip(*(x.tolist() for x in matches(docs, own)), strict=True):
                groups[d, k].append((p, q, n))
            got = []
            for (d, k), hits in groups.items():
                counts = own.counts[k].tolist()
                spanned, matched, a, b = passages(hits, int(own.size[k]), counts)
                if spanned >= span * counts[-1] and matched >= DENSE * spanned:
                    got.append((ids[d], own.ids[k], spanned, matched, a, b, any(p == 0 and n == own.size[k] for p, _, n in hits)))
            yield pd.DataFrame(got, columns=["doc_id", "item_id", "spanned", "matched", "first_word", "last_word", "whole"])

    return texts.mapInPandas(run, schema)
