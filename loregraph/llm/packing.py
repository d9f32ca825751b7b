"""Filling containers of fixed capacity with documents measured in tokens.

A linear grouping scheme: large lengths are rounded up within groups of equal cardinality, so that few sizes
are left; configurations that hold the largest size left and fill a container best are chosen one after another,
each used as often as the groups allow; the actual documents take the places of their group's size; small documents
then go where they fit best. Only a document larger than a container is cut: into full containers and a rest,
which is packed as any other item.

A table is packed in blocks of at most about BLOCK items, by a hash: each block is one task, however large the
table, and a block wastes no more than its last few containers.
"""

from __future__ import annotations

import base64
from bisect import bisect_left, insort
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A public byte-level BPE vocabulary as ranks, and the pattern by which it splits texts.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Items of a block.
BLOCK = 20_000
#: Items larger than this share of a container are grouped; the rest is small.
LARGE = 1 / 8
#: Sizes that the large items are rounded up to.
GROUPS = 200
#: Characters that are encoded at a time; longer texts are cut before a blank, where tokens end anyway.
CHUNK = 200_000


def token_counts(documents: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """(doc_id, tokens) of each document, whole; null texts have no tokens. The vocabulary is broadcast (under 1 MB)."""
    kind = documents.schema["doc_id"].dataType.simpleString()
    sent = documents.sparkSession.sparkContext.broadcast(Path(tokenizer).read_bytes())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in sent.value.splitlines())}
        enc = tiktoken.Encoding("packing", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "tokens": np.array([sum(len(enc.encode_ordinary(p)) for p in chunks(t or "")) for t in pdf["text"]], np.int64)})

    return documents.select("doc_id", "text").mapInPandas(run, f"doc_id {kind}, tokens long")


def chunks(text: str) -> list[str]:
    """Parts of a long text, cut between a letter and the single blank after it, where no token spans."""
    out, at = [], 0
    while len(text) - at > CHUNK:
        end = at + CHUNK
        while end > at + CHUNK // 2 and not (text[end] == " " and text[end - 1].isalpha() and end + 1 < len(text) and text[end + 1].isalpha()):
            end -= 1
        out.append(text[at:end])
        at = end
    return [*out, text[at:]]


def rounded(sizes: np.ndarray, groups: int = GROUPS) -> np.ndarray:
    """The group of each size, given in descending order: equal cardinality, the largest first."""
    return np.minimum(np.arange(len(sizes)) * groups // max(len(sizes), 1), groups - 1)


def configuration(size: list[int], left: list[int], capacity: int) -> list[int]:
    """How many items of each size fill a container best, with no more of a size than are left.

    Dynamic programme over reachable sums; of equally full ones, that with large items first.
    """
    reach = np.zeros(capacity + 1, bool)
    reach[0] = True
    steps: list[tuple[int, int, np.ndarray]] = []
    for k in range(len(size) - 1, -1, -1):
        most = min(left[k], capacity // size[k])
        part = 1
        while most > 0:
            take = min(part, most)
            most -= take
            part *= 2
            width = take * size[k]
            before = reach.copy()
            reach[width:] |= before[: capacity + 1 - width]
            steps.append((k, take, before))
        if reach[capacity]:
            break
    at = int(np.flatnonzero(reach)[-1])
    out = [0] * len(size)
    for k, take, before in reversed(steps):
        width = take * size[k]
        if at >= width and before[at - width] and not before[at]:
            out[k] += take
            at -= width
    return out


def pack(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(container, position) of each item of one block; every size is from 0 to ``capacity``."""
    n = len(sizes)
    where = np.full(n, -1, np.int64)
    place = np.zeros(n, np.int64)
    order = np.lexsort((np.arange(n), -sizes))
    large = order[sizes[order] > capacity * LARGE]
    small = order[sizes[order] <= capacity * LARGE]
    used: list[int] = []
    count: list[int] = []
    if len(large):
        group = rounded(sizes[large])
        queues: list[list[int]] = []
        size: list[int] = []
        for g in np.unique(group):
            own = large[group == g]
            top = int(sizes[own[0]])
            if size and size[-1] == top:
                queues[-1] += own.tolist()
            else:
                size.append(top)
                queues.append(own.tolist())
        heads = [0] * len(size)
        left = [len(q) for q in queues]
        while any(left):
            live = [k for k in range(len(size)) if left[k]]
            # the largest size left is in it, so that nothing hard to place is left to the end
            conf = configuration([size[k] for k in live], [left[k] - (k == live[0]) for k in live], capacity - size[live[0]])
            conf[0] += 1
            times = min(left[k] // a for k, a in zip(live, conf, strict=True) if a)
            for _ in range(times):
                c, fill, at = len(used), 0, 0
                for k, a in zip(live, conf, strict=True):
                    for i in queues[k][heads[k] : heads[k] + a]:
                        where[i], place[i] = c, at
                        fill += int(sizes[i])
                        at += 1
                    heads[k] += a
                used.append(fill)
                count.append(at)
            for k, a in zip(live, conf, strict=True):
                left[k] -= a * times
    room = sorted((capacity - f, c) for c, f in enumerate(used))
    for i in small.tolist():
        s = int(sizes[i])
        k = bisect_left(room, (s, -1))
        if k < len(room):
            r, c = room.pop(k)
        else:
            r, c = capacity, len(used)
            used.append(0)
            count.append(0)
        where[i], place[i] = c, count[c]
        used[c] += s
        count[c] += 1
        insort(room, (r - s, c))
    return where, place


def packed(counts: DataFrame, capacities: DataFrame, block: int = BLOCK) -> DataFrame:
    """(capacity_id, container_id, position, doc_id, piece, first_token, tokens) for every document and capacity.

    ``counts``: (doc_id, tokens); repeated rows count once. ``capacities``: (capacity_id, capacity_tokens), a
    few rows; ones that are null or not positive are left out. A document without tokens is an item of size 0.
    Two documents with the same id but other sizes are two items.
    """
    items = counts.where(F.col("tokens").isNotNull()).distinct()
    sizes = [(r.capacity_id, r.capacity_tokens) for r in capacities.where("capacity_tokens > 0").select("capacity_id", "capacity_tokens").distinct().orderBy("capacity_id", "capacity_tokens").toLocalIterator()]
    kind = counts.schema["doc_id"].dataType.simpleString()
    ckind = capacities.schema["capacity_id"].dataType.simpleString()
    schema = f"capacity_id {ckind}, container_id string, position int, doc_id {kind}, piece int, first_token long, tokens int"
    if not sizes:
        return counts.sparkSession.createDataFrame([], schema)
    blocks = max(1, -(-counts.count() // block))
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("capacity_id"), F.lit(c).alias("capacity")) for i, c in sizes]))
    rows = items.withColumn("_block", F.pmod(F.xxhash64("doc_id", "tokens"), F.lit(blocks))).select("*", each.alias("_c")).select("doc_id", "tokens", "_block", F.col("_c.capacity_id").alias("capacity_id"), F.col("_c.capacity").alias("capacity"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["doc_id", "tokens"], na_position="first")
        cap, blk = int(pdf["capacity"].iloc[0]), int(pdf["_block"].iloc[0])
        size = pdf["tokens"].to_numpy(np.int64)
        full = np.where(size > cap, size // cap, 0)
        rest = size - full * cap
        packs = np.flatnonzero((rest > 0) | (full == 0))
        where, place = pack(rest[packs], cap)
        row = np.concatenate([packs, np.repeat(np.arange(len(size)), full)])
        piece = np.concatenate([full[packs], np.concatenate([np.arange(f) for f in full[full > 0]]) if full.any() else np.zeros(0, np.int64)]).astype(np.int64)
        base = int(where.max()) + 1 if len(where) else 0
        container = np.concatenate([where, base + np.arange(int(full.sum()))])
        taken = np.concatenate([rest[packs], np.full(int(full.sum()), cap)])
        return pd.DataFrame(
            {
                "capacity_id": pdf["capacity_id"].iloc[0], "container_id": [f"{blk}-{c}" for c in container], "position": np.concatenate([place, np.zeros(int(full.sum()), np.int64)]).astype(np.int32),
                "doc_id": pdf["doc_id"].to_numpy()[row], "piece": piece.astype(np.int32), "first_token": piece * cap, "tokens": taken.astype(np.int32),
            }
        )

    return rows.groupBy("capacity_id", "capacity", "_block").applyInPandas(run, schema)
