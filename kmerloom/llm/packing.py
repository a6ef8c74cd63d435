"""Packing token ids into windows by Karmarkar-Karp multiway differencing.

Long documents first give whole windows; what is left of every document is
dealt over windows by differencing: partial partitions are merged so that
the heavy parts of one meet the light parts of the other, which leaves
near-equal windows.  Their number starts a little above the least that could
hold all ids; where a window exceeds the capacity, more windows are taken and
the differencing runs again.

Each task packs the documents of its partition in groups of bounded size,
so there is no shuffle, and a lost task gives the same pieces again.

Defined results: a null or empty text is one piece that holds the end id;
repeated rows are packed like any others; an empty table has no pieces.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame

from kmerloom.llm import tokens
from kmerloom.llm.common import small_batches

CAPACITY = 2048
#: Pieces that are packed together.
GROUP = 4096
#: Ids of a window that the first differencing leaves free, as a share, since windows are nearly equal only.
SPARE = 1 / 96
#: Parts up to which a merge is quicker on lists than on arrays.
FEW = 16
#: What is left of a document is cut to at most this many ids, so that a window holds several pieces.
LONGEST = 200

PIECES = (
    "doc_id bigint, start bigint, length bigint, ids binary, doc_tokens bigint, "
    "sequence_id bigint, offset bigint, sequence_length bigint"
)


def differencing(sizes: np.ndarray, k: int) -> np.ndarray:
    """The part (0 to k - 1) of each size by multiway largest differencing.

    A partial partition is a row of k sums in ascending order; the two of
    the largest spread are merged, the sums of one added to those of the
    other in opposite order.
    """
    n = len(sizes)
    if k == 1 or n == 0:
        return np.zeros(n, np.int64)
    # A node keeps the sums that are not zero; made[] tells where the parts of its two halves went.
    sums: list[list | np.ndarray | None] = [[x] for x in sizes.tolist()]
    heap = [(-x[0], i) for i, x in enumerate(sums)]
    heapq.heapify(heap)
    made: list[tuple] = []
    while len(heap) > 1:
        i, j = heapq.heappop(heap)[1], heapq.heappop(heap)[1]
        a, b = sums[i], sums[j]
        sums[i] = sums[j] = None
        width = len(a) + len(b)
        if width <= min(k, FEW):
            both = a + b
            order = sorted(range(width), key=both.__getitem__)
            place = [0] * width
            for rank, at in enumerate(order):
                place[at] = rank
            both = [both[at] for at in order]
            made.append((i, j, place[: len(a)], place[len(a) :]))
        else:
            a, b = np.asarray(a), np.asarray(b)
            over = max(0, width - k)
            # the lightest of a go onto the heaviest of b
            at_a = np.arange(len(a))
            at_b = np.concatenate([np.arange(len(a), width - over), np.arange(over)[::-1]])
            both = np.zeros(width - over, np.int64)
            both[at_a] = a
            both[at_b] += b
            order = np.argsort(both, kind="stable")
            place = np.empty_like(order)
            place[order] = np.arange(len(order))
            both = both[order]
            made.append((i, j, place[at_a], place[at_b]))
        sums.append(both)
        heapq.heappush(heap, (-int(both[-1] - (both[0] if len(both) == k else 0)), len(sums) - 1))
    name: list[list | np.ndarray | None] = [None] * len(sums)
    name[-1] = np.arange(len(sums[-1]))
    for node in range(len(sums) - 1, n - 1, -1):
        i, j, at_a, at_b = made[node - n]
        own, name[node] = name[node], None
        if isinstance(at_a, list):
            own = own if isinstance(own, list) else own.tolist()
            name[i], name[j] = [own[x] for x in at_a], [own[x] for x in at_b]
        else:
            name[i], name[j] = own[at_a], own[at_b]
    return np.array([x[0] for x in name[:n]], np.int64)


def windows(sizes: np.ndarray, capacity: int = CAPACITY) -> np.ndarray:
    """Near-equal windows within the capacity; their number rises until all fit."""
    if sizes.max(initial=0) > capacity:
        raise ValueError("a piece is larger than a window")
    total = int(sizes.sum())
    k = max(1, -(-total // capacity))
    if k > 1:
        k = max(k, round(total / (capacity * (1 - SPARE))))
    while True:
        part = differencing(sizes, k)
        fullest = int(np.bincount(part, weights=sizes, minlength=k).max(initial=0))
        if fullest <= capacity:
            return part
        # so many windows that the fullest would fit if it stayed as far above the mean
        room = capacity - (fullest - total / k)
        k = max(k + 1, int(total / room) + 1 if room > capacity / 2 else k + k // 8)


def cut(n_tokens: int, capacity: int, longest: int) -> tuple[int, list[int]]:
    """How many whole windows a document fills, and the sizes of what is left."""
    whole, left = divmod(n_tokens, capacity)
    if not left:
        return whole, []
    # what is left over is of all sizes, and small pieces level the windows
    return whole, [longest] * (left // longest) + ([left % longest] if left % longest else [])


def pack(docs: DataFrame, key: str = "doc_id", text: str = "text", tokenizer: str = tokens.TOKENIZER, capacity: int = CAPACITY, group: int = GROUP, longest: int = LONGEST) -> DataFrame:
    """One row per piece: where its ids stand in the document and in which sequence."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        coder = tokens.encoder(tokenizer)
        context = TaskContext.get()
        first = (context.partitionId() if context else 0) << 40
        used = 0
        left: list[tuple] = []

        def rows(pieces: list[tuple], sequence: np.ndarray, offset: np.ndarray, total: np.ndarray) -> pd.DataFrame:
            return pd.DataFrame(
                {
                    "doc_id": pd.array([p[0] for p in pieces], "Int64"),
                    "start": [p[1] for p in pieces],
                    "length": [len(p[2]) for p in pieces],
                    "ids": [p[2].astype("<u4").tobytes() for p in pieces],
                    "doc_tokens": [p[3] for p in pieces],
                    "sequence_id": sequence,
                    "offset": offset,
                    "sequence_length": total,
                }
            )

        def packed(pieces: list[tuple]) -> pd.DataFrame:
            nonlocal used
            sizes = np.array([len(p[2]) for p in pieces])
            part = windows(sizes, capacity)
            order = np.argsort(part, kind="stable")
            ends = np.cumsum(sizes[order])
            fresh = np.concatenate([[True], np.diff(part[order]) > 0])
            base = (ends - sizes[order])[fresh]
            name = np.cumsum(fresh) - 1
            filled = np.bincount(name, weights=sizes[order]).astype(np.int64)
            out = rows([pieces[i] for i in order], first + used + name, ends - sizes[order] - base[name], filled[name])
            used += int(name[-1]) + 1
            return out

        for batch in batches:
            for docs_ in tokens.slices(batch, size=tokens.WORD_SLICE_BYTES):
                full = []
                for doc, ids in zip(docs_["doc_id"], coder.encode(docs_["text"]), strict=True):
                    doc = None if pd.isna(doc) else int(doc)
                    whole, sizes = cut(len(ids), capacity, longest)
                    full += [(doc, i * capacity, ids[i * capacity : (i + 1) * capacity], len(ids)) for i in range(whole)]
                    at = whole * capacity
                    for size in sizes:
                        left.append((doc, at, ids[at : at + size], len(ids)))
                        at += size
                if full:
                    n = len(full)
                    yield rows(full, first + used + np.arange(n), np.zeros(n, np.int64), np.full(n, capacity))
                    used += n
                while len(left) >= 2 * group:
                    yield packed(left[:group])
                    left = left[group:]
        if left:
            yield packed(left)

    rows_ = docs.selectExpr(f"cast(`{key}` as bigint) as doc_id", f"`{text}` as text")
    return rows_.mapInPandas(run, PIECES)
