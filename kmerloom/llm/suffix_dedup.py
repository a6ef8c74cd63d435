"""Removal of repeated byte strings by merging Burrows-Wheeler transforms.

A byte goes if a string of ``LENGTH`` bytes covers it that also starts
earlier: in a document of a smaller key, or earlier in the same one.

1. Every window of ``LENGTH`` bytes is assigned to the byte gram of the least
   hash inside it, its anchor.  Equal windows have equal anchors, so all work
   is local to an anchor.  Windows in a row with one anchor form a segment.
   Segments travel as hashes, never as text: anchors that occur once are
   done, and of equal segments (64 bits of the segment beside the anchor's
   64) all but the first are removed whole.
2. What is left are anchors with different segments, as at the edges of a
   shared passage.  Their bytes are fetched from the documents and dealt over
   tasks by anchor.  A task builds suffix arrays and Burrows-Wheeler
   transforms of shards of its segments and merges them by refining their
   interleave one character at a time, to the depth of ``LENGTH``.  Only
   suffixes behind a whole window enter, which are a quarter or so; intervals
   that the refinement never splits are the repeated strings.
3. An anchor with more than ``MOST_SEGMENTS`` different segments is split:
   its segments go through both steps again as if they were documents, with
   longer grams, which share fewer neighbours (``GRAMS``).  At the longest,
   a segment is a window and its anchor all of it, so every split ends.
   Anchors that a sample finds hot are dealt by anchor and segment from the
   start and split like the others; what the sample misses costs time, not
   results.

Defined results: a null text is empty; empty and short texts lose nothing;
rows that agree in key and text are one document, each row with its result;
rows that share only the key come in the order of their texts' hashes; a
null key comes first; columns beside key and text do not matter, whatever
their names; an empty table gives an empty one.
"""

from __future__ import annotations

import functools
import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kmerloom.llm.common import release, sampled, small_batches, written

LENGTH = 100
#: Bytes of an anchor, each for the anchors that those before leave crowded; windows hold LENGTH - gram + 1 of them.
GRAMS = (40, 70, LENGTH)
#: Bytes that a task cuts into segments at once, bytes whose segments it deals out together, and bytes a bucket stands for.
PIECE_BYTES, CHUNK_BYTES, BUCKET_BYTES = 1 << 18, 1 << 20, 16 << 20
#: Segments of an anchor that suffix sorting takes; bytes that are sorted together; shards they are cut to.
MOST_SEGMENTS, BATCH_BYTES, SHARDS = 1 << 12, 1 << 19, 4
#: Hot anchors are looked for in this many bytes and at least this share of the input; at most so many are told apart.
SAMPLE_BYTES, SAMPLE_SHARE, MOST_HOT = 4 << 20, 1 / 256, 1 << 16
NULL_KEY = -(2**63)
_BASE = 0x9E3779B97F4A7C15 | 1
_POS_BITS = 24


@functools.lru_cache(2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64."""
    inverse = pow(_BASE, -1, 2**64)
    out = []
    for b in (_BASE, inverse):
        p = np.full(n, b, np.uint64)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


def segments(data: np.ndarray, ends: np.ndarray, length: int = LENGTH, gram: int = GRAMS[0]) -> tuple[np.ndarray, ...]:
    """Segments of texts laid end to end: anchor hash, first window, number of windows.

    ``ends`` are the texts' ends in ``data``.  No window reaches over an end.
    """
    n = len(data)
    if n < length:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    with np.errstate(over="ignore"):
        power, inverse = _powers(max(n, PIECE_BYTES))
        prefix = np.zeros(n + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[:n], out=prefix[1:])
        h = (prefix[gram:] - prefix[:-gram]) * inverse[: n - gram + 1]
        del prefix
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(32)
    mask = np.uint64((1 << _POS_BITS) - 1)
    ranked = (h & ~mask) | np.arange(len(h), dtype=np.uint64)
    # least of each run of ``span`` grams: from the left inside a block and from the right inside the one before
    span = length - gram + 1
    blocks = -(-len(ranked) // span)
    padded = np.full(blocks * span, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(ranked)] = ranked
    grid = padded.reshape(blocks, span)
    left = np.minimum.accumulate(grid, axis=1).reshape(-1)
    right = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    starts = n - length + 1
    least = np.minimum(right[:starts], left[span - 1 : span - 1 + starts])
    anchor = (least & mask).astype(np.int64)
    del ranked, padded, grid, left, right, least
    text = np.repeat(np.arange(len(ends), dtype=np.int32), np.diff(ends, prepend=0))[:starts]
    valid = np.arange(starts) + length <= ends[text]
    fresh = np.ones(starts, bool)
    fresh[1:] = (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1]) | ~valid[:-1]
    first = np.flatnonzero(fresh & valid)
    stop = np.flatnonzero(valid & np.concatenate([fresh[1:] | ~valid[1:], [True]]))
    return h[anchor[first]], first, stop - first + 1


def _pack(value) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(pickle.dumps(value, 5))


def _unpack(blob: bytes):
    return pickle.loads(zstandard.ZstdDecompressor().decompress(blob))


def _releasing(run: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]) -> Callable:
    """``run``, after which the worker gives its memory back: it waits, with what it holds, beside those of the next stages."""

    def whole(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield from run(batches)
        release()

    return whole


def _keyed(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Key, hash of the text (which Python computes alike) and the text's bytes."""
    small_batches(docs.sparkSession)
    body = F.coalesce(F.col(text), F.lit(""))
    return docs.select(
        F.col(key).cast("long").alias("doc_id"),
        F.coalesce(F.col(key).cast("long"), F.lit(NULL_KEY)).alias("k"),
        F.xxhash64(body).alias("h"),
        body.cast("binary").alias("data"),
    )


def _firsts(*columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order by the columns (the last counts most) and where the last two change in it."""
    order = np.lexsort(columns)
    a, b = columns[-1][order], columns[-2][order]
    return order, np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])


@dataclass
class _Chunk:
    """Segments of some texts; of equal ones the first alone in ``order``, the others in ``again``."""

    k: np.ndarray
    h: np.ndarray
    base: np.ndarray
    text: np.ndarray
    anchor: np.ndarray
    digest: np.ndarray
    start: np.ndarray
    count: np.ndarray
    order: np.ndarray
    again: np.ndarray


def _chunk(texts: list[tuple], gram: int) -> _Chunk | None:
    """Segments of texts (``k``, ``h``, ``base``, ``within``, bytes); equal rows count once."""
    texts.sort(key=lambda d: d[:3])
    texts = [d for i, d in enumerate(texts) if not i or d[:3] != texts[i - 1][:3]]
    sizes = np.array([len(d[4]) for d in texts])
    ends = np.cumsum(sizes)
    flat = b"".join(d[4] for d in texts)
    data = np.frombuffer(flat, np.uint8)
    anchors, starts, counts = [], [], []
    at = 0
    while at < len(data):  # pieces overlap by LENGTH - 1
        stop = min(len(data), at + PIECE_BYTES)
        a, s, c = segments(data[at:stop], np.concatenate([ends[(ends > at) & (ends < stop)] - at, [stop - at]]), gram=gram)
        anchors.append(a)
        starts.append(s + at)
        counts.append(c)
        at = stop if stop == len(data) else stop - LENGTH + 1
    if not sum(map(len, anchors)):
        return None
    start, count = np.concatenate(starts), np.concatenate(counts)
    digest = np.fromiter((xxhash.xxh3_64_intdigest(flat[s : s + c + LENGTH - 1]) for s, c in zip(start.tolist(), count.tolist(), strict=True)), np.uint64, len(start)).view(np.int64)
    text = np.searchsorted(ends, start, side="right")
    start = start - (ends - sizes)[text]
    k, h, base, within = (np.array([d[i] for d in texts], np.int64) for i in range(4))
    with np.errstate(over="ignore"):
        anchor = np.concatenate(anchors).view(np.int64) ^ (within[text] * np.int64(0x9E3779B97F4A7C1))
    order, first = _firsts(start + base[text], h[text], k[text], digest, anchor)
    return _Chunk(k, h, base, text, anchor, digest, start, count, order[first], order[~first])


def _chunks(batches: Iterator[pd.DataFrame], gram: int) -> Iterator[_Chunk]:
    texts, size = [], 0
    for batch in batches:
        for k, h, base, within, data in batch[["k", "h", "base", "within", "data"]].itertuples(index=False):
            texts.append((k, h, base, within, bytes(data)))
            size += len(texts[-1][4])
            if size >= CHUNK_BYTES:
                chunk = _chunk(texts, gram)
                texts, size = [], 0
                if chunk:
                    yield chunk
    chunk = _chunk(texts, gram) if texts else None
    if chunk:
        yield chunk


def _hot(texts: DataFrame, gram: int, total: int) -> np.ndarray:
    """Anchors that would fill a good part of a bucket, as far as a sample tells."""
    share = max(SAMPLE_BYTES / total, SAMPLE_SHARE) if total > SAMPLE_BYTES else 1.0
    some = texts.where(sampled(share, "k", "h", "base"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for c in _chunks(batches, gram):
            anchor, n = np.unique(c.anchor[c.order], return_counts=True)
            yield pd.DataFrame({"anchor": anchor, "n": n})

    found = some.mapInPandas(_releasing(run), "anchor bigint, n bigint").groupBy("anchor").agg(F.sum("n").alias("n"))
    # a segment stands for 30 bytes of text or so
    least = max(share * BUCKET_BYTES / 120, share * total / 30 / MOST_HOT, 16)
    return np.sort(np.array([r["anchor"] for r in found.where(F.col("n") >= least).select("anchor").collect()], np.int64))


def _deal(texts: DataFrame, buckets: int, gram: int, hot: np.ndarray) -> DataFrame:
    """Segments of chunks of texts as packed arrays, dealt over buckets by anchor, those of hot anchors by segment, too.

    Of equal segments in a chunk only the first travels; the others are
    removed whole already.
    """

    def blobs(c: _Chunk, name: int) -> pd.DataFrame:
        anchor, digest = c.anchor[c.order], c.digest[c.order]
        spread = anchor ^ np.where(np.isin(anchor, hot), digest, 0)
        bucket = (((spread ^ (spread >> 31)) & 0x7FFFFFFF) % buckets).astype(np.int32)
        by = np.argsort(bucket, kind="stable")
        cuts = np.searchsorted(bucket[by], np.arange(buckets + 1))
        out = []
        for b in np.flatnonzero(np.diff(cuts)):
            i = c.order[by[cuts[b] : cuts[b + 1]]]
            used, small = np.unique(c.text[i], return_inverse=True)
            out.append((int(b), _pack((c.k[used], c.h[used], c.base[used], small.astype(np.int32), c.anchor[i], c.digest[i], c.start[i].astype(np.int32), c.count[i].astype(np.uint8)))))
        if len(c.again):
            i = c.text[c.again]
            out.append((name % buckets, _pack(("again", c.k[i], c.h[i], c.base[i], c.start[c.again], c.count[c.again]))))
        return pd.DataFrame(out, columns=["bucket", "blob"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for number, c in enumerate(_chunks(batches, gram), TaskContext.get().partitionId()):
            yield blobs(c, number)

    return texts.mapInPandas(_releasing(run), "bucket int, blob binary").repartitionById(buckets, F.col("bucket"))


def _sort_out(dealt: DataFrame, hot: np.ndarray, last: bool, most: int) -> DataFrame:
    """``k``, ``h``, ``base``, ``start``, ``windows``, ``anchor`` and ``crowd``: the anchor is null where the segment is removed whole, else bytes decide.

    ``crowd`` tells anchors with more than ``most`` different segments; there are none in the ``last`` turn.
    """

    def frame(k, h, base, start, count, anchor=None, crowd=False) -> Iterator[pd.DataFrame]:
        for lo in range(0, len(k), 1 << 16):
            i = slice(lo, lo + (1 << 16))
            anchors = pd.array([None] * len(k[i]), "Int64") if anchor is None else anchor[i]
            yield pd.DataFrame({"k": k[i], "h": h[i], "base": base[i], "start": start[i].astype(np.int64), "windows": count[i].astype(np.int64), "anchor": anchors, "crowd": False if anchor is None else crowd[i]})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = []
        for batch in batches:
            for blob in batch["blob"]:
                got = _unpack(blob)
                if isinstance(got[0], str):
                    yield from frame(*got[1:])
                else:
                    parts.append(got)
        if not parts:
            return
        text = np.concatenate([p[3] + at for p, at in zip(parts, np.cumsum([0] + [len(p[0]) for p in parts]), strict=False)])
        k, h, base, _, anchor, digest, start, count = (np.concatenate([p[i] for p in parts]) for i in range(8))
        del parts
        order, first = _firsts(start + base[text], h[text], k[text], digest, anchor)
        text, anchor, start, count = (x[order] for x in (text, anchor, start, count))
        del order, digest
        same = np.zeros(len(text), bool)  # the same text in two chunks
        same[1:] = (k[text[1:]] == k[text[:-1]]) & (h[text[1:]] == h[text[:-1]]) & (base[text[1:]] == base[text[:-1]]) & (start[1:] == start[:-1]) & ~first[1:]
        again = np.flatnonzero(~first & ~same)
        i = text[again]
        yield from frame(k[i], h[i], base[i], start[again], count[again])
        text, anchor, start, count = (x[first] for x in (text, anchor, start, count))
        edges = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1], [True]]))
        n = np.repeat(np.diff(edges), np.diff(edges))
        split = np.zeros(len(n), bool) if last else (n > most) | np.isin(anchor, hot)
        left = np.flatnonzero((n > 1) | split)
        i = text[left]
        yield from frame(k[i], h[i], base[i], start[left], count[left], anchor[left], split[left])

    return dealt.mapInPandas(_releasing(run), "k bigint, h bigint, base bigint, start bigint, windows bigint, anchor bigint, crowd boolean")


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Suffix array by prefix doubling; the last character is the only least one.

    The first order is by as many characters as 64 bits hold; a round sorts
    only the suffixes that are not told apart yet.
    """
    key, n = text.astype(np.uint64), len(text)
    bits, width = max(int(key.max()).bit_length(), 1), 1
    while 2 * width * bits <= 64 and width < n:
        further = key[width:].copy()
        key <<= np.uint64(width * bits)
        key[:-width] |= further
        width *= 2
    order = np.argsort(key)
    key = key[order]
    rank = np.empty(n, np.int64)  # of a suffix: the place of the first one that equals it so far
    left = np.arange(n)  # places whose suffixes are to be ranked
    while True:
        fresh = np.ones(len(left) + 1, bool)
        fresh[1:-1] = key[1:] != key[:-1]
        first = np.flatnonzero(fresh)
        rank[order[left]] = np.repeat(left[first[:-1]], np.diff(first))
        left = left[~(fresh[1:] & fresh[:-1])]
        if not len(left):
            return order
        suffix = order[left]
        key = rank[suffix] * n + rank[suffix + width]
        by = np.argsort(key)
        key, order[left] = key[by], suffix[by]
        width *= 2


def merge(transforms: list[np.ndarray], behind: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Repeated intervals of sorted shards, from their transforms alone.

    The interleave of the shards' suffixes starts with one shard behind the
    other.  A round sorts it stably by the characters before the suffixes,
    which orders by one character more the suffixes that begin there; a
    block is split where character or former block change.  Only suffixes
    ``behind`` a whole window of ``depth`` characters enter, since the rounds
    of no other one end in a window; a suffix leaves when it is alone in its
    block.  Given are the suffixes left at ``depth`` (numbers in the stacked
    shards) and their blocks.
    """
    stacked = np.concatenate(transforms)
    before = np.empty(len(stacked), np.int32)  # of a suffix: the number of the one that begins a character earlier
    at = 0
    for t in transforms:
        before[at + np.argsort(t, kind="stable")] = np.arange(at, at + len(t), dtype=np.int32)
        at += len(t)
    suffix = np.flatnonzero(behind).astype(np.int32)
    block = np.zeros(len(suffix), np.int32)
    for _ in range(depth):
        character = stacked[suffix]
        order = np.argsort(character, kind="stable")
        character, block, suffix = character[order], block[order], before[suffix[order]]
        fresh = np.ones(len(order) + 1, bool)
        fresh[1:-1] = (character[1:] != character[:-1]) | (block[1:] != block[:-1])
        stays = ~(fresh[1:] & fresh[:-1])
        suffix, block = suffix[stays], np.cumsum(fresh[:-1], dtype=np.int32)[stays]
        if not len(suffix):
            break
    return suffix, block


def _repeated(strings: list[bytes], order: np.ndarray, length: int, shards: int) -> tuple[np.ndarray, np.ndarray]:
    """Windows that also start earlier: their string's number and their start, ascending."""
    parts = np.array_split(np.arange(len(strings)), min(shards, len(strings)))
    transforms, where = [], []
    for part in parts:
        sizes = np.array([len(strings[i]) + 1 for i in part])
        flat = np.frombuffer(b"\x00".join(strings[i] for i in part) + b"\x00", np.uint8)
        text = np.zeros(len(flat) + 1, np.uint8 if flat.max() < 254 else np.uint16)
        np.add(flat, 2, out=text[:-1], dtype=text.dtype)
        ends = np.cumsum(sizes)
        text[ends - 1] = 1
        suffixes = suffix_array(text)
        transforms.append(text[suffixes - 1])
        own = np.append(np.repeat(np.arange(len(part), dtype=np.int32), sizes), np.int32(len(part) - 1))
        start = np.append(np.arange(len(flat)) - np.repeat(ends - sizes, sizes), -1)  # the last character is behind no window
        where.append((part[own[suffixes]], start[suffixes]))
    string, start = (np.concatenate(x) for x in zip(*where, strict=True))
    suffix, interval = merge(transforms, start >= length, length)
    string, start = string[suffix], start[suffix]
    by = np.lexsort((start, order[string], interval))
    later = np.zeros(len(by), bool)
    later[1:] = interval[by][1:] == interval[by][:-1]
    hit = by[later]
    hit = hit[np.lexsort((start[hit], string[hit]))]
    return string[hit], start[hit]


def repeats(strings: list[bytes], order: np.ndarray, length: int = LENGTH, shards: int = SHARDS) -> list[np.ndarray]:
    """Per string the starts of windows that also start earlier.

    ``order`` ranks the strings' windows: a window's place is its string's
    rank and then its start.
    """
    string, start = _repeated(strings, order, length, shards)
    cuts = np.searchsorted(string, np.arange(len(strings) + 1))
    return [start[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def _fetch(texts: DataFrame, open_: DataFrame) -> DataFrame:
    """The bytes of the segments that are not decided yet; ``start`` counts from the document's start."""
    wanted = open_.groupBy("k", "h", "base").agg(F.collect_list(F.struct("start", "windows", "anchor", "crowd")).alias("want"))
    joined = texts.select("k", "h", "base", "data").join(wanted, ["k", "h", "base"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for k, h, base, data, want in batch[["k", "h", "base", "data", "want"]].itertuples(index=False):
                for w in want:
                    at = w["start"]
                    out.append((w["anchor"], w["crowd"], k, h, base + at, bytes(data[at : at + w["windows"] + LENGTH - 1])))
                if len(out) > 1 << 14:
                    yield pd.DataFrame(out, columns=["anchor", "crowd", "k", "h", "start", "data"])
                    out = []
            yield pd.DataFrame(out, columns=["anchor", "crowd", "k", "h", "start", "data"])

    return joined.mapInPandas(_releasing(run), "anchor bigint, crowd boolean, k bigint, h bigint, start bigint, data binary")


def _by_suffixes(fetched: DataFrame, parts: int) -> DataFrame:
    """Spans that repeat, by merged transforms over batches of whole anchors."""

    def batch_spans(f: pd.DataFrame) -> pd.DataFrame:
        f = f.drop_duplicates(["anchor", "k", "h", "start"])
        order = np.empty(len(f), np.int64)
        order[np.lexsort((f["start"], f["h"], f["k"]))] = np.arange(len(f))
        # windows of one document may come from several segments; their absolute starts keep their order
        string, start = _repeated(f["data"].tolist(), order, LENGTH, SHARDS)
        breaks = (string[1:] != string[:-1]) | (start[1:] - start[:-1] > LENGTH)
        first = np.flatnonzero(np.append(True, breaks)[: len(start)])
        last = np.flatnonzero(np.append(breaks, True)[: len(start)])
        k, h, base = (f[c].to_numpy()[string[first]] for c in ("k", "h", "start"))
        return pd.DataFrame({"k": k, "h": h, "lo": base + start[first], "hi": base + start[last] + LENGTH})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        size = 0
        for batch in batches:
            # rows come sorted by anchor; the last anchor may go on in the next batch
            rest = batch
            while len(rest):
                held.append(rest)
                size += int(rest["data"].map(len).sum())
                if size < BATCH_BYTES:
                    break
                rows = pd.concat(held, ignore_index=True)
                sizes = rows["data"].map(len).cumsum().to_numpy()
                group = rows["anchor"].to_numpy()
                cut = int(np.searchsorted(sizes, BATCH_BYTES))
                edges = np.flatnonzero(group[1:] != group[:-1]) + 1
                fit = edges[edges <= cut] if (edges <= cut).any() else edges[:1]
                if not len(fit):
                    held, rest = [rows], rows[:0]
                    break
                yield batch_spans(rows[: fit[-1]])
                rest, held, size = rows[fit[-1] :], [], 0
        if held:
            yield batch_spans(pd.concat(held, ignore_index=True))

    dealt = fetched.repartition(parts, F.col("anchor")).sortWithinPartitions("anchor")
    return dealt.select("anchor", "k", "h", "start", "data").mapInPandas(_releasing(run), "k bigint, h bigint, lo bigint, hi bigint")


def spans(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``k`` (key), ``h`` (hash of the text), ``lo`` and ``hi``: spans whose windows all start earlier too; they may overlap."""
    return _spans(_keyed(docs, key, text))


def _spans(rows: DataFrame) -> DataFrame:
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    texts = rows.select("k", "h", F.lit(0).cast("long").alias("base"), F.lit(0).cast("long").alias("within"), "data")
    found = None
    for gram in GRAMS:
        total = texts.agg(F.sum(F.octet_length("data"))).first()[0] or 0
        if found is not None and not total:
            break
        several = total > BUCKET_BYTES
        buckets = max(-(-total // BUCKET_BYTES), parts if several else 1)
        hot = _hot(texts, gram, total) if several else np.zeros(0, np.int64)
        sorted_out = written(_sort_out(_deal(texts, buckets, gram, hot), hot, gram == LENGTH, MOST_SEGMENTS))
        at = F.col("base") + F.col("start")
        whole = sorted_out.where("anchor is null").select("k", "h", at.alias("lo"), (at + F.col("windows") + (LENGTH - 1)).alias("hi"))
        fetched = written(_fetch(texts, sorted_out.where("anchor is not null")))
        here = whole.union(_by_suffixes(fetched.where("not crowd"), buckets))
        found = here if found is None else found.union(here)
        texts = fetched.where("crowd").select("k", "h", F.col("start").alias("base"), F.col("anchor").alias("within"), "data")
    return found


def _cut(data: bytes, spans_) -> tuple[bytes, list[int]]:
    """What is left of the bytes, and the maximal spans removed as starts and ends in turn."""
    merged: list[int] = []
    if spans_ is not None:
        flat = np.asarray(spans_, np.int64).reshape(-1, 2)
        for lo, hi in flat[np.lexsort((flat[:, 1], flat[:, 0]))].tolist():
            if merged and lo <= merged[-1]:
                merged[-1] = max(merged[-1], hi)
            else:
                merged += [lo, hi]
    edges = [0, *merged, len(data)]
    return b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)), merged


def _cut_rows(data: pd.Series, spans_: pd.Series) -> pd.DataFrame:
    release()
    got = [_cut(bytes(d), s) for d, s in zip(data, spans_, strict=True)]
    return pd.DataFrame({"kept": [g[0] for g in got], "removed": [np.array(g[1], np.int64) for g in got]})


def _readable(kept: pd.Series) -> pd.Series:
    release()
    return pd.Series([bytes(k).decode("utf-8", "ignore") for k in kept], dtype=object)


def _with_cuts(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``_row`` (the input row) and ``_cut`` (what is left of its text, what was removed)."""
    body = F.coalesce(F.col(text), F.lit(""))
    found = written(_spans(_keyed(docs, key, text)))
    found = found.groupBy("k", "h").agg(F.flatten(F.collect_list(F.array("lo", "hi"))).alias("_spans"))
    rows = docs.select(F.struct("*").alias("_row"), F.coalesce(F.col(key).cast("long"), F.lit(NULL_KEY)).alias("k"), F.xxhash64(body).alias("h"))
    joined = rows.join(found, ["k", "h"], "left")
    cut = F.pandas_udf(_cut_rows, "kept binary, removed array<bigint>")
    return joined.select("_row", cut(F.coalesce(F.col("_row")[text], F.lit("")).cast("binary"), "_spans").alias("_cut"))


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: ``doc_id``, ``n_bytes``, ``removed`` (maximal spans) and ``kept``, the bytes left."""
    rows = _with_cuts(docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")), "doc_id", "text")
    pairs = F.expr("transform(sequence(0, size(_cut.removed) div 2), i -> struct(get(_cut.removed, 2 * i) as lo, get(_cut.removed, 2 * i + 1) as hi))")
    return rows.select(
        F.col("_row.doc_id").alias("doc_id"),
        F.coalesce(F.octet_length("_row.text"), F.lit(0)).cast("long").alias("n_bytes"),
        F.filter(pairs, lambda p: p["lo"].isNotNull()).alias("removed"),
        F.col("_cut.kept").alias("kept"),
    )


def without_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", chars: str = "n_chars") -> DataFrame:
    """The documents with their texts less the repeated bytes.

    Bytes of a character that was cut apart go, too; a null text stays null;
    a column of text lengths (``chars``) follows the texts.
    """
    left = F.pandas_udf(_readable, "string")(F.col("_cut.kept"))
    rows = _with_cuts(docs, key, text).select("_row", F.when(F.col("_row")[text].isNotNull(), left).alias("_left"))
    columns = []
    for c in docs.columns:
        if c == text:
            columns.append(F.col("_left").alias(c))
        elif c == chars:
            columns.append(F.coalesce(F.char_length("_left").cast(docs.schema[c].dataType), F.col("_row")[c]).alias(c))
        else:
            columns.append(F.col("_row")[c].alias(c))
    return rows.select(*columns)

