"""SimHash near-duplicates found through Golay-code fuzzy keys.

A 64-bit fingerprint is cut into three segments of 22, 21 and 21 bits, and
each segment is read as a word of the perfect binary Golay code of length
23: every word lies within 3 bits of exactly one of 4,096 codewords.  Two
fingerprints with at most 4 different bits have, for some segment and the
next one round the ring, either (no error, up to two) or (up to one, up to
one).  A word with e errors against another lies within 3 + e bits of the
other's codeword; so one side gives the pair of its own codeword indices as
a key, the other side the indices of all codewords near enough, and every
link meets in a join on equal keys.  Candidates are verified inside the
join, exact copies of a fingerprint are collapsed before it.

Defined results: null and empty texts have the fingerprint zero and link
like any other; repeated rows come out once each; rows with a null key get
the smallest key of their component; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kmerloom.llm.common import small_batches, written
from kmerloom.llm.components import components

SHINGLE = 4
SEED = 42
MAX_BITS = 4
#: First bit and width of each segment.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: Generator polynomial of the Golay code of length 23.
GENERATOR = 0b110001110101


def fingerprint(text: str | None) -> int:
    """The SimHash of a text's word shingles, as an unsigned 64-bit integer."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    n = max(1, len(words) - SHINGLE + 1)
    starts = np.concatenate([[0], ends[:-1] + 1])[:n].tolist()
    stops = ends[-n:].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(line[a:b], SEED) for a, b in zip(starts, stops, strict=True)], "<u8")
    total = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 16):
        part = hashes[at : at + (1 << 16)]
        total += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * total > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id``, the text's hash ``h`` and the fingerprint ``fp`` as a signed 64-bit integer."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            fp = np.array([fingerprint(t) for t in batch["text"]], np.uint64).view(np.int64)
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "h": batch["h"], "fp": fp})

    small_batches(docs.sparkSession)
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"), F.xxhash64(F.col(text)).alias("h"))
    return rows.mapInPandas(run, "doc_id bigint, h bigint, fp bigint")


@lru_cache(maxsize=1)
def _code() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Syndromes of the low 12 and high 11 bits; per syndrome the errors of up to 5 bits, padded with -1, and their weights."""

    def remainder(x: int) -> int:
        for bit in range(22, 10, -1):
            if x >> bit & 1:
                x ^= GENERATOR << (bit - 11)
        return x

    low = np.array([remainder(x) for x in range(1 << 12)])
    high = np.array([remainder(x << 12) for x in range(1 << 11)])
    cosets: list[list[int]] = [[] for _ in range(1 << 11)]
    for weight in range(6):
        for bits in combinations(range(23), weight):
            e = sum(1 << b for b in bits)
            cosets[low[e & 4095] ^ high[e >> 12]].append(e)
    width = max(map(len, cosets))
    errors = np.array([c + [-1] * (width - len(c)) for c in cosets])
    weights = np.array([[e.bit_count() if e >= 0 else 99 for e in c.tolist()] for c in errors])
    return np.stack([low, np.resize(high, 1 << 12)]), errors, weights


def _near(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices of the codewords within 5 bits of each word (nearest first) and their distances (99: padding)."""
    syndromes, errors, weights = _code()
    s = syndromes[0][words & 4095] ^ syndromes[1][words >> 12]
    return np.where(errors[s] >= 0, (words[:, None] ^ errors[s]) >> 11, 0), weights[s]


def _segments(fps: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    bits = fps.astype(np.int64).view(np.uint64)
    return [_near(((bits >> np.uint64(at)) & np.uint64((1 << width) - 1)).astype(np.int64)) for at, width in SEGMENTS]


def own_keys(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and keys: per ring pair the fingerprint's own two codeword indices."""
    near = _segments(fps)
    keys = [(r << 24) | (near[r][0][:, 0] << 12) | near[(r + 1) % 3][0][:, 0] for r in range(3)]
    return np.tile(np.arange(len(fps)), 3), np.concatenate(keys)


def near_keys(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and keys of all codeword pairs at which a linked fingerprint may stand."""
    near = _segments(fps)
    rows, keys = [], []
    for r in range(3):
        (a, wa), (b, wb) = near[r], near[(r + 1) % 3]
        first = np.arange(a.shape[1]) == 0
        both = ((wa <= 4)[:, :, None] & (wb <= 4)[:, None, :]) | ((first & (wa <= 3))[:, :, None] & (wb <= 5)[:, None, :])
        row, i, j = np.nonzero(both)
        rows.append(row)
        keys.append((r << 24) | (a[row, i] << 12) | b[row, j])
    return np.concatenate(rows), np.concatenate(keys)


def _keyed(fps: DataFrame, near: bool) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            values = batch["fp"].to_numpy()
            for at in range(0, len(values), 1024):
                part = values[at : at + 1024]
                row, key = (near_keys if near else own_keys)(part)
                yield pd.DataFrame({"key": key.astype(np.int32), "fp": part[row]})

    return fps.mapInPandas(run, "key int, fp bigint")


def links(fps: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """Pairs ``a`` < ``b`` of distinct fingerprints with at most ``max_bits`` (4 or fewer) different bits."""
    if max_bits > MAX_BITS:
        raise ValueError("the keys cover up to 4 different bits")
    distinct = fps.select("fp").distinct()
    own = _keyed(distinct, False).withColumnRenamed("fp", "x")
    near = _keyed(distinct, True).withColumnRenamed("fp", "y")
    close = (F.col("x") != F.col("y")) & (F.bit_count(F.col("x").bitwiseXOR(F.col("y"))) <= max_bits)
    # the planner takes both sides for as small as the fingerprints they are made from
    met = own.join(near.hint("merge"), (own["key"] == near["key"]) & close)
    return met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def _grouped(docs: DataFrame, key: str, text: str, max_bits: int) -> tuple[DataFrame, DataFrame]:
    """The documents' fingerprints, and the ``component`` (a fingerprint) of each that occurs, with its least key (``first``)."""
    rows = written(fingerprints(docs, key, text))
    first = written(rows.groupBy("fp").agg(F.min("doc_id").alias("first")))
    found = components(links(first, max_bits), "a", "b").withColumnRenamed("node", "fp")
    return rows, first.join(found, "fp", "left").select("fp", "first", F.coalesce("component", "fp").alias("component"))


def groups(docs: DataFrame, key: str = "doc_id", text: str = "text", max_bits: int = MAX_BITS) -> DataFrame:
    """Per document: ``doc_id``, ``fp`` and ``component_id``, the smallest key reachable over links.

    Null and empty texts share the fingerprint zero; null keys take part and
    name no group (a group of them alone has a null name); repeated rows come
    out once each; an empty table gives an empty one.
    """
    rows, named = _grouped(docs, key, text, max_bits)
    smallest = named.groupBy("component").agg(F.min("first").alias("component_id"))
    named = named.join(smallest, "component").select("fp", "component_id")
    return rows.join(named, "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", max_bits: int = MAX_BITS) -> DataFrame:
    """One document of each group, with all its columns: that of the smallest key.

    Null keys come behind all others; of one key's texts the one of the
    smallest hash stays, and of rows that agree in key and text one.
    """
    rows, named = _grouped(docs, key, text, max_bits)
    # a row per fingerprint first, so no group is joined document by document
    each = rows.groupBy("fp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h")).alias("one"))
    chosen = each.join(named, "fp").groupBy("component").agg(F.min("one").alias("one")).select(F.col("one.doc_id").alias("_k"), F.col("one.h").alias("_h"))
    mine = docs.select(F.struct("*").alias("_row"), F.col(key).cast("long").alias("_k"), F.xxhash64(F.col(text)).alias("_h"))
    here, there = mine.alias("a"), chosen.alias("b")
    met = here.join(there, (F.col("a._h") == F.col("b._h")) & F.col("a._k").eqNullSafe(F.col("b._k")), "left_semi")
    one = F.row_number().over(Window.partitionBy("_k", "_h").orderBy("_h"))
    return met.withColumn("_one", one).where("_one = 1").select("_row.*")
