"""Language-model scores from a hierarchical Pitman-Yor bigram model.

Every training word is a context with a restaurant of its own; all context
restaurants share the unigram restaurant as their parent, whose base is
uniform over the training vocabulary and one unseen word.  A customer of a
context is a training token behind that word; the tables of the contexts are
the customers of the parent.  Seating is sampled in blocks: all customers of
one dish in one restaurant are seated anew, given everyone else's tables of
the sweep before (all blocks of a sweep at once).  Sweeps form a chain: each
starts from the tables that the one before left.  The first ``ROUNDS`` sweeps
are burn-in; each later one is a sample, scored with its own tables and
totals.  The predictive probabilities of the samples are averaged and summed
per document as log10; held-out documents give the perplexity.

How it runs: tokens go once through a shuffle, as compressed runs dealt over
buckets by word, and words that would fill a good part of a bucket by word
and context, so no bucket is hot.  A bucket then holds all that concerns its
words, in a table that Spark keeps in buckets: a sweep joins what stays fixed
of a bucket with its tables where they lie, and only totals of contexts move.
These are kept by context: each bucket sends one sum per context to the
context's home, and the homes answer with the totals, so a hot context costs
its home one number a bucket.  The driver sees totals and the words treated
as hot (at most ``MOST_HOT``).

Words are known by 64-bit hashes.  Defined results: a null text is empty and
has the end token alone; without training documents every token is unseen;
repeated rows are scored once each; a null key counts as the empty text in
the split; columns beside key and text do not matter; an empty table gives an
empty one.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kmerloom.llm.common import key_mod, release, remove, shared_dir, small_batches, written, written_in_buckets

FOLDS, TEST_FOLD = 7, 2
#: Tokens that a task gathers before it deals them out, and tokens a bucket is meant to hold.
CHUNK_TOKENS, BUCKET_TOKENS = 1_000_000, 4_000_000
#: Words with a quarter of a bucket's tokens are hot, but not more words than this.
MOST_HOT = 1 << 16
STRENGTH = 1.0
#: Sweeps of burn-in before the samples that are averaged, one sweep each.
ROUNDS, SAMPLES = 1, 3
SLICE_BYTES = 4 << 20

#: No word holds a space, so these are no words.
BEGIN, END = b" begin", b" end"


def _hash(word: bytes) -> int:
    return xxhash.xxh64_intdigest(word, 0) - (1 << 63)


def words(text: str | None) -> list[bytes]:
    """Lower-cased (A-Z only) words of a text."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def _rows(docs: DataFrame, key: str, text: str) -> DataFrame:
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.select("doc_id", (key_mod(F.col("doc_id"), FOLDS) == TEST_FOLD).alias("held_out"), "text")


def _split(texts: pd.Series) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts in a row, and how many each text has."""
    lower = pc.ascii_trim_whitespace(pc.ascii_lower(pa.array(texts, pa.large_string(), from_pandas=True).fill_null("")))
    split = pc.ascii_split_whitespace(lower)
    counts = pc.list_value_length(split).to_numpy().astype(np.int64)
    words_ = split.flatten()
    blank = pc.equal(lower, "").to_numpy(zero_copy_only=False)
    if blank.any():  # an empty text is split into one empty word
        words_, counts[blank] = words_.filter(pc.not_equal(words_, "")), 0
    return words_, counts


class _Chunk:
    """Tokens of some documents as numbers of a vocabulary of their own; 0 begins, 1 ends."""

    def __init__(self, docs: list[tuple], words_: list[pa.Array], counts: list[np.ndarray]):
        #: Key and side of every document, and its tokens.
        self.docs, self.sizes = docs, np.concatenate(counts) + 1
        coded = pa.concat_arrays(words_).dictionary_encode()
        self.types = coded.dictionary.cast(pa.large_binary())
        ends = np.cumsum(self.sizes) - 1
        self.tokens = np.ones(int(self.sizes.sum()), np.int32)
        inner = np.ones(len(self.tokens), bool)
        inner[ends] = False
        self.tokens[inner] = coded.indices.to_numpy() + 2

    def hashes(self) -> np.ndarray:
        """As ``_hash`` has them."""
        own = map(xxhash.xxh64_intdigest, chain((BEGIN, END), self.types.to_numpy(zero_copy_only=False)))
        return (np.fromiter(own, np.uint64, len(self.types) + 2) ^ np.uint64(1 << 63)).view(np.int64)


def _chunks(batches: Iterator[pd.DataFrame], only_train: bool = False) -> Iterator[_Chunk]:
    docs: list[tuple] = []
    words_: list[pa.Array] = []
    counts: list[np.ndarray] = []
    n = 0
    for batch in batches:
        if only_train:
            batch = batch[~batch["held_out"]]
        got, sizes = _split(batch["text"])
        names = list(batch[["doc_id", "held_out"]].itertuples(index=False, name=None))
        first = np.concatenate([[0], np.cumsum(sizes)])
        lo = 0
        while lo < len(sizes):
            # up to the document that fills the chunk
            hi = min(len(sizes), lo + 1 + int(np.searchsorted(np.cumsum(sizes[lo:] + 1), CHUNK_TOKENS - n)))
            docs += names[lo:hi]
            words_.append(got[first[lo] : first[hi]])
            counts.append(sizes[lo:hi])
            n += int(first[hi] - first[lo]) + hi - lo
            lo = hi
            if n >= CHUNK_TOKENS:
                chunk = _Chunk(docs, words_, counts)
                docs, words_, counts, n = [], [], [], 0
                yield chunk
                del chunk
    if n:
        yield _Chunk(docs, words_, counts)


def vocabulary(rows: DataFrame) -> DataFrame:
    """``word`` (hash) and ``n``, its training tokens, the end token among them."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for chunk in _chunks(batches, True):
            hashes = chunk.hashes()
            n = np.bincount(chunk.tokens, minlength=len(hashes))
            used = n > 0
            yield pd.DataFrame({"word": hashes[used], "n": n[used]})
            del chunk, hashes, n, used
            release()

    return rows.mapInPandas(run, "word bigint, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


@dataclass
class _Common:
    """What every task knows: totals and the hot words."""

    tokens: int
    types: int
    hot: np.ndarray
    hot_tokens: np.ndarray
    buckets: int


@dataclass
class _State:
    """What a sweep leaves for the next beside the tables: hot words' customers and root tables, totals, discounts."""

    hot_customers: np.ndarray
    hot_tables: np.ndarray
    customers: float
    root_tables: float
    discount: float
    root_discount: float


def _find(sorted_: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Where each value stands in a sorted array, or -1."""
    if not len(sorted_):
        return np.full(len(values), -1, np.int64)
    at = np.minimum(np.searchsorted(sorted_, values), len(sorted_) - 1)
    return np.where(sorted_[at] == values, at, -1)


def _steps(sorted_: np.ndarray) -> np.ndarray:
    """Ascending hashes as their differences, whose first bytes are mostly 0."""
    return np.diff(sorted_.view(np.uint64), prepend=np.uint64(0))


def _pack(arrays: tuple) -> bytes:
    """Arrays as planes of first, second ... bytes, which compress better than whole numbers."""

    def planes(x):
        if not isinstance(x, np.ndarray) or x.itemsize == 1:
            return x
        return x.dtype.str, np.ascontiguousarray(np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.itemsize).T)

    return zstandard.ZstdCompressor(level=3).compress(pickle.dumps(tuple(map(planes, arrays)), 5))


def _unpack(blob: bytes) -> tuple:
    arrays = pickle.loads(zstandard.ZstdDecompressor().decompress(blob))
    return tuple(np.ascontiguousarray(x[1].T).view(x[0]).ravel() if isinstance(x, tuple) else x for x in arrays)


def _deal(rows: DataFrame, common: _Common) -> DataFrame:
    """Rows of ``bucket``, ``chunk``, ``blob``: the pairs of a chunk that belong to a bucket, packed; and what stays with the chunk, its number below 0."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part = TaskContext.get().partitionId()
        for number, chunk in enumerate(_chunks(batches)):
            name = (part << 20) + number
            # words by ascending hashes (as unsigned numbers), so that those of a bucket lie close together
            hashes = chunk.hashes()
            rank = np.argsort(hashes.view(np.uint64))
            hashes, number_of = hashes[rank], np.empty(len(rank), np.int64)
            number_of[rank] = np.arange(len(rank))
            width = len(hashes)
            sizes = chunk.sizes
            w = number_of[chunk.tokens]
            chunk.types = chunk.tokens = None
            u = np.concatenate([[number_of[0]], w[:-1]])
            u[np.concatenate([[0], np.cumsum(sizes)[:-1]])] = number_of[0]
            doc = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
            pair = w * width + u
            del w, u
            order = np.argsort(pair, kind="stable")
            pair, doc = pair[order], doc[order]
            del order
            fresh = np.concatenate([[True], (pair[1:] != pair[:-1]) | (doc[1:] != doc[:-1])])
            times = np.diff(np.concatenate([np.flatnonzero(fresh), [len(pair)]]))
            pair, doc = pair[fresh], doc[fresh]
            w, c = pair // width, pair % width
            spread = hashes[w] ^ np.where((_find(common.hot, hashes) >= 0)[w], hashes[c] * 0x9E3779B97F4A7C1, 0)
            bucket = ((spread.view(np.uint64) >> np.uint64(33)) * np.uint64(common.buckets) >> np.uint64(31)).astype(np.int64)
            by = np.argsort(bucket, kind="stable")
            cuts = np.searchsorted(bucket[by], np.arange(common.buckets + 1))
            held = np.array([d[1] for d in chunk.docs], bool)
            pair, doc, times, w, c = pair[by], doc[by], times[by], w[by], c[by]
            new_pair = np.ones(len(pair), bool)
            new_pair[1:] = (pair[1:] != pair[:-1]) | (bucket[by][1:] != bucket[by][:-1])
            first = np.flatnonzero(new_pair)
            train = np.add.reduceat(times * ~held[doc], first)
            w, c = w[first], c[first]
            pair_cuts = np.searchsorted(first, cuts)
            out, words_ = [], []
            for b in np.flatnonzero(np.diff(cuts)):
                own = slice(pair_cuts[b], pair_cuts[b + 1])
                word_first = np.flatnonzero(np.concatenate([[True], w[own][1:] != w[own][:-1]]))
                n_pairs = np.diff(np.append(word_first, len(w[own]))).astype(np.int32)
                words_.append(n_pairs)
                behind, context = np.unique(c[own], return_inverse=True)
                out.append((int(b), name, _pack((_steps(hashes[w[own][word_first]]), n_pairs, _steps(hashes[behind]), context.astype(np.int32), train[own].astype(np.int32)))))
            # which document a pair stands in stays with the chunk, and meets the scores of its pairs in the end
            kept = (
                [d[0] for d in chunk.docs],
                held,
                sizes,
                np.concatenate(words_),
                np.diff(np.append(first, len(doc))).astype(np.int32),
                doc.astype(np.uint16 if len(sizes) < 1 << 16 else np.int32),
                np.minimum(times, 255).astype(np.uint8),
                times[times >= 255],
            )
            out.append((_home_of_chunk(name, common), -1 - name, _pack(kept)))
            yield pd.DataFrame(out, columns=["bucket", "chunk", "blob"])
            del out, kept, doc, times, pair, w, c, by, bucket, spread
            release()

    return rows.mapInPandas(run, "bucket int, chunk bigint, blob binary").repartitionById(common.buckets, F.col("bucket"))


def _home(contexts: np.ndarray, common: _Common) -> np.ndarray:
    """The bucket that keeps a context's totals."""
    return ((contexts ^ (contexts >> 31)) & 0x7FFFFFFF) % common.buckets


def _home_of_chunk(name: int, common: _Common) -> int:
    """The bucket that keeps what stays with a chunk."""
    return (name * 0x9E3779B97F4A7C15 % 2**64 >> 33) % common.buckets


class _Bucket:
    """All tokens of a bucket's words, pairs of word and context merged over chunks.

    ``contexts`` stand in the order of their homes, as the homes' answers do.
    """

    def __init__(self, frame: pd.DataFrame, common: _Common):
        self.number = int(frame["bucket"].iloc[0])
        self.parts, hashes, behind, contexts, counts, sizes = [], [], [], [], [], []
        at = 0
        for chunk, blob in frame[["chunk", "blob"]].sort_values("chunk").itertuples(index=False):
            word, n_pairs, own, context, train = _unpack(blob)
            word, own = (np.cumsum(x).view(np.int64) for x in (word, own))
            self.parts.append((chunk, len(word), len(context)))
            hashes.append(word)
            sizes.append(n_pairs)
            behind.append(own)
            contexts.append(context + np.int32(at))
            counts.append(train)
            at += len(own)
        self.words, self.word_of = np.unique(np.concatenate(hashes).view(np.uint64), return_inverse=True)
        self.words = self.words.view(np.int64)
        word = np.repeat(self.word_of.astype(np.int32), np.concatenate(sizes)).astype(np.int64)
        del hashes, sizes
        self.contexts, number = np.unique(np.concatenate(behind).view(np.uint64), return_inverse=True)
        self.contexts = self.contexts.view(np.int64)
        home = _home(self.contexts, common)
        order = np.argsort(home, kind="stable")
        self.contexts, self.home = self.contexts[order], home[order]
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        width = len(self.contexts)
        # in the order of the contexts' hashes, so that the pairs of a chunk ascend
        word *= width
        word += number[np.concatenate(contexts)]
        del behind, contexts, number
        pairs, self.pair_of = np.unique(word, return_inverse=True)
        del word
        self.word, self.context = pairs // width, place[pairs % width]
        self.count = np.bincount(self.pair_of, np.concatenate(counts), len(pairs)).astype(np.int64)
        self.hot = _find(common.hot, self.words)
        self.tokens = np.bincount(self.word, self.count, len(self.words))
        self.tokens[self.hot >= 0] = common.hot_tokens[self.hot[self.hot >= 0]]

    def fixed(self) -> tuple:
        """What sweeps need, which no sweep changes."""
        return self.word.astype(np.int32), self.context.astype(np.int32), self.count.astype(np.int32), self.contexts, self.hot.astype(np.int32)

    def maps(self) -> list[tuple]:
        """Per chunk its number, the training tokens of its words and the steps from each of its pairs to the next."""
        out, word_at, pair_at = [], 0, 0
        for chunk, n_words, n_pairs in self.parts:
            tokens = self.tokens[self.word_of[word_at : word_at + n_words]].astype(np.int64)
            out.append((chunk, _pack((tokens, np.diff(self.pair_of[pair_at : pair_at + n_pairs], prepend=0).astype(np.int32)))))
            word_at, pair_at = word_at + n_words, pair_at + n_pairs
        return out


class _Seating:
    """The tables of a bucket after a sweep, and what is known of the rest."""

    def __init__(self, number: int, fixed: tuple, seated: tuple, answers: list[tuple], common: _Common, state: _State):
        self.number, self.fixed, self.common, self.state = number, fixed, common, state
        self.word, self.context, self.count, self.contexts, self.hot = (x if i == 3 else x.astype(np.int64) for i, x in enumerate(fixed))
        self.tables, root, self.total = (x.astype(np.float64) for x in seated)
        self.context_tables, self.context_tokens = (np.concatenate([a[i] for a in answers]).astype(np.float64) for i in (0, 1))
        hot = self.hot >= 0
        self.customers = np.bincount(self.word, self.tables, len(self.hot))
        self.customers[hot] = state.hot_customers[self.hot[hot]]
        root[hot] = state.hot_tables[self.hot[hot]]
        self.root = root
        self.base = 1 / (common.types + 1)

    def probability(self) -> np.ndarray:
        """Of every pair's word behind its context, by the tables as they are."""
        s = self.state
        parent = (self.customers - s.root_discount * self.root + (STRENGTH + s.root_discount * s.root_tables) * self.base) / (STRENGTH + s.customers)
        back = STRENGTH + s.discount * self.context_tables[self.context]
        return (self.count - s.discount * self.tables + back * parent[self.word]) / (STRENGTH + self.context_tokens[self.context])

    def sweep(self, seed: int) -> None:
        """Seat the customers of every pair, then those of the words in the root, given all others' tables."""
        s = self.state
        rng = np.random.default_rng([seed, self.number])
        # a lone customer has a table, whatever the chances
        many = np.flatnonzero(self.count > 1)
        word, tables = self.word[many], self.tables[many]
        others = self.customers[word] - tables
        root = np.minimum(self.root[word], others)
        new = (STRENGTH + s.root_discount * (s.root_tables - self.root[word] + root)) * self.base
        parent = (others - s.root_discount * root + new) / (STRENGTH + s.customers - tables)
        back = STRENGTH + s.discount * (self.context_tables[self.context[many]] - tables)
        self.tables = (self.count > 0).astype(np.float64)
        self.tables[many] = seat(self.count[many], back * parent, s.discount, rng, s.discount * parent)
        sent = np.bincount(self.word, self.tables, len(self.hot))
        self.root = _seat_root(sent, self.root, s, self.base, rng)


def _seat_root(customers: np.ndarray, root: np.ndarray, s: _State, base: float, rng: np.random.Generator) -> np.ndarray:
    """Tables of words in the root, given those of the others."""
    new = (STRENGTH + s.root_discount * (s.root_tables - root)) * base
    return seat(customers.astype(np.int64), new, s.root_discount, rng, np.full(len(customers), s.root_discount * base))


def seat(customers: np.ndarray, new: np.ndarray, discount: float, rng: np.random.Generator, more: np.ndarray | None = None) -> np.ndarray:
    """Tables taken when each row's customers sit down one after another.

    A customer takes a new table by the weight ``new``, and ``more`` for each
    table that the row has already, and joins the others by their number less the discount for each table.  Behind the 64th, an
    eighth of those present sit down at a time by the same chances.
    """
    out = (customers > 0).astype(np.float64)
    order = np.flatnonzero(customers > 1)
    order = order[np.argsort(-customers[order], kind="stable")]
    n, weight = customers[order], new[order]
    extra = np.zeros(len(n)) if more is None else more[order]
    tables = np.ones(len(n))
    present = 1
    while len(n) and present < n[0]:
        step = 1 if present < 64 else present // 8
        active = int(np.searchsorted(-n, -present, side="left"))
        t = tables[:active]
        w = weight[:active] + extra[:active] * t
        chance = w / (w + np.maximum(present + (step - 1) / 2 - discount * t, 1e-9))
        if step == 1:
            t += rng.random(active) < chance
        else:
            t += rng.binomial(np.minimum(step, n[:active] - present), chance)
        present += step
    out[order] = np.minimum(tables, n)
    return out


SWEPT = "kind int, bucket int, at bigint, v double, blob binary"
#: Kinds of rows, all of the bucket that they come from: what stays fixed, its tables, how its pairs stand in chunks,
#: what stays with a chunk, sums for the homes of contexts (``at``), totals of hot words and of all for the driver.
FIXED, TABLES, MAP, KEPT, SUMS, HOT, TOTAL = range(7)


def _left(number: int, fixed: tuple, tables: np.ndarray, root: np.ndarray, total: np.ndarray, common: _Common) -> Iterator[pd.DataFrame]:
    """The rows that a bucket leaves behind after a sweep."""
    word, context, count, contexts, hot = fixed
    word, hot = word.astype(np.int64), hot.astype(np.int64)
    small = np.uint8 if tables.max(initial=0) < 256 else np.int32
    rows = [(TABLES, number, 0, None, _pack((tables.astype(small), root.astype(np.int32), total.astype(np.float32))))]
    home = _home(contexts, common)
    sums = np.bincount(context, tables, len(contexts)).astype(np.int64), np.bincount(context, count, len(contexts)).astype(np.int64)
    cuts = np.searchsorted(home, np.arange(common.buckets + 1))
    for b in np.flatnonzero(np.diff(cuts)):
        own = slice(cuts[b], cuts[b + 1])
        rows.append((SUMS, number, int(b), None, _pack((contexts[own], *(x[own].astype(np.int32 if x[own].max() < 1 << 31 else np.int64) for x in sums)))))
    m = np.bincount(word, tables, len(hot))
    cold = hot < 0
    rows += [(HOT, number, int(h), float(v), None) for h, v in zip(hot[~cold & (m > 0)], m[~cold & (m > 0)], strict=True)]
    totals = [m.sum(), root[cold].sum(), (count == 1).sum(), (count == 2).sum(), (m[cold] == 1).sum(), (m[cold] == 2).sum()]
    rows += [(TOTAL, number, i, float(v), None) for i, v in enumerate(totals)]
    yield pd.DataFrame(rows, columns=["kind", "bucket", "at", "v", "blob"])


def _start(rows: DataFrame, common: _Common) -> DataFrame:
    """The dealt tokens in buckets, with one table a dish in every restaurant."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, list[pd.DataFrame]] = {}
        for batch in batches:
            kept = batch[batch["chunk"] < 0]
            if len(kept):
                yield pd.DataFrame({"kind": KEPT, "bucket": kept["bucket"], "at": -1 - kept["chunk"], "v": None, "blob": kept["blob"]})
            for bucket, part in batch[batch["chunk"] >= 0].groupby("bucket"):
                held.setdefault(bucket, []).append(part)
        for bucket in sorted(held):
            b = _Bucket(pd.concat(held.pop(bucket)), common)
            tables = (b.count > 0).astype(np.float64)
            root = (np.bincount(b.word, tables, len(b.words)) > 0).astype(np.float64)
            stay = [(FIXED, b.number, 0, None, _pack(b.fixed()))] + [(MAP, b.number, chunk, None, blob) for chunk, blob in b.maps()]
            yield pd.DataFrame(stay, columns=["kind", "bucket", "at", "v", "blob"])
            yield from _left(b.number, b.fixed(), tables, root, np.zeros(len(tables)), common)
            del b, tables, root, stay
            release()

    return written_in_buckets(_deal(rows, common).mapInPandas(run, SWEPT), common.buckets, shared_dir(rows.sparkSession))


def _answers(swept: DataFrame, common: _Common) -> DataFrame:
    """Per bucket the ``answers``: totals of its contexts, added up at the contexts' homes (``at``)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        frames = [b for b in batches if len(b)]
        for home, part in pd.concat(frames).groupby("at") if frames else ():
            sent = [_unpack(x) for x in part["blob"]]
            _, place = np.unique(np.concatenate([x[0] for x in sent]), return_inverse=True)
            sums = [np.bincount(place, np.concatenate([x[i] for x in sent]))[place].astype(np.int64) for i in (1, 2)]
            ends = np.cumsum([len(x[0]) for x in sent])
            for bucket, end, x in zip(part["bucket"], ends, sent, strict=True):
                own = slice(end - len(x[0]), end)
                blob = _pack(tuple(v[own].astype(np.int32 if v[own].max() < 1 << 31 else np.int64) for v in sums))
                yield pd.DataFrame({"bucket": [bucket], "at": [home], "blob": [blob]})

    sums = swept.where(F.col("kind") == SUMS).select("bucket", "at", "blob")
    homes = sums.repartitionById(common.buckets, F.col("at").cast("int")).mapInPandas(run, "bucket int, at bigint, blob binary")
    return homes.groupBy("bucket").agg(F.collect_list(F.struct("at", "blob")).alias("answers"))


def _state(swept: DataFrame, common: _Common, before: _State | None, seed: int) -> _State:
    """Totals after a sweep; the hot words, whose customers sit in many buckets, are seated in the root here."""
    got = swept.where(F.col("kind") >= HOT).groupBy("kind", "at").agg(F.sum("v").alias("v")).toPandas()
    hot, totals = np.zeros(len(common.hot)), np.zeros(6)
    for kind, array in ((HOT, hot), (TOTAL, totals)):
        own = got[got["kind"] == kind]
        array[own["at"].to_numpy(int)] = own["v"].to_numpy()

    def discount(n1: float, n2: float) -> float:
        return float(np.clip(n1 / (n1 + 2 * n2), 0.1, 0.95)) if n1 else 0.5

    if before is None:
        tables = (hot > 0).astype(np.float64)
        d, d0 = discount(totals[2], totals[3]), discount(totals[4], totals[5])
    else:
        tables = _seat_root(hot, before.hot_tables, before, 1 / (common.types + 1), np.random.default_rng([seed, 1 << 31]))
        d, d0 = before.discount, before.root_discount
    return _State(hot, tables, totals[0], totals[1] + tables.sum(), d, d0)


def _met(first: DataFrame, swept: DataFrame, common: _Common) -> DataFrame:
    """A row per bucket: what is ``fixed``, its ``tables``, and the ``answers`` about its contexts."""
    fixed = first.where(F.col("kind") == FIXED).select("bucket", F.col("blob").alias("fixed"))
    tables = swept.where(F.col("kind") == TABLES).select("bucket", F.col("blob").alias("tables"))
    # merge joins, as blobs are for no hash table; both sides lie in buckets
    return fixed.join(tables.hint("merge"), "bucket").join(_answers(swept, common).hint("merge"), "bucket")


def _seating(row, common: _Common, state: _State) -> _Seating:
    answers = [_unpack(a["blob"]) for a in sorted(row.answers, key=lambda a: a["at"])]
    return _Seating(int(row.bucket), _unpack(row.fixed), _unpack(row.tables), answers, common, state)


def _sweep(first: DataFrame, swept: DataFrame, common: _Common, state: _State, seed: int, sample: bool, path: str) -> DataFrame:
    """The next sweep from the tables of the last; if that was a sample, its probabilities are added up first."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                b = _seating(row, common, state)
                if sample:
                    b.total += b.probability()
                b.sweep(seed)
                yield from _left(b.number, b.fixed, b.tables, b.root, b.total, common)
                del b
                release()

    return written_in_buckets(_met(first, swept, common).mapInPandas(run, SWEPT), common.buckets, path)


def _chain(rows: DataFrame, common: _Common, sweeps: int, burn_in: int) -> Iterator[tuple[DataFrame, DataFrame, _State]]:
    """The first rows, the rows left and the state: at the start, then after each sweep."""
    spark, before = rows.sparkSession, None
    first = swept = _start(rows, common)
    state = _state(swept, common, None, 0)
    yield first, swept, state
    for i in range(1, sweeps + 1):
        # files of shuffles go when the driver's JVM collects what refers to them
        spark._jvm.System.gc()
        path = shared_dir(spark)
        swept = _sweep(first, swept, common, state, i, i - 1 > burn_in, path)
        state = _state(swept, common, state, i)
        if before:
            remove(spark, before)
        before = path
        yield first, swept, state
    spark._jvm.System.gc()


def _score(first: DataFrame, swept: DataFrame, common: _Common, state: _State, samples: int) -> DataFrame:
    """Sums of every document: buckets send the scores of their pairs back to the chunks these came from."""
    floor = np.log10(common.tokens + common.types + 1)

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                seating = _seating(row, common, state)
                score = np.log10(np.maximum((seating.total + seating.probability()) / samples, 1e-300)).astype(np.float32)
                del seating
                for m in sorted(row.maps, key=lambda m: m["at"]):
                    tokens, steps = _unpack(m["blob"])
                    pairs = np.cumsum(steps, dtype=np.int64)
                    home = np.int32(_home_of_chunk(int(m["at"]), common))
                    yield pd.DataFrame({"home": [home], "bucket": [row.bucket], "chunk": [m["at"]], "blob": [_pack((tokens, score[pairs]))]})
                del score
                release()

    def add_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                sent: dict[int, list] = {}
                for x in sorted(row.sent, key=lambda x: x["bucket"]):
                    sent.setdefault(x["chunk"], []).append(x["blob"])
                for k in row.kept:
                    yield of_chunk(_unpack(k["blob"]), [_unpack(x) for x in sent.pop(k["at"])])

    def of_chunk(kept: tuple, back: list[tuple]) -> pd.DataFrame:
        docs, held, sizes, n_pairs, n_docs, doc, times, many = kept
        times = times.astype(np.int64)
        times[times == 255] = many
        tokens = np.repeat(np.repeat(np.concatenate([x[0] for x in back]), n_pairs), n_docs)
        sums = [np.bincount(doc, times * v, len(docs)) for v in (tokens > 0, np.log10(tokens + 1) - floor, np.repeat(np.concatenate([x[1] for x in back]), n_docs))]
        return pd.DataFrame(
            {
                "doc_id": pd.array([None if pd.isna(d) else int(d) for d in docs], "Int64"),
                "held_out": held,
                "n_tokens": sizes,
                "n_known": sums[0].astype(np.int64),
                "base_score": sums[1],
                "score": sums[2],
            }
        )

    maps = first.where(F.col("kind") == MAP).groupBy("bucket").agg(F.collect_list(F.struct("at", "blob")).alias("maps"))
    sent = _met(first, swept, common).join(maps.hint("merge"), "bucket").mapInPandas(work, "home int, bucket int, chunk bigint, blob binary")
    back = sent.groupBy(F.col("home").alias("bucket")).agg(F.collect_list(F.struct("bucket", "chunk", "blob")).alias("sent"))
    kept = first.where(F.col("kind") == KEPT).groupBy("bucket").agg(F.collect_list(F.struct("at", "blob")).alias("kept"))
    met = kept.hint("merge").join(back.hint("merge"), "bucket")
    return met.mapInPandas(add_up, "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, base_score double, score double")


def _common(rows: DataFrame) -> _Common:
    """What every task knows, from the counts of all training words."""
    vocab = written(vocabulary(rows))
    tokens, types = vocab.agg(F.sum("n"), F.count("*")).first()
    tokens = tokens or 0
    # at most MOST_HOT rows
    hot = vocab.where((F.col("n") * 4 >= BUCKET_TOKENS) & (F.col("n") * MOST_HOT >= tokens)).toPandas().sort_values("word", ignore_index=True)
    return _Common(
        tokens,
        types,
        hot["word"].to_numpy(np.int64),
        hot["n"].to_numpy(float),
        max(1, -(-tokens // BUCKET_TOKENS), int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")) if tokens > BUCKET_TOKENS else 1),
    )


def score(docs: DataFrame, key: str = "doc_id", text: str = "text", rounds: int = ROUNDS, samples: int = SAMPLES) -> DataFrame:
    """Base score and model score of every document, learned from those whose crc32(key) mod 7 is not 2."""
    small_batches(docs.sparkSession)
    rows = _rows(docs, key, text)
    common = _common(rows)
    for first, swept, state in _chain(rows, common, rounds + samples, rounds):
        pass
    sums = _score(first, swept, common, state, samples)
    return sums.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(common.tokens).cast("long").alias("train_tokens"), "base_score", "score")


def perplexity(scores: DataFrame, column: str = "score") -> DataFrame:
    """Perplexity per side of the split, from the summed log10 probabilities."""
    return scores.groupBy("held_out").agg(F.pow(F.lit(10.0), -F.sum(column) / F.sum("n_tokens")).alias("perplexity"))
