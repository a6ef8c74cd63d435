"""K-mer features of nucleotide sequences.

Counts and weights are made a sequence at a time: letters become numbers, a
k-mer is a number in base four, and numpy counts or weighs all of a batch of
rows at once, for all k in one pass and without a shuffle.  A row is one
sequence, so ids are expected to be unique.  Positional weights stay one
array per sequence (``id``, ``seq``, ``w``) until a long table is asked for.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LETTERS = ("A", "C", "G", "T")
#: Letters that are worked on together; k up to which a number in base four fits; k with a table entry for every k-mer.
SLICE, LONGEST_K, DENSE_K = 1 << 22, 31, 10
#: Positions whose scales or marks travel to the tasks as arrays; longer sequences are joined instead.
MAX_POSITIONS = 1 << 22

_CODES = np.full(256, 4, np.uint8)
_CODES[np.frombuffer(b"ACGTacgt", np.uint8)] = [0, 1, 2, 3, 0, 1, 2, 3]


def dna(text: Column) -> Column:
    """Upper-case nucleotide letters of a text; a locale never decides what is upper case."""
    return F.regexp_replace(F.translate(text, "acgt", "ACGT"), "[^ACGT]", "")


def lexicon(spark: SparkSession, k: int) -> DataFrame:
    """All 4^k k-mers over ACGT (``kmer``)."""
    if k < 1:
        raise ValueError("k must be at least 1")
    letters = F.array(*[F.lit(x) for x in LETTERS])
    out = spark.range(1).select(F.explode(letters).alias("kmer"))
    for _ in range(k - 1):
        out = out.withColumn("x", F.explode(letters)).select(F.concat("kmer", "x").alias("kmer"))
    return out


def _slices(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows whose sequences have about ``SLICE`` letters together; null sequences are empty."""
    for batch in batches:
        if len(batch):
            batch = batch.assign(seq=batch["seq"].fillna(""))
            cuts = (batch["seq"].map(len).cumsum() // SLICE).to_numpy()
            for _, part in batch.groupby(cuts, sort=False):
                yield part


def _laid_out(seqs: Iterable[str]) -> tuple[np.ndarray, np.ndarray]:
    """Letter codes of sequences end to end (4: no letter; one behind each sequence), and where they begin."""
    seqs = list(seqs)
    sizes = np.fromiter(map(len, seqs), np.int64, len(seqs))
    flat = _CODES[np.frombuffer("\n".join([*seqs, ""]).encode("ascii", "replace"), np.uint8)]
    return flat, np.concatenate([[0], np.cumsum(sizes + 1)])


def _numbers(flat: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k-mer at each place as a number, and whether it is one."""
    n = max(len(flat) - k + 1, 0)
    code, ok = np.zeros(n, np.int32 if k <= 15 else np.int64), np.ones(n, bool)
    for j in range(k):
        letter = flat[j : j + n]
        ok &= letter < 4
        code = code * 4 + (letter & 3)
    return code, ok


def _words(code: np.ndarray, k: int) -> np.ndarray:
    """K-mers by their numbers."""
    distinct, place = np.unique(code, return_inverse=True) if k > 7 else (np.arange(4**k), code)
    letters = np.empty((len(distinct), k), np.uint8)
    for j in range(k):
        letters[:, k - 1 - j] = np.frombuffer(b"ACGT", np.uint8)[distinct >> (2 * j) & 3]
    return letters.view(f"S{k}").ravel().astype(str).astype(object)[place]


def _tally(flat: np.ndarray, starts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sequence, number and count of the k-mers of sequences laid end to end."""
    found = []
    of = np.repeat(np.arange(len(starts) - 1, dtype=np.int32), np.diff(starts))
    for lo in range(0, len(flat), SLICE):
        code, ok = _numbers(flat[lo : lo + SLICE + k - 1], k)
        place = np.flatnonzero(ok)
        row = of[place + lo].astype(np.int64)
        if len(starts) << 2 * k < 1 << 62:
            key = row << 2 * k | code[place]
            if len(starts) << 2 * k < 1 << 31:
                key = key.astype(np.int32)
            key, n = np.unique(key, return_counts=True)
            found.append((key.astype(np.int64) >> 2 * k, key & (4**k - 1), n))
        else:
            both, n = np.unique(np.stack([row, code[place]]), axis=1, return_counts=True)
            found.append((both[0], both[1], n))
    if len(found) == 1:
        return found[0]
    row, code, n = (np.concatenate([f[i] for f in found]) for i in range(3))
    order = np.lexsort((code, row))
    row, code, n = row[order], code[order], n[order]
    first = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (code[1:] != code[:-1])])) if len(row) else order
    return row[first], code[first], np.add.reduceat(n, first) if len(first) else n


def _any_letters(part: pd.DataFrame, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, k-mer and count, whatever the letters."""
    upper = part["seq"].str.translate(str.maketrans("acgt", "ACGT"))
    each = [(i, w, n) for i, s in enumerate(upper) for w, n in Counter(s[j : j + k] for j in range(len(s) - k + 1)).items()]
    row, word, n = zip(*each, strict=True) if each else ((), (), ())
    return np.array(row, np.int64), np.array(word, object), np.array(n, np.int64)


def occurrences(seqs: DataFrame, k: int, acgt_only: bool = True) -> DataFrame:
    """``id``, ``start`` (from 1) and ``kmer`` of every k-mer occurrence."""
    if k < 1:
        raise ValueError("k must be at least 1")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in _slices(batches):
            upper = part["seq"].str.translate(str.maketrans("acgt", "ACGT"))
            for i, s in zip(part["id"], upper, strict=True):
                for lo in range(0, len(s) - k + 1, SLICE):
                    at = range(lo, min(lo + SLICE, len(s) - k + 1))
                    yield pd.DataFrame({"id": i, "start": np.arange(at.start, at.stop, dtype=np.int32) + 1, "kmer": [s[j : j + k] for j in at]})

    kind = seqs.schema["id"].dataType.simpleString()
    out = seqs.select("id", "seq").mapInPandas(run, f"id {kind}, start int, kmer string")
    return out.where(F.col("kmer").rlike("^[ACGT]+$")) if acgt_only else out


def counts(seqs: DataFrame, ks: int | range | list[int], acgt_only: bool = True) -> DataFrame:
    """``id``, ``kmer``, ``k``, ``cnt``: overlapping occurrences, for one or several k; a row of ``seqs`` is one sequence."""
    ks = [ks] if isinstance(ks, int) else list(ks)
    if min(ks) < 1:
        raise ValueError("k must be at least 1")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in _slices(batches):
            ids = part["id"].to_numpy()
            flat, starts = _laid_out(part["seq"])
            for k in ks:
                if acgt_only and k <= LONGEST_K:
                    row, code, n = _tally(flat, starts, k)
                    word = _words(code, k)
                else:
                    row, word, n = _any_letters(part, k)
                    if acgt_only:
                        plain = np.array([set(w) <= set("ACGT") for w in word], bool)
                        row, word, n = row[plain], word[plain], n[plain]
                yield pd.DataFrame({"id": ids[row], "kmer": word, "k": np.int32(k), "cnt": n})

    kind = seqs.schema["id"].dataType.simpleString()
    return seqs.select("id", "seq").mapInPandas(run, f"id {kind}, kmer string, k int, cnt bigint")


def totals(seqs: DataFrame, ks: int | range | list[int]) -> DataFrame:
    """``k``, ``kmer``, ``n_ids`` (sequences that hold it) and ``total``; each task sends one row per k-mer, k up to ``DENSE_K``."""
    ks = [ks] if isinstance(ks, int) else list(ks)
    if not 1 <= min(ks) <= max(ks) <= DENSE_K:
        raise ValueError(f"k must be from 1 to {DENSE_K}")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, sums = ({k: np.zeros(4**k, np.int64) for k in ks} for _ in range(2))
        for part in _slices(batches):
            flat, starts = _laid_out(part["seq"])
            for k in ks:
                _, code, n = _tally(flat, starts, k)
                held[k] += np.bincount(code, minlength=4**k)
                sums[k] += np.bincount(code, n, 4**k).astype(np.int64)
        for k in ks:
            some = np.flatnonzero(held[k])
            yield pd.DataFrame({"k": np.int32(k), "kmer": _words(some, k), "n_ids": held[k][some], "total": sums[k][some]})

    parts = seqs.select("id", "seq").mapInPandas(run, "k int, kmer string, n_ids bigint, total bigint")
    return parts.groupBy("k", "kmer").agg(F.sum("n_ids").alias("n_ids"), F.sum("total").alias("total"))


def presence(counted: DataFrame, min_ids: int = 2) -> DataFrame:
    """In how many sequences each k-mer occurs (``n_ids``), for those in ``min_ids`` or more."""
    out = counted.groupBy("kmer").agg(F.count("*").alias("n_ids"), F.sum("cnt").alias("total"))
    return out.where(F.col("n_ids") >= min_ids)


def _table(model: DataFrame) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Per k the sorted numbers and weights of a model's k-mers; a model has at most as many rows as features were selected."""
    rows = model.select("kmer", "weight").toPandas()
    rows = rows[rows["kmer"].str.fullmatch("[ACGT]+")]
    out = {}
    for k, part in rows.groupby(rows["kmer"].map(len)):
        code = np.array([int(w.translate(str.maketrans("ACGT", "0123")), 4) for w in part["kmer"]], np.int64)
        order = np.argsort(code)
        out[int(k)] = code[order], part["weight"].to_numpy(float)[order]
    return out


def weight_arrays(seqs: DataFrame, model: DataFrame) -> DataFrame:
    """``id``, ``seq``, ``w``: per position the weights of all model k-mers that lie over it; 0 where none does."""
    table = _table(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in _slices(batches):
            flat, starts = _laid_out(part["seq"])
            w = np.zeros(len(flat))
            for k, (known, weight) in table.items():
                for lo in range(0, len(flat), SLICE):
                    code, ok = _numbers(flat[lo : lo + SLICE + k - 1], k)
                    at = np.minimum(np.searchsorted(known, code), len(known) - 1)
                    hit = np.where(ok & (known[at] == code), weight[at], 0.0)
                    for j in range(k):
                        w[lo + j : lo + j + len(hit)] += hit
            yield pd.DataFrame({"id": part["id"], "seq": part["seq"], "w": [w[a : b - 1] for a, b in zip(starts[:-1], starts[1:], strict=True)]})

    kind = seqs.schema["id"].dataType.simpleString()
    return seqs.select("id", "seq").mapInPandas(run, f"id {kind}, seq string, w array<double>")


def weight_sums(seqs: DataFrame, model: DataFrame) -> DataFrame:
    """``id``, ``len`` and ``raw``, the weights of all model k-mers of a sequence, each as often as it occurs; a row for every sequence."""
    table = _table(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in _slices(batches):
            flat, starts = _laid_out(part["seq"])
            raw = np.zeros(len(part))
            for k, (known, weight) in table.items():
                for lo in range(0, len(flat), SLICE):
                    code, ok = _numbers(flat[lo : lo + SLICE + k - 1], k)
                    at = np.minimum(np.searchsorted(known, code), len(known) - 1)
                    hit = np.flatnonzero(ok & (known[at] == code))
                    row = np.searchsorted(starts, hit + lo, side="right") - 1
                    raw += np.bincount(row, weight[at[hit]], len(part))
            yield pd.DataFrame({"id": part["id"], "len": part["seq"].map(len).astype(np.int32), "raw": raw})

    kind = seqs.schema["id"].dataType.simpleString()
    return seqs.select("id", "seq").mapInPandas(run, f"id {kind}, len int, raw double")


def long_weights(arrays: DataFrame) -> DataFrame:
    """``id``, ``pos`` (from 1), ``w`` of weights in arrays."""
    return arrays.select("id", F.posexplode("w").alias("at", "w")).select("id", (F.col("at") + 1).alias("pos"), "w")


def positional_weights(seqs: DataFrame, model: DataFrame) -> DataFrame:
    """``id``, ``pos``, ``w``: ``weight_arrays`` as a long table."""
    return long_weights(weight_arrays(seqs, model))


def position_masses(arrays: DataFrame) -> DataFrame:
    """``pos``, ``pos_mass``, ``neg_mass`` and ``used`` (whether any weight is there); each task sends one row per position."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = np.zeros((2, 0))
        used, longest = np.zeros(0, bool), 0
        for batch in batches:
            for w in batch["w"]:
                if len(w) > len(used):
                    wider = max(len(w), 2 * len(used))
                    sums = np.pad(sums, ((0, 0), (0, wider - len(used))))
                    used = np.pad(used, (0, wider - len(used)))
                n = len(w)
                sums[0, :n] += np.maximum(w, 0)
                sums[1, :n] += np.maximum(-np.asarray(w), 0)
                used[:n] |= np.asarray(w) != 0
                longest = max(n, longest)
        n = longest
        yield pd.DataFrame({"pos": np.arange(1, n + 1, dtype=np.int32), "pos_mass": sums[0, :n], "neg_mass": sums[1, :n], "used": used[:n]})

    parts = arrays.select("w").mapInPandas(run, "pos int, pos_mass double, neg_mass double, used boolean")
    return parts.groupBy("pos").agg(F.sum("pos_mass").alias("pos_mass"), F.sum("neg_mass").alias("neg_mass"), F.bool_or("used").alias("used"))


def position_scales(masses: DataFrame, band: float = 0.2) -> DataFrame:
    """``pos``, ``up``, ``down``: how far the positive and negative mass of a position is above the median position."""
    middle = masses.agg(F.median("pos_mass").alias("pm"), F.median("neg_mass").alias("nm"))

    def scale(x: str, m: str) -> Column:
        r = F.try_divide(x, m)
        return F.when((F.abs(r - 1) < band) | (r < 1), F.lit(1.0)).otherwise(r)

    joined = masses.join(F.broadcast(middle))  # one row
    return joined.select("pos", scale("pos_mass", "pm").alias("up"), scale("neg_mass", "nm").alias("down"))


def position_arrays(table: DataFrame, *columns: str) -> list[np.ndarray] | None:
    """Columns of a table by position as arrays for the tasks; none beyond ``MAX_POSITIONS``."""
    n = table.agg(F.max("pos")).first()[0] or 0
    if n > MAX_POSITIONS:
        return None
    rows = table.select("pos", *columns).toPandas().sort_values("pos")
    out = []
    for c in columns:
        values = rows[c].to_numpy()
        full = np.zeros(n, bool if values.dtype == bool else float)
        full[rows["pos"].to_numpy(int) - 1] = values
        out.append(full)
    return out


def norm_weights(arrays: DataFrame, masses: DataFrame | None = None, band: float = 0.2) -> DataFrame:
    """Weights in arrays divided by their position's scale; 0 where that is undefined."""
    scales = position_scales(position_masses(arrays) if masses is None else masses, band)
    known = position_arrays(scales, "up", "down")
    if known is None:
        w = F.col("w")
        scaled = F.when(w > 0, w / F.col("up")).when(w < 0, w / F.col("down")).otherwise(0.0)
        long_ = long_weights(arrays).join(scales, "pos").select("id", "pos", F.coalesce(scaled, F.lit(0.0)).alias("w"))
        back = long_.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("pos", "w"))).alias("p"))
        return arrays.select("id", "seq").join(back, "id", "left").select("id", "seq", F.coalesce(F.col("p.w"), F.array().cast("array<double>")).alias("w"))
    up, down = known

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for w in batch["w"]:
                w = np.asarray(w)
                by = np.where(w > 0, up[: len(w)], down[: len(w)])
                scaled = np.divide(w, by, out=np.zeros(len(w)), where=(w != 0) & ~np.isnan(by))
                out.append(scaled)
            yield batch.assign(w=out)

    return arrays.mapInPandas(run, arrays.schema)


def preselect(tested: DataFrame, max_kmers: int) -> DataFrame:
    """K-mers whose smaller one-sided p-value is among the ``max_kmers`` least; ties at the end are kept."""
    v = F.least("p_right", "p_left")
    scored = tested.select("*", v.alias("v"))
    # the bound is the max_kmers-th least value, so all that tie with it stay
    bound = scored.select("v").where("v is not null").orderBy("v").limit(max_kmers).agg(F.max("v").alias("bound"))
    return scored.join(F.broadcast(bound), F.col("v") <= F.col("bound")).drop("bound")


class _Words:
    """Rows of a table function: the distinct words of ``k`` of the four letters in a sequence, and how often each occurs."""

    def eval(self, seq: str, k: int) -> Iterator[tuple[str, int]]:
        if seq is None or k is None or k < 1:
            return
        found: dict[str, int] = {}
        for part in re.split("[^ACGT]+", seq):
            for i in range(len(part) - k + 1):
                word = part[i : i + k]
                found[word] = found.get(word, 0) + 1
        yield from found.items()


def register_table_function(spark: SparkSession, name: str = "kmers") -> None:
    """Let SQL ask for words: ``SELECT id, kmer, cnt FROM seqs, LATERAL kmers(seq, 3)``; null sequences have none."""
    spark.udtf.register(name, F.udtf(_Words, returnType="kmer string, cnt bigint"))
