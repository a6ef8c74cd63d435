"""Motifs as position weight matrices: scanning, assignment, construction, discovery."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kmerloom.functions.stats import running_sums
from kmerloom.operators.alignment import BIN, GroupAligner, align, group_profiles

LETTERS = "ACGT"
NONE = "NA"
#: Letters of sequences that are scored together, and of a sign's peaks that refinement keeps in memory.
SLICE, IN_MEMORY = 1 << 20, 4 << 20
#: Windows that are scored together.
WINDOWS = 1 << 20

_CODES = np.full(256, 5, np.uint8)
_CODES[np.frombuffer(b"ACGT-", np.uint8)] = np.arange(5)


@dataclass(frozen=True)
class MotifOptions:
    """Constants of motif discovery."""

    count_scale: float = 20.0
    pseudo_count: float = 1.0
    weight_scale: float = 1000.0
    min_information: float = 0.1
    max_rounds: int = 25
    min_weight_share: float = 0.01
    seed_lengths: tuple[int, ...] = (4, 5, 6)


@dataclass(frozen=True)
class Motif:
    """A named matrix: one row of four probabilities (A, C, G, T) per position."""

    name: str
    sign: int
    columns: tuple[tuple[float, ...], ...]

    def log2(self, scale: float = 20.0, pseudo: float = 1.0) -> list[list[float]]:
        """Log2 probabilities of A, C, G, T and the dash per position, with pseudo-counts."""
        out = []
        for column in self.columns:
            n = [math.floor(scale * p + 0.5) + pseudo for p in column] + [pseudo]
            out.append([math.log2(x / sum(n)) for x in n])
        return out


def best_windows(seqs: Sequence[str], table: Sequence[Sequence[float]], digits: int = 9) -> tuple[np.ndarray, np.ndarray]:
    """Per sequence the score of its best window and the window's place, the first of equals.

    ``table`` has log2 probabilities of A, C, G, T and the dash per position.
    A sequence is padded with as many dashes on both sides as the table has
    positions, and places count from the first dash; windows with unknown
    letters do not count (minus infinity).
    """
    m = len(table)
    rows = np.array([[*row, -np.inf] for row in table])
    sizes = np.fromiter(map(len, seqs), np.int64, len(seqs))
    best, place = np.zeros(len(seqs)), np.zeros(len(seqs), np.int64)
    # a table much longer than a sequence is mostly dashes
    for some, score in ((2 * sizes >= m, _by_columns), (2 * sizes < m, _by_letters)):
        own = np.flatnonzero(some)
        # like lengths together
        own = own[np.argsort(sizes[own], kind="stable")]
        for own in np.split(own, np.flatnonzero(np.diff(np.cumsum(sizes[own] + m) // WINDOWS)) + 1):
            if not len(own):
                continue
            n = sizes[own] + m  # windows of each sequence
            at = np.concatenate([[0], np.cumsum(n)[:-1]])
            total = np.round(score([seqs[i] for i in own], rows, n), digits)
            top = np.maximum.reduceat(total, at)
            hit = np.flatnonzero(total == np.repeat(top, n))
            of = np.repeat(np.arange(len(own)), n)[hit]
            _, first = np.unique(of, return_index=True)
            best[own], place[own] = top, hit[first] - at
    return best, place


def _codes_of(text: str) -> np.ndarray:
    return _CODES[np.frombuffer(text.encode("ascii", "replace"), np.uint8)]


def _by_columns(seqs: Sequence[str], rows: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Scores of all windows of all sequences, summed over the table's positions."""
    m = len(rows)
    pad = "-" * m
    flat = _codes_of("".join(f"{pad}{x}{pad}" for x in seqs))
    place = np.arange(int(n.sum())) + np.repeat(np.arange(len(seqs)) * m, n)
    total = np.zeros(len(place))
    for j, row in enumerate(rows):
        total += row[flat[place + j]]
    return total


def _by_letters(seqs: Sequence[str], rows: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The same, summed over the sequences' letters: each takes the place of a dash.  Sequences come in ascending order of length."""
    m = len(rows)
    dashes = rows[:, 4]
    # the last position first, as the window moves over a letter
    gain = np.ascontiguousarray((rows - dashes[:, None])[::-1].T)
    total = np.full(int(n.sum()), dashes.sum())
    lo = at = 0
    while lo < len(seqs):
        hi = int(np.searchsorted(n, n[lo], side="right"))
        count, size = hi - lo, int(n[lo])
        letters = _codes_of("".join(seqs[lo:hi])).reshape(count, size - m)
        part = total[at : at + count * size].reshape(count, size)
        for i in range(size - m):
            part[:, i + 1 : i + 1 + m] += gain[letters[:, i]]
        lo, at = hi, at + count * size
    return total


def _parts(batch: pd.DataFrame) -> Iterator[pd.DataFrame]:
    """Rows with a sequence, about ``SLICE`` letters of them together."""
    cuts = (batch["seq"].map(len).cumsum() // SLICE).to_numpy()
    for _, part in batch.groupby(cuts, sort=False):
        yield part


def scan(seqs: DataFrame, motifs: Sequence[Motif], scale: float = 20.0, pseudo: float = 1.0) -> DataFrame:
    """``id``, ``motif``, ``score`` (2^log2) and ``position`` of each motif's best window, the first of equals.

    Sequences are padded with as many dashes on both sides as the motif is
    long, so that a motif may hang over an end; positions can be 0 or less.
    """
    tables = [(motif.name, len(motif.columns), motif.log2(scale, pseudo)) for motif in motifs]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for part in _parts(batch):
                for name, m, table in tables:
                    best, place = best_windows(part["seq"].tolist(), table)
                    known = np.isfinite(best)
                    score = pd.array(np.where(known, 2.0 ** np.where(known, best, 0), 0), "Float64")
                    score[~known] = None
                    yield pd.DataFrame({"id": part["id"], "motif": name, "score": score, "position": (place + 1 - m).astype(np.int32)})

    kind = seqs.schema["id"].dataType.simpleString()
    return seqs.where("seq is not null").select("id", "seq").mapInPandas(run, f"id {kind}, motif string, score double, position int")


def background(seqs: DataFrame) -> list[float]:
    """Shares of A, C, G and T in sequences (equal shares if there are none)."""
    n = seqs.agg(*[F.sum(F.length("seq") - F.length(F.translate("seq", x, ""))).alias(x) for x in LETTERS]).first()
    total = sum(v or 0 for v in n)
    return [(v or 0) / total for v in n] if total else [0.25] * 4


def assign(peaks: DataFrame, motifs: Sequence[Motif], shares: Sequence[float], options: MotifOptions = MotifOptions(), windows: bool = False) -> DataFrame:
    """``peaks`` (``seq``, ``weight``) with ``motif`` and ``llr``, its log2 odds over the background.

    A peak takes the motif of its sign whose best window is best above the
    best window of background letters; the first of equals, and none if all
    are below the background.  ``windows`` adds the motif's best ``window``
    with its dashes.  Null sequences and weights take no motif.
    """
    tables = [(m.name, m.sign, m.log2(options.count_scale, options.pseudo_count)) for m in motifs]
    plain = {len(t): Motif(NONE, 0, (tuple(shares),) * len(t)).log2(options.count_scale, options.pseudo_count) for _, _, t in tables}

    def of_part(part: pd.DataFrame) -> pd.DataFrame:
        seqs, place_of = np.unique(part["seq"].to_numpy(object), return_inverse=True)
        seqs = seqs.tolist()
        sign = np.sign(part["weight"].fillna(0).to_numpy(float))
        below = {m: best_windows(seqs, table)[0] for m, table in plain.items()}
        llr, name = np.full(len(part), -np.inf), np.full(len(part), NONE, object)
        window = np.full(len(part), None, object)
        for motif, of, table in tables:
            m = len(table)
            best, place = best_windows(seqs, table)
            with np.errstate(invalid="ignore"):
                odds = np.round(best - below[m], 9)[place_of]
            better = (sign == of) & (odds > llr)
            llr[better], name[better] = odds[better], motif
            if windows:
                for i in np.flatnonzero(better):
                    at, pad = int(place[place_of[i]]), "-" * m
                    window[i] = f"{pad}{seqs[place_of[i]]}{pad}"[at : at + m]
        name[llr < 0] = NONE
        odds = pd.array(np.where(np.isfinite(llr), llr, 0), "Float64")
        odds[~np.isfinite(llr)] = None
        return part.assign(motif=name, llr=odds, **({"window": window} if windows else {}))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            whole = batch["seq"].notna()
            if (~whole).any():
                yield batch[~whole].assign(motif=NONE, llr=None, **({"window": None} if windows else {}))
            for part in _parts(batch[whole]):
                yield of_part(part)

    extra = ", window string" if windows else ""
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in peaks.schema.fields if f.name not in ("motif", "llr", "window"))
    return peaks.drop("motif", "llr", "window").mapInPandas(run, f"{columns}, motif string, llr double{extra}")


def group_stats(assigned: DataFrame, motifs: Sequence[Motif] | None = None) -> DataFrame:
    """Per motif and sign: number of peaks and sum of |weight|; motifs without a peak have zeros if they are named."""
    sign = F.signum("weight").cast("int")
    found = assigned.groupBy("motif", sign.alias("sign")).agg(F.count("*").alias("n_peaks"), F.sum(F.abs("weight")).alias("weight"))
    if motifs is None:
        return found
    names = assigned.sparkSession.createDataFrame([(m.name, m.sign) for m in motifs], "motif string, sign int")
    every = names.union(found.select("motif", "sign")).distinct()
    return every.join(found, ["motif", "sign"], "left").fillna(0, ["n_peaks"]).fillna(0.0, ["weight"])


def heavy_motifs(groups: DataFrame, share: float = 0.01) -> DataFrame:
    """Groups (``consensus``, ``sign``, ``weight``) with a share of all weight, and the heaviest of each sign."""
    total = groups.groupBy("consensus", "sign").agg(F.sum(F.abs("weight")).alias("weight"))
    whole = total.agg(F.sum("weight").alias("whole"))
    top = F.row_number().over(Window.partitionBy("sign").orderBy(F.desc("weight"), "consensus"))
    ranked = total.withColumn("rank", top).join(F.broadcast(whole))  # one row
    return ranked.where((F.col("weight") >= share * F.col("whole")) | (F.col("rank") == 1)).select("consensus", "sign", "weight")


def seed_alignment(sequences: DataFrame, seed: str) -> DataFrame:
    """``seq`` padded with dashes so that the first occurrences of the seed stand in one column; others are left out."""
    at = F.instr("seq", seed)
    found = sequences.where(F.col("seq").contains(seed)).select("seq", "weight", at.alias("at"))
    edge = found.agg(F.max("at").alias("left"), F.max(F.length("seq") - F.col("at")).alias("right"))
    padded = F.concat(
        F.repeat(F.lit("-"), (F.col("left") - F.col("at")).cast("int")),
        F.col("seq"),
        F.repeat(F.lit("-"), (F.col("right") - F.length("seq") + F.col("at")).cast("int")),
    )
    return found.join(F.broadcast(edge)).select("seq", "weight", padded.alias("aligned"))  # one row


def _rounded(sums: Column, scale: float) -> Column:
    """A weight as a count, 1 at least where there is any."""
    return F.when(sums > 0, F.greatest(F.floor(sums * scale + 0.5), F.lit(1))).otherwise(0)


def from_alignment(aligned: DataFrame, options: MotifOptions = MotifOptions()) -> DataFrame:
    """``pos``, ``A``, ``C``, ``G``, ``T``, ``information`` of the matrix of weighted, aligned sequences.

    The weights of a column's letter are summed and then counted in
    thousandths, at least 1; its dashes give a quarter of their count to each
    letter.  Columns outside the first and last informative one are cut off.
    """
    from kmerloom.sources.tables import stage

    # dashes at the ends are most of a long alignment: they are what the other rows leave
    w, inner = F.abs("weight"), F.trim(F.col("aligned"), F.lit("-"))
    lead = F.length("aligned") - F.length(F.ltrim(F.col("aligned"), F.lit("-")))
    letters = aligned.select(w.alias("w"), lead.alias("lead"), F.posexplode(F.split(inner, "")).alias("i", "letter")).where("letter <> ''")
    per = letters.groupBy((F.col("lead") + F.col("i")).alias("pos")).agg(
        *[F.sum(F.when(F.col("letter") == x, F.col("w")).otherwise(0.0)).alias(x) for x in LETTERS + "-"], F.sum("w").alias("here"), F.count("*").alias("n")
    )
    whole = aligned.agg(F.max(F.length("aligned")).alias("width"), F.sum(w).alias("whole"), F.count("aligned").alias("members"))
    columns = whole.where("width > 0").select("whole", "members", F.explode(F.sequence(F.lit(0), F.col("width") - 1)).alias("pos"))
    filled = columns.join(per, "pos", "left").fillna(0.0, [*LETTERS, "-", "here"]).fillna(0, ["n"])
    # where all have a letter there is no dash, whatever the sums' last digits say
    outside = F.when(F.col("n") < F.col("members"), F.col("whole") - F.col("here")).otherwise(0.0)
    # a row a column of the alignment, read for the edges and the matrix
    sums = stage(filled.select("pos", *LETTERS, (F.col("-") + outside).alias("-")))
    counts = sums.select("pos", *[_rounded(F.col(x), options.weight_scale).alias(f"_{x}") for x in LETTERS + "-"])
    gap = F.floor(F.col("_-") / 4 + 0.5)
    filled = counts.select("pos", *[(F.col(f"_{x}") + gap).alias(x) for x in LETTERS])
    whole = sum((F.col(x) for x in LETTERS), F.lit(0))
    shares = filled.select("pos", *[F.try_divide(F.col(x).cast("double"), whole).alias(x) for x in LETTERS])
    entropy = sum((F.when(F.col(x) > 0, F.col(x) * F.log2(x)).otherwise(0.0) for x in LETTERS), F.lit(0.0))
    info = shares.withColumn("information", 2 + entropy)
    edge = info.where(F.col("information") > options.min_information).agg(F.min("pos").alias("first"), F.max("pos").alias("last"))
    inside = info.join(F.broadcast(edge), F.col("pos").between(F.col("first"), F.col("last")))  # one row
    return inside.select((F.col("pos") - F.col("first") + 1).alias("pos"), *LETTERS, "information")


def build_matrix(aligned: Sequence[str], weights: Sequence[float], options: MotifOptions = MotifOptions()) -> tuple[tuple[float, ...], ...]:
    """The matrix of ``from_alignment`` for a few sequences in memory."""
    sums = np.zeros((len(aligned[0]), 5))
    for s, w in zip(aligned, weights, strict=True):
        for i, c in enumerate(s):
            if c in "ACGT-":
                sums[i, "ACGT-".index(c)] += abs(w)
    return _matrix(sums, options)


def _matrix(sums: np.ndarray, options: MotifOptions) -> tuple[tuple[float, ...], ...]:
    """Shares of the letters between the first and last informative position, from the weights of A, C, G, T and dashes."""
    counts = np.where(sums > 0, np.maximum(np.floor(sums * options.weight_scale + 0.5), 1), 0)
    letters = counts[:, :4] + np.floor(counts[:, 4:] / 4 + 0.5)
    p = letters / np.maximum(letters.sum(1, keepdims=True), 1)
    info = 2 + np.where(p > 0, p * np.log2(np.maximum(p, 1e-300)), 0).sum(1)
    keep = np.flatnonzero(info > options.min_information)
    p = p[keep[0] : keep[-1] + 1] if len(keep) else p
    return tuple(tuple(map(float, row)) for row in p)


def consensus(columns: Sequence[Sequence[float]]) -> str:
    """The likeliest letter of each position, the first of equals."""
    return "".join(LETTERS[int(np.argmax(c))] for c in columns)


def seed_cover(peaks: DataFrame, lengths: Sequence[int] = (4, 5, 6)) -> DataFrame:
    """Greedy cover of peaks (``seq``, ``weight``) by k-mers: ``seq``, ``weight``, ``seed``, ``round``.

    A k-mer weighs, over the peaks not yet covered, the sum of its length
    times the peak's weight over the peak's length.  Each round takes the
    heaviest (then the longest, then the first), and the peaks that hold it
    are covered; peaks without any k-mer stay without a seed.

    A k-mer that comes before all others of its peaks keeps its weight until
    its round, since only seeds of its own peaks could lower it.  So all such
    k-mers are taken at once, and rounds are numbered at the end: a pass takes
    as many seeds as do not touch each other, and no seed reaches the driver.
    """
    from kmerloom.sources.tables import stage

    # pairs carry a number in place of the sequence
    whole = stage(peaks.select("seq", "weight").distinct().withColumn("peak", F.monotonically_increasing_id()))
    words = F.array_distinct(F.flatten(F.array(*[_words_of(F.col("seq"), k) for k in lengths])))
    pairs = whole.select("peak", (F.abs("weight") / F.length("seq")).alias("unit"), F.explode(words).alias("seed"))
    tops, taken = [], []
    while True:
        sums = pairs.groupBy("seed").agg(F.sum(F.length("seed") * F.col("unit")).alias("v")).where("v > 0")
        rank = F.struct((-F.round("v", 9)).alias("v"), (-F.length("seed")).alias("len"), "seed")
        ranked = pairs.join(sums, "seed").select("peak", "unit", "seed", rank.alias("rank"))
        first = stage(ranked.groupBy("peak", "unit").agg(F.min("rank").alias("best"), F.collect_list("seed").alias("seeds")))
        if first.isEmpty():
            break
        # a k-mer is taken where each of its peaks puts it first
        each = first.select("best", F.explode("seeds").alias("seed"))
        ready = each.groupBy("seed").agg(F.min("best").alias("best"), F.bool_and(F.col("seed") == F.col("best.seed")).alias("ready"))
        ready = stage(ready.where("ready").select("best", F.lit(1).alias("one"), F.lit(len(taken)).alias("pass")))
        tops.append(first.select("peak", "best", F.lit(len(taken)).alias("pass")))
        taken.append(ready)
        pairs = first.join(ready, "best", "left_anti").select("peak", "unit", F.explode("seeds").alias("seed"))
    if not taken:
        return whole.select("seq", "weight", F.lit(NONE).alias("seed"), F.lit(None).cast("int").alias("round"))
    seeds = running_sums(reduce(DataFrame.union, taken), "best", round="one")
    covered = reduce(DataFrame.union, tops).join(seeds, ["best", "pass"])
    numbered = covered.select("peak", F.col("best.seed").alias("seed"), F.col("round").cast("int").alias("round"))
    out = whole.join(numbered, "peak", "left")
    return out.select("seq", "weight", F.coalesce("seed", F.lit(NONE)).alias("seed"), "round")


def _words_of(seq: Column, k: int) -> Column:
    """All words of ``k`` letters of a sequence, with repeats."""
    last = F.length(seq) - (k - 1)
    at = F.when(last > 0, F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.substring(seq, i, F.lit(k)))


def seed_profiles(covered: DataFrame, bin_size: int = BIN) -> DataFrame:
    """``motif``, ``pos`` and weights ``A``, ``C``, ``G``, ``T``, ``gap`` of the peaks of each seed (``motif``), first occurrences in one column.

    Two peaks alone are aligned with each other instead, seed or none.
    """
    each = covered.where(F.col("motif") != NONE).groupBy("motif", "seq").agg(F.sum(F.abs("weight")).alias("w"))
    sizes = each.groupBy("motif").agg(F.count("*").alias("members"), F.sum("w").alias("whole"))
    placed = each.join(sizes, "motif")
    pairs = group_profiles(placed.where("members = 2").select("motif", "seq", F.col("w").alias("weight")), bin_size)
    at = F.instr("seq", F.col("motif"))
    letters = placed.where("members <> 2").select("motif", "w", "whole", at.alias("at"), F.posexplode(F.split("seq", "")).alias("i", "letter"))
    sums = [F.sum(F.when(F.col("letter") == x, F.col("w")).otherwise(0.0)).alias(x) for x in LETTERS]
    per = letters.groupBy("motif", (F.col("i") - F.col("at")).alias("pos")).agg(*sums, F.sum("w").alias("here"), F.count("*").alias("n"), F.max("whole").alias("whole"))
    every = per.join(sizes.select("motif", "members"), "motif")
    # where all have a letter there is no dash, whatever the sums' last digits say
    gap = F.when(F.col("n") < F.col("members"), F.col("whole") - F.col("here")).otherwise(0.0)
    return every.select("motif", "pos", *LETTERS, gap.alias("gap")).unionByName(pairs)


def named(groups: dict[str, list[tuple]], sign: int, options: MotifOptions = MotifOptions()) -> list[Motif]:
    """Motifs from weights of A, C, G, T and dashes by position, named after their consensus; of one name the first."""
    out: dict[str, Motif] = {}
    for name in sorted(groups):
        columns = _matrix(np.array([row[1:] for row in sorted(groups[name])], float), options)
        if columns:
            name = f"{consensus(columns)}{'+' if sign > 0 else '-'}"
            out.setdefault(name, Motif(name, sign, columns))
    return list(out.values())


def window_profiles(assigned: DataFrame) -> DataFrame:
    """``motif``, ``pos`` and weights of letters and dashes of peaks that have a motif, from the windows that ``assign`` found."""
    letters = assigned.select("motif", F.abs("weight").alias("w"), F.posexplode(F.split("window", "")).alias("pos", "letter"))
    sums = [F.sum(F.when(F.col("letter") == x, F.col("w")).otherwise(0.0)).alias(c) for x, c in zip(LETTERS + "-", [*LETTERS, "gap"], strict=True)]
    return letters.groupBy("motif", "pos").agg(*sums)


def rebuild(assigned: DataFrame, sign: int, options: MotifOptions = MotifOptions(), bin_size: int = BIN) -> list[Motif]:
    """A motif for every group of peaks of a sign, from all of its peaks; only matrices reach the driver.

    Peaks with a motif count by their best windows; those without are a
    group that is aligned as a whole.
    """
    own = assigned.where(F.signum("weight") == sign)
    groups: dict[str, list] = {}
    for part in (window_profiles(own.where(F.col("motif") != NONE)), group_profiles(own.where(F.col("motif") == NONE), bin_size)):
        for r in part.collect():
            groups.setdefault(r["motif"], []).append((r["pos"], *(r[x] for x in (*LETTERS, "gap"))))
    return named(groups, sign, options)


def refine(peaks: DataFrame, motifs: Sequence[Motif], shares: Sequence[float], sign: int, options: MotifOptions = MotifOptions(), min_weight: float = 0.0) -> tuple[list[Motif], float]:
    """Hard expectation maximisation on the peaks of a sign: assign and rebuild while the total log2 odds rise.

    Groups lighter than ``min_weight`` are dropped, but the heaviest stays;
    peaks without a motif form a group that can become one; motifs without a
    peak go.
    """
    return _refine(members_of(peaks, sign), [m for m in motifs if m.sign == sign], shares, sign, options, min_weight)


def _refine(own: DataFrame | Members, state: list[Motif], shares: Sequence[float], sign: int, options: MotifOptions, min_weight: float) -> tuple[list[Motif], float]:
    best, kept = -math.inf, []
    for _ in range(options.max_rounds):
        if not state:
            break
        assigned = _assigned(own, state, shares, sign, options)
        total = assigned.total()
        if total <= best:
            break
        weights = assigned.weights()
        best, kept = total, [m for m in state if m.name in weights]
        heaviest = max(weights, key=lambda m: (weights[m], m), default=None)
        names = [m for m, w in weights.items() if w >= min_weight or m == heaviest]
        state = assigned.rebuilt(names)
    return kept, best


def prune(peaks: DataFrame, motifs: Sequence[Motif], shares: Sequence[float], sign: int, options: MotifOptions = MotifOptions(), min_weight: float = 0.0) -> list[Motif]:
    """Leave each motif out in turn, the lightest first, and refine the others; what comes of it stays, and fewer motifs shorten the turn."""
    own = members_of(peaks, sign)
    state, _ = _refine(own, [m for m in motifs if m.sign == sign], shares, sign, options, min_weight)
    weights = _assigned(own, state, shares, sign, options).weights() if state else {}
    state = sorted(state, key=lambda m: (weights.get(m.name, 0.0), m.name))
    turn = 0
    while turn < len(state) - 1:
        before = len(state)
        state, _ = _refine(own, state[:turn] + state[turn + 1 :], shares, sign, options, min_weight)
        if len(state) >= before:
            turn += 1
    return state


class _InTasks:
    """Peaks of a sign with their motifs, as a table that is written once, as several aggregations read it."""

    def __init__(self, own: DataFrame, state: Sequence[Motif], shares: Sequence[float], sign: int, options: MotifOptions):
        from kmerloom.sources.tables import stage

        self.rows, self.sign, self.options = stage(assign(own, state, shares, options, windows=True)), sign, options

    def total(self) -> float:
        return self.rows.agg(F.sum("llr")).first()[0] or 0.0

    def weights(self) -> dict[str, float]:
        return {r["motif"]: r["weight"] for r in group_stats(self.rows).collect()}

    def rebuilt(self, names: list[str]) -> list[Motif]:
        return rebuild(self.rows.where(F.col("motif").isin(names)), self.sign, self.options)


class Members:
    """Peaks of a sign in memory, with the best windows of the matrices that were looked for last.

    The columns are those of a table of peaks with a sequence and a weight;
    scores of a matrix do not change while it stays as it is, which most do
    from round to round.
    """

    def __init__(self, spark, seqs: Sequence[str], weights: Sequence[float]):
        self.seqs, self.weight = list(seqs), np.abs(np.asarray(weights, float))
        self.aligner = GroupAligner(spark)
        self.found: dict[tuple, tuple[np.ndarray, np.ndarray]] = {}
        sizes = np.cumsum([len(s) for s in self.seqs])
        cuts = np.searchsorted(sizes, np.arange(SLICE, int(sizes[-1]) if len(sizes) else 0, SLICE)).tolist()
        self.slices = [self.seqs[a:b] for a, b in zip([0, *cuts], [*cuts, len(self.seqs)], strict=True) if b > a]

    def look(self, tables: list[tuple]) -> list[tuple[np.ndarray, np.ndarray]]:
        """The best windows of each table; those of other tables are forgotten."""
        kept = {t: self.found[t] for t in tables if t in self.found}
        for t in tables:
            if t not in kept:
                parts = [best_windows(s, t) for s in self.slices]
                kept[t] = tuple(np.concatenate([p[i] for p in parts]) if parts else np.zeros(0, kind) for i, kind in ((0, float), (1, np.int64)))
        self.found = kept
        return [kept[t] for t in tables]


class _InMemory:
    """``_InTasks`` of peaks in memory, with the same rules as ``assign``, ``window_profiles`` and ``rebuild``."""

    def __init__(self, own: Members, state: Sequence[Motif], shares: Sequence[float], sign: int, options: MotifOptions):
        def table(m: Motif) -> tuple:
            return tuple(map(tuple, m.log2(options.count_scale, options.pseudo_count)))

        self.own, self.sign, self.options = own, sign, options
        tables = [table(m) for m in state]
        plain = {len(t): table(Motif(NONE, 0, (tuple(shares),) * len(t))) for t in tables}
        looked = own.look([*tables, *plain.values()])
        below = {m: looked[len(tables) + i][0] for i, m in enumerate(plain)}
        self.names = [*(m.name for m in state), NONE]
        self.llr, self.place = np.full(len(own.seqs), -np.inf), np.zeros(len(own.seqs), np.int64)
        self.motif = np.full(len(own.seqs), len(state))
        self.widths = [len(t) for t in tables]
        for i, (t, (best, place)) in enumerate(zip(tables, looked, strict=False)):
            with np.errstate(invalid="ignore"):
                odds = np.round(best - below[len(t)], 9)
            better = odds > self.llr
            self.llr[better], self.place[better], self.motif[better] = odds[better], place[better], i
        self.motif[self.llr < 0] = len(state)

    def total(self) -> float:
        return float(self.llr[np.isfinite(self.llr)].sum())

    def weights(self) -> dict[str, float]:
        n = np.bincount(self.motif, minlength=len(self.names))
        sums = np.bincount(self.motif, self.own.weight, len(self.names))
        return {name: float(w) for name, w, k in zip(self.names, sums, n, strict=True) if k}

    def rebuilt(self, names: list[str]) -> list[Motif]:
        groups: dict[str, list] = {}
        for i, name in enumerate(self.names):
            rows = np.flatnonzero(self.motif == i)
            if name not in names or not len(rows):
                continue
            seqs, weight = [self.own.seqs[r] for r in rows], self.own.weight[rows]
            if name == NONE:
                sums = self.own.aligner.profile(seqs, weight)
            else:
                pad, m = "-" * self.widths[i], self.widths[i]
                place, step, sums = self.place[rows].tolist(), max(1, SLICE // m), np.zeros((m, 5))
                for lo in range(0, len(rows), step):
                    some = slice(lo, lo + step)
                    windows = "".join([f"{pad}{s}{pad}"[a : a + m] for s, a in zip(seqs[some], place[some], strict=True)])
                    sums += np.stack([np.bincount(c, weight[some], 6)[:5] for c in _codes_of(windows).reshape(-1, m).T])
            if len(sums):
                groups[name] = [(pos, *map(float, row)) for pos, row in enumerate(sums)]
        return named(groups, self.sign, self.options)


def cover_in_memory(own: Members, lengths: Sequence[int] = (4, 5, 6)) -> list[str]:
    """``seed_cover`` of peaks in memory that are distinct: the seed of each."""
    words = [{s[i : i + k] for k in lengths for i in range(len(s) - k + 1)} for s in own.seqs]
    # the first of equal weights is the longest and then the first
    names = sorted(set().union(*words), key=lambda x: (-len(x), x)) if words else []
    number = {x: i for i, x in enumerate(names)}
    peak = np.repeat(np.arange(len(words)), [len(x) for x in words])
    word = np.fromiter((number[x] for own_words in words for x in own_words), np.int64, len(peak))
    unit = own.weight / np.maximum([len(s) for s in own.seqs], 1)
    value = unit[peak] * np.array([len(x) for x in names], float)[word]
    seeds = [NONE] * len(words)
    while len(peak):
        v = np.round(np.bincount(word, value, len(names)), 9)
        first = int(v.argmax())
        if v[first] <= 0:
            break
        covered = np.zeros(len(words), bool)
        covered[peak[word == first]] = True
        for i in np.flatnonzero(covered):
            seeds[i] = names[first]
        rest = ~covered[peak]
        peak, word, value = peak[rest], word[rest], value[rest]
    return seeds


def seed_motifs_in_memory(own: Members, sign: int, options: MotifOptions = MotifOptions()) -> list[Motif]:
    """Motifs of the heavy groups of a cover, as ``heavy_motifs`` and ``seed_profiles`` make them of tables."""
    members: dict[str, list[int]] = {}
    for i, seed in enumerate(cover_in_memory(own, options.seed_lengths)):
        members.setdefault(seed, []).append(i)
    weights = {seed: float(own.weight[rows].sum()) for seed, rows in members.items()}
    least, heaviest = options.min_weight_share * sum(weights.values()), min(weights, key=lambda x: (-weights[x], x), default=None)
    groups: dict[str, list] = {}
    for seed, rows in members.items():
        if seed == NONE or (weights[seed] < least and seed != heaviest):
            continue
        seqs, weight = [own.seqs[r] for r in rows], own.weight[rows]
        if len(rows) == 2:
            groups[seed] = [(pos, *map(float, row)) for pos, row in enumerate(own.aligner.profile(seqs, weight))]
            continue
        sizes = np.array([len(s) for s in seqs])
        at = np.array([s.index(seed) for s in seqs])
        pos = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes + at, sizes) + at.max()
        each = np.repeat(weight, sizes)
        sums = np.bincount(pos * 6 + _codes_of("".join(seqs)), each, 6 * (int(pos.max()) + 1)).reshape(-1, 6)
        # where all have a letter there is no dash, whatever the sums' last digits say
        gap = np.where(np.bincount(pos) < len(rows), weight.sum() - np.bincount(pos, each), 0.0)
        groups[seed] = [(i, *map(float, row[:4]), float(g)) for i, (row, g) in enumerate(zip(sums, gap, strict=True))]
    return named(groups, sign, options)


def members_of(peaks: DataFrame, sign: int) -> DataFrame | Members:
    """Peaks of a sign: in memory up to ``IN_MEMORY`` letters, else as they are."""
    own = peaks.where(F.signum("weight") == sign).select("seq", "weight")
    # what a peak takes beside its letters counts as 64 of them
    held = own.agg(F.sum(F.length("seq") + 64)).first()[0] or 0
    if held > IN_MEMORY or own.where("seq is null").limit(1).count():
        return own
    rows = own.toPandas().sort_values(["seq", "weight"], kind="stable")
    return Members(own.sparkSession, rows["seq"].tolist(), rows["weight"].to_numpy(float))


def _assigned(own: DataFrame | Members, state: Sequence[Motif], shares: Sequence[float], sign: int, options: MotifOptions) -> _InTasks | _InMemory:
    return (_InMemory if isinstance(own, Members) else _InTasks)(own, state, shares, sign, options)


def least_error_threshold(points: DataFrame) -> DataFrame:
    """The value at which the weight of errors is least: errors are negatives (``hit`` false) from it on and positives below it."""
    each = points.groupBy("x").agg(
        F.sum(F.when(F.col("hit"), F.col("weight")).otherwise(0.0)).alias("h"), F.sum(F.when(F.col("hit"), 0.0).otherwise(F.col("weight"))).alias("f")
    )
    whole = points.agg(F.sum(F.when(F.col("hit"), 0.0).otherwise(F.col("weight"))).alias("all_f"))
    error = F.col("h_upto") - F.col("h") + F.col("all_f") - F.col("f_upto") + F.col("f")
    return running_sums(each, "x", h_upto="h", f_upto="f").join(F.broadcast(whole)).select("x", error.alias("error")).agg(F.min_by("x", F.struct("error", "x")).alias("threshold"), F.min("error").alias("error"))
