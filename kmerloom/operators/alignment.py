"""Multiple alignment of weighted sequences, group by group.

Sequences are aligned progressively: pairs are compared first, a guide tree
joins the most alike, and along the tree alignments are aligned with each
other, column by column, with affine gaps; gaps at the ends cost their
extension alone.  What is kept of an alignment is its profile: how many
sequences, and how much weight, have each letter or a dash in each column.

A group of any size is worked off in bins of about ``BIN`` sequences that lie
nearest to the same of its heaviest sequences, each bin in a task of its own;
the bins' profiles are aligned in the same way until one is left.  So no task
sees a whole group, every sequence counts, and a group that fits a bin is
aligned along one guide tree.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kmerloom.sources.tables import stage

LETTERS = "ACGT"
#: Score of equal and of different letters (the usual matrix of nucleotides), cost of a gap's first and of each further place.
MATCH, MISMATCH, GAP_OPEN, GAP_EXTEND = 5.0, -4.0, 100.0, 1.25
#: Sequences of a bin, and heaviest sequences of a group that bins form around.
BIN, CENTRES = 128, 16
#: Pairs times columns that are scored together.
CELLS = 1 << 18
#: Cells of bins below which they are aligned at once, without tasks; bins that are remembered.
AT_ONCE, REMEMBERED = 1 << 20, 20_000

_SCORES = np.where(np.eye(4, dtype=bool), MATCH, MISMATCH)
_CODES = np.full(256, 4, np.int64)
_CODES[np.frombuffer(b"ACGT", np.uint8)] = np.arange(4)


def codes(seq: str) -> np.ndarray:
    """0 to 3 for A, C, G and T, 4 for all else."""
    return _CODES[np.frombuffer(seq.encode("ascii", "replace"), np.uint8)]


@dataclass
class Profile:
    """Columns of an alignment: numbers of sequences (``n``) and their weights (``w``) by A, C, G, T and dash."""

    n: np.ndarray
    w: np.ndarray
    size: float
    weight: float

    @classmethod
    def of(cls, seq: str, weight: float) -> Profile:
        own = codes(seq)
        n = np.zeros((len(own), 5))
        known = own < 4
        n[np.flatnonzero(known), own[known]] = 1.0
        return cls(n, n * weight, 1.0, weight)

    @property
    def shares(self) -> np.ndarray:
        return self.n[:, :4] / self.size

    @property
    def consensus(self) -> str:
        """The likeliest letter of the columns that more than half of the sequences share."""
        return "".join(LETTERS[int(c[:4].argmax())] for c in self.n if c[:4].sum() * 2 > self.size)

    def spread(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Counts and weights of the columns ``at``; -1 is a column of dashes."""
        n, w = (np.vstack([x, [0, 0, 0, 0, whole]]) for x, whole in ((self.n, self.size), (self.w, self.weight)))
        return n[at], w[at]


def pair(scores: np.ndarray, gap_open: float = GAP_OPEN, extend: float = GAP_EXTEND) -> tuple[float, np.ndarray, np.ndarray]:
    """Best alignment of two rows of columns by the scores of their pairs: its score, and per place the column of each or -1.

    A gap of k places costs ``gap_open`` and k - 1 extensions, or k
    extensions at an end.  Of equal ways a pair goes before a gap in the
    second, and that before a gap in the first.
    """
    if scores.shape[0] <= scores.shape[1]:
        return _pair(scores, gap_open, extend, [0, 1, 2])
    # the shorter one is gone through step by step
    best, left, right = _pair(scores.T, gap_open, extend, [0, 2, 1])
    return best, right, left


def _pair(scores: np.ndarray, gap_open: float, extend: float, order: list[int]) -> tuple[float, np.ndarray, np.ndarray]:
    """``pair`` with the last steps in the order in which they go before each other."""
    m, n = scores.shape
    low = -np.inf
    both, first, second = (np.full((m + 1, n + 1), low) for _ in range(3))  # the last step: a pair, a column of the first or of the second alone
    both[0, 0] = 0.0
    first_open = np.full(n + 1, gap_open)
    first_open[[0, n]] = extend
    steps = extend * np.arange(n + 1)
    for i in range(m + 1):
        if i:
            both[i, 1:] = np.maximum(np.maximum(both[i - 1, :-1], first[i - 1, :-1]), second[i - 1, :-1]) + scores[i - 1]
            first[i] = np.maximum(np.maximum(both[i - 1], second[i - 1]) - first_open, first[i - 1] - extend)
        opened = extend if i in (0, m) else gap_open
        # the best place before where the gap can have begun
        start = np.maximum.accumulate(np.maximum(both[i], first[i]) + steps)
        second[i, 1:] = start[:-1] - opened - (steps[1:] - extend)

    def likeliest(values: list[float]) -> int:
        most = max(values) - 1e-9
        return next(k for k in order if values[k] >= most)

    i, j = m, n
    tables = (both, first, second)
    state = likeliest([float(t[m, n]) for t in tables])
    best = max(float(t[m, n]) for t in tables)
    left: list[int] = []
    right: list[int] = []
    while i or j:
        if state == 0:
            left.append(i - 1)
            right.append(j - 1)
            i, j = i - 1, j - 1
            costs = (0.0, 0.0, 0.0)
        elif state == 1:
            left.append(i - 1)
            right.append(-1)
            i -= 1
            costs = (first_open[j], extend, first_open[j])
        else:
            left.append(-1)
            right.append(j - 1)
            j -= 1
            opened = extend if i in (0, m) else gap_open
            costs = (opened, opened, extend)
        state = likeliest([float(t[i, j] - c) for t, c in zip(tables, costs, strict=True)])
    return best, np.array(left[::-1], int), np.array(right[::-1], int)


def merge(a: Profile, b: Profile) -> tuple[Profile, np.ndarray, np.ndarray]:
    """The profile of two aligned with each other, and the columns of each per place (-1: dashes)."""
    _, left, right = pair(a.shares @ _SCORES @ b.shares.T)
    (n1, w1), (n2, w2) = a.spread(left), b.spread(right)
    return Profile(n1 + n2, w1 + w2, a.size + b.size, a.weight + b.weight), left, right


def pair_scores(seqs: Sequence[str]) -> np.ndarray:
    """Scores of the best alignments of all pairs of sequences, each with itself too; pairs of like lengths are computed together."""
    own = [codes(s) for s in seqs]
    size = np.array([len(c) for c in own])
    a, b = np.triu_indices(len(seqs))
    a, b = np.where(size[a] <= size[b], a, b), np.where(size[a] <= size[b], b, a)  # the shorter one first
    out = np.zeros(len(a))
    like = np.ceil(np.log2(np.maximum(size, 1))).astype(int)
    kinds = like[a] * 64 + like[b]
    for kind in np.unique(kinds):
        at = np.flatnonzero(kinds == kind)
        step = max(1, CELLS // (int(size[b[at]].max()) + 1))
        for lo in range(0, len(at), step):
            some = at[lo : lo + step]
            out[some] = _scores_of([own[i] for i in a[some]], [own[i] for i in b[some]])
    scores = np.zeros((len(seqs), len(seqs)))
    scores[a, b] = scores[b, a] = out
    return scores


def _scores_of(short: list[np.ndarray], long: list[np.ndarray]) -> np.ndarray:
    """Scores of pairs of coded sequences, as ``pair`` finds them, all pairs a row at a time."""
    m, n = (np.array([len(c) for c in side]) for side in (short, long))
    x, y = (np.full((len(short), int(sizes.max(initial=0))), 4) for sizes in (m, n))
    for letters, side in ((x, short), (y, long)):
        for i, c in enumerate(side):
            letters[i, : len(c)] = c
    table = np.zeros((5, 5))
    table[:4, :4] = _SCORES
    places = np.arange(y.shape[1] + 1)
    first_open = np.where((places == 0) | (places == n[:, None]), GAP_EXTEND, GAP_OPEN)
    steps = GAP_EXTEND * places
    both = np.full(first_open.shape, -np.inf)
    first, second, out = both.copy(), both.copy(), np.zeros(len(m))
    both[:, 0] = 0.0
    for i in range(x.shape[1] + 1):
        if i:
            reached = np.maximum(np.maximum(both, first), second)
            first = np.maximum(np.maximum(both, second) - first_open, first - GAP_EXTEND)
            both = np.full(first.shape, -np.inf)
            both[:, 1:] = reached[:, :-1] + table[x[:, i - 1, None], y]
        opened = np.where((i == 0) | (i == m), GAP_EXTEND, GAP_OPEN)[:, None]
        start = np.maximum.accumulate(np.maximum(both, first) + steps, axis=1)
        second = np.full(first.shape, -np.inf)
        second[:, 1:] = start[:, :-1] - opened - (steps[1:] - GAP_EXTEND)
        done = np.flatnonzero(m == i)
        out[done] = np.maximum(np.maximum(both[done, n[done]], first[done, n[done]]), second[done, n[done]])
    return out


def distances(seqs: Sequence[str]) -> np.ndarray:
    """1 less the score of a pair over the lesser of both scores with themselves."""
    scores = pair_scores(seqs)
    own = np.maximum(np.diag(scores), MATCH)
    return 1 - scores / np.minimum(own[:, None], own[None, :])


def guide_tree(distance: np.ndarray) -> list[tuple[int, int]]:
    """Pairs to join, nearest first, by average distance; the n-th join makes node len + n.  Of equals the first."""
    n = len(distance)
    d = distance.astype(float).copy()
    np.fill_diagonal(d, np.inf)
    name, size = list(range(n)), np.ones(n)
    out = []
    for step in range(n - 1):
        i, j = sorted(divmod(int(np.round(d, 9).argmin()), n))
        out.append((name[i], name[j]))
        joined = (size[i] * d[i] + size[j] * d[j]) / (size[i] + size[j])
        d[i], d[:, i] = joined, joined
        d[i, i], d[j], d[:, j] = np.inf, np.inf, np.inf
        size[i] += size[j]
        name[i] = n + step
    return out


def progressive(profiles: Sequence[Profile], names: Sequence[str]) -> tuple[Profile, list[np.ndarray]]:
    """One profile of all along their guide tree (by the sequences ``names``), and the columns of each per place (-1: dashes)."""
    nodes = list(profiles)
    members = [[i] for i in range(len(nodes))]
    columns = [np.arange(len(p.n)) for p in nodes]
    for i, j in guide_tree(distances(names)) if len(nodes) > 1 else []:
        joined, left, right = merge(nodes[i], nodes[j])
        for side, at in ((i, left), (j, right)):
            for k in members[side]:
                columns[k] = np.where(at < 0, -1, columns[k][at])
        nodes.append(joined)
        members.append(members[i] + members[j])
        nodes[i] = nodes[j] = None
    return nodes[-1], columns


def align(sequences: Sequence[str]) -> list[str]:
    """A few sequences in memory with dashes in their gaps; equal ones are aligned once."""
    distinct = sorted(set(sequences))
    if not distinct:
        return []
    _, columns = progressive([Profile.of(s, 1.0) for s in distinct], distinct)
    made = {s: "".join("-" if c < 0 else s[c] for c in at) for s, at in zip(distinct, columns, strict=True)}
    return [made[s] for s in sequences]


_SCHEMA = "motif string, name string, size double, weight double, n array<double>, w array<double>"


def _packed(p: Profile) -> dict:
    return {"size": p.size, "weight": p.weight, "n": p.n.reshape(-1), "w": p.w.reshape(-1)}


def _unpacked(r) -> Profile:
    return Profile(np.asarray(r.n).reshape(-1, 5), np.asarray(r.w).reshape(-1, 5), r.size, r.weight)


def _binned(rows: DataFrame, bin_size: int) -> DataFrame:
    """Profiles with the bin of their group: around the heaviest, and by hash where there are too many around one."""
    order = Window.partitionBy("motif").orderBy(F.desc(F.round("weight", 9)), "name")
    # a rank below 16 in a group needs no whole group in a task
    centres = rows.select("motif", "name", "weight").withColumn("c", F.row_number().over(order)).where(F.col("c") <= CENTRES)
    centres = centres.groupBy("motif").agg(F.sort_array(F.collect_list(F.struct("c", "name")))["name"].alias("centres"))
    sizes = rows.groupBy("motif").agg(F.count("*").alias("members"))

    @F.pandas_udf("int")
    def nearest(name: pd.Series, centre: pd.Series) -> pd.Series:
        return pd.Series([int(np.argmax([_alike(s, c) for c in others])) for s, others in zip(name, centre, strict=True)])

    joined = rows.join(sizes, "motif").join(centres, "motif")  # a row a group
    # a group that fits a bin is one
    near = F.when(F.col("members") > bin_size, nearest("name", "centres")).otherwise(0)
    placed = joined.withColumn("near", near).drop("centres", "members")
    counts = placed.groupBy("motif", "near").agg(F.ceil(F.count("*") / bin_size).alias("parts"))
    return placed.join(counts, ["motif", "near"]).withColumn("part", F.pmod(F.xxhash64("name", "weight"), "parts").cast("int")).drop("parts")


def _parts_of(s: str) -> set[str]:
    """Pairs and triples of letters."""
    return {s[i : i + k] for k in (2, 3) for i in range(len(s) - k + 1)}


def _alike(a: str, b: str) -> float:
    """Share of common pairs and triples of letters, for the choice of bins alone."""
    x, y = _parts_of(a), _parts_of(b)
    return len(x & y) / max(1, min(len(x), len(y)))


def group_profiles(members: DataFrame, bin_size: int = BIN) -> DataFrame:
    """``motif``, ``pos`` (from 0) and weights ``A``, ``C``, ``G``, ``T``, ``gap`` of the aligned sequences of each group.

    ``members`` has ``motif``, ``seq`` and ``weight``; equal sequences of a
    group are one with their weights together.  Null and empty sequences
    take no part.
    """
    alone = members.where(F.length("seq") > 0).groupBy("motif", "seq").agg(F.sum(F.abs("weight")).alias("weight"))

    def start(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            made = [_packed(Profile.of(s, w)) for s, w in zip(b["seq"], b["weight"], strict=True)]
            yield pd.DataFrame({"motif": b["motif"], "name": b["seq"], **{c: [m[c] for m in made] for c in ("size", "weight", "n", "w")}})

    def one(batch: pd.DataFrame) -> pd.DataFrame:
        batch = batch.sort_values(["name", "weight"], kind="stable")
        whole, _ = progressive([_unpacked(r) for r in batch.itertuples()], batch["name"].tolist())
        name = whole.consensus or batch["name"].iloc[0]
        return pd.DataFrame({"motif": batch["motif"].iloc[:1].tolist(), "name": [name], **{k: [v] for k, v in _packed(whole).items()}})

    rows = stage(alone.mapInPandas(start, _SCHEMA))
    most = rows.groupBy("motif").count().agg(F.max("count")).first()[0] or 0
    while most > 1:
        rows = stage(_binned(rows, bin_size).groupBy("motif", "near", "part").applyInPandas(one, _SCHEMA))
        fewer = rows.groupBy("motif").count().agg(F.max("count")).first()[0]
        # bins of one sequence each would go on for ever: wider ones then
        bin_size = bin_size if fewer <= most // 2 else 2 * bin_size
        most = fewer
    columns = F.posexplode(F.transform(F.sequence(F.lit(0), F.expr("size(w) div 5 - 1")), lambda i: F.slice("w", i * 5 + 1, 5))).alias("pos", "c")
    return rows.where(F.size("w") > 0).select("motif", columns).select("motif", "pos", *[F.col("c")[i].alias(x) for i, x in enumerate((*LETTERS, "gap"))])


_P1, _P2, _P3, _P4, _P5 = 0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5
_ALL = (1 << 64) - 1


def _turned(x: int, n: int) -> int:
    return (x << n | x >> (64 - n)) & _ALL


def _hash(data: bytes, seed: int) -> int:
    """xxHash of 64 bits, as ``F.xxhash64`` has it of one value."""
    n, at = len(data), 0

    def step(acc: int, word: int) -> int:
        return _turned((acc + word * _P2) & _ALL, 31) * _P1 & _ALL

    if n >= 32:
        v = [(seed + _P1 + _P2) & _ALL, (seed + _P2) & _ALL, seed, (seed - _P1) & _ALL]
        while at + 32 <= n:
            v = [step(x, int.from_bytes(data[at + 8 * i : at + 8 * i + 8], "little")) for i, x in enumerate(v)]
            at += 32
        h = sum(_turned(x, r) for x, r in zip(v, (1, 7, 12, 18), strict=True)) & _ALL
        for x in v:
            h = ((h ^ step(0, x)) * _P1 + _P4) & _ALL
    else:
        h = (seed + _P5) & _ALL
    h = (h + n) & _ALL
    while at + 8 <= n:
        h = (_turned(h ^ step(0, int.from_bytes(data[at : at + 8], "little")), 27) * _P1 + _P4) & _ALL
        at += 8
    if at + 4 <= n:
        h = (_turned(h ^ int.from_bytes(data[at : at + 4], "little") * _P1 & _ALL, 23) * _P2 + _P3) & _ALL
        at += 4
    for byte in data[at:]:
        h = _turned(h ^ byte * _P5 & _ALL, 11) * _P1 & _ALL
    h = (h ^ h >> 33) * _P2 & _ALL
    h = (h ^ h >> 29) * _P3 & _ALL
    return h ^ h >> 32


def _part(name: str, weight: float, parts: int) -> int:
    """``pmod(xxhash64(name, weight), parts)``."""
    h = _hash(np.float64(weight).tobytes(), _hash(name.encode(), 42))
    return (h - (1 << 64) if h >> 63 else h) % parts


@dataclass
class GroupAligner:
    """``group_profiles`` of one group whose sequences are in memory, bin by bin in tasks.

    Bins are those of ``group_profiles``.  A bin that was aligned before, in
    this or another group, is not aligned again: rounds of refinement change
    groups little.
    """

    spark: SparkSession
    bin_size: int = BIN
    known: dict[tuple, Profile] = field(default_factory=dict)
    parts: dict[str, set[str]] = field(default_factory=dict)

    def profile(self, seqs: Sequence[str], weights: Sequence[float]) -> np.ndarray:
        """Weights of A, C, G, T and dash by column; equal sequences are one."""
        if len(self.known) > REMEMBERED:
            self.known.clear()
        alone: dict[str, float] = {}
        for s, w in zip(seqs, weights, strict=True):
            if s:
                alone[s] = alone.get(s, 0.0) + abs(w)
        # name, weight, and what the profile is made from
        rows = [(s, w, (s, w)) for s, w in alone.items()]
        size = self.bin_size
        if len(rows) == 1:
            return Profile.of(*rows[0][:2]).w
        while len(rows) > 1:
            most = len(rows)
            bins = [sorted(b, key=lambda r: r[:2]) for b in self._bins(rows, size)]
            made = self._aligned([tuple(r[2] for r in b) for b in bins], bins)
            rows = [(p.consensus or b[0][0], p.weight, key) for (key, p), b in zip(made, bins, strict=True)]
            size = size if len(rows) <= most // 2 else 2 * size
        return self.known[rows[0][2]].w if rows else np.zeros((0, 5))

    def _bins(self, rows: list[tuple], size: int) -> list[list[tuple]]:
        if len(rows) <= size:
            return [rows]
        centres = [self._parts(r[0]) for r in sorted(rows, key=lambda r: (-round(r[1], 9), r[0]))[:CENTRES]]
        near: dict[int, list] = {}
        for r in rows:
            x = self._parts(r[0])
            near.setdefault(int(np.argmax([len(x & y) / max(1, min(len(x), len(y))) for y in centres])), []).append(r)
        out: dict[tuple, list] = {}
        for k, own in near.items():
            parts = -(-len(own) // size)
            for r in own:
                out.setdefault((k, _part(r[0], r[1], parts) if parts > 1 else 0), []).append(r)
        return list(out.values())

    def _parts(self, name: str) -> set[str]:
        if name not in self.parts:
            self.parts[name] = _parts_of(name)
        return self.parts[name]

    def _aligned(self, keys: list[tuple], bins: list[list[tuple]]) -> list[tuple[tuple, Profile]]:
        todo = {}
        for key, b in zip(keys, bins, strict=True):
            if key not in self.known:
                todo[key] = [(name, self.known.get(made) or Profile.of(*made)) for name, _, made in b]
        cells = sum(sum(len(name) for name, _ in b) ** 2 for b in todo.values())
        if len(todo) < 2 or cells < AT_ONCE:
            found = list(map(_of_bin, todo.values()))
        else:
            found = self.spark.sparkContext.parallelize(list(todo.values()), len(todo)).map(_of_bin).collect()
        self.known.update(zip(todo, found, strict=True))
        return [(key, self.known[key]) for key in keys]


def _of_bin(rows: list[tuple[str, Profile]]) -> Profile:
    return progressive([p for _, p in rows], [name for name, _ in rows])[0]
