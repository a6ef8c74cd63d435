"""Refinement of motifs in memory, against tasks and brute force."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from kmerloom.operators import alignment, motifs
from kmerloom.operators.motifs import Motif


def peaks_of(spark, rng, n):
    core = ["TACGT", "GGCATT", "CCCCA"]
    rows = {}
    for i in range(n):
        body = ["".join(rng.choice(list("ACGT"), rng.integers(0, 6))) for _ in range(2)]
        rows[body[0] + (core[i % 3] if i % 4 else "") + body[1] or "A"] = float(rng.integers(1, 400)) / 64 * (1 if i % 5 else -1)
    rows["ACGT" * 40] = 3.0
    return spark.createDataFrame(list(rows.items()), "seq string, weight double")


def same(a, b):
    assert [(m.name, m.sign) for m in a] == [(m.name, m.sign) for m in b]
    assert all(np.allclose(x.columns, y.columns, atol=1e-9) for x, y in zip(a, b, strict=True))


def test_in_memory_equals_tasks(spark, monkeypatch):
    rng = np.random.default_rng(6)
    peaks = peaks_of(spark, rng, 420).cache()
    start = [Motif("a", 1, ((0.0, 0.0, 0.0, 1.0), (0.9, 0.1, 0.0, 0.0), (0.0, 1.0, 0.0, 0.0), (0.0, 0.0, 1.0, 0.0))), Motif("b", 1, ((0.0, 1.0, 0.0, 0.0),) * 5), Motif("c", -1, ((0.0, 0.0, 1.0, 0.0), (0.0, 0.0, 1.0, 0.0), (0.0, 1.0, 0.0, 0.0)))]
    shares = motifs.background(peaks)
    options = motifs.MotifOptions(max_rounds=3)
    monkeypatch.setattr(alignment, "AT_ONCE", 0)  # bins go to tasks
    read = []
    plain = motifs._InTasks
    monkeypatch.setattr(motifs, "_InTasks", lambda *a: read.append(1) or plain(*a))
    found = motifs.refine(peaks, start, shares, 1, options, 2.0)
    pruned = motifs.prune(peaks, start, shares, -1, options, 2.0)
    assert not read  # no table is written a round
    monkeypatch.setattr(motifs, "IN_MEMORY", 0)
    want = motifs.refine(peaks, start, shares, 1, options, 2.0)
    assert read and found[1] == pytest.approx(want[1], abs=1e-6)
    same(found[0], want[0])
    same(pruned, motifs.prune(peaks, start, shares, -1, options, 2.0))


def test_groups_in_memory_have_the_bins_of_tables(spark):
    rng = np.random.default_rng(7)
    rows = [("NA", "".join(rng.choice(list("ACGT"), rng.integers(1, 12))), float(rng.integers(1, 99)) / 7) for _ in range(700)]
    rows += [("NA", "ACGTT" * 30, 2.5), rows[0], ("NA", "", 1.0)]
    table = alignment.group_profiles(spark.createDataFrame(rows, "motif string, seq string, weight double"), 40).orderBy("pos").collect()
    aligner = alignment.GroupAligner(spark, 40)
    got = aligner.profile([s for _, s, _ in rows], [w for *_, w in rows])
    assert np.allclose(got, [[r[x] for x in (*"ACGT", "gap")] for r in table], atol=1e-9)
    made = len(aligner.known)
    again = aligner.profile([s for _, s, _ in rows], [w for *_, w in rows])
    assert np.array_equal(got, again) and len(aligner.known) == made
    assert aligner.profile([], []).shape == (0, 5) and aligner.profile(["AC"], [2.0]).tolist() == [[2, 0, 0, 0, 0], [0, 2, 0, 0, 0]]
    names = ["", "ACGT", "A" * 33, "AC" * 40]
    hashed = spark.createDataFrame([(s, 1.25) for s in names], "name string, weight double").select(F.pmod(F.xxhash64("name", "weight"), F.lit(7)))
    assert [alignment._part(s, 1.25, 7) for s in names] == [r[0] for r in hashed.collect()]


def test_wide_matrices_cost_their_letters(monkeypatch):
    """A long sequence among short ones adds no work to theirs."""
    rng = np.random.default_rng(8)
    seqs = ["".join(rng.choice(list("ACGTN"), n)) for n in (3, 0, 7, 190, 7, 500, 1)]
    table = np.log2(rng.dirichlet(np.ones(5), 400)).tolist()
    monkeypatch.setattr(motifs, "WINDOWS", 1000)
    best, place = motifs.best_windows(seqs, table)
    for s, top, at in zip(seqs, best, place, strict=True):
        padded = "-" * 400 + s + "-" * 400
        scores = [round(sum(table[j]["ACGT-".index(c)] if c != "N" else -np.inf for j, c in enumerate(padded[i : i + 400])), 9) for i in range(len(s) + 400)]
        assert top == pytest.approx(max(scores), abs=2e-9) or top == max(scores)
        assert at == int(np.argmax(scores))
    taken = []
    plain = motifs._codes_of
    monkeypatch.setattr(motifs, "_codes_of", lambda text: taken.append(len(text)) or plain(text))
    motifs.best_windows(seqs[:5], table)
    assert sum(taken) == sum(map(len, seqs[:5]))


def test_seeds_in_memory_equal_tables(spark, monkeypatch):
    from kmerloom.plans import experiment

    peaks = peaks_of(spark, np.random.default_rng(9), 90).cache()
    options = motifs.MotifOptions(min_weight_share=0.02)
    got = experiment._seed_motifs(peaks, 1, options)
    own = motifs.members_of(peaks, 1)
    seeds = dict(zip(own.seqs, motifs.cover_in_memory(own), strict=True))
    table = motifs.seed_cover(peaks.where("weight > 0"))
    assert {r["seq"]: r["seed"] for r in table.collect()} == seeds
    monkeypatch.setattr(motifs, "IN_MEMORY", 0)
    want = experiment._seed_motifs(peaks, 1, options)
    assert len(got) > 2
    same(got, want)


def test_long_alignments_leave_their_outer_dashes(spark, monkeypatch):
    from kmerloom.sources import tables

    rng = np.random.default_rng(10)
    seqs = ["".join(rng.choice(list("ACGT"), n)) for n in rng.integers(3, 20, 40)] + ["AC--GT", "T" * 70]
    rows = [("-" * int(a) + s + "-" * int(200 - len(s) - a), float(w) / 32) for s, a, w in zip(seqs, rng.integers(60, 120, 42), [*rng.integers(1, 99, 41), 9000], strict=True)]
    read = []
    monkeypatch.setattr(tables, "stage", lambda df, plain=tables.stage: read.append(plain(df)) or read[-1])
    got = motifs.from_alignment(spark.createDataFrame(rows, "aligned string, weight double")).orderBy("pos").collect()
    want = motifs.build_matrix(*zip(*rows, strict=True))
    assert np.allclose([[r[x] for x in "ACGT"] for r in got], want)
    # the sums are a row a column, made once for the edges and the matrix
    assert len(read) == 1 and read[0].count() == 200
    assert motifs.from_alignment(spark.createDataFrame([], "aligned string, weight double")).collect() == []
