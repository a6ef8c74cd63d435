"""Registered queries on small tables, against brute force."""

import numpy as np
import pytest

from kmerloom.operators import motifs
from kmerloom.plans import fixtures as fx
from kmerloom.plans import registry


def documents(spark, folder, texts):
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{folder}/documents.parquet")
    return str(folder)


def test_pwm_scan_reads_whole_sequences(spark, tmp_path):
    rng = np.random.default_rng(0)
    texts = ["".join(rng.choice(list("ACGT"), n)) for n in (30, 300, 500)] + ["G" * 200 + "TACAACGGGACTA" + "G" * 200]
    d = documents(spark, tmp_path, texts)
    seqs = {r["id"]: r["seq"] for r in fx.sequences(spark, d).collect()}
    want = {}
    for i, seq in seqs.items():
        for motif in fx.MOTIFS:
            table, m = motif.log2(), len(motif.columns)
            padded = "-" * m + seq + "-" * m
            scores = [round(sum(table[j]["ACGT-".index(padded[at + j])] for j in range(m)), 9) for at in range(len(padded) - m)]
            at = max(range(len(scores)), key=lambda x: (scores[x], -x))
            want[i, motif.name] = (at + 1 - m, 2 ** scores[at])
    got = {(r["id"], r["motif"]): (r["position"], r["score"]) for r in registry.pwm_scan(spark, d).collect()}
    assert set(got) == set(want)
    for k, (position, value) in want.items():
        assert got[k] == (position, pytest.approx(value, abs=1e-8))
    assert max(position for position, _ in got.values()) > 60


def plain_cover(peaks, lengths=(4, 5, 6)):
    """Seed and round by distinct peak, one seed after the other."""
    rest = {(s, w): {s[i : i + k] for k in lengths for i in range(len(s) - k + 1)} for s, w in peaks}
    want = {p: ("NA", None) for p in rest}
    number = 0
    while True:
        sums = {}
        for (s, w), seeds in rest.items():
            for seed in seeds:
                sums[seed] = sums.get(seed, 0) + len(seed) * abs(w) / len(s)
        sums = {x: v for x, v in sums.items() if v > 0}
        if not sums:
            return want, number
        number += 1
        seed = min(sums, key=lambda x: (-round(sums[x], 9), -len(x), x))
        want |= {p: (seed, number) for p, seeds in rest.items() if seed in seeds}
        rest = {p: seeds for p, seeds in rest.items() if seed not in seeds}


def test_seed_cover_goes_on(spark, tmp_path, monkeypatch):
    words = ["".join(x) for x in np.random.default_rng(1).permutation([(a, b, c, a, b) for a in "ACGT" for b in "ACGT" for c in "ACGT"])][:30]
    peaks = [(w, 1.0 + i / 8) for i, w in enumerate(words)] + [("AC", 1.0)]
    monkeypatch.setattr(registry, "_peaks", lambda s, d: spark.createDataFrame(peaks, "seq string, weight double"))
    got = {(r["seq"], r["weight"]): (r["seed"], r["round"]) for r in registry.seed_cover(spark, str(tmp_path)).collect()}
    want, number = plain_cover(peaks)
    assert number > 20 and got == want


def test_seed_cover_takes_many_seeds_a_pass(spark, monkeypatch):
    from kmerloom.sources import tables

    rng = np.random.default_rng(3)
    core = ["TGCATT", "GGGG", "ACGTA"]
    peaks = []
    for i in range(160):
        body = "".join(rng.choice(list("ACGT"), rng.integers(0, 14)))
        peaks.append((body + (core[i % 3] if i % 2 else ""), float(rng.integers(-8, 9)) / 4))
    peaks += [peaks[1], ("", 1.0), ("AAAAAAAA", 0.0), ("CCCCC", -2.0), ("CCCCC", 2.0)]
    written = []
    monkeypatch.setattr(tables, "stage", lambda df, plain=tables.stage: written.append(1) or plain(df))
    rows = motifs.seed_cover(spark.createDataFrame(peaks, "seq string, weight double")).collect()
    want, number = plain_cover(peaks)
    assert {(r["seq"], r["weight"]): (r["seed"], r["round"]) for r in rows} == want and len(rows) == len(want)
    assert number > 20 and len(written) < number, (number, len(written))
    none = motifs.seed_cover(spark.createDataFrame([("AC", 1.0), (None, 1.0), ("ACGTT", None)], "seq string, weight double")).collect()
    assert {(r["seq"], r["seed"], r["round"]) for r in none} == {("AC", "NA", None), (None, "NA", None), ("ACGTT", "NA", None)}
    assert motifs.seed_cover(spark.createDataFrame([], "seq string, weight double")).collect() == []


def test_motifs_are_rebuilt_from_all_peaks(spark):
    rng = np.random.default_rng(2)
    rows = [("NA", "TACG" + "".join(rng.choice(list("ACGT"), rng.integers(0, 3))), 2.0 + i / 1024) for i in range(210)]
    rows += [("NA", "".join(rng.choice(list("ACGT"), rng.integers(1, 4))) + "GACC", 1.0) for _ in range(600)]
    windows = [("m", "GGTA", "GTA", 1.0), ("m", "CGTA", "GTA", 1.5), ("m", "TA", "-TA", 1.0)]
    made = spark.createDataFrame([(*r[:2], None, r[2]) for r in rows] + windows, "motif string, seq string, window string, weight double")
    got = motifs.rebuild(made, 1, bin_size=1000)
    seqs, weights = [s for _, s, _ in rows], [w for *_, w in rows]
    want = [motifs.build_matrix(motifs.align(seqs), weights), motifs.build_matrix([x for _, _, x, _ in windows], [w for *_, w in windows])]
    assert len(got) == len(want)
    for m, columns in zip(got, want, strict=True):
        assert np.allclose(m.columns, columns)


def test_motif_em_rounds(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(registry, "_peaks", lambda s, d: s.createDataFrame([("TACG", 1.0)], "seq string, weight double"))
    monkeypatch.setattr(motifs, "refine", lambda peaks, found, shares, sign, options=motifs.MotifOptions(): seen.append((sign, options)) or (list(found), 0.0))
    registry.motif_em(spark, "")
    assert [sign for sign, _ in seen] == [1, -1] and seen[0][1].max_rounds == 25
