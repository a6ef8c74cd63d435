"""The experiment from files to predictions, on planted signals."""

import os

import numpy as np
import pytest

from kmerloom.operators import kmers, regression
from kmerloom.plans import experiment
from kmerloom.sources import kmer_store


def reporters(n, seed, length=(100, 121)):
    rng = np.random.default_rng(seed)
    return ["".join(rng.choice(list("ACGT"), rng.integers(*length))) for _ in range(n)]


def rate(seq):
    return 0.25 + 0.06 * sum(seq[i : i + 3] == "TTT" for i in range(len(seq) - 2)) - 0.05 * sum(seq[i : i + 3] == "GCA" for i in range(len(seq) - 2))


TIMES = [0.0, 1.0, 2.0, 3.0, 4.0, 5.0, 6.0]


def write(folder, seqs, times=TIMES):
    (folder / "s.txt").write_text("".join(f"r{i}\t{s}\n" for i, s in enumerate(seqs)))
    rows = ["name\t" + "\t".join(f"t{t}" for t in times)]
    rows += [f"r{i}\t" + "\t".join(str(int(5000 * np.exp(-max(rate(s), 0.05) * t))) for t in times) for i, s in enumerate(seqs)]
    (folder / "c.txt").write_text("\n".join(rows) + "\n")


def test_regression_finds_planted_weights_and_skips_fits_without_sequence(spark):
    seqs = reporters(120, 0)
    table = spark.createDataFrame(list(enumerate(seqs)), "id long, seq string")
    rows = [(i, -rate(s), 10.0, 1.0, 0.99, 0.9) for i, s in enumerate(seqs)]
    strangers = [(10_000 + i, -9.0 + i, 10.0, 1.0, 0.99, 0.9) for i in range(60)]
    kind = "id long, a double, b double, t double, r double, p double"
    found = experiment.fit_regression(spark.createDataFrame(rows + strangers, kind), table, ks=[3], penalties=20)
    weights = {r["kmer"]: r["weight"] for r in found.model.collect()}
    assert weights["TTT"] == pytest.approx(0.06, abs=1e-3) and weights["GCA"] == pytest.approx(-0.05, abs=1e-3)
    assert found.intercept == pytest.approx(0.25, abs=0.02)
    assert {r["id"] for r in found.fitted.collect()} == set(range(120))
    held = found.held_out.toPandas()
    assert np.corrcoef(held["y"], held["pred"])[0, 1] > 0.999


def test_regression_reads_words_from_a_store(spark, tmp_path):
    seqs = reporters(60, 5)
    table = spark.createDataFrame(list(enumerate(seqs)), "id long, seq string")
    fits = spark.createDataFrame([(i, -rate(s), 10.0, 1.0, 0.99, 0.9) for i, s in enumerate(seqs)], "id long, a double, b double, t double, r double, p double")
    store = kmer_store.save(kmers.counts(table, [3]), table, [3], f"file://{tmp_path}/store", buckets=4)
    plain = experiment.features(table, fits.withColumn("d", -fits.a), [3])
    names, rows = experiment.features(table, fits.withColumn("d", -fits.a), [3], store=store)
    assert names == plain[0] and sorted(rows.collect()) == sorted(plain[1].collect())
    part = table.where("id > 3")
    lacking = kmer_store.save(kmers.counts(part, [3]), part, [3], f"file://{tmp_path}/part", buckets=4)
    with pytest.raises(ValueError, match="{3: 4}"):
        experiment.features(table, fits.withColumn("d", -fits.a), [3], store=lacking)


def test_from_files_to_predictions(spark, tmp_path):
    write(tmp_path, reporters(90, 1))
    folder = f"file://{tmp_path}/out"
    args = (spark, f"{tmp_path}/s.txt", f"{tmp_path}/c.txt", TIMES, folder, [3], 100)
    fits, model, matrices = experiment.fit_all(*args)
    got = {r["id"]: r for r in fits.collect()}
    truth = {f"r{i}": max(rate(s), 0.05) for i, s in enumerate(reporters(90, 1))}
    assert set(got) == set(truth)
    fitted = [(truth[i], -r["a"]) for i, r in got.items() if r["a"] is not None]
    assert len(fitted) > 80 and np.corrcoef(*zip(*fitted))[0, 1] > 0.99
    weights = {r["kmer"]: r["weight"] for r in model.collect()}
    assert weights["TTT"] > 0.03 and weights["GCA"] < -0.02
    assert {"motif", "sign", "pos", "A", "C", "G", "T", "top", "least"} == set(matrices.columns) and matrices.count() > 0
    # the second run reads what the first one stored
    stamps = {p: os.stat(p).st_mtime_ns for p in (tmp_path / "out").rglob("*.parquet")}
    again = experiment.fit_all(*args)
    assert again[1].count() == model.count() and stamps == {p: os.stat(p).st_mtime_ns for p in (tmp_path / "out").rglob("*.parquet")}
    fresh = reporters(40, 2)
    (tmp_path / "n.txt").write_text("".join(f"n{i}\t{s}\n" for i, s in enumerate(fresh)) + "short\tACGT\n")
    rates, peaks = experiment.predict_all(spark, f"{tmp_path}/n.txt", f"{tmp_path}/n.txt", model, matrices, folder)
    predicted = {r["id"]: r["rate"] for r in rates.collect()}
    assert set(predicted) == {f"n{i}" for i in range(40)}
    assert np.corrcoef([rate(s) for s in fresh], [predicted[f"n{i}"] for i in range(40)])[0, 1] > 0.95
    assert set(peaks.columns) >= {"id", "start", "end", "weight", "seq", "motif", "llr"}
    for r in peaks.collect():
        s = fresh[int(r["id"][1:])]
        assert r["seq"] in s and (r["motif"] == "NA" or r["motif"].endswith("+" if r["weight"] > 0 else "-"))


def test_rates_are_corrected_for_length(spark):
    """Raw sums that grow with length lead to rates that do not."""
    rng = np.random.default_rng(3)
    lengths = np.exp2(rng.uniform(5, 12, 600)).astype(int)
    raw = 0.002 * lengths * np.exp(rng.normal(0, 0.1, 600)) + 0.2
    rows = spark.createDataFrame([(i, int(n), float(r)) for i, (n, r) in enumerate(zip(lengths, raw, strict=True))] + [(999, 10, 1.0)], "id long, len int, raw double")
    got = {r["id"]: r["d"] for r in regression.correct_length(rows, 0.1).collect()}
    assert len(got) == 601 and got[999] is None
    d = np.array([got[i] for i in range(600)])
    low, high = 0.02888, 2.7726  # half-lives of a day and of a quarter of an hour
    assert (d >= low - 1e-3).all() and (d <= high + 1e-3).all()
    plain = np.clip(raw + 0.1, low, high)
    assert abs(np.polyfit(np.log2(lengths), np.log2(d), 1)[0]) < 0.3 * abs(np.polyfit(np.log2(lengths), np.log2(plain), 1)[0])


def test_regression_reads_its_sequences_once(spark, monkeypatch):
    """The selection's many passes and all later steps read what was written of the fits and sequences, without a join."""
    n = 40
    seqs = spark.createDataFrame([(i, "ACGTTGCA" * 4 if i % 2 else None) for i in range(n)], "id long, seq string")
    fits = spark.createDataFrame([(i, -0.1 - i / 100, 5.0, 1.0, 0.9, 0.5) for i in range(n)], "id long, a double, b double, t double, r double, p double")
    seen = []

    def selected(rows, onset, plain=regression.select_rows):
        seen.append(rows)
        return plain(rows, onset)

    class Enough(Exception):
        pass

    def features(rows, *rest):
        seen.append(rows)
        raise Enough

    monkeypatch.setattr(regression, "select_rows", selected)
    monkeypatch.setattr(experiment, "features", features)
    with pytest.raises(Enough):
        experiment.fit_regression(fits.where("id < 30"), seqs, ks=[3])
    assert all("Join" not in df._jdf.queryExecution().optimizedPlan().toString() for df in seen)
    assert [df.count() for df in seen] == [15, 15]
