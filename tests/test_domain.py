"""Closed-form cases of the domain operators."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from kmerloom.functions import stats
from kmerloom.operators import decay, enrichment, kmers, lasso, logistic, motifs, peaks, presentation, regression, spikes
from kmerloom.sources import tables


def seqs(spark, *rows):
    return spark.createDataFrame([(i, s) for i, s in enumerate(rows)], "id long, seq string")


def test_kmer_counts(spark):
    got = {r["kmer"]: r["cnt"] for r in kmers.counts(seqs(spark, "AAACAAAC"), 3).collect()}
    assert got == {"AAA": 2, "AAC": 2, "ACA": 1, "CAA": 1}
    assert kmers.counts(seqs(spark, "A", "AC", ""), 3).count() == 0
    assert {r["kmer"]: r["cnt"] for r in kmers.counts(seqs(spark, "acgNacg"), 3).collect()} == {"ACG": 2}
    assert kmers.lexicon(spark, 3).distinct().count() == 64
    with pytest.raises(ValueError):
        kmers.lexicon(spark, 0)


def test_positional_weights_add_up(spark):
    model = spark.createDataFrame([("AAA", 3, 0.5), ("AC", 2, -0.25)], "kmer string, k int, weight double")
    w = kmers.positional_weights(seqs(spark, "AAAAC"), model).orderBy("pos").toPandas()["w"].tolist()
    assert w == [0.5, 1.0, 1.0, 0.25, -0.25]


@pytest.mark.parametrize("p", [0.01, 0.25, 0.5, 0.99])
def test_hazen(spark, p):
    x = np.random.default_rng(0).normal(size=997).round(2)
    df = spark.createDataFrame([(float(v),) for v in x], "x double")
    assert stats.hazen_percentile(df, "x", p) == pytest.approx(np.percentile(x, 100 * p, method="hazen"), abs=1e-12)
    one = df.agg(stats.hazen(F.col("x"), p, F.count("x"))).first()[0]
    assert one == pytest.approx(np.percentile(x, 100 * p, method="hazen"), abs=1e-12)


def test_hazen_small(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (4.0,), (8.0,)], "x double")
    assert stats.hazen_percentile(df, "x", 0.25) == 1.5
    assert stats.hazen_percentile(df.limit(0), "x", 0.25) is None


def test_bh(spark):
    df = spark.createDataFrame([(0.01,), (0.02,), (0.03,), (0.5,)], "p double")
    assert stats.bh_threshold(df, "p").first()[0] == pytest.approx(0.0375)
    assert stats.bh_threshold(df.where("p > 1"), "p").first()[0] == 0


def test_tails():
    assert stats.gamma_upper(2.0, np.array([3.0]))[0] == pytest.approx(math.exp(-3) * 4)
    assert stats.gamma_upper(0.5, np.array([1.92]))[0] == pytest.approx(math.erfc(math.sqrt(1.92)), rel=1e-9)
    assert stats.t_upper(0.0, 5) == pytest.approx(0.5)
    assert stats.t_upper(2.015048, 5) == pytest.approx(0.05, abs=1e-6)
    assert stats.t_upper(-2.015048, 5) == pytest.approx(0.95, abs=1e-6)
    assert stats.ks_upper(0.0, 10, 10) == 1


def test_planted_decay(spark):
    rows = [(1, float(t), 5 - 0.5 * math.log2(math.e) * (t - 1)) for t in range(1, 7)] + [(2, float(t), 3.0) for t in range(1, 7)]
    logs = spark.createDataFrame(rows, "id long, tm double, log_x double")
    noise = spark.createDataFrame([(float(t), 0.4) for t in range(1, 7)], "tm double, sd double")
    got = {r["id"]: r for r in decay.fit(logs, noise, -20.0).collect()}
    assert got[1]["a"] == pytest.approx(-0.5) and got[1]["b"] == pytest.approx(5) and got[1]["r"] == pytest.approx(1)
    assert got[2]["a"] == pytest.approx(-math.log(2) / 24) and got[2]["t"] == 1
    tests = {r["id"]: r["p"] for r in decay.goodness_of_fit(logs, decay.fit(logs, noise, -20.0), noise, -20.0).collect()}
    assert tests[1] == pytest.approx(1)


def test_odd_degrees_of_freedom(spark):
    df = spark.createDataFrame([(3.0,), (11.07,)], "x double")
    got = [r[0] for r in df.select(stats.chi2_upper(F.col("x"), 5)).collect()]
    assert got[1] == pytest.approx(0.05, abs=1e-4) and 0.69 < got[0] < 0.71


def test_spikes(spark):
    df = spark.createDataFrame([(i, 1.0, q) for i, q in enumerate([100.0, 50.0, 5.0, 12.0, 6.0])], "rank int, tm double, q double")
    assert [r["q"] for r in spikes.drop_outliers(df).orderBy("rank").collect()] == [100, 50, 0, 12, 6]
    b, a = spikes.identity_regression(np.array([50.0, 25, 12.5, 0]), np.array([500.0, 250, 125, 0]), np.ones(4), 1e6)
    assert a * 1e6 == pytest.approx(10, rel=1e-3) and b * 1e6 == pytest.approx(0, abs=1)


def test_logistic_recovers():
    x = np.linspace(0, 12, 25)
    p = np.array([0.8, 1.0, 5.0, 6.0])
    got, error = logistic.fit_logistic(x, logistic.logistic(p, x), [0, -10, -10, 0], [5, 10, 10, 24], 20)
    assert error < 1e-8 and np.allclose(got, p, atol=1e-3)
    step = 1e-6
    for j in range(4):
        q = p.copy()
        q[j] += step
        assert np.allclose((logistic.logistic(q, x) - logistic.logistic(p, x)) / step, logistic.gradient(p, x)[:, j], atol=1e-4)


def test_peak_runs(spark):
    w = [0, 0, 3, 3, 0, 0, 0, 3, 0, 0, 0.1]
    weights = spark.createDataFrame([(i, "ACGTACGTACG", [float(x) for x in w]) for i in (0, 1)], "id long, seq string, w array<double>")
    got = peaks.runs(weights, 1, 1.0).where("id = 0").orderBy("start").collect()
    # the first run begins at the first position with weight, and is not widened over it
    assert [(r["start"], r["end"], r["weight"], r["seq"]) for r in got] == [(6, 10, 3.0, "CGTAC")]
    assert peaks.runs(weights, -1, 1.0).count() == 0
    assert peaks.runs(weights.limit(0), 1, 1.0).count() == 0


def test_engine_against_plain_counting(spark, monkeypatch):
    """One pass over letters, in slices of any size, agrees with counting substrings."""
    rng = np.random.default_rng(4)
    texts = ["".join(rng.choice(list("ACGTNacg"), n)) for n in (0, 1, 2, 3, 7, 50, 400)] + ["", "ACGT" * 30]
    df = seqs(spark, *texts).repartition(2)
    model = spark.createDataFrame([("ACG", 3, 0.5), ("TA", 2, -0.25), ("GGGAC", 5, 2.0), ("A" * 12, 12, 1.0)], "kmer string, k int, weight double")
    table = {r["kmer"]: r["weight"] for r in model.collect()}
    for size in (1 << 22, 16):
        monkeypatch.setattr(kmers, "SLICE", size)
        want, weights = {}, {}
        for i, t in enumerate(texts):
            u = t.upper()
            for k in (2, 3, 5):
                for j in range(len(u) - k + 1):
                    if set(u[j : j + k]) <= set("ACGT"):
                        want[i, u[j : j + k]] = want.get((i, u[j : j + k]), 0) + 1
            w = [0.0] * len(u)
            for word, x in table.items():
                for j in range(len(u) - len(word) + 1):
                    if u[j : j + len(word)] == word:
                        w[j : j + len(word)] = [y + x for y in w[j : j + len(word)]]
            weights[i] = w
        assert {(r["id"], r["kmer"]): r["cnt"] for r in kmers.counts(df, [2, 3, 5]).collect()} == want
        per = {(r["k"], r["kmer"]): (r["n_ids"], r["total"]) for r in kmers.totals(df, [2, 3, 5]).collect()}
        assert per == {(len(w), w): (sum(x == w for _, x in want), sum(n for (_, x), n in want.items() if x == w)) for w in {x for _, x in want}}
        assert {r["id"]: list(r["w"]) for r in kmers.weight_arrays(df, model).collect()} == weights
        sums = {r["id"]: (r["len"], r["raw"]) for r in kmers.weight_sums(df, model).collect()}
        assert sums == {i: (len(t), sum(table.get(w, 0) * n for (x, w), n in want.items() if x == i)) for i, t in enumerate(texts)}
    assert {r["kmer"] for r in kmers.counts(seqs(spark, "ANA"), 2, acgt_only=False).collect()} == {"AN", "NA"}
    assert kmers.counts(seqs(spark, "A" * 40), 35).first()["cnt"] == 6


def test_scales_by_arrays_and_by_joins(spark, monkeypatch):
    rng = np.random.default_rng(6)
    rows = [(i, "A" * n, [float(x) for x in rng.integers(-3, 4, n)]) for i, n in enumerate((5, 9, 9, 20, 0))]
    weights = spark.createDataFrame(rows, "id long, seq string, w array<double>")
    fast = {r["id"]: list(r["w"]) for r in kmers.norm_weights(weights).collect()}
    level = peaks.threshold(weights)
    monkeypatch.setattr(kmers, "MAX_POSITIONS", 3)
    assert {r["id"]: list(r["w"]) for r in kmers.norm_weights(weights).collect()} == fast
    assert peaks.threshold(weights) == pytest.approx(level)


def test_sparse_lasso_agrees_with_dense(spark):
    rng = np.random.default_rng(1)
    width = 12
    x = rng.integers(0, 3, (200, width))
    y = x @ np.concatenate([[1.5, -2.0], np.zeros(width - 2)]) + rng.normal(0, 0.1, 200)
    rows = [(i, i % 10, float(y[i]), [int(j) for j in x[i].nonzero()[0]], [float(v) for v in x[i][x[i] > 0]]) for i in range(200)]
    design = spark.createDataFrame(rows, "id long, fold int, y double, j array<int>, v array<double>")
    dense, sparse = regression.lasso(regression.gram(design, width), 30), lasso.lasso_rows(design, width, 30)
    assert np.allclose(dense.penalties, sparse.penalties)
    assert np.allclose(dense.coefficients, sparse.coefficients, atol=5e-3) and np.allclose(dense.mse, sparse.mse, rtol=0.05)
    assert set(sparse.coefficients[sparse.chosen(1)].nonzero()[0]) >= {0, 1}


def test_tests_by_name(spark):
    members = spark.createDataFrame([(i, "AAA") for i in range(20)] + [(i, "CCC") for i in range(0, 40, 2)] + [(0, "GGG"), (1, "GGG"), (5, "TTT")], "id long, kmer string")
    scores = spark.createDataFrame([(i, (1.0 if i < 20 else 0.0) + i / 1000) for i in range(40)], "id long, s double")
    for kind in ("t", "ks", "permutation"):
        up, down = ({r["kmer"]: r["p"] for r in enrichment.test(members, scores, kind, tail).collect()} for tail in ("right", "left"))
        assert set(up) == {"AAA", "CCC", "GGG"} and up["AAA"] < 0.05 < down["AAA"] and up["GGG"] == down["GGG"] == 1
    both = {r["kmer"]: (r["p_right"], r["p_left"]) for r in enrichment.both_tails(members, scores).collect()}
    assert both["AAA"][0] < 1e-6 and both["GGG"] == (1, 1)
    with pytest.raises(ValueError):
        enrichment.test(members, scores, "none")


def test_pwm_scan_edges(spark):
    motif = motifs.Motif("m", 1, ((0.0, 0.0, 0.0, 1.0), (1.0, 0.0, 0.0, 0.0), (0.0, 1.0, 0.0, 0.0)))
    got = {r["id"]: r for r in motifs.scan(seqs(spark, "GGTACGG", "AC", "TACTAC"), [motif]).collect()}
    assert got[0]["position"] == 3 and got[1]["position"] == 0 and got[2]["position"] == 1


def test_assign_ties_and_none(spark):
    flat = ((0.25,) * 4,) * 4
    found = motifs.assign(
        spark.createDataFrame([("ACGT", 1.0), ("ACGT", -1.0)], "seq string, weight double"), [motifs.Motif("a", 1, flat), motifs.Motif("b", 1, flat)], [0.25] * 4
    ).collect()
    assert {(r["weight"], r["motif"]) for r in found} == {(1.0, "a"), (-1.0, "NA")}


def test_matrix_and_cover(spark):
    columns = motifs.build_matrix(["-TACG", "ATACG", "CTAC-"], [1.0, 1.0, 1.0])
    assert motifs.consensus(columns).startswith("ATAC") or "TAC" in motifs.consensus(columns)
    got = motifs.seed_cover(spark.createDataFrame([("ATTTTA", 1.0), ("CTTTTC", 2.0), ("GGGG", 1.0), ("AC", 1.0)], "seq string, weight double")).collect()
    by = {r["seq"]: r["seed"] for r in got}
    assert by["AC"] == "NA" and all(r["seed"] in r["seq"] for r in got if r["seed"] != "NA") and len(got) == 4


def test_enrichment(spark):
    members = spark.createDataFrame([(i, "AAA") for i in range(20)] + [(i, "CCC") for i in range(0, 40, 2)], "id long, kmer string")
    scores = spark.createDataFrame([(i, 1.0 if i < 20 else 0.0) for i in range(40)], "id long, s double")
    got = {(r["kmer"], r["value"]): r for r in enrichment.hypergeometric(members, scores).collect()}
    assert got[("AAA", 1.0)]["p_right"] < 1e-8 and got[("AAA", 1.0)]["p_left"] == pytest.approx(1)
    mi = {r["kmer"]: r["mi"] for r in enrichment.mutual_information(members, scores).collect()}
    assert mi["AAA"] == pytest.approx(1) and mi["CCC"] == pytest.approx(0, abs=1e-12)
    perm = {r["kmer"]: r["p"] for r in enrichment.permutation_test(members, scores).collect()}
    assert perm["AAA"] < 0.01 < perm["CCC"]
    ks = {r["kmer"]: r for r in enrichment.ks_test(members, scores, "right").collect()}
    assert ks["AAA"]["d_more"] == pytest.approx(0.5) and ks["AAA"]["p"] < 0.1


def test_regression(spark):
    rng = np.random.default_rng(0)
    names = ["AA", "CC", "GG", "TT"]
    x = rng.integers(0, 5, (300, 4))
    y = 1 + x @ np.array([2.0, -1.0, 0.0, 0.0]) + rng.normal(0, 0.01, 300)
    counts = spark.createDataFrame([(i, k, 2, int(x[i, j])) for i in range(300) for j, k in enumerate(names) if x[i, j]], "id long, kmer string, k int, cnt long")
    targets = spark.createDataFrame([(i, float(v)) for i, v in enumerate(y)], "id long, d double")
    rows = regression.design(counts, targets, names)
    folds = regression.gram(rows, 4)
    beta, b0, _ = regression.least_squares(regression.total(folds))
    assert np.allclose(beta, [2, -1, 0, 0], atol=0.01) and b0 == pytest.approx(1, abs=0.02)
    path = regression.lasso(folds, 30)
    b = path.coefficients[path.one_se]
    assert b[0] > 1 and b[1] < 0
    # optimality: the gradient of inactive features stays within the penalty
    c, r, scale, _, _ = regression._standardised(regression.total(folds))
    for i in (5, 15, 25):
        grad = r - c @ (path.coefficients[i] * scale)
        assert (np.abs(grad) <= path.penalties[i] + 1e-4).all()
    cv = regression.cross_validate(rows, 4).toPandas()
    assert np.corrcoef(cv["y"], cv["pred"])[0, 1] > 0.999


def test_threshold(spark):
    pairs = spark.createDataFrame([(0.1, 0.0), (0.2, 0.0), (0.8, 2.0), (0.9, 2.0), (0.15, 2.0)], "pred double, d double")
    r = regression.best_threshold(pairs).first()
    assert (r["threshold"], r["false_positives"], r["false_negatives"]) in {(0.15, 1, 0), (0.8, 0, 1)}


def test_motifs_are_found_again(spark):
    """A planted word is refined from a blurred motif; leaving motifs out keeps what peaks need."""
    rng = np.random.default_rng(3)
    other = lambda n: "".join(rng.choice(list("ACGT"), n))
    made = [(other(int(rng.integers(1, 5))) + "TTCAGG" + other(int(rng.integers(1, 5))), 1.0 + i / 1000) for i in range(80)]
    made += [(other(2) + "GAGAGA" + other(2), -1.0 - i / 1000) for i in range(30)]
    found = spark.createDataFrame(made, "seq string, weight double")
    blurred = motifs.Motif("start", 1, tuple(tuple(0.55 if x == c else 0.15 for x in "ACGT") for c in "TTCAGG"))
    flat = motifs.Motif("flat", 1, ((0.25,) * 4,) * 6)
    shares = motifs.background(found)
    assert sum(shares) == pytest.approx(1)
    state, total = motifs.refine(found, [blurred, flat], shares, 1)
    assert total > 0 and any("TTCAGG" in m.name and max(max(c) for c in m.columns) > 0.9 for m in state)
    assert all(m.sign == 1 and len(m.columns) <= 20 for m in state)
    kept = motifs.prune(found, state, shares, 1, min_weight=5.0)
    assert any("TTCAGG" in m.name for m in kept) and len(kept) <= max(1, len(state))
    assert motifs.refine(found, [blurred], shares, -1) == ([], -math.inf)


def test_windows_of_assigned_peaks(spark):
    motif = motifs.Motif("m", 1, tuple(tuple(float(x == c) for x in "ACGT") for c in "TAC"))
    rows = [("GGTACG", 1.0), ("AC", 1.0), (None, 1.0), ("GGTACG", -1.0), ("", 2.0), ("NNTACN", None)]
    got = motifs.assign(spark.createDataFrame(rows, "seq string, weight double"), [motif], [0.25] * 4, windows=True).collect()
    by = {(r["seq"], r["weight"]): (r["motif"], r["window"]) for r in got}
    assert len(got) == len(rows) and by["GGTACG", 1.0] == ("m", "TAC") and by["AC", 1.0] == ("m", "-AC")
    assert by[None, 1.0] == by["GGTACG", -1.0] == by["NNTACN", None] == ("NA", None)


def test_files(spark, tmp_path):
    (tmp_path / "s.txt").write_text("a\tacgt\nb  GGG\n")
    assert {(r["id"], r["seq"]) for r in tables.read_sequences(spark, str(tmp_path / "s.txt")).collect()} == {("a", "ACGT"), ("b", "GGG")}
    ids = spark.createDataFrame([("b",), ("z",)], "id string")
    assert {(r["id"], r["seq"]) for r in tables.read_sequences(spark, str(tmp_path / "s.txt"), ids).collect()} == {("b", "GGG"), ("z", "")}
    (tmp_path / "c.txt").write_text("name\tt0\tt1\nx\t1\t2\nSPIKE_1\t3\t4\n")
    got = tables.read_counts(spark, str(tmp_path / "c.txt"), [0, 1]).collect()
    assert len(got) == 4 and {r["id"] for r in got if r["is_spike"]} == {"SPIKE_1"}
    tables.write_tsv(spark.createDataFrame([("a", 1.23456789, True, None)], "i string, x double, b boolean, n string"), str(tmp_path / "out"))
    text = "".join(p.read_text() for p in (tmp_path / "out").glob("part-*"))
    assert text.strip("\n") == "a\t1.2346\t1\t"
    made = []
    for _ in range(2):
        tables.memoised(spark, f"file://{tmp_path}/memo", "s", {"k": 3}, lambda: made.append(1) or spark.range(3)).count()
    assert made == [1]


def test_presentation(spark):
    df = spark.createDataFrame([(float(i), float(i % 2)) for i in range(10)], "x double, y double")
    grid = presentation.histogram_2d(df, "x", "y", 5)
    assert grid.agg(F.sum("n")).first()[0] == 10
    assert presentation.smoothed(grid, 5)["density"].sum() == pytest.approx(1, abs=0.2)
    top = presentation.top_weights(spark.createDataFrame([("a", 1.0), ("b", -1.0), ("c", 0.5)], "kmer string, weight double"), 1)
    assert top.count() == 2


def one_by_one(x, y, w, low, high, restarts, seed=0):
    """The fits of all starts, one after the other."""
    found = []
    for p in logistic._starts(x, y, low, high, restarts, np.random.default_rng(seed)):
        damp, r = 1e-2, logistic.logistic(p, x) - y
        error = float(w @ (r * r))
        for _ in range(200):
            j = logistic.gradient(p, x)
            a = j.T @ (w[:, None] * j)
            step = np.linalg.lstsq(a + damp * np.diag(np.diag(a) + 1e-12), -j.T @ (w * r), rcond=None)[0]
            q = np.clip(p + step, low, high)
            new = float(w @ ((logistic.logistic(q, x) - y) ** 2))
            if new < error:
                gain, p, r, error, damp = error - new, q, logistic.logistic(q, x) - y, new, max(damp / 3, 1e-12)
                if gain < 1e-12 * (1 + error):
                    break
            else:
                damp *= 4
                if damp > 1e10:
                    break
        found.append((error, p))
    return min(found, key=lambda f: f[0])


def test_logistic_starts_together_and_one_by_one():
    import time

    rng = np.random.default_rng(4)
    low, high = np.array([0, -20, -20, 0.0]), np.array([5, 20, 20, 24.0])
    spent = {"together": 0.0, "one": 0.0}
    for weights in (np.ones(12), rng.integers(1, 9, 12).astype(float)):
        x = np.linspace(0, 11, 12)
        y = logistic.logistic(np.array([1.2, 1.0, 7.0, 5.0]), x) + rng.normal(0, 0.05, 12)
        start = time.perf_counter()
        p, error = logistic.fit_logistic(x, y, low, high, 100, weights=weights)
        spent["together"] += time.perf_counter() - start
        start = time.perf_counter()
        want, q = one_by_one(x, y, weights, low, high, 100)
        spent["one"] += time.perf_counter() - start
        assert error == pytest.approx(want, rel=1e-8) and np.allclose(p, q, atol=1e-4)
        assert (p >= low).all() and (p <= high).all()
    assert spent["together"] < spent["one"] / 3
    # weights stand for repeats
    twice = logistic.fit_logistic(np.repeat(x, 2), np.repeat(y, 2), low, high, 40)
    assert twice[1] == pytest.approx(logistic.fit_logistic(x, y, low, high, 40, weights=np.full(12, 2.0))[1], rel=1e-8)


def test_kmers_as_a_table_function(spark):
    table = seqs(spark, "AAACAAAC", "ACGNACG", "A", None)
    kmers.register_table_function(spark)
    got = {(r["id"], r["kmer"]): r["cnt"] for r in spark.sql("SELECT id, kmer, cnt FROM {t}, LATERAL kmers(seq, 3)", t=table).collect()}
    want = {(r["id"], r["kmer"]): r["cnt"] for r in kmers.counts(table.where("seq is not null"), 3).collect()}
    assert got == want and got[0, "AAA"] == 2 and got[1, "ACG"] == 2
