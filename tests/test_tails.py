"""Tails and percentiles of any size against exact counterparts."""

import math
from fractions import Fraction

import numpy as np
import pytest

from kmerloom.functions import stats
from kmerloom.operators import decay, enrichment


def exact(x, n, k, total):
    whole = math.comb(total, n)
    pmf = {i: Fraction(math.comb(k, i) * math.comb(total - k, n - i), whole) for i in range(max(0, n + k - total), min(n, k) + 1)}
    return float(sum(v for i, v in pmf.items() if i >= x)), float(sum(v for i, v in pmf.items() if i <= x))


def test_hypergeometric_tails_against_fractions():
    rng = np.random.default_rng(0)
    cases = [(0, 0, 0, 5), (0, 5, 0, 5), (3, 3, 3, 3), (1, 1, 1, 1), (0, 3, 2, 10), (7, 10, 9, 12), (400, 1000, 900, 2000), (600, 1000, 900, 2000)]
    for _ in range(150):
        total = int(rng.integers(1, 300))
        n, k = (int(v) for v in rng.integers(0, total + 1, 2))
        cases.append((int(rng.integers(0, min(n, k) + 1)), n, k, total))
    right, left = stats.hypergeometric_tails(*map(np.array, zip(*cases, strict=True)))
    for case, r, q in zip(cases, right, left, strict=True):
        if case[0] < max(0, case[1] + case[2] - case[3]):
            continue
        want = exact(*case)
        assert (r, q) == (pytest.approx(want[0], rel=1e-9, abs=1e-12), pytest.approx(want[1], rel=1e-9, abs=1e-12)), case


def test_hypergeometric_tails_of_large_tables():
    """Near the mean of a very large table the tails are those of a normal law, and both tails share one term."""
    total, n, k = 10**9, 10**6, 3 * 10**8
    mean = n * k / total
    sd = math.sqrt(mean * (1 - k / total) * (total - n) / (total - 1))
    x = np.array([int(mean - 3 * sd), int(mean), int(mean + 3 * sd)])
    right, left = stats.hypergeometric_tails(x, np.full(3, n), np.full(3, k), np.full(3, total))
    for a, r, q in zip(x, right, left, strict=True):
        assert r == pytest.approx(0.5 * math.erfc((a - 0.5 - mean) / sd / math.sqrt(2)), rel=0.02)
        assert q == pytest.approx(0.5 * math.erfc((mean - a - 0.5) / sd / math.sqrt(2)), rel=0.02)


def test_hypergeometric_takes_any_number_of_scores(spark):
    n = 2500
    members = spark.createDataFrame([(i, "AAA") for i in range(0, n, 5)], "id long, kmer string")
    scores = spark.createDataFrame([(i, float(i // 2)) for i in range(n)], "id long, s double")
    got = enrichment.hypergeometric(members, scores, min_items=1).toPandas()
    assert len(got) == 1250 and got["x"].sum() == 500
    for r in got.sample(20, random_state=0).itertuples():
        assert (r.p_right, r.p_left) == pytest.approx(exact(r.x, 500, 2, n), rel=1e-9)


@pytest.mark.parametrize("ranked", [10, 100_000])
def test_percentiles_of_groups(spark, ranked):
    rng = np.random.default_rng(1)
    groups = {"a": rng.normal(size=3000), "b": rng.integers(0, 3, 2000).astype(float), "c": np.array([5.0]), "d": rng.exponential(size=501), "e": np.full(900, 2.0)}
    rows = [(g, float(v)) for g, x in groups.items() for v in x] + [("a", None), ("a", float("nan")), ("f", None)]
    shares = {"a": 0.37, "b": 0.5, "c": 0.1, "d": 0.999, "e": 0.2, "f": 0.5}
    got = stats.grouped_percentiles(spark.createDataFrame(rows, "g string, x double").repartition(6), "g", "x", spark.createDataFrame(list(shares.items()), "g string, p double"), ranked)
    found = {r["g"]: r["value"] for r in got.collect()}
    assert set(found) == set(groups)
    for g, x in groups.items():
        assert found[g] == pytest.approx(np.percentile(x, 100 * shares[g], method="hazen"), abs=1e-12), g


def test_noise_above_the_bar_is_exact(spark):
    rng = np.random.default_rng(2)
    x = {t: rng.normal(t, 1 + t, 700 + 100 * t) for t in (0, 1, 2)}
    logs = spark.createDataFrame([(float(t), float(v)) for t, own in x.items() for v in own], "tm double, log_x double")
    got = {r["tm"]: r["sd"] for r in decay.column_noise(logs, keep=100, ranked=20).collect()}
    s = {}
    for t, own in x.items():
        cut = np.percentile(own, max(0, 100 - math.ceil(100 / len(own))), method="hazen")
        s[t] = own[own > cut].std(ddof=1)
    low, high = min(s.values()), max(s.values())
    for t in x:
        assert got[t] == pytest.approx(0.16 * (2 + (s[t] - low) / (high - low)), rel=1e-12)


@pytest.mark.parametrize("range_scores", [7, 10_000])
def test_permutations_over_ranges(spark, range_scores):
    rng = np.random.default_rng(3)
    n = 300
    s = np.round(rng.normal(size=n), 1)
    held = {"UP": [i for i in range(n) if s[i] > 0.3][:25], "ANY": list(range(0, n, 11)), "FEW": [1, 2, 3]}
    members = spark.createDataFrame([(i, k) for k, ids in held.items() for i in ids], "id long, kmer string")
    scores = spark.createDataFrame([(i, float(v)) for i, v in enumerate(s)] + [(900, None)], "id long, s double")
    got = {r["kmer"]: r for r in enrichment.permutation_test(members, scores, rounds=2000, range_scores=range_scores).collect()}
    assert got["FEW"]["p"] == 1 and got["UP"]["p"] < 0.01
    for kmer, ids in held.items():
        diff = s[ids].mean() - s.mean()
        assert got[kmer]["diff"] == pytest.approx(diff) and got[kmer]["n"] == len(ids)
    # plain permutations of the pooled scores
    ids = held["ANY"]
    pool, diff = np.concatenate([s, s[ids]]), s[ids].mean() - s.mean()
    hits = 0
    for _ in range(4000):
        p = rng.permutation(pool)
        hits += p[: len(ids)].mean() - p[len(ids) :].mean() >= diff - 1e-12
    assert got["ANY"]["p"] == pytest.approx(hits / 4000, abs=0.04)
    assert enrichment.permutation_test(members, scores.limit(0)).count() == 0


def test_reporters_good_in_every_series(spark):
    from kmerloom.plans import experiment

    rows = [(i, float(t), c) for i, early, late in ((1, 100.0, 100.0), (2, 100.0, 1.0), (3, 1.0, 100.0), (4, 90.0, 90.0)) for t, c in [(1, early), (2, early), (3, early), (4, late), (5, late), (6, late)]]
    counted = spark.createDataFrame(rows, "id long, tm double, cnt double")
    got = experiment.common_reporters(counted, {"early": (1, 2, 3), "late": (4, 5, 6)})
    assert {r["id"] for r in got.collect()} == {1, 4}
    found = experiment.fit_series(counted, None, {"early": (1, 2, 3), "late": (4, 5, 6)})
    assert all({r["id"] for r in x.fits.where("a is not null").collect()} == {1, 4} for x in found.values())
    assert experiment.fit_series(counted, None, {}) == {}
