"""Least squares of any rank over partitions, against numpy."""

import numpy as np
import pytest

from kmerloom.operators import regression

KIND = "id long, fold int, y double, j array<int>, v array<double>"


def design(spark, x, y, parts=11):
    rows = [(i, i % 4, float(y[i]), [int(j) for j in r.nonzero()[0]] or None, [float(v) for v in r[r != 0]] or None) for i, r in enumerate(x)]
    return spark.createDataFrame(rows, KIND).repartition(parts, "id")


def deficient(n=120, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.integers(0, 4, (n, 9)).astype(float)
    x[:, 3] = x[:, 0] + x[:, 1]  # a sum of others
    x[:, 5] = 2.0  # the intercept again
    x[:, 7] = 0.0
    return x, x @ rng.normal(size=9) + rng.normal(0, 0.1, n)


def test_basic_solution_of_deficient_rank(spark):
    x, y = deficient()
    found = regression.linear_fit(design(spark, x, y), 9)
    full = np.column_stack([x, np.ones(len(x))])
    best = np.linalg.lstsq(full, y, rcond=None)[0]
    coefficients = np.append(found.beta, found.b0)
    assert found.rank == np.linalg.matrix_rank(full) == 7 and np.count_nonzero(coefficients) == 7
    assert np.allclose(full @ coefficients, full @ best, atol=1e-9)
    assert found.error == pytest.approx(((y - full @ best) ** 2).sum(), rel=1e-9)
    assert found.beta[7] == 0 and (found.beta[5] == 0) != (found.b0 == 0)


def test_solvers_agree_on_full_rank(spark):
    rng = np.random.default_rng(1)
    x = rng.integers(0, 5, (150, 5)).astype(float)
    y = x @ np.array([1.0, -2.0, 0.5, 0.0, 3.0]) + 4 + rng.normal(0, 0.01, 150)
    rows = design(spark, x, y)
    best = np.linalg.lstsq(np.column_stack([x, np.ones(150)]), y, rcond=None)[0]
    for solver in ("qr", "normal"):
        found = regression.linear_fit(rows, 5, solver)
        assert np.allclose(np.append(found.beta, found.b0), best, atol=1e-8) and found.rank == 6
    without = regression.linear_fit(rows, 5, "qr", intercept=False)
    assert without.b0 == 0 and np.allclose(without.beta, np.linalg.lstsq(x, y, rcond=None)[0], atol=1e-9)
    sparse = regression.linear_fit(rows, 5, "lasso")
    assert sparse.error == pytest.approx(((y - x @ sparse.beta - sparse.b0) ** 2).sum()) and sparse.beta[4] > 2.5
    with pytest.raises(ValueError):
        regression.linear_fit(rows, 5, "none")


def test_digits_survive_nearly_equal_features(spark):
    """Columns that differ by a millionth: sums of products would see one."""
    rng = np.random.default_rng(2)
    a = rng.normal(size=200)
    x = np.column_stack([a, a + 1e-6 * rng.normal(size=200)])
    found = regression.linear_fit(design(spark, x, x @ np.array([2.0, -1.0]) + 0.5), 2)
    assert np.allclose(np.append(found.beta, found.b0), [2.0, -1.0, 0.5], atol=1e-6)


def test_held_out_predictions(spark):
    x, y = deficient(seed=3)
    got = regression.cross_validate(design(spark, x, y), 9).toPandas().sort_values("id")
    full = np.column_stack([x, np.ones(len(x))])
    for fold in range(4):
        out = np.arange(len(y)) % 4 == fold
        best = np.linalg.lstsq(full[~out], y[~out], rcond=None)[0]
        assert np.allclose(got["pred"].to_numpy()[out], full[out] @ best, atol=1e-8)


def test_empty_and_short_tables(spark):
    assert regression.linear_fit(spark.createDataFrame([], KIND), 3).rank == 0
    one = regression.linear_fit(design(spark, np.array([[1.0, 2.0]]), np.array([5.0]), 1), 2)
    assert one.rank == 1 and one.error == pytest.approx(0)
    alone = spark.createDataFrame([(0, 0, 1.0, [0], [1.0])], KIND)
    assert regression.cross_validate(alone, 2).first()["pred"] == 0
