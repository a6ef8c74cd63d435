"""The lasso over partitions against the same path in memory, and its optimality."""

import numpy as np
import pytest

from kmerloom.operators import lasso, regression


def made(spark, n, width, seed, strong=6, noise=0.3, density=0.3):
    rng = np.random.default_rng(seed)
    x = rng.integers(1, 4, (n, width)) * (rng.random((n, width)) < density)
    x[:, -1] = 2  # a feature without variance
    b = np.zeros(width)
    b[:strong] = rng.choice([-2.0, -1.0, 1.0, 1.5], strong)
    y = x @ b + rng.normal(0, noise, n) + 3
    rows = [(i, i % 5, float(y[i]), [int(j) for j in x[i].nonzero()[0]] or None, [float(v) for v in x[i][x[i] > 0]] or None) for i in range(n)]
    return x, y, spark.createDataFrame(rows, "id long, fold int, y double, j array<int>, v array<double>").repartition(7)


def in_memory(x, y, width, **options):
    j = [row.nonzero()[0] for row in x]
    problem = regression._Sparse(j, [row[row > 0].astype(float) for row in x], y, width)
    penalties, found, b0 = regression.sparse_path(problem, rounds=100_000, tolerance=1e-10, **options)
    out = np.zeros((len(found), width))
    for i, (places, b) in enumerate(found):
        out[i, places] = b
    return penalties, out, b0


@pytest.mark.parametrize("n,width", [(200, 20), (40, 50)])
def test_same_path_as_in_memory(spark, n, width):
    x, y, rows = made(spark, n, width, n)
    got = lasso.lasso_rows(rows, width, 12)
    penalties, want, b0 = in_memory(x, y, width, n=12, ratio=1e-4)
    assert got.penalties[-1] / got.penalties[0] == pytest.approx(1e-4)
    assert np.allclose(got.penalties, penalties, rtol=1e-10)
    assert np.abs(got.coefficients - want).max() < 1e-6 and np.abs(got.intercepts - b0).max() < 1e-6
    errors = []
    for fold in range(5):
        out = np.arange(n) % 5 == fold
        _, b, c = in_memory(x[~out], y[~out], width, penalties=penalties)
        errors.append(((y[out, None] - x[out] @ b.T - c) ** 2).mean(0))
    assert np.allclose(got.mse, np.mean(errors, 0), rtol=1e-5)
    assert np.allclose(got.se, np.std(errors, 0, ddof=1) / np.sqrt(5), rtol=1e-4)
    assert set(range(6)) <= set(got.coefficients[got.chosen()].nonzero()[0])


def test_solutions_are_optimal(spark):
    x, y, rows = made(spark, 80, 150, 3)
    got = lasso.lasso_rows(rows, 150, 20, ahead=7)
    centred = x - x.mean(0)
    sd = np.where(x.std(0) > 1e-6, x.std(0), np.inf)
    for lam, b, b0 in zip(got.penalties, got.coefficients, got.intercepts, strict=True):
        left = y - x @ b - b0
        grad = centred.T @ left / len(y) / sd
        assert abs(left.mean()) < 1e-9 and (np.abs(grad) <= lam * (1 + 1e-6)).all()
        on = b != 0
        assert np.allclose(grad[on], lam * np.sign(b[on]), rtol=1e-5, atol=1e-9)


def test_equal_features_and_odd_tables(spark):
    x, y, _ = made(spark, 50, 8, 5)
    x[:, 1] = x[:, 0]
    rows = [(i, i % 3, float(y[i]), [int(j) for j in r.nonzero()[0]], [float(v) for v in r[r > 0]]) for i, r in enumerate(x)]
    kind = "id long, fold int, y double, j array<int>, v array<double>"
    got = lasso.lasso_rows(spark.createDataFrame(rows, kind), 8, 10)
    assert np.isfinite(got.coefficients).all()
    single = regression._Sparse([r.nonzero()[0] for r in x[:, 1:]], [r[r > 0].astype(float) for r in x[:, 1:]], y, 7)
    _, found, _ = regression.sparse_path(single, got.penalties, rounds=100_000, tolerance=1e-11)
    one = np.zeros((10, 7))
    for i, (places, b) in enumerate(found):
        one[i, places] = b
    assert np.abs(got.coefficients[:, 0] + got.coefficients[:, 1] - one[:, 0]).max() < 1e-5  # how they share it is free
    empty = lasso.lasso_rows(spark.createDataFrame([], kind), 8, 10)
    assert not empty.coefficients.any() and len(empty.penalties) == 10
    flat = lasso.lasso_rows(spark.createDataFrame([(i, 0, 2.0, None, None) for i in range(4)], kind), 8, 10)
    assert not flat.coefficients.any() and np.allclose(flat.intercepts, 2)
