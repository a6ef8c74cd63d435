"""Logistic curves: evaluation as columns, bounded fits of small series."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def sigmoid(b: Column, t: Column, x: Column) -> Column:
    return 1 / (1 + F.exp(b * (x - t)))


def evaluate(b: Column, h0: Column, h1: Column, t: Column, x: Column) -> Column:
    """From ``h1`` far before ``t`` to ``h0`` far behind it (for a positive slope)."""
    return h0 + (h1 - h0) * sigmoid(b, t, x)


def logistic(p: np.ndarray, x: np.ndarray) -> np.ndarray:
    b, h0, h1, t = p
    return h0 + (h1 - h0) / (1 + np.exp(np.clip(b * (x - t), -700, 700)))


def gradient(p: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Derivatives by slope, both levels and midpoint, a column each."""
    b, h0, h1, t = p
    s = 1 / (1 + np.exp(np.clip(b * (x - t), -700, 700)))
    d = s * (1 - s)
    return np.stack([-(h1 - h0) * (x - t) * d, 1 - s, s, (h1 - h0) * b * d], 1)


def _starts(x: np.ndarray, y: np.ndarray, low: np.ndarray, high: np.ndarray, n: int, rng: np.random.Generator) -> np.ndarray:
    """Random starts in a box around the data, inside the bounds."""
    spread = max(float(np.ptp(y)), 1e-6)
    box_low = np.array([-2.0, y.min() - spread / 2, y.min() - spread / 2, x.min()])
    box_high = np.array([2.0, y.max() + spread / 2, y.max() + spread / 2, x.max()])
    lo, hi = np.clip(box_low, low, high), np.clip(box_high, low, high)
    return lo + rng.random((n, 4)) * (hi - lo)


def _curves(p: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Values of many curves at ``x`` (a row a curve) and their derivatives (a matrix a curve)."""
    b, h0, h1, t = (p[:, i, None] for i in range(4))
    s = 1 / (1 + np.exp(np.clip(b * (x - t), -700, 700)))
    d = s * (1 - s)
    return h0 + (h1 - h0) * s, np.stack([-(h1 - h0) * (x - t) * d, 1 - s, s, (h1 - h0) * b * d], 2)


def fit_logistic(x, y, low, high, restarts: int = 100, seed: int = 0, rounds: int = 200, weights=None) -> tuple[np.ndarray, float]:
    """Bounded, weighted least squares by projected Levenberg-Marquardt from seeded random starts, all at once: parameters and error."""
    x, y = np.asarray(x, float), np.asarray(y, float)
    low, high = np.asarray(low, float), np.asarray(high, float)
    w = np.ones(len(x)) if weights is None else np.asarray(weights, float)
    p = _starts(x, y, low, high, restarts, np.random.default_rng(seed))
    damp = np.full(restarts, 1e-2)
    values, slopes = _curves(p, x)
    r = values - y
    error = (w * r * r).sum(1)
    active = np.arange(restarts)
    for _ in range(rounds):
        if not len(active):
            break
        j = slopes[active]
        a = np.einsum("rni,n,rnj->rij", j, w, j)
        g = np.einsum("rni,n,rn->ri", j, w, r[active])
        diagonal = np.einsum("rii->ri", a) + 1e-12
        steep = a + np.einsum("r,ri,ij->rij", damp[active], diagonal, np.eye(4))
        step = -np.einsum("rij,rj->ri", np.linalg.pinv(steep, rcond=4 * np.finfo(float).eps, hermitian=True), g)
        q = np.clip(p[active] + step, low, high)
        values, new_slopes = _curves(q, x)
        r_new = values - y
        new = (w * r_new * r_new).sum(1)
        better = new < error[active]
        won, lost = active[better], active[~better]
        gain = error[won] - new[better]
        p[won], r[won], error[won], slopes[won] = q[better], r_new[better], new[better], new_slopes[better]
        damp[won] = np.maximum(damp[won] / 3, 1e-12)
        damp[lost] *= 4
        active = np.sort(np.concatenate([won[gain >= 1e-12 * (1 + error[won])], lost[damp[lost] <= 1e10]]))
    best = int(error.argmin())
    return p[best], float(error[best])


def fit_series(points: DataFrame, low, high, restarts: int = 100, seed: int = 0) -> DataFrame:
    """``series``, ``b``, ``h0``, ``h1``, ``t``, ``error``: a fit per series of ``x``, ``y`` (time courses, so few points each)."""

    def one(f: pd.DataFrame) -> pd.DataFrame:
        f = f.dropna(subset=["x", "y"]).sort_values(["x", "y"])
        if f.empty:
            return pd.DataFrame(columns=["series", "b", "h0", "h1", "t", "error"])
        p, error = fit_logistic(f["x"], f["y"], low, high, restarts, seed)
        return pd.DataFrame({"series": f["series"].iloc[:1].astype(str), "b": p[:1], "h0": p[1:2], "h1": p[2:3], "t": p[3:], "error": [error]})

    rows = points.select(F.col("series").cast("string"), F.col("x").cast("double"), F.col("y").cast("double"))
    return rows.groupBy("series").applyInPandas(one, "series string, b double, h0 double, h1 double, t double, error double")
