"""Linear models of rates on k-mer counts.

Least squares and cross-validation work on triangles that tasks factor and a
tree of tasks joins, per fold, so no digits are lost and any rank will do.
Sums of products are aggregated by Spark, too, for the lasso path of few
features by coordinate descent (``lasso`` has that of many).  The number of features is bounded by selection
before, so the matrix of sums is as well.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kmerloom.functions.stats import hazen_percentile, running_sums
from kmerloom.operators import decay
from kmerloom.operators.kmers import weight_sums
from kmerloom.sources.tables import stage

FOLDS = 10
#: Letters below which a sequence has no predicted rate: a fifth of a reporter's 110.
LOW_LENGTH = 22


def select_rows(fits: DataFrame, onset: bool = False, max_rows: int = 20_000, alpha: float = 0.01) -> DataFrame:
    """``id``, ``d`` (target: onset or rate) and ``quality`` of the sequences fit to learn from.

    Left out are levels below 0.8, onsets above 6 h and fits that are both
    rejected and poorly explained.  Level, p and r are scaled between their
    1st and 99th percentiles and summed; above ``max_rows`` those whose
    quality is above the percentile 1 - max_rows / n stay, at nine digits, so
    that equal fits share a fate whatever the order of additions.
    """
    ok = (F.col("b") >= 0.8) & (F.col("t") <= 6) & ~((F.col("p") <= 2 * alpha) & (F.col("r") <= 0.7))
    target = F.col("t") if onset else -F.col("a")
    rows = fits.where(F.col("b").isNotNull() & ok).select("id", target.alias("d"), "b", "p", "r")
    total = F.lit(0.0)
    for c in ("b", "p", "r"):
        low = hazen_percentile(rows, c, 0.01)
        if low is None:
            return rows.select("id", "d", F.lit(None).cast("double").alias("quality"))
        high = hazen_percentile(rows.select((F.col(c) - low).alias(c)), c, 0.99)
        scaled = F.try_divide(F.col(c) - F.lit(low), F.lit(high))
        total = total + F.greatest(F.lit(0.0), F.least(F.lit(1.0), scaled))
    summed = rows.select("id", "d", total.alias("s"))
    edge = summed.agg(F.min("s").alias("lo"), F.max("s").alias("hi"), F.count("s").alias("n"))
    out = summed.join(F.broadcast(edge)).select("id", "d", F.try_divide(F.col("s") - F.col("lo"), F.col("hi") - F.col("lo")).alias("quality"), "n")
    n = out.count()
    if n > max_rows:
        out = out.withColumn("q9", F.round("quality", 9))
        out = out.where(F.col("q9") > hazen_percentile(out, "q9", 1 - max_rows / n))
    return out.select("id", "d", "quality")


def stack_fits(tables: list[DataFrame]) -> DataFrame:
    """Fits of several experiments on top of each other, without selection."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out


def expand_times(logs: DataFrame, fits: DataFrame) -> DataFrame:
    """``id``, ``tm``, ``y``: apparent rate since the onset at each later time."""
    since = F.col("tm") - F.col("t")
    return logs.join(fits.select("id", "b", "t"), "id").where(since > 0).select("id", "tm", ((F.col("b") - F.col("log_x")) / since).alias("y"))


def best_threshold(pairs: DataFrame, level: float = 1.0) -> DataFrame:
    """One row: the prediction from which on ``d`` is called above ``level`` with the fewest errors (the least of equals), and its errors."""
    g = F.col("d") > level
    each = pairs.groupBy("pred").agg(F.count_if(g).alias("yes"), F.count_if(~g).alias("no"))
    whole = pairs.agg(F.count_if(~g).alias("all_no"))
    fn = F.col("yes_upto") - F.col("yes")
    fp = F.col("all_no") - F.col("no_upto") + F.col("no")
    rows = running_sums(each, "pred", yes_upto="yes", no_upto="no").join(F.broadcast(whole)).select("pred", fp.alias("fp"), fn.alias("fn"))
    best = rows.agg(F.min_by(F.struct("pred", "fp", "fn"), F.struct(F.col("fp") + F.col("fn"), F.col("pred"))).alias("b"))
    return best.select(F.col("b.pred").alias("threshold"), F.col("b.fp").alias("false_positives"), F.col("b.fn").alias("false_negatives"))


@dataclass
class Sums:
    """Sums of products of features, 1 and target, for all rows or a fold."""

    xx: np.ndarray
    xy: np.ndarray
    yy: float

    def __sub__(self, o: Sums) -> Sums:
        return Sums(self.xx - o.xx, self.xy - o.xy, self.yy - o.yy)

    @property
    def n(self) -> float:
        return float(self.xx[-1, -1])


def design(counts: DataFrame, targets: DataFrame, kmers: list[str]) -> DataFrame:
    """``id``, ``fold``, ``y`` and sparse features: positions in ``kmers`` and counts; sequences without any feature stay."""
    names = targets.sparkSession.createDataFrame([(k, i) for i, k in enumerate(kmers)], "kmer string, j int")
    pairs = counts.join(F.broadcast(names), "kmer").groupBy("id").agg(F.collect_list(F.struct("j", F.col("cnt").cast("double").alias("v"))).alias("x"))
    fold = F.pmod(F.xxhash64(F.col("id").cast("string")), F.lit(FOLDS)).cast("int")
    rows = targets.where(F.col("d").isNotNull()).select("id", F.col("d").alias("y"))
    return rows.join(pairs, "id", "left").select("id", fold.alias("fold"), "y", F.col("x.j").alias("j"), F.col("x.v").alias("v"))


def gram(rows: DataFrame, width: int) -> dict[int, Sums]:
    """Sums of products per fold: partial matrices in tasks, then summed row by row of the matrix."""

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for fold, part in batch.groupby("fold"):
                for lo in range(0, len(part), 256):
                    some = part.iloc[lo : lo + 256]
                    x = np.zeros((len(some), width + 2))
                    for i, (j, v) in enumerate(zip(some["j"], some["v"], strict=True)):
                        if j is not None:
                            x[i, np.asarray(j, int)] = v
                    x[:, width], x[:, width + 1] = 1.0, some["y"]
                    total[fold] = total.get(fold, 0) + x.T @ x
        for fold, m in total.items():
            yield pd.DataFrame({"fold": fold, "i": np.arange(width + 2), "row": list(m)})

    parts = rows.mapInPandas(partial, "fold int, i int, row array<double>")
    summed = parts.select("fold", "i", F.posexplode("row").alias("k", "v")).where("v <> 0").groupBy("fold", "i", "k").agg(F.sum("v").alias("v"))
    got = summed.groupBy("fold", "i").agg(F.collect_list("k").alias("k"), F.collect_list("v").alias("v")).toPandas()
    out = {}
    for fold, part in got.groupby("fold"):
        m = np.zeros((width + 2, width + 2))
        for i, k, v in zip(part["i"], part["k"], part["v"], strict=True):
            m[i, np.asarray(k, int)] = v
        out[int(fold)] = Sums(m[:-1, :-1], m[:-1, -1], float(m[-1, -1]))
    return out


def total(folds: dict[int, Sums]) -> Sums:
    parts = list(folds.values())
    return Sums(sum(p.xx for p in parts), sum(p.xy for p in parts), sum(p.yy for p in parts))


def least_squares(s: Sums, intercept: bool = True) -> tuple[np.ndarray, float, float]:
    """Coefficients of least norm, intercept and sum of squared errors."""
    if intercept:
        beta = np.linalg.lstsq(s.xx, s.xy, rcond=1e-10)[0]
    else:
        beta = np.append(np.linalg.lstsq(s.xx[:-1, :-1], s.xy[:-1], rcond=1e-10)[0], 0.0)
    return beta[:-1], float(beta[-1]), error(s, beta)


def _triangle(x: np.ndarray) -> np.ndarray:
    """The square upper triangle of a matrix's QR factorisation."""
    r = np.linalg.qr(x, mode="r")
    return np.vstack([r, np.zeros((x.shape[1] - len(r), x.shape[1]))]) if len(r) < x.shape[1] else r


def factors(rows: DataFrame, width: int) -> dict[int, np.ndarray]:
    """Per fold the triangle of features, 1 and target: each task factors its rows, and triangles are factored together, eight at a time."""
    size = width + 2
    step = max(256, size)

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        node = TaskContext.get().partitionId()
        found: dict[int, np.ndarray] = {}
        for batch in batches:
            for fold, part in batch.groupby("fold"):
                for lo in range(0, len(part), step):
                    some = part.iloc[lo : lo + step]
                    x = np.zeros((len(some), size))
                    for i, (j, v) in enumerate(zip(some["j"], some["v"], strict=True)):
                        if j is not None:
                            x[i, np.asarray(j, int)] = v
                    x[:, width], x[:, width + 1] = 1.0, some["y"]
                    found[fold] = _triangle(np.vstack([found[fold], x]) if fold in found else x)
        for fold, r in found.items():
            yield pd.DataFrame({"fold": [fold], "node": [node], "r": [r.tobytes()]})

    def together(part: pd.DataFrame) -> pd.DataFrame:
        stacked = np.vstack([np.frombuffer(r).reshape(size, size) for r in part.sort_values("node")["r"]])
        return pd.DataFrame({"fold": part["fold"].iloc[:1], "node": part["node"].iloc[:1] // 8, "r": [_triangle(stacked).tobytes()]})

    kind = "fold int, node int, r binary"
    parts = stage(rows.mapInPandas(partial, kind))
    while (parts.agg(F.max("node")).first()[0] or 0) > 0:
        parts = stage(parts.groupBy("fold", F.expr("node div 8")).applyInPandas(together, kind))
    return {r["fold"]: np.frombuffer(bytes(r["r"])).reshape(size, size) for r in parts.collect()}  # a triangle a fold


@dataclass
class LinearFit:
    """Coefficients, intercept, sum of squared errors and rank of a least-squares fit."""

    beta: np.ndarray
    b0: float
    error: float
    rank: int


def basic_solution(triangle: np.ndarray, intercept: bool = True, tolerance: float = 1e-10) -> LinearFit:
    """Least squares from a triangle of features, 1 and target: columns are pivoted by what is left of them.

    A column of which the chosen ones leave less than ``tolerance`` is their
    sum and has no coefficient, so there are as many coefficients as the rank.
    """
    a, c = triangle[:, :-1].copy(), triangle[:, -1].copy()
    if not intercept:
        a[:, -1] = 0.0
    whole = np.sqrt((a**2).sum(0))
    order, m = [], min(a.shape)
    left = np.ones(a.shape[1], bool)
    for k in range(m):
        size = np.where(left & (whole > 0), np.sqrt((a[k:] ** 2).sum(0)), 0.0)
        size[size <= tolerance * whole] = 0.0
        j = int(size.argmax())
        if not size[j]:
            break
        # a reflection that leaves the column at its k-th place alone
        v = a[k:, j].copy()
        v[0] += math.copysign(size[j], v[0])
        v /= np.linalg.norm(v)
        a[k:] -= 2 * np.outer(v, v @ a[k:])
        c[k:] -= 2 * v * (v @ c[k:])
        order.append(j)
        left[j] = False
    rank = len(order)
    beta = np.zeros(a.shape[1])
    if rank:
        beta[order] = np.linalg.solve(np.triu(a[:rank, order]), c[:rank])
    return LinearFit(beta[:-1], float(beta[-1]), float(c[rank:] @ c[rank:]), rank)


def stacked(parts: list[np.ndarray]) -> np.ndarray:
    """The triangle of all rows of some triangles."""
    return _triangle(np.vstack(parts))


#: Ways to fit: sums of products (quick, loses half the digits), pivoted QR (any rank), and the lasso at one standard error.
SOLVERS = ("normal", "qr", "lasso")


def linear_fit(rows: DataFrame, width: int, solver: str = "qr", intercept: bool = True) -> LinearFit:
    """Design rows fitted by a solver's name; the lasso has an intercept always."""
    if solver not in SOLVERS:
        raise ValueError(f"no solver named {solver}")
    triangles = factors(rows, width)
    whole = stacked(list(triangles.values())) if triangles else np.zeros((width + 2, width + 2))
    if solver == "qr":
        return basic_solution(whole, intercept)
    if solver == "normal":
        beta, b0, wrong = least_squares(total(gram(rows, width)), intercept)
        return LinearFit(beta, b0, wrong, int(np.linalg.matrix_rank(whole[:, : width + intercept])))
    from kmerloom.operators.lasso import lasso_rows

    path = lasso_rows(rows, width)
    beta, b0 = path.coefficients[path.one_se], float(path.intercepts[path.one_se])
    # the triangle keeps lengths, so errors of any coefficients follow from it
    left = whole @ np.concatenate([-beta, [-b0, 1.0]])
    return LinearFit(beta, b0, float(left @ left), int(np.count_nonzero(beta)))


def error(s: Sums, beta: np.ndarray) -> float:
    """Sum of squared errors of coefficients (the intercept last) on some rows."""
    return float(max(s.yy - 2 * beta @ s.xy + beta @ s.xx @ beta, 0.0))


@dataclass
class LassoPath:
    """Solutions along the penalties, cross-validated errors and the two usual choices."""

    penalties: np.ndarray
    coefficients: np.ndarray
    intercepts: np.ndarray
    mse: np.ndarray
    se: np.ndarray

    @property
    def least(self) -> int:
        return int(self.mse.argmin())

    @property
    def one_se(self) -> int:
        """The largest penalty whose error is within a standard error of the least."""
        return int(np.flatnonzero(self.mse <= self.mse[self.least] + self.se[self.least])[0])

    def chosen(self, min_features: int = 5) -> int:
        return self.one_se if np.count_nonzero(self.coefficients[self.one_se]) >= min_features else self.least


def _standardised(s: Sums) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, float]:
    n = s.n
    mean, my = s.xx[-1, :-1] / n, s.xy[-1] / n
    cov = s.xx[:-1, :-1] / n - np.outer(mean, mean)
    sd = np.sqrt(np.maximum(np.diag(cov), 0))
    scale = np.where(sd > 1e-12, sd, np.inf)
    return cov / np.outer(scale, scale), (s.xy[:-1] / n - mean * my) / scale, scale, mean, my


def lasso_path(s: Sums, penalties: np.ndarray | None = None, n: int = 100, ratio: float = 1e-4, rounds: int = 1000, tolerance: float = 1e-6) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Penalties (descending), coefficients and intercepts of 1/(2n) |y - Xb|^2 + penalty |b| on standardised features."""
    c, r, scale, mean, my = _standardised(s)
    if penalties is None:
        top = max(float(np.abs(r).max(initial=0)), 1e-12)
        penalties = top * np.geomspace(1, ratio, n)
    beta = np.zeros(len(r))
    grad = r.copy()  # r - c @ beta
    betas = []
    for lam in penalties:
        for _ in range(rounds):
            change = 0.0
            active = np.flatnonzero((beta != 0) | (np.abs(grad) > lam))
            for j in active:
                if c[j, j] <= 0:
                    continue
                z = grad[j] + c[j, j] * beta[j]
                new = math.copysign(max(abs(z) - lam, 0.0), z) / c[j, j]
                if new != beta[j]:
                    grad -= c[:, j] * (new - beta[j])
                    change = max(change, abs(new - beta[j]))
                    beta[j] = new
            if change < tolerance:
                break
        betas.append(beta / scale)
    betas = np.array(betas)
    return penalties, betas, my - betas @ mean


def lasso(folds: dict[int, Sums], n: int = 100) -> LassoPath:
    """The path on all rows, errors from fits without each fold; for few features, whose sums of products are small."""
    whole = total(folds)
    penalties, coefficients, intercepts = lasso_path(whole, n=n)
    errors = []
    for part in folds.values():
        _, b, b0 = lasso_path(whole - part, penalties)
        errors.append([error(part, np.append(x, y)) / part.n for x, y in zip(b, b0, strict=True)])
    return _path(penalties, coefficients, intercepts, np.array(errors))


def _path(penalties: np.ndarray, coefficients: np.ndarray, intercepts: np.ndarray, errors: np.ndarray) -> LassoPath:
    se = errors.std(0, ddof=1) / math.sqrt(len(errors)) if len(errors) > 1 else np.zeros(len(penalties))
    return LassoPath(penalties, coefficients, intercepts, errors.mean(0), se)


class _Sparse:
    """Sparse features of some rows by column, standardised in thought only."""

    def __init__(self, j: list, v: list, y: np.ndarray, width: int):
        sizes = [0 if x is None else len(x) for x in j]
        row = np.repeat(np.arange(len(j)), sizes)
        column = np.concatenate([np.zeros(0, np.int64), *[np.asarray(x, np.int64) for x in j if x is not None]])
        value = np.concatenate([np.zeros(0), *[np.asarray(x, float) for x in v if x is not None]])
        order = np.argsort(column, kind="stable")
        self.row, self.column, self.value = row[order], column[order], value[order]
        self.at = np.searchsorted(self.column, np.arange(width + 1))
        self.n, self.width, self.y = len(y), width, y
        self.sum = np.bincount(self.column, self.value, width)
        self.mean = self.sum / max(self.n, 1)
        square = np.bincount(self.column, self.value**2, width) / max(self.n, 1) - self.mean**2
        self.sd = np.where(square > 1e-12, np.sqrt(np.maximum(square, 0)), np.inf)

    def gradient(self, r: np.ndarray, shift: float) -> np.ndarray:
        """Of all features, at residuals ``r + shift``, which sum to 0."""
        return (np.bincount(self.column, self.value * r[self.row], self.width) + shift * self.sum) / (self.n * self.sd)


def sparse_path(x: _Sparse, penalties: np.ndarray | None = None, n: int = 100, ratio: float = 1e-4, rounds: int = 100, tolerance: float = 1e-4) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """``lasso_path`` by residuals, of a few rows in memory: only active features are cycled through, and all are checked in between.

    The least penalty is ``ratio`` times the greatest; coefficients are pairs
    of places and values.
    """
    r, shift = x.y - x.y.mean(), 0.0
    grad = x.gradient(r, shift)
    if penalties is None:
        penalties = max(float(np.abs(grad).max(initial=0)), 1e-12) * np.geomspace(1, ratio, n)
    beta, active, out = np.zeros(x.width), np.zeros(x.width, bool), []
    scale = float(x.y.std()) or 1.0
    for lam in penalties:
        while True:
            for _ in range(rounds):
                change = 0.0
                for j in np.flatnonzero(active):
                    own = slice(x.at[j], x.at[j + 1])
                    rows, values = x.row[own], x.value[own]
                    z = (values @ r[rows] + shift * x.sum[j]) / (x.n * x.sd[j]) + beta[j]
                    new = math.copysign(max(abs(z) - lam, 0.0), z)
                    step = (new - beta[j]) / x.sd[j]
                    if step:
                        r[rows] -= step * values
                        shift += step * x.mean[j]
                        change = max(change, abs(new - beta[j]))
                        beta[j] = new
                if change < tolerance * scale:
                    break
            late = (np.abs(x.gradient(r, shift)) > lam * (1 + 1e-9)) & ~active & np.isfinite(x.sd)
            if not late.any():
                break
            active |= late
        places = np.flatnonzero(beta)
        out.append((places, beta[places] / x.sd[places]))
    intercepts = np.array([x.y.mean() - b @ x.mean[j] for j, b in out])
    return penalties, out, intercepts


def apply_model(rows: DataFrame, models: dict[int, tuple[np.ndarray, float]]) -> DataFrame:
    """``id``, ``fold``, ``y``, ``pred`` of design rows by their fold's model (key -1: one model for all)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            pred = []
            for fold, j, v in zip(b["fold"], b["j"], b["v"], strict=True):
                beta, b0 = models.get(-1) or models[fold]
                pred.append(b0 + (float(beta[np.asarray(j, int)] @ np.asarray(v)) if j is not None else 0.0))
            out = b[["id", "fold", "y"]].copy()
            out["pred"] = pred
            yield out

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInPandas(run, f"id {kind}, fold int, y double, pred double")


def ols(rows: DataFrame, width: int) -> tuple[np.ndarray, float, DataFrame]:
    """Coefficients, intercept and fitted values of design rows; features that are sums of others have none."""
    found = linear_fit(rows, width)
    return found.beta, found.b0, apply_model(rows, {-1: (found.beta, found.b0)})


def cross_validate(rows: DataFrame, width: int) -> DataFrame:
    """Held-out predictions: ten solves from one factorisation of each fold."""
    folds = factors(rows, width)
    models = {}
    for f in folds:
        others = [r for g, r in folds.items() if g != f]
        found = basic_solution(stacked(others)) if others else LinearFit(np.zeros(width), 0.0, 0.0, 0)
        models[f] = (found.beta, found.b0)
    return apply_model(rows, models)


def score(seqs: DataFrame, model: DataFrame, b0: float, low_length: int = LOW_LENGTH) -> DataFrame:
    """``id``, ``len``, ``raw`` and ``score`` of every sequence: the weights of its k-mers, and that with the intercept.

    Sequences shorter than ``low_length`` have a null score; one without any
    k-mer of the model has the intercept.
    """
    sums = weight_sums(seqs, model)
    return sums.withColumn("score", F.when(F.col("len") >= low_length, F.col("raw") + F.lit(b0)))


def model_table(kmers: list[str], beta: np.ndarray, spark) -> DataFrame:
    """``kmer``, ``k``, ``weight`` and ``share`` of all absolute weight, of the features that have any."""
    whole = float(np.abs(beta).sum()) or 1.0
    rows = [(k, len(k), float(b), float(b) / whole) for k, b in zip(kmers, beta, strict=True) if b]
    return spark.createDataFrame(rows, "kmer string, k int, weight double, share double")


def length_slope(scored: DataFrame) -> DataFrame:
    """One row: slope and intercept of log2 rate on log2 length, and whether rates need correction (|slope| of 0.2 or more)."""
    ok = scored.where((F.col("d") > 0) & (F.col("len") > 0)).select(F.log2("d").alias("y"), F.log2("len").alias("x"))
    out = ok.agg(F.regr_slope("y", "x").alias("slope"), F.regr_intercept("y", "x").alias("intercept"))
    return out.withColumn("correct", F.abs("slope") >= 0.2)


def correct_length(scored: DataFrame, b0: float, low_length: int = LOW_LENGTH, restarts: int = 25, seed: int = 0) -> DataFrame:
    """``id``, ``d``: rates corrected for sequence length, clamped to their bounds.

    ``scored`` has ``id``, ``len`` and ``raw``, the weights' sum without the
    intercept.  Raw sums are moved to be positive; if their log2 depends on
    log2 length, a logistic curve through the means of length bins (32 to a
    doubling, so about a thousand at most) tells the factor each length brings.
    """
    from kmerloom.operators.logistic import fit_logistic, logistic

    rows = scored.where(F.col("len") >= low_length)
    shift = math.floor(hazen_percentile(rows, "raw", 0.02) or 0.0)
    moved = rows.select("id", "len", "raw", (F.col("raw") - shift).alias("d"))
    gate = length_slope(moved).first()
    if gate["slope"] is None or not gate["correct"]:
        return scored.select("id", F.when(F.col("len") >= low_length, decay.clamp_rate(F.col("raw") + b0)).alias("d"))
    x = F.round(F.log2("len") * 32) / 32
    means = moved.where(F.col("d") > 0).groupBy(x.alias("x")).agg(F.avg(F.log2("d")).alias("y"), F.count("*").alias("n")).toPandas()
    p, _ = fit_logistic(means["x"], means["y"], [0, -np.inf, -np.inf, 0], [10, np.inf, np.inf, 20], restarts, seed, weights=means["n"] / means["n"].sum())
    base = float(logistic(p, np.zeros(1))[0])
    b, h0, h1, t = (float(v) for v in p)
    curve = F.lit(h0) + F.lit(h1 - h0) / (1 + F.exp(F.lit(b) * (F.log2("len") - t)))
    z = F.pow(F.lit(2.0), curve - base)
    return scored.select("id", F.when(F.col("len") >= low_length, decay.clamp_rate(F.col("raw") / z + b0)).alias("d"))
