"""The lasso path of design rows that stay where they are.

One path on all rows and one without each fold go in step.  The driver holds
vectors of features only.  A pass over the rows gives the gradients of all
paths at some penalties in a row; features that the strong rule admits for
the next ones join the working set; sums of products of the working set with
itself are made by the tasks, kept as a table by blocks of features, and
solved on by a task a path.  Features that a solution would need and the
working set lacks show in the next gradients; they are admitted and the
penalties solved again.  So every solution is one of all features and rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kmerloom.operators.regression import LassoPath, _path
from kmerloom.sources.tables import stage

#: Penalties that are solved before gradients are made anew, features a block of sums, and rows that a task takes at a time.
AHEAD, BLOCK, ROWS = 4, 64, 256
#: Features that may join the working set at a time, or as many as have a coefficient.
GROWTH = 32
#: Least penalty over the greatest, whatever the shape of the table.
RATIO = 1e-4


def solve(c: np.ndarray, r: np.ndarray, lam: float, beta: np.ndarray, tolerance: float = 1e-7, rounds: int = 300) -> np.ndarray:
    """The minimum of 1/2 b'cb - r'b + lam |b| from ``beta`` on.

    Coordinates descend in turn; when they settle, the equations of the
    active ones are solved as they stand, and taken if no sign changes.
    """
    beta = beta.copy()
    grad = r - c @ beta
    size = np.diag(c).copy()
    scale = max(float(np.abs(r).max(initial=0.0)), 1e-300)
    turn = 0
    while turn < rounds:
        change = 0.0
        for j in np.flatnonzero((beta != 0) | (np.abs(grad) > lam)):
            if size[j] <= 0:
                continue
            z = grad[j] + size[j] * beta[j]
            new = math.copysign(max(abs(z) - lam, 0.0), z) / size[j]
            step = new - beta[j]
            if step:
                grad -= c[:, j] * step
                change = max(change, abs(step))
                beta[j] = new
        turn += 1
        if change <= tolerance * scale or turn % 50 == 0:
            exact = _on_active(c, r, lam, beta)
            if exact is not None:
                left = r - c @ exact
                if (np.abs(left[exact == 0]) <= lam + 1e-10 * scale).all():
                    return exact
            if change <= tolerance * scale * 1e-4:
                break
    return beta


def follow(c: np.ndarray, r: np.ndarray, upper: float, lower: float, beta: np.ndarray) -> np.ndarray | None:
    """The minimum of ``solve`` at ``lower`` from ``beta``, that at ``upper``: between, solutions are straight lines that bend where a feature joins or leaves.

    None where equations are not sharp (features that are sums of others) or the bends do not end.
    """
    beta = beta.copy()
    on = list(np.flatnonzero(beta))
    lam, left = upper, -1
    bound = np.zeros(len(r), bool)  # sums of active features: their gradients go with those
    grad = r - c @ beta
    size = np.diag(c)
    top = max(upper, 1e-300)
    inverse, own, turn = None, c[on], 0
    for _ in range(20 * len(r) + 100):
        sign = np.sign(beta[on])
        fresh = sign == 0
        sign[fresh] = np.sign(grad[on])[fresh]
        # the inverse is carried along, and made anew where it is no longer sharp
        way = inverse @ sign if inverse is not None else np.zeros(0)
        if on and (inverse is None or np.abs(own[:, on] @ way - sign).max() > 1e-10):
            try:
                inverse = np.linalg.inv(own[:, on])
            except np.linalg.LinAlgError:
                return None
            way = inverse @ sign
            way += inverse @ (sign - own[:, on] @ way)
            if not np.isfinite(way).all() or np.abs(own[:, on] @ way - sign).max() > 1e-8:
                return None
        slope = way @ own if on else np.zeros(len(r))
        off = (size > 0) & ~bound
        off[on] = False
        if left >= 0:
            off[left] = False
        step, event = lam - lower, None
        with np.errstate(divide="ignore", invalid="ignore"):
            for joins in ((lam - grad) / (1 - slope), (lam + grad) / (1 + slope)):
                # what is over the penalty by a last digit joins at once
                joins = np.where(off & (joins > -1e-6 * top), np.maximum(joins, 0.0), np.inf)
                j = int(joins.argmin()) if len(joins) else -1
                if j >= 0 and joins[j] < step:
                    step, event = float(joins[j]), ("join", j)
            leaves = np.where(beta[on] * way < 0, -beta[on] / way, np.inf)
        if len(leaves) and leaves.min() < step:
            step, event = float(leaves.min()), ("leave", int(leaves.argmin()))
        beta[on] += step * way
        turn += 1
        grad = grad - step * slope if turn % 50 else r - c @ beta
        lam -= step
        if event is None:
            return beta
        left = -1
        if event[0] == "join":
            j = event[1]
            ties = inverse @ own[:, j] if on else np.zeros(0)
            rest = size[j] - own[:, j] @ ties if on else size[j]
            if rest <= 1e-10 * size[j]:
                bound[j] = True
                continue
            if on:
                inverse = np.block([[inverse + np.outer(ties, ties) / rest, -ties[:, None] / rest], [-ties[None, :] / rest, np.array([[1 / rest]])]])
            else:
                inverse = np.array([[1 / rest]])
            on.append(j)
            own = np.vstack([own, c[j]])
        else:
            i = event[1]
            left = on.pop(i)
            beta[left] = 0.0
            own = np.delete(own, i, 0)
            others = np.delete(np.arange(len(inverse)), i)
            inverse = inverse[np.ix_(others, others)] - np.outer(inverse[others, i], inverse[i, others]) / inverse[i, i]
            bound[:] = False
    return None


def step_down(c: np.ndarray, r: np.ndarray, upper: float, lower: float, beta: np.ndarray) -> np.ndarray:
    """The minimum at ``lower`` from that at ``upper``, by its bends if they can be followed, else by descent."""
    found = follow(c, r, upper, lower, beta)
    if found is not None:
        exact = _on_active(c, r, lower, found)
        found = found if exact is None else exact
        grad, scale = r - c @ found, max(float(np.abs(r).max(initial=0.0)), 1e-300)
        on = found != 0
        usable = np.diag(c) > 0
        if (np.abs(grad[usable]) <= lower * (1 + 1e-6) + 1e-9 * scale).all() and np.allclose(grad[on], lower * np.sign(found[on]), rtol=1e-6, atol=1e-9 * scale):
            return found
    return solve(c, r, lower, beta if found is None else found)


def _on_active(c: np.ndarray, r: np.ndarray, lam: float, beta: np.ndarray) -> np.ndarray | None:
    """The solution with the signs of ``beta``, or none if it has others or is not sharp."""
    on = np.flatnonzero(beta)
    if not len(on):
        return beta
    sign = np.sign(beta[on])
    try:
        found = np.linalg.solve(c[np.ix_(on, on)], r[on] - lam * sign)
    except np.linalg.LinAlgError:
        return None
    if not np.isfinite(found).all() or (found * sign <= 0).any():
        return None
    if np.abs(c[np.ix_(on, on)] @ found - r[on] + lam * sign).max() > 1e-9 * max(1.0, np.abs(r).max()):
        return None
    out = np.zeros_like(beta)
    out[on] = found
    return out


@dataclass
class _Moments:
    """Of each path: rows, mean of the target, means and deviations of features, and the gradients at the start."""

    n: np.ndarray
    y: np.ndarray
    mean: np.ndarray
    sd: np.ndarray
    start: np.ndarray


@dataclass
class _State:
    """The working set in the order in which features joined it, and the blocks of its sums of products (a table each time)."""

    width: int
    place: dict[int, int] = field(default_factory=dict)
    blocks: list[DataFrame] = field(default_factory=list)

    @property
    def features(self) -> np.ndarray:
        return np.fromiter(self.place, np.int64, len(self.place))


def _moments(rows: DataFrame, folds: list[int], width: int) -> _Moments:
    base = {r["fold"]: r for r in rows.groupBy("fold").agg(F.count("*").alias("n"), F.sum("y").alias("y")).collect()}
    pairs = rows.where("j is not null").select("fold", "y", F.explode(F.arrays_zip("j", "v")).alias("e")).select("fold", "y", "e.j", "e.v")
    sums = pairs.groupBy("fold", "j").agg(F.sum("v").alias("x"), F.sum(F.col("v") * F.col("v")).alias("xx"), F.sum(F.col("v") * F.col("y")).alias("xy"))
    x, xx, xy = (np.zeros((len(folds), width)) for _ in range(3))
    at = {f: i for i, f in enumerate(folds)}
    for part in sums.toPandas().itertuples():  # a row a fold and feature
        x[at[part.fold], part.j], xx[at[part.fold], part.j], xy[at[part.fold], part.j] = part.x, part.xx, part.xy
    n, y = (np.array([float(base[f][c]) for f in folds]) for c in ("n", "y"))
    # each path lacks a fold, the last one none
    n, y, x, xx, xy = (np.concatenate([v.sum(0, keepdims=True) - v, v.sum(0, keepdims=True)]) for v in (n, y, x, xx, xy))
    rows_of = np.maximum(n, 1)[:, None]
    mean = x / rows_of
    square = xx / rows_of - mean**2
    sd = np.where(square > 1e-12, np.sqrt(np.maximum(square, 0)), np.inf)
    target = y / np.maximum(n, 1)
    return _Moments(n, target, mean, sd, (xy / rows_of - mean * target[:, None]) / sd)


def _sparse(part: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, feature and value of all entries of some rows."""
    sizes = [0 if j is None else len(j) for j in part["j"]]
    row = np.repeat(np.arange(len(part)), sizes)
    own = [k for k, n in enumerate(sizes) if n]
    j, v = part["j"].to_numpy(), part["v"].to_numpy()
    if not own:
        return row, np.zeros(0, np.int64), np.zeros(0)
    return row, np.concatenate([np.asarray(j[k], np.int64) for k in own]), np.concatenate([np.asarray(v[k], float) for k in own])


def _admit(rows: DataFrame, state: _State, new: np.ndarray, folds: list[int]) -> None:
    """Let features join the working set: sums of their products with all members, a block of features by path."""
    first = len(state.place)
    for f in new.tolist():
        state.place[f] = len(state.place)
    members = len(state.place)
    at = np.full(state.width, -1)
    at[state.features] = np.arange(members)

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for fold, part in batch.groupby("fold"):
                for lo in range(0, len(part), ROWS):
                    some = part.iloc[lo : lo + ROWS]
                    row, j, v = _sparse(some)
                    known = at[j] >= 0
                    x = np.zeros((len(some), members))
                    x[row[known], at[j[known]]] = v[known]
                    total[fold] = total.get(fold, 0) + x[:, first:].T @ x
        for fold, m in total.items():
            for lo in range(0, len(m), BLOCK):
                yield pd.DataFrame({"fold": [fold], "first": [first + lo], "m": [m[lo : lo + BLOCK].tobytes()]})

    def added(part: pd.DataFrame) -> pd.DataFrame:
        m = sum(np.frombuffer(b) for b in part["m"])
        return pd.DataFrame({"fold": part["fold"].iloc[:1], "first": part["first"].iloc[:1], "m": [m.tobytes()]})

    def by_path(part: pd.DataFrame) -> pd.DataFrame:
        """Of the folds' sums those of each path."""
        own = {r.fold: np.frombuffer(r.m) for r in part.itertuples()}
        whole = sum(own.values())
        made = [(whole - own.get(f, 0.0)).tobytes() for f in folds] + [whole.tobytes()]
        return pd.DataFrame({"path": np.arange(len(made)), "first": int(part["first"].iloc[0]), "width": members, "m": made})

    kind = "fold int, first int, m binary"
    parts = rows.mapInPandas(partial, kind).groupBy("fold", "first").applyInPandas(added, kind)
    state.blocks.append(stage(parts.groupBy("first").applyInPandas(by_path, "path int, first int, width int, m binary")))


def _solutions(state: _State, moments: _Moments, penalties: np.ndarray, start: np.ndarray, upper: np.ndarray) -> np.ndarray:
    """Standardised coefficients of the working set by path and penalty, each path in a task of its own; ``start`` are those at ``upper``."""
    features = state.features
    mean, sd, n, r = moments.mean[:, features], moments.sd[:, features], moments.n, moments.start[:, features]
    size = len(features)

    def one(part: pd.DataFrame) -> pd.DataFrame:
        g = int(part["path"].iloc[0])
        xx = np.zeros((size, size))
        for b in part.itertuples():
            m = np.frombuffer(b.m).reshape(-1, b.width)
            xx[b.first : b.first + len(m), : b.width] = m
        xx = np.tril(xx) + np.tril(xx, -1).T
        c = (xx / n[g] - np.outer(mean[g], mean[g])) / np.outer(sd[g], sd[g])
        beta, found, last = start[g], [], float(upper[g])
        for lam in penalties:
            beta = step_down(c, r[g], last, float(lam), beta)
            found.append(beta)
            last = float(lam)
        return pd.DataFrame({"path": g, "l": np.arange(len(found)), "beta": found})

    blocks = state.blocks[0]
    for b in state.blocks[1:]:
        blocks = blocks.union(b)
    got = blocks.groupBy("path").applyInPandas(one, "path int, l int, beta array<double>").toPandas()
    out = np.zeros((len(n), len(penalties), size))
    for r_ in got.itertuples():
        out[r_.path, r_.l] = r_.beta
    return out


def _gradients(rows: DataFrame, moments: _Moments, folds: list[int], features: np.ndarray, beta: np.ndarray, b0: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of all features by path and penalty, and the held-out squared errors, at coefficients on the scale of the counts."""
    paths, ahead, _ = beta.shape
    width = moments.mean.shape[1]
    weights = np.zeros((width, paths * ahead))
    weights[features] = beta.reshape(paths * ahead, -1).T
    level = b0.reshape(-1)
    number = {f: i for i, f in enumerate(folds)}
    names = [f"c{i}" for i in range(paths * ahead)]

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((width + 1, paths * ahead))
        for batch in batches:
            for lo in range(0, len(batch), ROWS):
                some = batch.iloc[lo : lo + ROWS]
                row, j, v = _sparse(some)
                y = some["y"].to_numpy(float)
                predicted = np.zeros((len(some), paths * ahead))
                begin = np.flatnonzero(np.diff(row, prepend=-1))
                if len(row):
                    predicted[row[begin]] = np.add.reduceat(v[:, None] * weights[j], begin)
                left = (y[:, None] - predicted - level).reshape(len(some), paths, ahead)
                own = np.array([number[f] for f in some["fold"]])
                held = left[np.arange(len(some)), own]
                np.add.at(total[width].reshape(paths, ahead), own, held**2)
                left[np.arange(len(some)), own] = 0.0  # a path learns nothing from the fold it lacks
                left = left.reshape(len(some), -1)
                for k in range(paths * ahead):
                    total[:width, k] += np.bincount(j, v * left[row, k], width)
        used = np.flatnonzero(total.any(1))
        yield pd.DataFrame({"j": used, **{name: total[used, k] for k, name in enumerate(names)}})

    sums = rows.mapInPandas(partial, "j int, " + ", ".join(f"{name} double" for name in names))
    got = sums.groupBy("j").agg(*[F.sum(name).alias(name) for name in names]).toPandas()
    out = np.zeros((width + 1, paths * ahead))
    out[got["j"].to_numpy(int)] = got[names].to_numpy()
    out = out.reshape(width + 1, paths, ahead)
    with np.errstate(invalid="ignore"):
        return out[:width] / (moments.n[:, None] * moments.sd.T[:, :, None]), out[width]


def lasso_rows(rows: DataFrame, width: int, n: int = 100, ratio: float = RATIO, ahead: int = AHEAD) -> LassoPath:
    """The path of design rows (``fold``, ``y``, ``j``, ``v``): solutions on all rows, errors from those without each fold.

    Penalties fall from the least that leaves no feature to ``ratio`` times
    that.  A table without rows has solutions without features; with one fold
    alone its own errors stand for held-out ones.
    """
    # a task has rows of a fold or two, so that it sums for few
    dealt = rows.select("fold", "y", "j", "v", F.xxhash64("y", "j").alias("salt")).repartitionByRange("fold", "salt")
    rows = stage(dealt.drop("salt"))
    folds = sorted(r["fold"] for r in rows.select("fold").distinct().collect())
    if not folds:
        return LassoPath(np.geomspace(1, ratio, n), np.zeros((n, width)), np.zeros(n), np.zeros(n), np.zeros(n))
    moments = _moments(rows, folds, width)
    paths, whole = len(folds) + 1, len(folds)
    known = moments.n > 0
    penalties = max(float(np.abs(moments.start[whole]).max(initial=0.0)), 1e-12) * np.geomspace(1, ratio, n)
    state, gradient = _State(width), moments.start.T[:, known]
    start = np.zeros((paths, 0))
    coefficients, intercepts, errors = np.zeros((n, width)), np.zeros(n), []
    # where each path has no feature yet
    last = np.maximum(np.abs(moments.start).max(1, initial=0.0), penalties[0])
    for lo in range(0, n, ahead):
        some = penalties[lo : lo + ahead]
        # by the strong rule gradients change no faster than penalties, so these alone are likely to be needed
        excess = (np.abs(gradient) / np.maximum(2 * some[-1] - last[known], 0.5 * some[-1])).max(1, initial=0.0)
        while True:
            excess[state.features] = 0.0
            new = np.flatnonzero((excess >= 1) & np.isfinite(moments.sd[known]).any(0))
            # the largest first, about as many as there are; the rest shows again if it is needed
            new = new[np.argsort(-excess[new], kind="stable")][: max(GROWTH, np.count_nonzero(start.any(0)))]
            if len(new):
                _admit(rows, state, new, folds)
                start = np.hstack([start, np.zeros((paths, len(new)))])
            features = state.features
            found = _solutions(state, moments, some, start, last) if len(features) else np.zeros((paths, len(some), 0))
            beta = found / moments.sd[:, None, features]
            b0 = moments.y[:, None] - np.einsum("gls,gs->gl", beta, moments.mean[:, features])
            gradients, squares = _gradients(rows, moments, folds, features, beta, b0)
            excess = np.nan_to_num(np.abs(gradients[:, known]) / some).max((1, 2), initial=0.0)
            excess[features] = 0.0
            if (excess <= 1 + 1e-7).all():
                break
        start, gradient, last = found[:, -1], gradients[:, known, -1], np.full(paths, some[-1])
        coefficients[lo : lo + len(some), features] = beta[whole]
        intercepts[lo : lo + len(some)] = b0[whole]
        errors.append(squares[:whole])
    held = moments.n[whole] - moments.n[:whole]
    return _path(penalties, coefficients, intercepts, np.concatenate(errors, 1) / held[:, None])
