"""Whitening of embeddings by Golub-Kahan-Lanczos bidiagonalisation.

The centred rows X are never multiplied with themselves.  Starting from a
vector v, rows give u = Xv and the columns give the next v = X'u, each made
orthogonal to all before it; the two recurrences leave a bidiagonal matrix B
with X V = U B, whose singular value decomposition is small: its right
vectors turn V into the components, its values over the square root of the
number of rows are their deviations.

Vectors of length d stay in the driver.  Those of length n do not exist: u is
X p for a short p that the recurrence yields, so a step is one job over the
rows, which computes Xq and all earlier U = XP from the short vectors and
returns sums of products: U'Xq (what full reorthogonalisation takes away),
X'Xq and the length of Xq.  Nothing is kept in executors, so a lost one costs
its tasks only.  Where the length of u falls to nothing, or a new v, the
space is complete so far and a fresh direction orthogonal to it is taken.

Components are final once d steps are done, or sooner when the last row of
B's left vectors bounds the error of all wanted ones.

Defined results: vectors that are null, empty or hold null or non-finite
entries are dropped, and so are those whose length is not the most frequent
one (of equals the shortest); rows of the same key are rows each; components
without variance have no whitened value (null) and no part in the identity
error; a table without vectors has no rows.  ``deviation`` is exact, and null
where it does not fit 64 bits.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kmerloom.llm.common import small_batches, written

#: Entries become whole numbers: floor(SCALE * c) + SHIFT.
SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 32
#: Relative size below which a vector counts as nothing, and error of a singular vector at which the steps end early.
NOTHING, TOLERANCE = 1e-12, 1e-14
_LONGEST = 2.0**62 / SCALE


@dataclass
class Centred:
    """Whole-number vectors (``key``, ``x`` array<bigint>) with their exact sums."""

    rows: DataFrame
    n: int
    sums: list[int]

    @property
    def width(self) -> int:
        return len(self.sums)

    def matrix(self) -> Callable[[pd.Series], np.ndarray]:
        """A function for tasks: vectors less the mean, rounded once."""
        whole = np.array([s // self.n for s in self.sums], np.int64)
        rest = np.array([s % self.n / self.n for s in self.sums])
        return lambda x: (np.stack(x.to_numpy()) - whole) - rest


def whole_numbers(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding") -> Centred:
    """Vectors of finite entries as whole numbers, written, and their sums."""
    v = F.col(vector).cast("array<double>")
    sound = ~F.exists("v", lambda e: e.isNull() | F.isnan(e) | (F.abs(e) >= F.lit(_LONGEST)))
    rows = vectors.select(F.col(key).alias("key"), v.alias("v")).where(F.coalesce(sound & (F.size("v") > 0), F.lit(False)))
    x = F.transform("v", lambda e: F.floor(e * SCALE) + F.lit(SHIFT).cast("long"))
    rows = written(rows.select("key", x.alias("x")))
    usual = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if usual is None:
        return Centred(rows, 0, [])
    rows = rows.where(F.size("x") == usual["d"])
    each = rows.select(F.posexplode("x").alias("j", "e")).groupBy("j").agg(F.sum(F.col("e").cast("decimal(38,0)")).alias("s"))
    sums = {r["j"]: int(r["s"]) for r in each.collect()}  # a row a dimension
    return Centred(rows, usual["count"], [sums[j] for j in range(usual["d"])])


def summed(data: Centred, size: int, part: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum over batches of centred rows of ``part``'s vectors of a size; each task adds up its own first."""
    centre = data.matrix()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(size)
        for batch in batches:
            if len(batch):
                total += part(centre(batch["x"]))
        yield pd.DataFrame({"j": np.arange(size), "s": total})

    rows = data.rows.select("x").mapInPandas(run, "j int, s double").groupBy("j").agg(F.sum("s").alias("s")).collect()
    out = np.zeros(size)
    for r in rows:
        out[r["j"]] = r["s"]
    return out


def _away(v: np.ndarray, basis: list[np.ndarray]) -> np.ndarray:
    """``v`` less its parts along an orthonormal basis, taken twice."""
    if basis:
        q = np.stack(basis, 1)
        for _ in range(2):
            v = v - q @ (q.T @ v)
    return v


def _fresh(basis: list[np.ndarray], width: int, rng: np.random.Generator) -> np.ndarray:
    v = _away(rng.standard_normal(width), basis)
    return v / np.linalg.norm(v)


@dataclass
class Factors:
    """Components (columns), their eigenvalues, descending, and the trace of the covariance."""

    components: np.ndarray
    eigenvalues: np.ndarray
    trace: float
    steps: int


def bidiagonalise(data: Centred, components: int = COMPONENTS, seed: int = 0) -> Factors:
    """The leading components of centred rows."""
    d, rng = data.width, np.random.default_rng(seed)
    trace = float(summed(data, 1, lambda x: np.array([np.einsum("ij,ij", x, x)]))[0])
    wanted = min(components, d)
    size = np.sqrt(trace)  # of X
    vs, ps, xtus = [_fresh([], d, rng)], np.zeros((d, 0)), np.zeros((d, 0))
    alphas: list[float] = []
    betas: list[float] = []  # betas[j] ties u_j to v_(j+1)
    while True:
        j = len(alphas)
        # u = X v_j - beta u_(j-1) = X q
        q = vs[j] - (betas[j - 1] * ps[:, j - 1] if j else 0.0)
        for _ in range(3):

            def products(x: np.ndarray, q: np.ndarray = q, p: np.ndarray = ps) -> np.ndarray:
                u = x @ q
                return np.concatenate([(x @ p).T @ u, x.T @ u, [u @ u]])

            got = summed(data, j + d + 1, products)
            h, g, square = got[:j], got[j : j + d], got[-1]
            left = square - h @ h
            q, g = q - ps @ h, g - xtus @ h
            # the more of u went away, the less exact is what is left
            if left >= 0.5 * square or square <= (NOTHING * size) ** 2:
                break
        alpha = float(np.sqrt(max(left, 0.0)))
        if alpha <= NOTHING * size:
            alpha, p, xtu = 0.0, np.zeros(d), np.zeros(d)
        else:
            p, xtu = q / alpha, g / alpha
        alphas.append(alpha)
        ps, xtus = np.column_stack([ps, p]), np.column_stack([xtus, xtu])
        if len(alphas) == d:
            break
        w = _away(xtu - alpha * vs[j], vs)
        beta = float(np.linalg.norm(w))
        if beta <= NOTHING * size:
            betas.append(0.0)
            vs.append(_fresh(vs, d, rng))
            continue
        betas.append(beta)
        vs.append(w / beta)
        if len(alphas) >= wanted:
            left_vectors, values, _ = np.linalg.svd(_upper(alphas, betas[:-1]))
            # residuals of X'u = s v; a space without a coupling to the rest can hide equal values, so d steps decide then
            if min(betas) > 0 and beta * np.abs(left_vectors[-1, :wanted]).max() <= TOLERANCE * values[wanted - 1]:
                vs.pop()
                break
    k = len(alphas)
    _, values, right = np.linalg.svd(_upper(alphas, betas[: k - 1]))
    return Factors(np.stack(vs[:k], 1) @ right[:wanted].T, values[:wanted] ** 2 / data.n, trace / data.n, k)


def _upper(alphas: list[float], betas: list[float]) -> np.ndarray:
    """The bidiagonal matrix of the recurrences."""
    return np.diag(alphas) + np.diag(betas[: len(alphas) - 1], 1)


def whiten(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """Per row: its key, ``n``, ``deviation``, ``whitened`` (array, an entry a component), ``explained`` (array) and ``identity_error``."""
    small_batches(vectors.sparkSession)
    data = whole_numbers(vectors, key, vector)
    kind = vectors.schema[key].dataType.simpleString()
    schema = f"key {kind}, deviation bigint, whitened array<double>"
    if not data.n:
        out = vectors.sparkSession.createDataFrame([], schema)
        return _named(out, key, 0, [], None)
    found = bidiagonalise(data, components)
    some = found.eigenvalues > NOTHING * max(found.trace, 0.0)
    weights = found.components / np.sqrt(np.where(some, found.eigenvalues, 1.0))
    k = int(some.sum())
    # eigenvalues descend, so the components with variance come first
    product = summed(data, k * k, lambda x: ((x @ weights[:, :k]).T @ (x @ weights[:, :k])).reshape(-1)) if k else np.zeros(0)
    error = float(np.abs(product.reshape(k, k) / data.n - np.eye(k)).max(initial=0.0)) if k else None
    centre, n, sums, d = data.matrix(), data.n, data.sums, data.width

    def project(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            x = np.stack(batch["x"].to_numpy())
            y = centre(batch["x"]) @ weights
            values = [[v if ok else None for v, ok in zip(row, some.tolist(), strict=True)] for row in y.tolist()]
            yield pd.DataFrame({"key": batch["key"], "deviation": pd.array(_deviations(x, n, sums, d), "Int64"), "whitened": values})

    rows = data.rows.withColumn("key", F.col("key").cast("string")).mapInPandas(project, schema.replace(f"key {kind}", "key string"))
    explained = (found.eigenvalues / found.trace).tolist() if found.trace > 0 else [None] * len(found.eigenvalues)
    return _named(rows.withColumn("key", F.col("key").cast(kind)), key, n, explained, error)


def _named(rows: DataFrame, key: str, n: int, explained: list, error: float | None) -> DataFrame:
    shares = F.array(*[F.lit(e).cast("double") for e in explained]).cast("array<double>")
    return rows.select(
        F.col("key").alias(key), F.lit(n).cast("long").alias("n"), "deviation", "whitened", shares.alias("explained"), F.lit(error).cast("double").alias("identity_error")
    )


def _deviations(x: np.ndarray, n: int, sums: list[int], d: int) -> list[int | None]:
    """Sums over dimensions of (n x - S)^2; in 64 bits where they surely fit, else in Python's integers."""
    off = x - np.array([s // n for s in sums], np.int64)  # from the mean's whole part
    rest = np.array([s % n for s in sums], np.int64)
    reach = int(np.abs(off).max(initial=0)) + 1
    if (n * reach) ** 2 * d < 2**63:
        return ((n * off - rest) ** 2).sum(1).tolist()
    out = []
    for row in off.tolist():
        total = sum((n * a - b) ** 2 for a, b in zip(row, rest.tolist(), strict=True))
        out.append(total if total < 2**63 else None)
    return out


def by_component(rows: DataFrame) -> DataFrame:
    """A row a component, numbered from 1, in place of the arrays."""
    kept = [c for c in rows.columns if c not in ("whitened", "explained")]
    each = rows.select(*kept, F.posexplode(F.arrays_zip("whitened", "explained")).alias("_at", "_pair"))
    return each.select(*kept, (F.col("_at") + 1).cast("int").alias("component"), F.col("_pair.whitened").alias("whitened"), F.col("_pair.explained").alias("explained"))
