"""Statistics that the built-in functions do not give in the needed form."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kmerloom.sources.tables import stage


def hazen(values: Column, p: float, n: Column) -> Column:
    """Percentile with plotting positions (i - 0.5) / n as an aggregate; ``n`` counts the values (not null).

    The built-in exact percentile interpolates between (i - 1) / (n - 1); its
    argument must be a constant, so this form picks from the sorted array and
    suits groups of bounded size.  See ``hazen_percentile`` for whole columns.
    """
    x = F.array_sort(F.collect_list(values))
    h = F.greatest(F.lit(1.0), F.least(n.cast("double"), n * F.lit(p) + 0.5))
    lo = F.floor(h).cast("int")
    hi = F.least(lo + 1, n.cast("int"))
    a, b = F.try_element_at(x, lo), F.try_element_at(x, hi)
    return a + (h - lo) * (b - a)


def hazen_percentile(df: DataFrame, column: str, p: float) -> float | None:
    """Percentile of a whole column with plotting positions (i - 0.5) / n.

    An approximate percentile brackets the two order statistics, values
    below the bracket are only counted, and inside it equal values are
    counted together; nothing is sorted or collected whole.
    """
    x = df.select(F.col(column).cast("double").alias("x")).where(F.col("x").isNotNull() & ~F.isnan("x"))
    accuracy = 1000
    slack = 2.0 / accuracy
    n, bracket, low, high = x.agg(
        F.count("*"),
        F.percentile_approx("x", [max(0.0, p - slack), min(1.0, p + slack)], accuracy),
        F.min("x"),
        F.max("x"),
    ).first()
    if not n:
        return None
    h = min(max(n * p + 0.5, 1.0), float(n))
    first = int(math.floor(h))
    second = min(first + 1, n)
    lo, hi = bracket
    while True:
        below, inside = x.agg(F.count_if(F.col("x") < lo), F.count_if(F.col("x").between(lo, hi))).first()
        if below < first and second <= below + inside:
            break
        lo, hi = (low, hi) if below >= first else (lo, high)
    run = Window.orderBy("x").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counted = x.where(F.col("x").between(lo, hi)).groupBy("x").count().withColumn("upto", F.sum("count").over(run) + below)
    a, b = counted.agg(
        F.min(F.when(F.col("upto") >= first, F.col("x"))),
        F.min(F.when(F.col("upto") >= second, F.col("x"))),
    ).first()
    return a + (h - first) * (b - a)


#: Distinct values inside a bracket that are ranked one by one.
RANKED = 100_000


def grouped_percentiles(df: DataFrame, group: str, column: str, shares: DataFrame, ranked: int = RANKED) -> DataFrame:
    """``group`` and ``value``: exact percentiles with plotting positions (i - 0.5) / n, a share a group (``shares``: ``group``, ``p``).

    All groups are searched at once.  A bracket around a group's two order
    statistics is refined by quantiles of what lies inside it, whose counts
    are then made exactly, until few enough values are left to be ranked; a
    bracket that the quantiles missed stays as it was.  Groups without values
    have no row.
    """
    x = df.select(group, F.col(column).cast("double").alias("x")).where(F.col("x").isNotNull() & ~F.isnan("x"))
    state = x.groupBy(group).agg(F.count("*").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi")).join(shares.select(group, "p"), group)
    h = F.greatest(F.lit(1.0), F.least(F.col("n").cast("double"), F.col("n") * F.col("p") + 0.5))
    state = state.withColumn("h", h).withColumn("first", F.floor("h")).withColumn("second", F.least(F.col("first") + 1, F.col("n")))
    state = stage(state.withColumns({"below": F.lit(0).cast("long"), "inside": F.col("n"), "open": F.lit(True)}))
    steps = 256
    while True:
        wide = state.where(F.col("open") & (F.col("inside") > ranked) & (F.col("lo") < F.col("hi")))
        if not wide.limit(1).count():
            break
        rows = x.join(wide, group).where(F.col("x").between(F.col("lo"), F.col("hi")))
        grid = rows.groupBy(group).agg(F.percentile_approx("x", [i / steps for i in range(1, steps)], 4 * steps).alias("grid"))
        low = F.floor((F.col("first") - F.col("below")) / F.col("inside") * steps).cast("int") - 2
        high = F.ceil((F.col("second") - F.col("below")) / F.col("inside") * steps).cast("int") + 2
        new = wide.join(grid, group).select(
            group,
            F.when(low >= 1, F.try_element_at("grid", F.greatest(low, F.lit(1)))).otherwise(F.col("lo")).alias("new_lo"),
            F.when(high < steps, F.try_element_at("grid", F.least(high, F.lit(steps - 1)))).otherwise(F.col("hi")).alias("new_hi"),
        )
        counted = rows.select(group, "x").join(new, group).groupBy(group, "new_lo", "new_hi")
        counts = counted.agg(F.count_if(F.col("x") < F.col("new_lo")).alias("less"), F.count_if(F.col("x").between(F.col("new_lo"), F.col("new_hi"))).alias("between"))
        joined = state.join(counts, group, "left")
        held = (F.col("below") + F.col("less") < F.col("first")) & (F.col("second") <= F.col("below") + F.col("less") + F.col("between")) & (F.col("between") < F.col("inside"))
        held = F.coalesce(held, F.lit(False))
        narrowed = {
            "lo": F.when(held, F.col("new_lo")).otherwise(F.col("lo")),
            "hi": F.when(held, F.col("new_hi")).otherwise(F.col("hi")),
            "below": F.when(held, F.col("below") + F.col("less")).otherwise(F.col("below")),
            "inside": F.when(held, F.col("between")).otherwise(F.col("inside")),
            # many equal values may leave nothing to refine
            "open": F.when(F.col("less").isNull(), F.col("open")).otherwise(held),
        }
        state = stage(joined.select(group, "n", "p", "h", "first", "second", *[c.alias(name) for name, c in narrowed.items()]))
    within = x.join(state, group).where(F.col("x").between(F.col("lo"), F.col("hi"))).groupBy(group, "x", "h", "first", "second", "below").count()
    run = Window.partitionBy(group).orderBy("x").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    upto = within.withColumn("upto", F.sum("count").over(run) + F.col("below"))
    ends = upto.groupBy(group, "h", "first").agg(
        F.min(F.when(F.col("upto") >= F.col("first"), F.col("x"))).alias("a"), F.min(F.when(F.col("upto") >= F.col("second"), F.col("x"))).alias("b")
    )
    return ends.select(group, (F.col("a") + (F.col("h") - F.col("first")) * (F.col("b") - F.col("a"))).alias("value"))


def running_sums(df: DataFrame, by: str, **sums: str) -> DataFrame:
    """``df`` with running sums of columns in ascending order of ``by``, whose values are distinct.

    Rows are dealt into ranges and summed inside each; what the ranges before
    hold together is a row a range.  No task sees more than its range.
    """
    dealt = stage(df.repartitionByRange(F.col(by)).withColumn("_range", F.spark_partition_id()))
    per = dealt.groupBy("_range").agg(*[F.sum(c).alias(f"_{name}") for name, c in sums.items()])
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    per = per.select("_range", *[F.coalesce(F.sum(f"_{name}").over(before), F.lit(0)).alias(f"_{name}") for name in sums])
    run = Window.partitionBy("_range").orderBy(by).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inside = dealt.withColumns({name: F.sum(c).over(run) for name, c in sums.items()})
    joined = inside.join(F.broadcast(per), "_range")
    return joined.select(*df.columns, *[(F.col(name) + F.col(f"_{name}")).alias(name) for name in sums])


def chi2_upper_even(x: Column, df: int) -> Column:
    """Upper tail of the chi-squared distribution with an even number of degrees of freedom."""
    if df % 2:
        raise ValueError("an even number of degrees of freedom is needed")
    terms = F.lit(1.0)
    for k in range(1, df // 2):
        terms = terms + F.pow(x / 2, F.lit(float(k))) / math.factorial(k)
    return F.exp(-x / 2) * terms


def gamma_upper(a: float, x: np.ndarray) -> np.ndarray:
    """Regularised upper incomplete gamma function, by series or continued fraction."""
    x = np.asarray(x, float)
    out = np.ones_like(x)
    with np.errstate(all="ignore"):
        small = (x > 0) & (x < a + 1)
        t = np.where(small, x, 1.0)
        term = total = np.full_like(t, 1 / a)
        for i in range(1, 500):
            term = term * t / (a + i)
            total = total + term
        out = np.where(small, 1 - total * np.exp(-t + a * np.log(t) - math.lgamma(a)), out)
        large = x >= a + 1
        t = np.where(large, x, a + 1)
        b = t + 1 - a
        c, d = np.full_like(t, 1e300), 1 / b
        h = d
        for i in range(1, 500):
            an = -i * (i - a)
            b = b + 2
            d = 1 / np.where(np.abs(an * d + b) < 1e-300, 1e-300, an * d + b)
            c = b + an / c
            c = np.where(np.abs(c) < 1e-300, 1e-300, c)
            h = h * d * c
        out = np.where(large, np.exp(-t + a * np.log(t) - math.lgamma(a)) * h, out)
    return np.where(np.isnan(x), np.nan, np.clip(out, 0, 1))


def beta_regularised(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_regularised(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    f, c, d = 1.0, 1.0, 0.0
    for i in range(400):
        m = i // 2
        if i == 0:
            num = 1.0
        elif i % 2 == 0:
            num = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        else:
            num = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1 / max(1 + num * d, 1e-300) if 1 + num * d > 0 else 1 / (1 + num * d)
        c = 1 + num / c
        f *= c * d
        if abs(1 - c * d) < 1e-14:
            break
    return front * (f - 1)


def t_upper(t: float, df: float) -> float:
    """Upper tail of Student's t distribution."""
    if math.isnan(t) or df <= 0:
        return math.nan
    p = beta_regularised(df / 2, 0.5, df / (df + t * t)) / 2
    return p if t >= 0 else 1 - p


def _stirling_error(n: np.ndarray) -> np.ndarray:
    """log n! less Stirling's formula."""
    n = np.asarray(n, float)
    few = np.array([math.lgamma(i + 1) - (i + 0.5) * math.log(i) + i - 0.5 * math.log(2 * math.pi) if i else 0.0 for i in range(16)])
    m = np.maximum(n, 16.0)
    series = (1 / 12 - (1 / 360 - (1 / 1260 - (1 / 1680 - 1 / 1188 / m**2) / m**2) / m**2) / m**2) / m
    return np.where(n < 16, few[np.minimum(n, 15).astype(int)], series)


def _deviance(x: np.ndarray, mean: np.ndarray) -> np.ndarray:
    """x log(x / mean) + mean - x without loss of digits where both are near."""
    with np.errstate(divide="ignore", invalid="ignore"):
        plain = np.where(x > 0, x * np.log(x / mean), 0.0) + mean - x
        v = (x - mean) / (x + mean)
        total, term = (x - mean) * v, 2 * x * v
        for i in range(1, 25):
            term = term * v * v
            total = total + term / (2 * i + 1)
    return np.where(np.abs(x - mean) < 0.1 * (x + mean), total, plain)


def _log_binomial(x: np.ndarray, n: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Log of the binomial probability by deviances (saddle-point form)."""
    with np.errstate(divide="ignore", invalid="ignore"):
        inner = _stirling_error(n) - _stirling_error(x) - _stirling_error(n - x) - _deviance(x, n * p) - _deviance(n - x, n * (1 - p))
        inner = inner + 0.5 * np.log(n / (2 * math.pi * x * (n - x)))
        out = np.where(x == 0, n * np.log1p(-p), np.where(x == n, n * np.log(p), inner))
    return np.where(n == 0, 0.0, out)


def hypergeometric_tails(x: np.ndarray, n: np.ndarray, k: np.ndarray, total: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Chances of at least and of at most ``x`` of ``k`` marked items among ``n`` drawn from ``total``.

    The probability of x comes from deviances; the tail away from the mode
    is summed term by term until terms vanish, and the other is its rest.
    Memory depends on the number of cases alone.
    """
    x, n, k, total = (np.asarray(v, float) for v in (x, n, k, total))
    least, most = np.maximum(0, n + k - total), np.minimum(n, k)
    inside = np.clip(x, least, most)
    p = np.where(total > 0, n / np.maximum(total, 1), 0.0)
    sharp = (p > 0) & (p < 1)
    q = np.where(sharp, p, 0.5)
    here = np.exp(_log_binomial(inside, k, q) + _log_binomial(n - inside, total - k, q) - _log_binomial(n, total, q))
    here = np.where(sharp, here, 1.0)  # all or none are drawn: one outcome
    up = inside >= (n + 1) * (k + 1) / (total + 2)
    tail, term, at = here.copy(), here.copy(), inside.copy()
    active = np.arange(len(x))
    while len(active):
        a, nn, kk, tt = at[active], n[active], k[active], total[active]
        with np.errstate(divide="ignore", invalid="ignore"):
            ratio = np.where(up[active], (kk - a) * (nn - a) / ((a + 1) * (tt - kk - nn + a + 1)), a * (tt - kk - nn + a) / ((kk - a + 1) * (nn - a + 1)))
        ratio = np.where(np.isfinite(ratio), np.maximum(ratio, 0.0), 0.0)
        term[active] *= ratio
        tail[active] += term[active]
        at[active] += np.where(up[active], 1, -1)
        active = active[term[active] > 1e-17 * tail[active]]
    rest = 1 - tail + here
    right, left = np.where(up, tail, rest), np.where(up, rest, tail)
    right = np.where(x <= least, 1.0, np.where(x > most, 0.0, right))
    left = np.where(x >= most, 1.0, np.where(x < least, 0.0, left))
    return np.clip(right, 0, 1), np.clip(left, 0, 1)


def ks_upper(d: float, n1: int, n2: int, two_sided: bool = False) -> float:
    """Asymptotic p-value of the two-sample Kolmogorov-Smirnov statistic."""
    n = n1 * n2 / (n1 + n2)
    if not two_sided:
        return math.exp(-2 * n * d * d)
    lam = max((math.sqrt(n) + 0.12 + 0.11 / math.sqrt(n)) * d, 0)
    return float(min(max(2 * sum((-1) ** (j - 1) * math.exp(-2 * lam * lam * j * j) for j in range(1, 102)), 0), 1))


def chi2_upper(x: Column, df: int) -> Column:
    """Upper tail of the chi-squared distribution for any degrees of freedom (even: in the JVM)."""
    if df % 2 == 0:
        return chi2_upper_even(x, df)

    def tail(v: pd.Series) -> pd.Series:
        return pd.Series(gamma_upper(df / 2, v.to_numpy(float) / 2))

    return F.pandas_udf(tail, "double")(x)


def bh_threshold(df: DataFrame, p: str, alpha: float = 0.05) -> DataFrame:
    """Benjamini-Hochberg threshold of a column of p-values: one row, ``threshold`` (0: none is significant).

    Zero p-values count as the least positive one.  Equal p-values share a
    rank's fate, so ranks come from counts of distinct values.
    """
    x = df.select(F.col(p).cast("double").alias("p")).where("p is not null and not isnan(p)")
    m, least = x.agg(F.count("*"), F.min(F.when(F.col("p") > 0, F.col("p")))).first()
    if not m:
        return df.sparkSession.range(1).select(F.lit(0.0).alias("threshold"))
    # only p-values up to alpha can be below their line
    low = x.select(F.when(F.col("p") == 0, F.lit(least)).otherwise(F.col("p")).alias("p")).where(F.col("p") <= alpha)
    ranked = running_sums(low.groupBy("p").count(), "p", k="count")
    line = F.lit(alpha) * F.col("k") / F.lit(m)
    return ranked.agg(F.coalesce(F.max(F.when(F.col("p") <= line, line)), F.lit(0.0)).alias("threshold"))
