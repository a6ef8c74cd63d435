"""Exponential decay: sample selection, noise, fits, predictions and tests on long count tables."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kmerloom.functions.stats import RANKED, chi2_upper, grouped_percentiles, hazen
from kmerloom.sources.tables import stage

LOG2E = math.log2(math.e)
#: Rates of a half-life of a day and of a quarter of an hour, per hour.
SLOWEST, FASTEST = -math.log(2) / 24, -math.log(2) / 0.25
LOWEST, HIGHEST = -20.0, 20.0


def shares(counts: DataFrame) -> DataFrame:
    """``tm``, ``share`` of all counts, ``near``: mean share of the time and its neighbours, absent ones as 0."""
    per = counts.groupBy("tm").agg(F.sum("cnt").alias("total"))
    # one row a time point: a single window partition is as small as the design
    order = Window.orderBy("tm")
    share = F.col("total") / F.sum("total").over(Window.partitionBy())
    x = per.select("tm", share.alias("share"))
    near = F.sum("share").over(order.rowsBetween(-1, 1)) / 3
    return x.select("tm", "share", near.alias("near"))


def usable_times(counts: DataFrame, first: float = 1.0, last: float = 10.0, min_share: float = 0.035) -> DataFrame:
    """Time points inside the range that hold enough of all counts and at least half of their neighbourhood."""
    ok = F.col("tm").between(first, last) & (F.col("share") >= min_share) & (F.col("share") >= 0.5 * F.col("near"))
    return shares(counts).where(ok).select("tm")


def select_reporters(counts: DataFrame, times: DataFrame, min_mean: float = 20.0) -> DataFrame:
    """Ids whose mean count over the given times is high enough; absent cells count as 0."""
    n = times.agg(F.count("*").alias("n"))
    sums = counts.join(F.broadcast(times), "tm").groupBy("id").agg(F.sum("cnt").alias("s"))
    return sums.join(F.broadcast(n)).where(F.col("s") / F.col("n") >= min_mean).select("id", (F.col("s") / F.col("n")).alias("mean_count"))


def detection_floor(counts: DataFrame, min_count: float = 5.0) -> DataFrame:
    """One row, ``floor``: lower quartile of the distinct log values at the least count above ``min_count``."""
    least = counts.where(F.col("cnt") > min_count).agg(F.min("cnt").alias("least"))
    values = counts.join(F.broadcast(least), F.col("cnt") == F.col("least")).select("log_x").distinct()
    return values.agg(hazen(F.col("log_x"), 0.25, F.count("log_x")).alias("floor"))


def column_noise(logs: DataFrame, kind: str = "std", factor: float = 0.32, keep: float = 1e6, ranked: int = RANKED) -> DataFrame:
    """``tm``, ``sd``: spread of a time's log values above a low percentile, moved to factor * [1, 1.5].

    The percentile is 100 - ceil(``keep`` / n) of a time's n values, 0 at
    least: up to some 10,000 values a time only the least is left out, beyond
    that about the 10,000 largest remain (a hundredth of ``keep``), and a
    hundredth of the values at least.
    It is exact at any size.
    """
    per = logs.groupBy("tm").agg(F.count("*").alias("n"), F.min("log_x").alias("lo"))
    percent = F.greatest(F.lit(0), 100 - F.ceil(F.lit(float(keep)) / F.col("n"))).cast("int")
    cut = per.select("tm", "lo")
    big = stage(per.where(percent > 0).select("tm", (percent / F.lit(100.0)).alias("p")))
    if big.limit(1).count():
        high = grouped_percentiles(logs.join(F.broadcast(big.select("tm")), "tm"), "tm", "log_x", big, ranked)  # a row a time
        cut = cut.join(high, "tm", "left").select("tm", F.coalesce("value", "lo").alias("lo"))
    spread = {"std": F.stddev_samp("log_x"), "var": F.var_samp("log_x"), "cv": F.stddev_samp("log_x") / F.median("log_x")}[kind]
    s = logs.join(F.broadcast(cut), "tm").where(F.col("log_x") > F.col("lo")).groupBy("tm").agg(spread.alias("s"))
    every = Window.partitionBy()
    scaled = factor * 0.5 * (2 + F.try_divide(F.col("s") - F.min("s").over(every), F.max("s").over(every) - F.min("s").over(every)))
    return s.select("tm", scaled.alias("sd"))


def bound_rate(a: Column) -> Column:
    return F.greatest(F.lit(FASTEST), F.least(F.lit(SLOWEST), a))


def bound_level(b: Column) -> Column:
    return F.greatest(F.lit(LOWEST), F.least(F.lit(HIGHEST), b))


def bound_onset(a: Column, t: Column, t0: Column) -> Column:
    """The onset, or the first time where the rate is the slowest allowed."""
    return F.when(a >= SLOWEST, t0).otherwise(t)


def weighted_line(points: DataFrame, **kept: Column) -> DataFrame:
    """``id``, ``a`` (natural rate, bounded), ``b``: weighted least squares of ``y`` on ``x``.

    Weights are clamped to [1e-10, 1] and squared; with fewer than two
    points that weigh more than that the rate is 0 and ``b`` the mean.
    ``kept`` are further aggregates of the points with a ``y``.
    """
    w = F.greatest(F.lit(1e-10), F.least(F.lit(1.0), F.abs("w")))
    p = points.where(F.col("y").isNotNull()).withColumns({"w": w, "v": w * w})
    s = p.groupBy("id").agg(
        F.sum("v").alias("sw"),
        F.sum(F.col("v") * F.col("x")).alias("sx"),
        F.sum(F.col("v") * F.col("y")).alias("sy"),
        F.sum(F.col("v") * F.col("x") * F.col("x")).alias("sxx"),
        F.sum(F.col("v") * F.col("x") * F.col("y")).alias("sxy"),
        F.avg("y").alias("my"),
        F.count_if(F.col("w") > 1e-10).alias("n"),
        *[c.alias(name) for name, c in kept.items()],
    )
    slope = F.coalesce(F.try_divide(F.col("sxy") - F.col("sy") / F.col("sw") * F.col("sx"), F.col("sxx") - F.col("sx") / F.col("sw") * F.col("sx")), F.lit(0.0))
    line = s.select("id", *kept, "my", "n", slope.alias("k"), (F.col("sy") / F.col("sw")).alias("ym"), (F.col("sx") / F.col("sw")).alias("xm"))
    a = F.when(F.col("n") < 2, F.lit(0.0)).otherwise(F.col("k"))
    b = F.when(F.col("n") < 2, F.col("my")).otherwise(F.col("ym") - F.col("k") * F.col("xm"))
    return line.select("id", bound_rate(a / LOG2E).alias("a"), bound_level(b).alias("b"), *kept)


def predict(tm: Column, a: Column, b: Column, t: Column, floor: Column | float | None = None) -> Column:
    """Log2 level at a time: flat to the onset, then falling at the rate; not below the floor."""
    y = a * LOG2E * F.greatest(tm - t, F.lit(0.0)) + b
    return y if floor is None else F.greatest(y, floor if isinstance(floor, Column) else F.lit(floor))


def predict_two_phase(tm: Column, a1: Column, a2: Column, b: Column, t: Column, floor: Column | None = None) -> Column:
    """Log2 level with one rate up to ``t`` and another behind it, without a jump."""
    late = a2 * LOG2E * tm + b + (a1 - a2) * LOG2E * t
    y = F.when(tm <= t, a1 * LOG2E * tm + b).otherwise(late)
    return y if floor is None else F.greatest(y, floor)


def _total(values: Column) -> Column:
    """The sum of an array of doubles."""
    return F.aggregate(values, F.lit(0.0), lambda acc, v: acc + v)


def r_squared(pairs: Column) -> Column:
    """Coefficient of determination on the linear scale of an array of structs ``y``, ``y_hat`` (both log2); 0 where it would be negative."""

    def linear(c: Column) -> Column:
        return F.pow(F.lit(2.0), c)

    error = _total(F.transform(pairs, lambda p: F.pow(linear(p["y"]) - linear(p["y_hat"]), F.lit(2.0))))
    # deviations from the first value, which are exactly 0 among equals
    off = F.transform(pairs, lambda p: linear(p["y"]) - linear(pairs[0]["y"]))
    spread = _total(F.transform(off, lambda d: d * d)) - F.pow(_total(off), F.lit(2.0)) / F.size(pairs)
    return F.when(spread > 0, F.greatest(F.lit(0.0), 1 - error / spread)).otherwise(0.0)


def fit(logs: DataFrame, noise: DataFrame, floor: float) -> DataFrame:
    """``id``, ``a``, ``b``, ``t``, ``r``: the decay model of every sequence.

    Values at or below the detection floor have no weight; the level is
    moved so that the mean residual is 0.
    """
    t0 = logs.agg(F.min("tm").alias("t0"))
    rows = logs.join(F.broadcast(noise), "tm").join(F.broadcast(t0))  # a row a time, one row
    w = F.when(F.col("log_x") <= floor, 0.0).otherwise(1 / F.col("sd"))
    x = F.greatest(F.col("tm") - F.col("t0"), F.lit(0.0))
    # a sequence's points stay with it as an array, one element a time
    weighed = rows.select("id", x.alias("x"), F.col("log_x").alias("y"), w.alias("w"), "tm", "t0")
    line = weighted_line(weighed, t0=F.min("t0"), pts=F.sort_array(F.collect_list(F.struct("tm", "y"))))
    first = line.withColumn("t", bound_onset(F.col("a"), F.col("t0"), F.col("t0")))

    def level(p: Column) -> Column:
        return predict(p["tm"], F.col("a"), F.col("b"), F.col("t"), floor)

    shift = _total(F.transform("pts", lambda p: level(p) - p["y"])) / F.size("pts")
    moved = first.withColumn("b", bound_level(F.col("b") - shift))
    both = moved.withColumn("pairs", F.transform("pts", lambda p: F.struct(p["y"].alias("y"), level(p).alias("y_hat"))))
    return both.select("id", "a", "b", "t", r_squared(F.col("pairs")).alias("r"))


def goodness_of_fit(logs: DataFrame, fits: DataFrame, noise: DataFrame, floor: float) -> DataFrame:
    """``id``, ``chi2``, ``p``: squared standardised residuals against as many degrees of freedom as there are times."""
    df = noise.count()
    y = predict(F.col("tm"), F.col("a"), F.col("b"), F.col("t"), floor)
    z = (F.col("log_x") - y) / F.col("sd")
    rows = logs.where(F.col("log_x") >= floor).join(F.broadcast(noise), "tm").join(fits, "id")
    chi2 = rows.groupBy("id").agg(F.sum(z * z).alias("chi2"))
    return chi2.select("id", "chi2", chi2_upper(F.col("chi2"), df).alias("p"))


def phase_rates(fits: DataFrame, low: float = -5.0, high: float = 1.5) -> DataFrame:
    """Log2 rates at 1 h and 10 h (``log_d1``, ``log_d10``) and log2 half-lives from two-phase fits (``a1``, ``a2``, ``t``)."""

    def rate(at: float) -> Column:
        a = F.when(F.col("t") > at, F.col("a1")).otherwise(F.col("a2"))
        return F.greatest(F.lit(low), F.least(F.lit(high), F.coalesce(F.log2(F.when(a < 0, -a)), F.lit(low))))

    t = F.floor(F.col("t") * 10 + 0.5) / 10
    rows = fits.withColumn("t", t).withColumn("log_d1", rate(1.0)).withColumn("log_d10", rate(10.0))
    return rows.select("id", "t", "log_d1", "log_d10", *[(math.log2(math.log(2)) - F.col(c)).alias(h) for c, h in (("log_d1", "log_h1"), ("log_d10", "log_h10"))])


def good_fit(b: Column, p: Column, r: Column, replicates: int = 0) -> Column:
    """High enough, and not rejected or well explained; replicates relax the bounds."""
    return (b > 1.0 - 0.1 * replicates) & ((p > 0.05) | (r > 0.7 - 0.05 * replicates))


def squared_error(pairs: DataFrame) -> DataFrame:
    """``id``, ``error``: sum of squared residuals over the noise."""
    return pairs.groupBy("id").agg(F.sum(((F.col("y") - F.col("y_hat")) / F.col("sd")) ** 2).alias("error"))


def clamp_rate(d: Column) -> Column:
    """Positive rates between half-lives of a day and of a quarter of an hour; null stays null."""
    return F.when(d.isNotNull(), F.greatest(F.lit(-SLOWEST), F.least(F.lit(-FASTEST), d)))


def half_life(d: Column) -> Column:
    return F.lit(math.log(2)) / d
