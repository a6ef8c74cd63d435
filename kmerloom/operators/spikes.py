"""Spike-in standards: cleaning, calibration and count normalisation."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kmerloom.functions.stats import hazen_percentile
from kmerloom.operators.logistic import fit_logistic, logistic

#: Amounts of the spikes in order, the empty one last, and their weights in the calibration (fixed values).
AMOUNTS = (50.0, 25.0, 12.5, 6.25, 3.125, 0.0)
WEIGHTS = (4.0, 4.0, 2.0, 2.0, 1.0, 10.0)


def drop_outliers(spikes: DataFrame) -> DataFrame:
    """``rank``, ``tm``, ``q``: 0 where a spike is a quarter or less of the one before and not more than the one after (five spikes)."""
    order = Window.partitionBy("tm").orderBy("rank")
    before, after = F.lag("q").over(order), F.lead("q").over(order)
    n = F.count("*").over(Window.partitionBy("tm"))
    odd = (n == 5) & (F.try_divide(F.col("q"), before) <= 0.25) & (F.try_divide(after, F.col("q")) >= 1)
    return spikes.withColumn("q", F.when(F.coalesce(odd, F.lit(False)), 0.0).otherwise(F.col("q").cast("double")))


def usable_columns(counts: DataFrame, spikes: DataFrame, min_reads: float = 50.0, min_spikes: float = 50.0, last: float = 24.0) -> DataFrame:
    """``tm``, ``usable``: enough spike and reporter reads, and a time between 0 and a day."""
    q = spikes.groupBy("tm").agg(F.sum("q").alias("sq"))
    c = counts.groupBy("tm").agg(F.sum("cnt").alias("sc"))
    ok = (F.col("sq") > min_spikes) & (F.col("tm") > 0) & (F.col("tm") < last) & (F.col("sc") > min_reads)
    return q.join(c, "tm", "left").select("tm", F.coalesce(ok, F.lit(False)).alias("usable"))


def redistribute(spikes: DataFrame, columns: DataFrame) -> DataFrame:
    """Spikes of unusable columns: their total in halving parts."""
    total = F.sum("q").over(Window.partitionBy("tm"))
    part = F.pow(F.lit(0.5), F.col("rank"))
    whole = F.sum(part).over(Window.partitionBy("tm"))
    q = F.when(F.col("usable"), F.col("q")).otherwise(total * part / whole)
    return spikes.join(F.broadcast(columns), "tm").withColumn("q", q).select("rank", "tm", "q", "usable")


def scale_fraction(counts: DataFrame, spikes: DataFrame, fraction: float = 0.001, percentile: float = 0.8) -> DataFrame:
    """Spikes scaled so that they make ``fraction`` of the reads of the most counted reporters in the usable columns."""
    used = spikes.where("usable").select("tm").distinct()
    inside = counts.join(F.broadcast(used), "tm")
    sums = inside.groupBy("id").agg(F.sum("cnt").alias("s"))
    cut = hazen_percentile(sums, "s", percentile) or 0.0
    w = sums.where(F.col("s") >= cut).agg(F.sum("s").alias("w"))
    v = spikes.where("usable").agg(F.sum("q").alias("v"))
    scale = F.try_divide("w", "v") * (fraction / (1 - fraction))
    one = w.join(v).select(F.coalesce(scale, F.lit(1.0)).alias("scale"))  # one row; without a usable column spikes stay
    return spikes.join(F.broadcast(one)).select("rank", "tm", F.floor(F.col("q") * F.col("scale") + 0.5).cast("double").alias("q"), "usable")


def smooth_totals(counts: DataFrame, spikes: DataFrame, seed: int = 0) -> DataFrame:
    """Spikes moved to a smooth course of their share over time: logistic from five usable columns on, else a line.

    The first usable column counts four times.  A row a time point reaches the driver.
    """
    q = spikes.groupBy("tm").agg(F.sum("q").alias("sq"), F.max("usable").alias("usable"))
    c = counts.groupBy("tm").agg(F.sum("cnt").alias("sc"))
    rows = q.join(c, "tm").orderBy("tm").toPandas()
    x = 1e5 * rows["sq"] / (rows["sq"] + rows["sc"])
    use = rows["usable"] & (x > 0)
    tm, y = rows.loc[use, "tm"].to_numpy(float), np.log2(x[use].to_numpy(float))
    if not len(tm):
        return spikes.select("rank", "tm", "q")
    tm4, y4 = np.concatenate([[tm[0]] * 3, tm]), np.concatenate([[y[0]] * 3, y])
    every = rows["tm"].to_numpy(float)
    if len(tm) >= 5:
        z = logistic(fit_logistic(tm4, y4, [0, 0, 0, 0], [0.6, np.inf, np.inf, 24], seed=seed)[0], every)
    else:
        z = np.polyval(np.polyfit(tm4, y4, 1 if len(tm) > 1 else 0), every)
    ratio = np.where(x > 0, 2.0**z / np.maximum(x, 1e-300), 0.0)
    table = spikes.sparkSession.createDataFrame(pd.DataFrame({"tm": every, "ratio": ratio}))
    return spikes.join(F.broadcast(table), "tm").select("rank", "tm", F.floor(F.col("q") * F.col("ratio") + 0.5).alias("q"))


def cap(counts: DataFrame, spikes: DataFrame) -> DataFrame:
    """Spikes of a column are at most its reporters' reads together."""
    q = F.sum("q").over(Window.partitionBy("tm"))
    c = counts.groupBy("tm").agg(F.sum("cnt").alias("sc"))
    share = F.greatest(F.lit(1.0), F.coalesce(F.try_divide(F.col("sq"), F.col("sc")), F.lit(1.0)))
    return spikes.withColumn("sq", q).join(F.broadcast(c), "tm", "left").select("rank", "tm", F.floor(F.col("q") / share + 0.5).alias("q"))


def mean_calibration(spikes: DataFrame) -> DataFrame:
    """``tm``, ``slope``, ``intercept``: a column's mean spike over the mean of all."""
    whole = spikes.agg(F.avg("q").alias("whole"))
    slope = F.try_divide(F.col("m"), F.col("whole"))
    per = spikes.groupBy("tm").agg(F.avg("q").alias("m")).join(F.broadcast(whole))  # one row
    return per.select("tm", F.when(slope != 0, slope).otherwise(1.0).alias("slope"), F.lit(0.0).alias("intercept"))


def identity_regression(x: np.ndarray, y: np.ndarray, weights: np.ndarray, trials: float | None, rounds: int = 50) -> tuple[float, float]:
    """Intercept and slope of counts ``y`` on ``x`` with an identity link, by reweighted least squares.

    Binomial with ``trials`` (per trial), Poisson without.
    """
    design = np.stack([np.ones_like(x), x], 1)
    share = y / trials if trials else y
    mu = (y + 0.5) / (trials + 1) if trials else y + 0.5
    beta = np.zeros(2)
    for _ in range(rounds):
        mu = np.clip(mu, 1e-12, 1 - 1e-12) if trials else np.maximum(mu, 1e-9)
        variance = mu * (1 - mu) / trials if trials else mu
        w = weights / variance
        new = np.linalg.lstsq(design * np.sqrt(w)[:, None], share * np.sqrt(w), rcond=None)[0]
        done = np.allclose(new, beta, rtol=1e-10, atol=0)
        beta = new
        if done:
            break
        mu = design @ beta
    return float(beta[0]), float(beta[1])


def regression_calibration(counts: DataFrame, spikes: DataFrame, poisson: bool = False) -> DataFrame:
    """``tm``, ``slope``, ``intercept`` of spike reads on spike amounts, a small fit per column."""
    total = counts.groupBy("tm").agg(F.sum("cnt").alias("sc"))

    def one(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("rank")
        q = np.concatenate([f["q"].fillna(0).to_numpy(float)[:5], [0.0]])
        x, w = np.array(AMOUNTS[: len(q) - 1] + AMOUNTS[-1:]), np.array(WEIGHTS[: len(q) - 1] + WEIGHTS[-1:])
        keep = ~((q == 0) & (x > 0))
        trials = None if poisson else float(q.sum() + f["sc"].iloc[0])
        if not q[keep].any():  # no spike was read
            return pd.DataFrame({"tm": f["tm"].iloc[:1], "slope": [1.0], "intercept": [0.0]})
        b, a = identity_regression(x[keep], q[keep], w[keep], trials)
        scale = trials or 1.0
        return pd.DataFrame({"tm": f["tm"].iloc[:1], "slope": [a * scale or 1.0], "intercept": [b * scale]})

    return spikes.join(total, "tm").groupBy("tm").applyInPandas(one, "tm double, slope double, intercept double")


def normalise(counts: DataFrame, calibration: DataFrame) -> DataFrame:
    """``id``, ``tm``, ``cnt``, ``log_x``: calibrated counts on the log2 scale.

    A count of 0 becomes half the least calibrated value of the positive
    counts of its column; what is not positive then, half the least positive.
    """
    x = (F.col("cnt") - F.col("intercept")) / F.col("slope")
    rows = counts.join(F.broadcast(calibration), "tm").select("id", "tm", "cnt", x.alias("x"))
    per = rows.groupBy("tm").agg(F.min(F.when(F.col("cnt") > 0, F.col("x"))).alias("m0"), F.min(F.when(F.col("x") > 0, F.col("x"))).alias("m1"))
    filled = F.when(F.col("cnt") == 0, F.col("m0") / 2).otherwise(F.col("x"))
    level: Column = F.when(filled <= 0, F.col("m1") / 2).otherwise(filled)
    return rows.join(F.broadcast(per), "tm").select("id", "tm", "cnt", F.log2(level).alias("log_x"))
