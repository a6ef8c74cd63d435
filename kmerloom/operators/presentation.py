"""The tables behind the plots: binned densities, top weights, confusion counts, logos."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def histogram(df: DataFrame, column: str, bins: int) -> DataFrame:
    """``bin`` (from 0), ``n``: equal steps between the least and greatest value."""
    edge = df.agg(F.min(column).alias("lo"), F.max(column).alias("hi"))
    at = F.least(F.floor(F.coalesce(F.try_divide(F.col(column) - F.col("lo"), F.col("hi") - F.col("lo")), F.lit(0.0)) * bins), F.lit(bins - 1))
    return df.where(F.col(column).isNotNull()).join(F.broadcast(edge)).groupBy(at.cast("int").alias("bin")).agg(F.count("*").alias("n"))


def histogram_2d(df: DataFrame, x: str, y: str, bins: int = 200) -> DataFrame:
    """``bx``, ``by``, ``n`` of points in a grid of ``bins`` by ``bins``."""
    edge = df.agg(F.min(x).alias("x0"), F.max(x).alias("x1"), F.min(y).alias("y0"), F.max(y).alias("y1"))

    def at(c: str, lo: str, hi: str):
        share = F.coalesce(F.try_divide(F.col(c) - F.col(lo), F.col(hi) - F.col(lo)), F.lit(0.0))
        return F.least(F.floor(share * bins), F.lit(bins - 1)).cast("int")

    rows = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).join(F.broadcast(edge))  # one row
    return rows.groupBy(at(x, "x0", "x1").alias("bx"), at(y, "y0", "y1").alias("by")).agg(F.count("*").alias("n"))


def smoothed(grid: DataFrame, bins: int = 200, strength: float = 20.0) -> pd.DataFrame:
    """A grid's density under a penalty on second differences in both directions (a bounded table, on the driver)."""
    z = np.zeros((bins, bins))
    for r in grid.collect():
        z[r["bx"], r["by"]] = r["n"]
    z /= max(z.sum(), 1)
    d1, d2 = np.diff(np.eye(bins), axis=0), np.diff(np.eye(bins), n=2, axis=0)
    lam = bins / strength
    solve = np.linalg.inv(np.eye(bins) + lam**2 * d2.T @ d2 + 2 * lam * d1.T @ d1)
    z = solve @ z @ solve.T
    i, j = np.meshgrid(np.arange(bins), np.arange(bins), indexing="ij")
    return pd.DataFrame({"bx": i.ravel(), "by": j.ravel(), "density": z.ravel()})


def top_weights(model: DataFrame, n: int) -> DataFrame:
    """The ``n`` largest weights by size, with those that tie with the last."""
    bound = model.select(F.abs("weight").alias("v")).orderBy(F.desc("v")).limit(n).agg(F.min("v").alias("bound"))
    return model.join(F.broadcast(bound), F.abs("weight") >= F.col("bound")).drop("bound")


def confusion(pairs: DataFrame, threshold: float, level: float = 1.0) -> DataFrame:
    """``actual``, ``called``, ``n``."""
    return pairs.groupBy((F.col("d") > level).alias("actual"), (F.col("pred") >= threshold).alias("called")).agg(F.count("*").alias("n"))


def fit_quality(pairs: DataFrame) -> DataFrame:
    """Correlation and number of pairs of target and prediction."""
    return pairs.agg(F.corr("d", "pred").alias("r"), F.count("*").alias("n"))


def weight_tracks(weights: DataFrame, scores: DataFrame) -> DataFrame:
    """Positional weights with their sequence's rate and half-life in minutes."""
    minutes = (60 * math.log(2) / F.col("score")).alias("half_life_minutes")
    return weights.join(scores.select("id", "score", minutes), "id")


def logo(matrix: DataFrame, n: int = 1000, seed: int = 0) -> DataFrame:
    """``n`` sequences drawn from a matrix (``pos``, ``A``, ``C``, ``G``, ``T``), seeded."""
    u = F.rand(seed)
    draws = matrix.select("pos", "A", "C", "G", F.explode(F.sequence(F.lit(1), F.lit(n))).alias("i")).withColumn("u", u)
    letter = F.when(F.col("u") < F.col("A"), "A").when(F.col("u") < F.col("A") + F.col("C"), "C").when(F.col("u") < F.col("A") + F.col("C") + F.col("G"), "G").otherwise("T")
    rows = draws.select("i", F.struct("pos", letter.alias("c")).alias("s")).groupBy("i").agg(F.array_sort(F.collect_list("s")).alias("s"))
    return rows.select("i", F.array_join(F.transform("s", lambda s: s["c"]), "").alias("seq"))


def rate_histogram(fits: DataFrame, column: str, bins: int = 50) -> DataFrame:
    """``histogram`` with each bin's share."""
    h = histogram(fits, column, bins)
    return h.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy()))
