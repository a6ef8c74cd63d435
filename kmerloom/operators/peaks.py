"""Peaks: runs of positions whose weight stands out.

Weights come as one array per sequence (``id``, ``seq``, ``w``), so all that
concerns a sequence is done in one task; positions count from 1.  What is
compared with a threshold is rounded to nine digits on both sides, so that
ties do not hang on the order of additions.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kmerloom.functions.stats import hazen_percentile
from kmerloom.operators.kmers import long_weights, position_arrays, position_masses
from kmerloom.sources.tables import stage

DIGITS = 9


def normalised(weights: DataFrame, top: float | None = None) -> tuple[DataFrame, float]:
    """Weights as shares of the largest absolute one (or of ``top``, that of a fitted model), and that one."""
    if top is None:
        most = F.greatest(F.array_max("w"), -F.array_min("w"))
        top = weights.agg(F.max(most)).first()[0] or 1.0
    return weights.withColumn("w", F.transform("w", lambda x: x / F.lit(top))), top


def moving_means(weights: DataFrame, used: DataFrame, width: int = 5) -> DataFrame:
    """``id``, ``m``: means of |w| over ``width`` of the ``used`` positions in a row, full windows only."""
    kind = weights.schema["id"].dataType.simpleString()
    marks = position_arrays(used, "used")
    if marks is None:
        ahead = Window.partitionBy("id").orderBy("pos").rowsBetween(0, width - 1)
        rows = long_weights(weights).join(used.where("used").select("pos"), "pos", "left_semi")
        means = rows.select("id", F.avg(F.abs("w")).over(ahead).alias("m"), F.count("*").over(ahead).alias("n"))
        return means.where(F.col("n") == width).select("id", "m")
    mark = marks[0]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = []
            for w in batch["w"]:
                x = np.abs(np.asarray(w, float))[mark[: len(w)]]
                n = max(len(x) - width + 1, 0)
                found.append(sum((x[j : j + n] for j in range(width)), np.zeros(n)) / width)
            if found:
                yield pd.DataFrame({"id": batch["id"].repeat([len(m) for m in found]).to_numpy(), "m": np.concatenate(found)})

    return weights.select("id", "w").mapInPandas(run, f"id {kind}, m double")


def threshold(weights: DataFrame, percentile: float = 0.99, width: int = 5, masses: DataFrame | None = None) -> float | None:
    """The peak threshold: a percentile of the moving means, over positions where any sequence has weight.

    Means are written once, as their percentile takes several passes.
    """
    used = position_masses(weights) if masses is None else masses
    return hazen_percentile(stage(moving_means(weights, used, width).select("m")), "m", percentile)


def edges(weights: DataFrame, masses: DataFrame | None = None) -> tuple[int, int]:
    """The first and last position at which any sequence has weight."""
    masses = position_masses(weights) if masses is None else masses
    first, last = masses.where("used").agg(F.min("pos"), F.max("pos")).first()
    return (first, last) if first else (1, 0)


def extract(weights: DataFrame, least: float, min_width: int = 1, extend: int = 2, edge: tuple[int, int] | None = None, signs: tuple[int, ...] = (1, -1)) -> DataFrame:
    """``id``, ``start``, ``end``, ``weight``, ``seq`` of maximal runs with sign * w above ``least``.

    Runs are widened by ``extend`` on both sides, but not over the first and
    last position that has any weight; their weight is the sum over the
    widened span, and they must be long and heavy enough for it.
    """
    first, last = edges(weights) if edge is None else edge
    least = round(least, DIGITS)

    def of_sequence(w: np.ndarray, seq: str, sign: int) -> tuple | None:
        hot = np.round(sign * w, DIGITS) > least
        if not hot.any():
            return None
        turn = np.flatnonzero(np.diff(hot, prepend=False, append=False))
        start = np.maximum(turn[::2] + 1 - extend, first)
        end = np.minimum(turn[1::2] + extend, last)
        n = np.minimum(end, len(w)) - start + 1
        at = np.concatenate([[0], np.cumsum(n)[:-1]])
        weight = np.add.reduceat(w[np.repeat(start - 1 - at, n) + np.arange(int(n.sum()))], at)
        kept = (n >= min_width + 2 * extend) & (np.round(sign * weight / n, DIGITS) >= round(0.5 * least, DIGITS))
        start, end, weight, n = start[kept], end[kept], weight[kept], n[kept]
        return start, end, weight, [seq[a - 1 : a - 1 + m] for a, m in zip(start.tolist(), n.tolist(), strict=True)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found, ids = [], []
            for i, seq, w in batch[["id", "seq", "w"]].itertuples(index=False):
                for sign in signs:
                    got = of_sequence(np.asarray(w, float), seq, sign)
                    if got is not None:
                        found.append(got)
                        ids.append(i)
            if found:
                sizes = [len(f[0]) for f in found]
                columns = {c: np.concatenate([f[j] for f in found]) for j, c in enumerate(("start", "end", "weight"))}
                yield pd.DataFrame({"id": pd.Series(ids).repeat(sizes).to_numpy(), **columns, "seq": [s for f in found for s in f[3]]})

    kind = weights.schema["id"].dataType.simpleString()
    return weights.select("id", "seq", "w").mapInPandas(run, f"id {kind}, start int, end int, weight double, seq string")


def runs(weights: DataFrame, sign: int, least: float, min_width: int = 1, extend: int = 2) -> DataFrame:
    """The peaks of one sign."""
    return extract(weights, least, min_width, extend, signs=(sign,))


def unique_peaks(peaks: DataFrame) -> DataFrame:
    """Distinct pairs of weight and sequence."""
    return peaks.select("weight", "seq").distinct()


def sequence_totals(peaks: DataFrame) -> DataFrame:
    """Per peak sequence the sum of its distinct weights."""
    return unique_peaks(peaks).groupBy("seq").agg(F.sum("weight").alias("weight"))


def motif_hits(assigned: DataFrame) -> DataFrame:
    """Per sequence and motif (``name:P`` or ``name:N`` by the peak's sign): ``score_sum`` of |weight|, least start and number of peaks."""
    name = F.concat("motif", F.when(F.col("weight") > 0, ":P").otherwise(":N"))
    return assigned.groupBy("id", name.alias("motif")).agg(
        F.sum(F.abs("weight")).alias("score_sum"), F.min("start").alias("min_pos"), F.count("*").alias("n")
    )


def hit_columns(motifs: list[tuple[str, int]], none: str = "NA") -> list[str]:
    """The columns of a hit matrix: motifs with their signs, then the unassigned peaks of both signs."""
    return [*[f"{name}:{'P' if sign > 0 else 'N'}" for name, sign in motifs], f"{none}:N", f"{none}:P"]


def hit_matrix(hits: DataFrame, columns: list[str], value: str = "n", ids: DataFrame | None = None) -> DataFrame:
    """Sequences by motifs, 0 where a motif has no hit; with ``ids`` sequences without any hit, too."""
    out = hits.groupBy("id").pivot("motif", columns).agg(F.first(value))
    if ids is not None:
        out = ids.select("id").join(out, "id", "left")
    return out.fillna(0)


def hit_summary(assigned: DataFrame) -> DataFrame:
    """Totals of positive and negative hits, mean and largest number of motifs of a sequence."""
    each = assigned.groupBy("id").agg(
        F.count_if(F.col("weight") > 0).alias("pos"), F.count_if(F.col("weight") < 0).alias("neg"), F.countDistinct("motif", F.signum("weight")).alias("m")
    )
    return each.agg(
        F.sum("pos").alias("n_positive"), F.sum("neg").alias("n_negative"), F.avg("m").alias("mean_motifs"), F.max("m").alias("max_motifs")
    )
