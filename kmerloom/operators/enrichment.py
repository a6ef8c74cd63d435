"""Enrichment of scores among the sequences that hold a k-mer.

The background of every test is all sequences with a score, those with the
k-mer among them.  ``members`` has a row per sequence and k-mer (``id``,
``kmer``), ``scores`` one per sequence (``id``, ``s``; null scores take no part).
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kmerloom.functions.stats import hypergeometric_tails, ks_upper, running_sums, t_upper
from kmerloom.sources.tables import stage

MIN_ITEMS = 10
#: Distinct scores of a block.
BLOCK_VALUES = 1000


def scored(members: DataFrame, scores: DataFrame, min_ids: int = 2) -> DataFrame:
    """``kmer``, ``id``, ``s`` for k-mers in at least ``min_ids`` scored sequences."""
    known = scores.where(F.col("s").isNotNull() & ~F.isnan(F.col("s").cast("double"))).select("id", F.col("s").cast("double").alias("s"))
    rows = members.select("id", "kmer").distinct().join(known, "id")
    enough = rows.groupBy("kmer").count().where(F.col("count") >= min_ids).select("kmer")
    return rows.join(enough, "kmer")


def _known(scores: DataFrame) -> DataFrame:
    return scores.where(F.col("s").isNotNull() & ~F.isnan(F.col("s").cast("double"))).select("id", F.col("s").cast("double").alias("s"))


def t_statistics(members: DataFrame, scores: DataFrame, min_items: int = MIN_ITEMS) -> DataFrame:
    """``kmer``, ``n``, ``t``: one-sample t of scores standardised by the background; null below ``min_items``."""
    back = _known(scores).agg(F.avg("s").alias("m"), F.stddev_samp("s").alias("sd"))
    z = (F.col("s") - F.col("m")) / F.col("sd")
    rows = scored(members, scores).join(F.broadcast(back))  # one row
    per = rows.groupBy("kmer").agg(F.count("*").alias("n"), F.avg(z).alias("mz"), F.stddev_samp(z).alias("sz"))
    t = F.when(F.col("n") >= min_items, F.try_divide("mz", F.col("sz") / F.sqrt("n")))
    return per.select("kmer", "n", t.alias("t"))


def t_test(members: DataFrame, scores: DataFrame, tail: str = "two", min_items: int = MIN_ITEMS) -> DataFrame:
    """``t_statistics`` with ``p`` (two, right or left tail); 1 where there are too few items."""

    def p(t: pd.Series, n: pd.Series) -> pd.Series:
        up = [t_upper(a, b - 1) if a == a and a is not None else math.nan for a, b in zip(t.astype(float), n, strict=True)]
        up = np.array(up)
        out = {"right": up, "left": 1 - up, "two": 2 * np.minimum(up, 1 - up)}[tail]
        return pd.Series(np.where(np.isnan(out), 1.0, out))

    return t_statistics(members, scores, min_items).withColumn("p", F.pandas_udf(p, "double")("t", "n"))


def ks_statistics(members: DataFrame, scores: DataFrame, min_items: int = MIN_ITEMS) -> DataFrame:
    """``kmer``, ``n``, ``d_less`` and ``d_more``: largest excess of the k-mer's distribution function over the background's, and of the background's over it."""
    known = _known(scores)
    size = known.agg(F.count("*").alias("total"))
    # background rank of each distinct score, by counts of distinct values
    back = running_sums(known.groupBy("s").agg(F.count("*").alias("c")), "s", upto="c")
    own = scored(members, scores).groupBy("kmer", "s").agg(F.count("*").alias("k"))
    mine = Window.partitionBy("kmer").orderBy("s").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    every = Window.partitionBy("kmer")
    rows = own.join(back, "s").join(F.broadcast(size)).withColumns({"here": F.sum("k").over(mine), "n": F.sum("k").over(every)})
    f, g = F.col("here") / F.col("n"), F.col("upto") / F.col("total")
    f_before, g_before = (F.col("here") - F.col("k")) / F.col("n"), (F.col("upto") - F.col("c")) / F.col("total")
    # the excess of the k-mer is greatest at one of its scores, that of the background just before one
    per = rows.groupBy("kmer").agg(F.max("n").alias("n"), F.max(f - g).alias("up"), F.max(g_before - f_before).alias("down"))
    return per.where(F.col("n") >= min_items).select("kmer", "n", F.greatest("up", F.lit(0.0)).alias("d_less"), F.greatest("down", F.lit(0.0)).alias("d_more"))


def ks_test(members: DataFrame, scores: DataFrame, tail: str = "two", min_items: int = MIN_ITEMS) -> DataFrame:
    """``ks_statistics`` with the asymptotic ``p``: right (scores higher), left (lower) or two tails."""
    total = _known(scores).count()
    d = {"right": F.col("d_more"), "left": F.col("d_less"), "two": F.greatest("d_less", "d_more")}[tail]

    def p(x: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([ks_upper(a, b, total, tail == "two") for a, b in zip(x, n, strict=True)], dtype="float64")

    return ks_statistics(members, scores, min_items).withColumn("p", F.pandas_udf(p, "double")(d, F.col("n")))


def hypergeometric(members: DataFrame, scores: DataFrame, min_items: int = MIN_ITEMS) -> DataFrame:
    """``kmer``, ``value``, ``x``, ``p_right``, ``p_left`` for each distinct score.

    ``x`` of the ``n`` sequences with the k-mer have the value, which ``k`` of
    all have; tails include x.  1 where one side has too few items.  Values
    meet k-mers in blocks, so there may be any number of them.
    """
    known = _known(scores)
    values = known.groupBy(F.col("s").alias("value")).agg(F.count("*").alias("k"))
    size = known.agg(F.count("*").alias("total"), F.ceil(F.count_distinct("s") / BLOCK_VALUES).alias("parts"))
    part = F.pmod(F.xxhash64("value"), F.greatest("parts", F.lit(1))).alias("part")
    blocks = values.join(F.broadcast(size)).groupBy(part, "total").agg(F.collect_list(F.struct("value", "k")).alias("values"))  # one row
    rows = scored(members, scores)
    per = rows.groupBy("kmer").agg(F.count("*").alias("n"))
    hits = rows.groupBy("kmer", F.col("s").alias("value")).agg(F.count("*").alias("x"))
    every = per.join(blocks).select("kmer", "n", "total", F.inline("values"))
    each = every.join(hits, ["kmer", "value"], "left").fillna(0, ["x"])

    def tails(x: pd.Series, n: pd.Series, k: pd.Series, total: pd.Series) -> pd.DataFrame:
        right, left = hypergeometric_tails(x, n, k, total)
        few = np.minimum(n, k) < min_items
        return pd.DataFrame({"right": np.where(few, 1.0, right), "left": np.where(few, 1.0, left)})

    p = F.pandas_udf(tails, "right double, left double")("x", "n", "k", "total")
    return each.withColumn("p", p).select("kmer", "value", "n", "x", F.col("p.right").alias("p_right"), F.col("p.left").alias("p_left"))


def mutual_information(members: DataFrame, scores: DataFrame, bins: int = 100, min_items: int = MIN_ITEMS) -> DataFrame:
    """``kmer``, ``mi``: bits between holding the k-mer and the score in steps of its range; null with too few items."""
    known = _known(scores)
    edge = known.agg(F.min("s").alias("mn"), F.max("s").alias("mx"), F.count("*").alias("total"))
    level = F.floor(F.coalesce(F.try_divide(bins * (F.col("s") - F.col("mn")), F.col("mx")), F.lit(0.0)) + 0.5)
    back = known.join(F.broadcast(edge)).groupBy(level.alias("bin")).agg(F.count("*").alias("all_bin"))
    rows = scored(members, scores).join(F.broadcast(edge)).select("kmer", level.alias("bin"), "total")
    joint = rows.groupBy("kmer", "bin").agg(F.count("*").alias("c"), F.max("total").alias("total")).join(F.broadcast(back), "bin")
    per = joint.withColumn("n", F.sum("c").over(Window.partitionBy("kmer")))

    def term(c, n, b):
        return F.when(c > 0, c / F.col("total") * F.log2(c.cast("double") * F.col("total") / (n * b))).otherwise(0.0)

    there = term(F.col("c"), F.col("n"), F.col("all_bin"))
    absent = term(F.col("all_bin") - F.col("c"), F.col("total") - F.col("n"), F.col("all_bin"))
    # bins that no sequence with the k-mer is in hold absent ones only
    sums = per.groupBy("kmer").agg(F.sum(there + absent).alias("m"), F.sum("all_bin").alias("seen"), F.max("n").alias("n"), F.max("total").alias("total"))
    # an unseen bin of b sequences adds b/total * log2(total / (total - n)), and their b add up
    rest = (F.col("total") - F.col("seen")) / F.col("total") * F.log2(F.try_divide(F.col("total").cast("double"), F.col("total") - F.col("n")))
    mi = F.greatest(F.lit(0.0), F.col("m") + F.coalesce(rest, F.lit(0.0)))
    enough = (F.col("n") >= min_items) & (F.col("total") - F.col("n") >= min_items)
    return sums.select("kmer", "n", F.when(enough, mi).alias("mi"))


#: Distinct scores of a range that a draw is made from, and parts of a range's k-mers.
RANGE_SCORES, PARTS = 10_000, 16


def permutation_test(members: DataFrame, scores: DataFrame, tail: str = "right", rounds: int = 1000, min_items: int = MIN_ITEMS, seed: int = 0, range_scores: int = RANGE_SCORES) -> DataFrame:
    """``kmer``, ``n``, ``diff``, ``p``: difference of means against random subsets of the pooled scores.

    The pool is the k-mer's scores and the background (which holds them, too),
    kept as counts of distinct scores in ranges.  A draw is dealt to the
    ranges by their sizes first, and made inside each by a task of its own;
    the driver has the ranges' sizes alone.  p = (1 + 10 * hits) / (1 + 10 *
    rounds), and 1 below ``min_items``.
    """
    known = _known(scores)
    back = known.groupBy("s").agg(F.count("*").alias("c"))
    n_values, total, mean = known.agg(F.count_distinct("s"), F.count("*"), F.avg("s")).first()
    kind = "kmer string, n bigint, diff double, p double"
    if not total:
        return members.sparkSession.createDataFrame([], kind)
    dealt = stage(back.repartitionByRange(-(-n_values // range_scores), "s").withColumn("range", F.spark_partition_id()))
    sizes = {r["range"]: r["c"] for r in dealt.groupBy("range").agg(F.sum("c").alias("c")).collect()}  # a row a range
    names = sorted(sizes)
    whole = np.array([sizes[r] for r in names], np.int64)
    own = stage(scored(members, scores).groupBy("kmer", "s").agg(F.count("*").alias("k")).join(dealt.select("s", "range"), "s"))
    per = own.groupBy("kmer").agg(F.sum("k").alias("n"), (F.sum(F.col("s") * F.col("k")) / F.sum("k") - mean).alias("diff"), F.sum(F.col("s") * F.col("k")).alias("own"))
    in_range = own.groupBy("kmer", "range").agg(F.sum("k").alias("k"), F.collect_list(F.struct("s", "k")).alias("values"))

    def deal(part: pd.DataFrame) -> pd.DataFrame:
        kmer, n = part["kmer"].iloc[0], int(part["k"].sum())
        held = dict(zip(part["range"], part["k"], strict=True))
        pool = whole + np.array([held.get(r, 0) for r in names])
        rng = np.random.default_rng([seed, *kmer.encode()])
        drawn = rng.multivariate_hypergeometric(pool, n, rounds, method="marginals") if len(names) > 1 else np.full((rounds, 1), n)
        values = dict(zip(part["range"], part["values"], strict=True))
        used = np.flatnonzero(drawn.any(0))
        return pd.DataFrame({"kmer": kmer, "range": [names[i] for i in used], "drawn": [drawn[:, i] for i in used], "values": [values.get(names[i], []) for i in used]})

    enough = in_range.join(per.where(F.col("n") >= min_items).select("kmer"), "kmer")
    pairs = "array<struct<s:double,k:bigint>>"
    asked = enough.groupBy("kmer").applyInPandas(deal, f"kmer string, range int, drawn array<bigint>, values {pairs}")
    asked = asked.withColumn("part", F.pmod(F.xxhash64("kmer"), F.lit(PARTS)))
    content = dealt.withColumn("part", F.explode(F.array(*[F.lit(i).cast("long") for i in range(PARTS)])))

    def draw(wanted: pd.DataFrame, pool: pd.DataFrame) -> pd.DataFrame:
        if wanted.empty:
            return pd.DataFrame({"kmer": [], "sums": []}, dtype=object)
        pool = pool.sort_values("s")
        s, c = pool["s"].to_numpy(), pool["c"].to_numpy(np.int64)
        sums = []
        for r in wanted.itertuples():
            counts = c.copy()
            for v in r.values:
                counts[np.searchsorted(s, v["s"])] += v["k"]
            rng = np.random.default_rng([seed, int(r.range), *r.kmer.encode()])
            sums.append(np.array([rng.multivariate_hypergeometric(counts, int(m), method="marginals") @ s if m else 0.0 for m in r.drawn]))
        return pd.DataFrame({"kmer": wanted["kmer"], "sums": sums})

    made = asked.groupBy("range", "part").cogroup(content.groupBy("range", "part")).applyInPandas(draw, "kmer string, sums array<double>")
    drawn = made.select("kmer", F.posexplode("sums").alias("round", "x")).groupBy("kmer", "round").agg(F.sum("x").alias("x"))
    pooled = F.lit(float(mean) * total) + F.col("own")
    each = drawn.join(per, "kmer").withColumn("d", F.col("x") / F.col("n") - (pooled - F.col("x")) / F.lit(total))
    hit = {"right": F.col("d") >= F.col("diff"), "left": F.col("d") <= F.col("diff"), "two": F.abs("d") >= F.abs("diff")}[tail]
    hits = each.groupBy("kmer").agg(F.count_if(hit).alias("hits"))
    p = F.when(F.col("n") >= min_items, (1 + 10 * F.coalesce("hits", F.lit(0))) / F.lit(1.0 + 10 * rounds)).otherwise(1.0)
    return per.join(hits, "kmer", "left").select("kmer", "n", "diff", p.alias("p"))


def both_tails(members: DataFrame, scores: DataFrame, min_items: int = MIN_ITEMS) -> DataFrame:
    """``kmer``, ``p_right``, ``p_left`` of the t-test, for the choice of features."""
    right = t_test(members, scores, "right", min_items)
    enough = F.col("t").isNotNull()
    return right.select("kmer", F.col("p").alias("p_right"), F.when(enough, 1 - F.col("p")).otherwise(1.0).alias("p_left"))


#: Tests by name; all but the last two take a tail.
TESTS = ("t", "ks", "permutation", "hypergeometric", "information")


def test(members: DataFrame, scores: DataFrame, kind: str = "t", tail: str = "two", min_items: int = MIN_ITEMS) -> DataFrame:
    """``kmer`` and ``p`` of a test by name; ``hypergeometric`` has a row per distinct score (``value``), ``information`` bits (``mi``) in place of p.

    K-mers in fewer than two scored sequences have no row; with fewer than
    ``min_items`` p is 1.
    """
    if kind not in TESTS:
        raise ValueError(f"no test named {kind}")
    if tail not in ("two", "right", "left"):
        raise ValueError(f"no tail named {tail}")
    if kind == "t":
        return t_test(members, scores, tail, min_items).select("kmer", "p")
    if kind == "ks":
        few = scored(members, scores).select("kmer").distinct()
        found = ks_test(members, scores, tail, min_items).select("kmer", "p")
        return few.join(found, "kmer", "left").fillna(1.0, ["p"])
    if kind == "permutation":
        return permutation_test(members, scores, tail, min_items=min_items).select("kmer", "p")
    if kind == "information":
        return mutual_information(members, scores, min_items=min_items).select("kmer", "mi")
    p = {"right": F.col("p_right"), "left": F.col("p_left"), "two": F.least(F.lit(1.0), 2 * F.least("p_right", "p_left"))}[tail]
    return hypergeometric(members, scores, min_items).select("kmer", "value", p.alias("p"))
