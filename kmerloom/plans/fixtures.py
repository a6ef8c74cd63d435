"""Domain tables derived from the driver's tables, with integer and dyadic arithmetic only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kmerloom.operators import kmers
from kmerloom.operators.motifs import Motif

B0 = 0.25
#: Four small matrices; probabilities are dyadic.
MOTIFS = (
    Motif("m1", 1, ((0.5, 0.25, 0.125, 0.125), (0.125, 0.5, 0.25, 0.125), (0.125, 0.125, 0.25, 0.5), (0.75, 0.125, 0.0, 0.125))),
    Motif("m2", 1, ((0.0, 0.125, 0.125, 0.75), (0.625, 0.125, 0.125, 0.125), (0.25, 0.25, 0.25, 0.25), (0.125, 0.75, 0.125, 0.0), (0.5, 0.0, 0.0, 0.5))),
    Motif("m3", -1, ((0.125, 0.125, 0.625, 0.125), (0.25, 0.125, 0.125, 0.5), (0.0, 0.875, 0.125, 0.0), (0.5, 0.125, 0.25, 0.125))),
    Motif("m4", -1, ((0.875, 0.0, 0.125, 0.0), (0.125, 0.125, 0.125, 0.625), (0.0, 0.25, 0.0, 0.75), (0.25, 0.5, 0.125, 0.125), (0.125, 0.25, 0.5, 0.125), (0.75, 0.0, 0.125, 0.125))),
)
#: Two series of samples by their times.
SERIES = {"early": (1, 2, 3, 4), "whole": tuple(range(7))}
BACKGROUND = (0.25, 0.25, 0.25, 0.25)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), kmers.dna(F.col("text")).alias("seq"))


def model(spark: SparkSession) -> DataFrame:
    """Weights of all 3-mers from their rank in the lexicon."""
    rank = sum((F.instr(F.lit("ACGT"), F.substring("kmer", i + 1, 1)) - 1) * 4 ** (2 - i) for i in range(3))
    weight = (F.pmod(rank * 37, F.lit(101)) - 50) / F.lit(1024.0)
    return kmers.lexicon(spark, 3).select("kmer", F.lit(3).alias("k"), weight.alias("weight"))


def counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``id``, ``tm``, ``cnt``: quantities by part and year, falling with time."""
    year = (F.year(F.to_timestamp_ntz(F.col("l_shipdate").cast("string"))) - 1995).alias("tm")
    sums = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("id"), year).agg(F.sum("l_quantity").alias("q"))
    return sums.select("id", F.col("tm").cast("double").alias("tm"), F.floor(F.col("q") / (1 + F.col("tm") * (1 + F.col("id") % 4))).cast("double").alias("cnt"))


def reporter_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``id``, ``tm``, ``cnt``: documents as reporters, whose counts fall faster the more ``TAA`` and slower the more ``GCA`` they hold."""

    def held(word: str) -> Column:
        return (F.length("seq") - F.length(F.replace("seq", F.lit(word), F.lit("")))) / len(word)

    rate = F.greatest(F.lit(0.05), F.least(F.lit(1.0), 0.4 + 0.004 * held("TAA") - 0.008 * held("GCA")))
    each = sequences(spark, sf_dir).select("id", rate.alias("rate"), F.explode(F.array(*[F.lit(float(t)) for t in range(8)])).alias("tm"))
    # a part in twenty more or less, by the id and the time
    noise = 1 + (F.pmod(F.col("id") * 7 + F.col("tm").cast("long") * 13, F.lit(11)) - 5) / 100.0
    return each.select("id", "tm", F.floor(4000 * F.exp(-F.col("rate") * F.col("tm")) * noise).cast("double").alias("cnt"))


def spikes(counted: DataFrame, scale: float = 500.0) -> DataFrame:
    """``rank`` 0 to 4, ``tm``, ``q``: halving shares of each time's total."""
    per = counted.groupBy("tm").agg(F.sum("cnt").alias("total"))
    each = per.select("tm", "total", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("rank"))
    return each.select("rank", "tm", F.floor(F.col("total") / (scale * F.pow(F.lit(2.0), "rank"))).cast("double").alias("q"))


def logs(counted: DataFrame) -> DataFrame:
    """Counts above 0 on the log2 scale."""
    return counted.where(F.col("cnt") > 0).select("id", "tm", "cnt", F.log2("cnt").alias("log_x"))


def quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), F.col("quality").cast("double").alias("s"))


def lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("n_chars").cast("double").alias("s"))
