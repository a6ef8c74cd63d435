"""Connected components of a link table by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kmerloom.llm.common import remove, shared_dir, written


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """``node`` and ``component`` (the smallest node reachable) for every node that has a link.

    Each round points all larger neighbours of a node at its smallest one and
    then all smaller neighbours of a node at their smallest, so trees become
    stars in a number of rounds that grows with the logarithm of the longest
    chain.  Rounds are written to the shared folder; only a count and a
    checksum reach the driver.  Null ends are ignored.
    """
    spark = links.sparkSession
    edges = links.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).distinct()
    base, turn, last = shared_dir(spark), 0, None
    edges = written(edges, f"{base}/{turn}")
    while True:
        state = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("hi", "lo"))).first()
        if state == last or not state[0]:
            return edges.select(F.col("hi").alias("node"), F.col("lo").alias("component")).union(
                edges.select(F.col("lo"), F.col("lo")).distinct()
            )
        last = state
        both = edges.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(edges.select("lo", "hi"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        large = written(large, f"{base}/{turn}-large")
        small = large.join(large.groupBy("hi").agg(F.min("lo").alias("m")), "hi")
        edges = (
            small.where("lo > m")
            .select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
            .union(small.select("hi", F.col("m").alias("lo")))
            .distinct()
        )
        edges = written(edges, f"{base}/{turn + 1}")
        remove(spark, f"{base}/{turn}")
        remove(spark, f"{base}/{turn}-large")
        turn += 1
