"""K-mer counts kept on disk: one folder per k, bucketed by sequence.

A store is two tables below a folder, ``counts`` (``id``, ``kmer``, ``cnt``,
``k``) and ``ids`` (``id``, ``k``: every sequence that was counted, also those
without a k-mer), both split by ``k`` and bucketed by ``id``.  Reading some k
opens only their folders, and joins or groups by ``id`` need no exchange.  A
third folder, ``layout``, is written last and tells that the store is whole.

The tables are entered in the session's catalog under names made from the
folder, so a store opens in any session that sees the folder.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kmerloom.sources.tables import parse_kmer_list

@dataclass(frozen=True)
class KmerStore:
    """An open store."""

    counts: DataFrame
    ids: DataFrame

    def load(self, ks: Sequence[int], ids: DataFrame | None = None) -> DataFrame:
        """``id``, ``kmer``, ``cnt``, ``k`` of some k, for all sequences or those of ``ids``."""
        out = self.counts.where(F.col("k").isin(list(ks)))
        return out if ids is None else out.join(ids.select("id"), "id", "left_semi")

    def rejected(self, ks: Sequence[int], ids: DataFrame) -> dict[int, int]:
        """The k that do not hold each sequence of ``ids`` exactly once, with the number of sequences at fault.

        A sequence asked for twice is at fault in every k.  Nothing is at
        fault where no sequence is asked for.
        """
        asked = ids.groupBy("id").agg(F.count("*").alias("asked"))
        held = self.ids.where(F.col("k").isin(list(ks))).groupBy("id").agg(F.collect_list("k").alias("held"))
        both = asked.join(held, "id", "left")
        held_once = {k: F.size("held") - F.size(F.array_remove("held", k)) == 1 for k in ks}
        bad = [F.count_if((F.col("asked") > 1) | ~F.coalesce(once, F.lit(False))).alias(f"k{k}") for k, once in held_once.items()]
        row = both.agg(*bad).first()
        return {k: row[f"k{k}"] for k in ks if row[f"k{k}"]}

    def stack(self, ks: Sequence[int], ids: DataFrame) -> tuple[DataFrame, dict[int, int]]:
        """Counts of all k that pass for the sequences of ``ids``, and the k that are ``rejected``; underscores in words as dots."""
        bad = self.rejected(ks, ids)
        return _dotted(self.load([k for k in ks if k not in bad], ids)), bad

    def filled(self, ks: Sequence[int], ids: DataFrame) -> DataFrame:
        """Counts of ``ids``; a sequence without any has one row with a null word and k and the count 0."""
        asked = ids.select("id").distinct()
        return asked.join(_dotted(self.load(ks)), "id", "left").fillna(0, ["cnt"])


def _dotted(counts: DataFrame) -> DataFrame:
    return counts.select("id", F.translate("kmer", "_", ".").alias("kmer"), "cnt", "k")


def _name(path: str, part: str) -> str:
    return f"kmer_store_{hashlib.sha256(path.encode()).hexdigest()[:16]}_{part}"


def save(counts: DataFrame, ids: DataFrame, ks: Sequence[int], path: str, buckets: int | None = None) -> KmerStore:
    """Write ``counts`` (``id``, ``kmer``, ``cnt``) of ``ids``, both bucketed alike, in place of what the folder held.

    ``ks`` are the k that were counted, each for all of ``ids``; the k of a
    row is its word's length.  There are as many buckets as the session has
    shuffle partitions, unless told otherwise.
    """
    spark = counts.sparkSession
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = counts.select("id", "kmer", "cnt", F.length("kmer").alias("k"))
    known = ids.select("id", F.explode(F.array(*[F.lit(int(k)) for k in ks])).alias("k"))
    for part, table in (("counts", found), ("ids", known)):
        spark.sql(f"DROP TABLE IF EXISTS {_name(path, part)}")
        # a task holds one bucket, so a folder gets one file a bucket
        dealt = table.repartition(buckets, "id")
        written = dealt.write.format("parquet").partitionBy("k").bucketBy(buckets, "id").sortBy("id").mode("overwrite")
        written.option("path", f"{path}/{part}").saveAsTable(_name(path, part))
    kinds = [(part, table.drop("k").schema.simpleString(), buckets) for part, table in (("counts", found), ("ids", known))]
    spark.createDataFrame(kinds, "part string, kind string, buckets int").coalesce(1).write.mode("overwrite").parquet(f"{path}/layout")
    return KmerStore(spark.table(_name(path, "counts")), spark.table(_name(path, "ids")))


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a whole store lies in the folder."""
    mark = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/layout/_SUCCESS")
    return mark.getFileSystem(spark._jsc.hadoopConfiguration()).exists(mark)


def open_store(spark: SparkSession, path: str) -> KmerStore:
    """Enter the tables of a folder in the catalog, unless they are there, and read them."""
    for part, kind, buckets in spark.read.parquet(f"{path}/layout").collect():  # two rows
        name = _name(path, part)
        if not spark.catalog.tableExists(name):
            columns = ", ".join(c.replace(":", " ", 1) for c in kind.removeprefix("struct<").removesuffix(">").split(","))
            layout = f"PARTITIONED BY (k) CLUSTERED BY (id) SORTED BY (id) INTO {buckets} BUCKETS"
            spark.sql(f"CREATE TABLE {name} ({columns}, k int) USING parquet {layout} LOCATION '{path}/{part}'")
            spark.catalog.recoverPartitions(name)
    return KmerStore(spark.table(_name(path, "counts")), spark.table(_name(path, "ids")))


def load(spark: SparkSession, path: str, text: str | None = None, ids: DataFrame | None = None, buckets: int | None = None) -> KmerStore | None:
    """The store of a folder; where there is none it is made from a text file of k-mers for ``ids`` (text ids), without which there is nothing to load.

    Lines of other sequences are left out.  The words' lengths are the k
    that were counted.
    """
    if exists(spark, path):
        return open_store(spark, path)
    if text is None or ids is None:
        return None
    listed = parse_kmer_list(spark.read.text(text))
    ks = sorted(r["k"] for r in listed.select(F.length("kmer").alias("k")).distinct().collect())  # a handful
    wanted = ids.select(F.col("id").cast("string").alias("id")).distinct()
    return save(listed.join(wanted, "id", "left_semi"), wanted, ks, path, buckets) if ks else None
