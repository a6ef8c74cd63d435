"""A corpus from raw documents to training windows, in five stages.

Each stage takes all that the one before it kept, and its decisions take
effect: rejected documents, near copies and repeated passages are gone from
what the next stage sees.  Stages are written as Parquet and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kmerloom.llm import packing, quality_model, quality_rules, simhash, suffix_dedup
from kmerloom.llm.common import shared_dir, written


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts; it learns from the labels of these documents.

    Null texts are scored as empty ones; labels without a key or a quality
    teach nothing; repeated rows are decided alike; without labels all stay.
    """
    return quality_model.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the standard rules; null, empty and short texts fail them, repeated rows are decided alike."""
    return quality_rules.keep_passing(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one of the smallest key.

    Null and empty texts are one group; null keys come behind all others; of
    repeated rows one stays.
    """
    return simhash.keep_one(docs)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents less the byte strings that also start earlier.

    Null texts stay null and empty ones empty; a null key comes first;
    repeated rows are one document and keep what it keeps.
    """
    return suffix_dedup.without_repeats(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token ids in windows, a checksum in place of the ids; null and empty texts have the end id alone."""
    return packing.pack(docs).withColumn("ids_crc32", F.crc32("ids")).drop("ids")


STAGES = [
    ("quality classifier", classify),
    ("quality rules", rules),
    ("SimHash near-dedup", near_duplicates),
    ("suffix-array dedup", repeats),
    ("packing", pack),
]

#: Models and suffix sorting have no SQL form; each stage's operator is tested against brute force or held-out rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; the rows of the last one."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    base = shared_dir(spark)
    for i, (_, stage) in enumerate(STAGES[:-1]):
        docs = written(stage(spark, docs, sf_dir), f"{base}/{i}")
    return STAGES[-1][1](spark, docs, sf_dir)
