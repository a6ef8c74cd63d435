"""Readers and writers of the experiment's files, and staged results."""

from __future__ import annotations

import hashlib
import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SPIKE_PREFIX = "SPIKE_"


def _upper(c: Column) -> Column:
    return F.translate(c, "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")


def read_sequences(spark: SparkSession, path: str, ids: DataFrame | None = None, min_length: int = 0) -> DataFrame:
    """``id`` and upper-case ``seq`` of a text file with two columns between white space.

    With ``ids`` (column ``id``) exactly those come out, an empty sequence
    where the file lacks one; ``min_length`` leaves shorter ones out.
    """
    part = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).where(F.trim("value") != "")
    seqs = rows.select(part[0].alias("id"), _upper(F.coalesce(F.get(part, F.lit(1)), F.lit(""))).alias("seq"))
    if ids is not None:
        seqs = ids.select("id").join(seqs, "id", "left").select("id", F.coalesce("seq", F.lit("")).alias("seq"))
    return long_enough(seqs, min_length) if min_length else seqs


def long_enough(seqs: DataFrame, min_length: int = 50) -> DataFrame:
    """Sequences of at least ``min_length`` letters (at least one)."""
    return seqs.where(F.length("seq") >= max(1, min_length))


def read_counts(spark: SparkSession, path: str, times: list[float]) -> DataFrame:
    """``id``, ``tm``, ``cnt``, ``is_spike`` of a tab-separated matrix with one column per time."""
    wide = spark.read.csv(path, sep="\t", header=True)
    if len(wide.columns) != len(times) + 1:
        raise ValueError(f"{len(times)} times for {len(wide.columns) - 1} columns")
    return split_spikes(unpivot(wide.toDF("id", *[f"c{i}" for i in range(len(times))]), times))


def unpivot(wide: DataFrame, times: list[float]) -> DataFrame:
    """Long ``id``, ``tm``, ``cnt`` of a matrix whose first column is the id."""
    key, *columns = wide.columns
    cells = F.array(*[F.struct(F.lit(float(t)).alias("tm"), F.col(c).cast("double").alias("cnt")) for t, c in zip(times, columns, strict=True)])
    return wide.select(F.col(key).alias("id"), F.inline(cells))


def split_spikes(counts: DataFrame) -> DataFrame:
    """``is_spike`` by the id's prefix."""
    return counts.withColumn("is_spike", F.col("id").cast("string").startswith(SPIKE_PREFIX))


def parse_kmer_list(lines: DataFrame) -> DataFrame:
    """``kmer``, ``id``, ``cnt`` of lines ``kmer count id,id weight,weight``; what repeats is summed."""
    part = F.split(F.trim("value"), r"\s+")
    rows = lines.where(F.size(part) >= 4).select(part[0].alias("kmer"), F.split(part[2], ",").alias("ids"), F.split(part[3], ",").alias("ws"))
    each = rows.select("kmer", F.explode(F.arrays_zip("ids", "ws")).alias("z"))
    each = each.where("z.ids is not null and z.ids <> ''")
    return each.groupBy("kmer", F.col("z.ids").alias("id")).agg(F.sum(F.col("z.ws").cast("double")).alias("cnt"))


def _number(c: Column) -> Column:
    """At most five significant digits; whole numbers plain."""
    digits = F.greatest(F.lit(0), 4 - F.floor(F.log10(F.nullif(F.abs(c), F.lit(0.0)))).cast("int"))
    shown = F.format_string("%.5g", c)
    return F.when(c == F.floor(c), F.format_string("%.0f", c)).when(digits >= 0, shown).otherwise(F.format_string("%.0f", c))


def as_text(df: DataFrame) -> DataFrame:
    """All columns as the text a tab-separated file holds: short numbers, 0 and 1 for booleans, empty for null."""
    out = []
    for name, kind in df.dtypes:
        c = F.col(name)
        if kind in ("double", "float"):
            c = _number(c.cast("double"))
        elif kind == "boolean":
            c = c.cast("int").cast("string")
        out.append(F.coalesce(c.cast("string"), F.lit("")).alias(name))
    return df.select(*out)


def write_tsv(df: DataFrame, path: str, header: bool = False) -> None:
    """Write a folder of tab-separated files."""
    as_text(df).write.mode("overwrite").option("sep", "\t").option("header", header).option("quote", "").option("emptyValue", "").csv(path)


def save_bundle(df: DataFrame, path: str) -> None:
    """A fitted table as Parquet, and ``id, -ln2/a, a, b, t, r`` as text beside it."""
    df.write.mode("overwrite").parquet(f"{path}/table")
    half_life = (F.lit(-1.0) * F.log(F.lit(2.0)) / F.col("a")).alias("half_life")
    write_tsv(df.select("id", half_life, "a", "b", "t", "r"), f"{path}/text")


def work_dir(spark: SparkSession) -> str:
    """A new folder that driver and executors share."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="kmerloom-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/stage-{uuid.uuid4().hex}"


def stage(df: DataFrame) -> DataFrame:
    """Write and read back, which ends the lineage of iterative work."""
    path = work_dir(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stored_path(folder: str, name: str, parameters: dict) -> str:
    """Where a result with these parameters is kept."""
    key = hashlib.sha256(repr(sorted(parameters.items())).encode()).hexdigest()[:16]
    return f"{folder}/{name}-{key}"


def memoised(spark: SparkSession, folder: str, name: str, parameters: dict, make) -> DataFrame:
    """A stage's stored result, made first if no run with the same parameters left one."""
    path = stored_path(folder, name, parameters)
    target = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
