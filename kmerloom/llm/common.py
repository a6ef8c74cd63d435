"""What the operators of this subpackage share: shared storage and splits."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Code points that separate words: space, tab, line feed, vertical tab, form feed, carriage return.
SPACES = " \t\n\x0b\x0c\r"


#: Bytes of a batch that goes to a Python worker, where the session has Spark's default; texts and blobs are long.
ARROW_BYTES = 4 << 20
_ARROW_KEY, _ARROW_DEFAULT = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b"


def small_batches(spark: SparkSession) -> None:
    """Bound the batches of this session's Python tasks by bytes, unless it was told another bound."""
    if spark.conf.get(_ARROW_KEY, _ARROW_DEFAULT) == _ARROW_DEFAULT:
        spark.conf.set(_ARROW_KEY, str(ARROW_BYTES))


def release() -> None:
    """Give freed memory of this Python worker back, which lives on for later tasks (where the C library can)."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass


def shared_dir(spark: SparkSession) -> str:
    """A new folder under ``spark.checkpoint.dir``, which driver and executors share.

    Where the setting is absent a local session (as in tests) takes a temporary folder; on a cluster that is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="kmerloom-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/kmerloom-{uuid.uuid4().hex}"


def written(df: DataFrame, path: str | None = None, whole_files: bool = False) -> DataFrame:
    """``df`` written to the shared folder as Parquet and read back: lineage ends there.

    With ``whole_files`` a partition is one row group, so that no later task reads a part of it.
    """
    spark = df.sparkSession
    path = path or shared_dir(spark)
    out = df.write.mode("overwrite").option("compression", "zstd")
    if whole_files:
        out = out.option("parquet.block.size", str(2**30))
    out.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def written_in_buckets(df: DataFrame, buckets: int, path: str, column: str = "bucket") -> DataFrame:
    """``df`` written as a table in buckets of a column and read back, so that joins on the column need no shuffle.

    The catalog forgets the table's name at once; its files stay at ``path``.
    """
    spark = df.sparkSession
    name = f"kmerloom_{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").option("path", path).bucketBy(buckets, column).saveAsTable(name)
    out = spark.table(name)
    spark.sql(f"DROP TABLE {name}")
    return out


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared storage."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def key_mod(key: Column, n: int) -> Column:
    """crc32 of the key's text modulo ``n``; a null key counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), F.lit(n))


def sampled(share: float | Column, *columns: str, seed: int = 0) -> Column:
    """Whether a row is in a sample of this share, by a hash of its columns; no share is too small to be told apart."""
    share = F.lit(float(share)) if isinstance(share, (int, float)) else share
    place = F.xxhash64(*columns, F.lit(seed)).bitwiseAND(F.lit(2**63 - 1)).cast("double") / F.lit(2.0**63)
    return (place < share) | (share >= 1)
