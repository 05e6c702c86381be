"""What the operators of this subpackage share: shared storage, guarded broadcasts, defined row order."""

from __future__ import annotations

import gc
import re
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The characters between words: space, \t, \n, \v, \f, \r.
WORD_SPACE = " \t\n\x0b\x0c\r"
WORD_RE = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share. Where the session names none, one is made if driver and executors are one process; else that is an error."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    jvm = spark.sparkContext._jsc.sc().getCheckpointDir()
    if jvm.isDefined():
        return jvm.get()
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    made = tempfile.mkdtemp(prefix="corvane-shared-")
    spark.sparkContext.setCheckpointDir(made)
    return made


def cut(df: DataFrame) -> DataFrame:
    """The rows of df, written to the shared folder, so that lost executors cost no recomputation of its lineage."""
    spark = df.sparkSession
    shared_dir(spark)
    return df.checkpoint(eager=True)


def release(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of steps that nothing refers to any more, and their checkpoints where
    spark.cleaner.referenceTracking.cleanCheckpoints is set.

    It does so when the driver collects garbage, which an iterative job with little on the driver seldom makes it do.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str = "table") -> tuple[DataFrame, str]:
    """df written as a compressed table in the shared folder and read again, with its path for erase()."""
    path = scratch(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def erase(spark: SparkSession, *paths: str) -> None:
    """Deletes tables that written() made and nothing reads any more."""
    jvm = spark.sparkContext._jvm
    for path in paths:
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def small_or_shuffled(df: DataFrame, rows: int, entries: Column | None = None) -> DataFrame:
    """df with a broadcast hint if it counts at most `rows` rows, or entries where a row holds several; beyond that unhinted, for a shuffled join. df must be cheap to count: cut it first."""
    some = df.limit(rows + 1).agg(F.count("*").alias("n"), F.sum(F.lit(1) if entries is None else entries).alias("m")).first()
    return F.broadcast(df) if max(some["n"], some["m"] or 0) <= rows else df


def spread(df: DataFrame) -> DataFrame:
    """df dealt to all cores where its files make fewer tasks than there are cores; larger tables stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def words_of(text):
    """The words of a text column as an array, without regular expressions."""
    flat = F.translate(F.coalesce(text, F.lit("")), WORD_SPACE[1:], " " * 5)
    return F.array_remove(F.split(flat, " ", -1), "")


def batches(rows: Iterator[pa.RecordBatch], max_bytes: int = 4 << 20, max_rows: int = 4096) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of bounded bytes, so that very long texts don't pile up in one."""
    for b in rows:
        start, n = 0, b.num_rows
        while start < n:
            size = max(1, min(n - start, max_rows))
            while size > 1 and b.slice(start, size).get_total_buffer_size() and _bytes(b.slice(start, size)) > max_bytes:
                size = max(1, size // 2)
            yield b.slice(start, size)
            start += size


def _bytes(b: pa.RecordBatch) -> int:
    return b.nbytes
