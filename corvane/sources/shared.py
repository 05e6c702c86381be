"""The folder that the driver and all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: For rows of a megabyte or more: the size of pages and groups is looked at after each row, not after a hundred, and a group, which a reader holds as a whole, ends at 16 MB.
WIDE = {"parquet.page.size.row.check.min": "1", "parquet.page.size.row.check.max": "1", "parquet.block.size": str(2**24)}


def shared_dir(spark: SparkSession) -> str:
    """The one that the session names in spark.checkpoint.dir; where it names none, one is made if driver and executors are one process, else that is an error."""
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
    """The rows of df, written to the shared folder: what follows neither computes them again nor moves its filters into their expressions."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, name: str = "table", **options: str) -> DataFrame:
    """The rows of df, written to the shared folder as a table of columns: for rows that are read more than once, of which some readers need few columns. The table stays there.

    options: of the writer, as WIDE for rows of a megabyte or more.
    """
    path = scratch(df.sparkSession, name)
    df.write.options(compression="zstd", **options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
