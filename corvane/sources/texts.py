"""Texts out of files: patterns of paths, rows in file order, shards of a data set, parents, sources of a vocabulary."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from corvane.functions import text as T

from .tables import read_jsonl


def expand(spark: SparkSession, patterns: str | Sequence[str]) -> list[str]:
    """The files that match any of the patterns, each once, in order of path. None at all is an error. Any file system of the session will do."""
    jvm, found = spark.sparkContext._jvm, set()
    for pattern in [patterns] if isinstance(patterns, str) else patterns:
        at = jvm.org.apache.hadoop.fs.Path(pattern)
        found |= {s.getPath().toString() for s in at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(at) or ()}
    if not found:
        raise FileNotFoundError(f"nothing matches {patterns}")
    return sorted(found)


def ordinal() -> Column:
    """A column that orders rows of files as they stand there, files by path: for use right upon a read."""
    return F.struct(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))


def jsonl_texts(spark: SparkSession, path: str | list[str], field: str = "text", limit: int | None = None) -> DataFrame:
    """(text) of JSON lines in file order, the first `limit` of them if given. Nothing is checked but that lines are JSON."""
    rows = spark.read.schema(f"`{field}` string").option("mode", "FAILFAST").json(path)
    if limit is None:
        return rows.select(F.col(field).alias("text"))
    return rows.select(F.col(field).alias("text"), ordinal().alias("__o")).orderBy("__o").limit(limit).select("text")


def eval_texts(spark: SparkSession, patterns: str | Sequence[str], field: str = "text") -> DataFrame:
    """(text) of all files that match: strings that aren't blank. Malformed lines are skipped; no file is an error."""
    schema = StructType([StructField(field, StringType())])
    rows = read_jsonl(spark, expand(spark, patterns), schema, strict=False)
    return rows.select(F.col(field).alias("text")).where(T.normalize(F.col("text")) != "")


def stream_dataset(spark: SparkSession, patterns: str | Sequence[str], field: str) -> DataFrame:
    """(ordinal, text) of one column of Parquet shards, without null and empty texts. `ordinal` orders rows by shard and place in it; only the one column is read."""
    rows = spark.read.parquet(*expand(spark, patterns))
    order = F.struct(F.col("_metadata.file_path").alias("path"), F.col("_metadata.row_index").alias("row"))
    return rows.select(order.alias("ordinal"), F.col(field).alias("text")).where(F.col("text") != "")


def matches(where: Mapping[str, object]) -> Column:
    """Whether a row has the wanted value, or one of the wanted list, in each field; null is a value like any other."""
    out = F.lit(True)
    for name, wanted in where.items():
        some = F.lit(False)
        for value in wanted if isinstance(wanted, (list, tuple, set)) else [wanted]:
            some = some | F.col(name).eqNullSafe(F.lit(value))
        out = out & some
    return out


def parents(rows: DataFrame, order: str, text: str = "text", parent: str = "parent_id") -> DataFrame:
    """(parent_id, text) of rows; those without an id are named by their place: par-0, par-1 and so on, over all rows in order."""
    from corvane.operators.sampling import places

    return places(rows, order).select(F.coalesce(F.col(parent).cast("string"), F.concat(F.lit("par-"), F.col("place").cast("string"))).alias("parent_id"), F.col(text).alias("text"))


def vocabulary_texts(lines: DataFrame, line: str = "value", keep: tuple[str, ...] = ()) -> DataFrame:
    """(text), after the columns to keep, of lines that aren't blank: the field `text` of those that are JSON objects with a string there, the line itself of others."""
    at = F.btrim(F.col(line), F.lit(" \t\n\x0b\x0c\r"))
    return lines.where(at != "").select(*keep, F.coalesce(F.get_json_object(at, "$.text"), at).alias("text"))
