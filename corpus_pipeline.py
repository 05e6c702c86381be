"""A pipeline from documents to token ids, each stage by one of corvane.llm's operators.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read
again as the next one's docs. All but the last return the columns of documents.

Null and empty texts fail the quality rules and go there; null sources are one source; rows without a
doc_id are linked with nothing and stay; of rows with equal doc_id and text one stays; an empty table
stays empty through all stages. Columns beyond those of documents pass until the last stage.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm.bpe import encode_decode
from corvane.llm.common import cut, erase, small_or_shuffled, written
from corvane.llm.minhash import near_duplicates
from corvane.llm.mixing import mix
from corvane.llm.quality import quality_rules
from corvane.llm.secrets import redacted

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Rows of removed keys up to which they are broadcast.
BROADCAST_ROWS = 200_000


def guarded(stage: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """The stage, with columns beyond those of documents under names that nothing else has."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        more = {c: f"beyond {k}" for k, c in enumerate(docs.columns) if c not in COLUMNS}
        out = stage(spark, docs.withColumnsRenamed(more) if more else docs, sf_dir)
        return out.withColumnsRenamed({v: k for k, v in more.items()}) if more else out

    return run


@guarded
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the line rule reject go; the others lose their boilerplate lines, and n_chars is counted anew there."""
    kept = quality_rules(docs, clean=True).where("kept")
    size = F.when(F.col("n_removed_lines") > 0, F.length("clean_text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)
    return kept.withColumns({"text": F.col("clean_text"), "n_chars": size}).select(*docs.columns)


@guarded
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest doc_id of each group of near copies stays, and one row of those with equal doc_id and text.

    Rows are told apart by doc_id and text, so one that shares its doc_id with a copy goes or stays by its own text. Rows without a doc_id stay all.
    """
    row = F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", F.xxhash64(F.coalesce("text", F.lit("")), F.col("text").isNull()).alias("text")))
    keyed = docs.withColumn("__row", row)
    told = cut(near_duplicates(keyed.select("__row", "text"), key="__row").select("__row", "kept"))
    gone = small_or_shuffled(cut(told.where("not kept").select("__row").distinct()), BROADCAST_ROWS)
    out = keyed.join(gone, "__row", "left_anti")
    again = cut(told.where("kept and __row is not null").groupBy("__row").count().where("count > 1").select("__row"))
    if not again.isEmpty():
        again = small_or_shuffled(again, BROADCAST_ROWS)
        out = out.join(again, "__row", "left_anti").unionByName(out.join(again, "__row", "left_semi").dropDuplicates(["__row"]))
    return out.select(*docs.columns)


@guarded
def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced in the texts, and n_chars counted anew there."""
    return redacted(docs)


@guarded
def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target takes it, from 0 to 3 times."""
    key = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("\n"), F.coalesce("text", F.lit("")))
    keyed = docs.withColumn("__row", F.md5(key))  # 128 bits, so that no two documents share their number of copies
    takes = mix(keyed.select("__row", "text", "source"), key="__row").where("taken > 0")
    times = takes.groupBy("__row").agg(F.max((F.col("taken") / F.col("size")).cast("int")).alias("__times"))
    out = keyed.join(times, "__row").withColumn("__n", F.explode(F.sequence(F.lit(1), F.col("__times"))))
    return out.select(*docs.columns)


@guarded
def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens and ids of each document."""
    told = encode_decode(docs.select("doc_id", "lang", "source", "text"))
    return told.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("secrets", secrets), ("mixing", mixing), ("tokens", tokens)]

#: Neither components nor merges can be had in SQL; tests hold run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    last = None
    for k, (_, stage) in enumerate(STAGES):
        docs, path = written(stage(spark, docs, sf_dir), f"stage{k}")
        if last:
            erase(spark, last)
        last = path
    return docs
