"""The ban and the quality filter over a stream of texts, for corpora that arrive in files over time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.functions import text as X
from corvane.operators.quality import viable


def read_texts(spark: SparkSession, folder: str, schema: T.StructType) -> DataFrame:
    """Parquet files as they arrive."""
    return spark.readStream.schema(schema).parquet(folder)


def admitted(texts: DataFrame, ban: DataFrame, least_sentences: int, least_words: int, most_words: int, text: str = "text", time: str | None = None, within: str = "1 day") -> DataFrame:
    """Viable texts of a stream (or a table) that the static ban doesn't hold, with their key. With an event time, a text counts once within the watermark; its state is bounded by it."""
    keyed = texts.withColumn("key", X.folded_key(F.col(text))).where(viable(X.normalize(F.col(text)), least_sentences, least_words, most_words))
    banned = ban.select(X.folded_key(F.col(text)).alias("key")).distinct()
    kept = keyed.join(banned.withColumn("__ban", F.lit(True)), "key", "left").where("__ban is null").drop("__ban")
    return kept.withWatermark(time, within).dropDuplicatesWithinWatermark(["key"]) if time else kept


def windowed_counts(rows: DataFrame, time: str, by: str, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(window, by, n) of admitted rows, closed once the watermark has passed."""
    return rows.withWatermark(time, late).groupBy(F.window(time, width), by).agg(F.count("*").alias("n"))
