"""Grows a pool of source texts: new files are taken as a stream, and each text gets a decision.

    spark-submit jobs/source_pool.py --documents PATH --bans PATH --out PATH --checkpoint PATH

Texts that aren't viable, that evaluation texts hold (as a whole or in an n-gram), or that the pool has already are told apart and
not admitted. Decisions are written to OUT/decisions, partitioned by batch, status and domain; admitted ones have the normalized
text, its key and its part (pool, or val for a seeded share of keys). A run takes the files that the checkpoint doesn't know, in
batches of `files_per_batch`, and ends. Of equal texts the one of the earliest batch is admitted, within a batch that of the smallest doc_id.

A batch is a function of its files and of the batches before it, and replaces only its own partitions: one that was cut off is made
again with the same result. Null texts aren't viable; null and empty domains are the domain "none"; repeated rows are duplicates.
"""

from __future__ import annotations

import logging
import sys
from pathlib import Path

if __name__ == "__main__":
    sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions import text as T
from corvane.operators import dedup
from corvane.operators.quality import viable
from corvane.sources.shared import cut
from jobs import common

log = logging.getLogger("jobs.source_pool")
CONFIG = "source_pool.json"
DOCUMENTS = "doc_id long, text string, lang string, source string"
DECISIONS = "doc_id long, source string, key string, text string, part string, batch long, status string, domain string"


def decisions(spark: SparkSession, out: str) -> DataFrame:
    """Everything decided so far."""
    return common.read_there(spark, f"{out}/decisions", DECISIONS)


def known_keys(spark: SparkSession, out: str, batch: int) -> DataFrame:
    """Keys that batches before this one admitted; only partitions of admitted texts are read, and of them only the keys."""
    return decisions(spark, out).where((F.col("status") == "admit") & (F.col("batch") < batch)).select("key")


def decide(rows: DataFrame, bans: DataFrame, known: DataFrame, settings: dict) -> DataFrame:
    """rows (doc_id, text, lang, source) with key, text (normalized), part, status and domain; key and text of texts that aren't viable are null, text and part of those not admitted.

    Texts are normalized and tested once, and only viable ones go on. The keys of earlier batches meet only those of this one.
    """
    n = T.normalize(F.col("text"))
    domain = F.coalesce(F.nullif(F.col("lang"), F.lit("")), F.lit("none"))
    told = rows.select("doc_id", "source", domain.alias("domain"), n.alias("n"))
    told = told.withColumn("ok", F.coalesce(viable(F.col("n"), settings["least_sentences"], settings["least_words"], settings["most_words"]), F.lit(False)))
    told = cut(told.select("doc_id", "source", "domain", "ok", F.when(F.col("ok"), F.col("n")).alias("n"), F.when(F.col("ok"), T.folded_key(F.col("n"))).alias("key"), F.monotonically_increasing_id().alias("row")))
    good = told.where("ok")
    mine = dedup.small(good.select("key").distinct())
    seen = dedup.small(cut(known.join(mine, "key", "left_semi").distinct())).withColumn("seen", F.lit(True))
    exact = dedup.small(bans.select(T.folded_key(F.col("text")).alias("key")).distinct()).withColumn("exact", F.lit(True))
    gram = dedup.sharing_grams(good, bans.where("text is not null").select(F.col("text").alias("n")), "row", "n", settings["gram"]).withColumn("gram", F.lit(True))
    good = cut(good.join(seen, "key", "left").join(exact, "key", "left").join(gram, "row", "left"))
    fresh = F.col("seen").isNull() & F.col("exact").isNull() & F.col("gram").isNull()
    first = good.where(fresh).groupBy("key").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "n", "row")).alias("first")).select(F.col("first.row").alias("row"), F.lit(True).alias("first"))
    status = F.when(F.col("seen").isNotNull(), "duplicate").when(F.col("exact").isNotNull(), "eval_exact").when(F.col("gram").isNotNull(), "eval_ngram").when(F.col("first").isNotNull(), "admit").otherwise("duplicate")
    good = good.join(first, "row", "left").withColumn("status", status)
    draw = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{settings['seed']}:"), "key"), 256), 1, 8), 16, 10).cast("long") % 10_000
    part = F.when(draw < round(settings["val_share"] * 10_000), "val").otherwise("pool")
    admitted = F.col("status") == "admit"
    good = good.select("doc_id", "source", "key", F.when(admitted, F.col("n")).alias("text"), F.when(admitted, part).alias("part"), "status", "domain")
    bad = told.where("not ok").select("doc_id", "source", "key", F.col("n").alias("text"), F.lit(None).cast("string").alias("part"), F.lit("not_viable").alias("status"), "domain")
    return good.unionByName(bad)


def take(spark: SparkSession, rows: DataFrame, number: int, bans: DataFrame, out: str, settings: dict) -> None:
    """Decides about one batch and writes its partitions, which replace those of an earlier try."""
    told = decide(rows, bans, known_keys(spark, out, number), settings).withColumn("batch", F.lit(number))
    told = told.hint("rebalance", "status", "domain")  # files of even size, whatever the share of a status
    told.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch", "status", "domain").parquet(f"{out}/decisions")
    counts = {r["status"]: r["count"] for r in decisions(spark, out).where(F.col("batch") == number).groupBy("status").count().collect()}
    log.info("batch %d: read %d texts, wrote %s", number, sum(counts.values()), counts)


def run(spark: SparkSession, documents: str, bans: str, out: str, checkpoint: str, settings: dict | None = None) -> DataFrame:
    """Takes all files under `documents` that the checkpoint doesn't know, and gives all decisions so far."""
    settings = common.defaults(CONFIG) | (settings or {})
    ban = spark.read.parquet(bans).select("text")
    log.info("reading new files of %s, %d evaluation texts of %s", documents, ban.count(), bans)
    at = documents.rstrip("/")
    at = at if set(at) & set("*?[{") else f"{at[:-1]}[{at[-1]}]"  # as a pattern, the path may be a folder or a file
    stream = spark.readStream.schema(DOCUMENTS).option("maxFilesPerTrigger", settings["files_per_batch"]).parquet(at)
    query = stream.writeStream.foreachBatch(lambda rows, number: take(spark, rows, number, ban, out, settings)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    try:
        query.awaitTermination()
    finally:
        query.stop()
    told = decisions(spark, out)
    log.info("%s holds %s", out, {(r["status"], r["domain"]): r["count"] for r in told.groupBy("status", "domain").count().orderBy("status", "domain").collect()})
    return told


def main(argv: list[str] | None = None) -> None:
    args, settings = common.arguments(__doc__.split("\n")[0], CONFIG, {"documents": "Parquet files of doc_id, text, lang, source", "bans": "a Parquet table of evaluation texts", "out": "the pool's folder", "checkpoint": "the stream's folder"}, argv)
    spark = common.session("source_pool")
    try:
        run(spark, args.documents, args.bans, args.out, args.checkpoint, settings)
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
