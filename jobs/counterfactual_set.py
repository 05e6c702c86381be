"""Builds a counterfactual set: clean parents, and edits of them by family and dose, one condition a partition.

    spark-submit jobs/counterfactual_set.py --documents PATH --out PATH

Rows are written to OUT/rows, partitioned by set and condition; OUT/manifest gets a line for each condition with its counts, and is
written last. Readers take the rows of sets that the manifest lists, so a set that was cut off is never read. A set's id is a
digest of the settings and the parents: the same input and settings are made once, others become a set beside it.

Null texts are no parents; a null doc_id is the parent "none"; repeated rows are parents of one id and stay each.
"""

from __future__ import annotations

import json
import logging
import sys
from pathlib import Path

if __name__ == "__main__":
    sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions import text as T
from corvane.operators import conditions, perturb
from corvane.operators.quality import viable
from corvane.sources.shared import cut
from jobs import common

log = logging.getLogger("jobs.counterfactual_set")
CONFIG = "counterfactual_set.json"
ROWS = "parent_id string, text string, realized_rate double, set_id string, condition string"
MANIFEST = "condition string, family string, group string, kind string, role string, dose double, dose_kind string, status string, n long, set_id string"


def manifest(spark: SparkSession, out: str) -> DataFrame:
    """A row for each condition of each whole set."""
    return common.read_there(spark, f"{out}/manifest", MANIFEST, "json")


def read_set(spark: SparkSession, out: str, set_id: str) -> DataFrame:
    """The rows of a whole set with what the manifest says of their conditions; none of a set that the manifest doesn't list."""
    told = manifest(spark, out).where((F.col("set_id") == set_id) & (F.col("status") == "included"))
    return common.read_there(spark, f"{out}/rows", ROWS).where(F.col("set_id") == set_id).join(F.broadcast(told.drop("set_id", "status")), "condition")  # a row for each condition


def normalized(spark: SparkSession, documents: str) -> DataFrame:
    docs = spark.read.parquet(documents).select("doc_id", "text", "source")
    return docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("none")).alias("parent_id"), T.normalize(F.col("text")).alias("n"), "source")


def set_id_of(parents: DataFrame, settings: dict) -> str:
    """A digest of the settings, the number of parents and, in any order, their texts; equal rows are told by the number."""
    bits = F.conv(F.substring(F.sha2(F.concat("parent_id", F.lit(":"), "n"), 256), 1, 15), 16, 10).cast("long")
    n, x = parents.agg(F.count("*"), F.coalesce(F.bit_xor(bits), F.lit(0))).first()
    return parents.sparkSession.range(1).select(F.substring(F.sha2(F.lit(f"{json.dumps(settings, sort_keys=True)}:{n}:{x}"), 256), 1, 16)).first()[0]


def run(spark: SparkSession, documents: str, out: str, settings: dict | None = None) -> str:
    """Makes the set, unless the manifest lists it already, and gives its id."""
    settings = common.defaults(CONFIG) | (settings or {})
    texts = normalized(spark, documents)
    fits = viable(F.col("n"), settings["least_sentences"], settings["least_words"], settings["most_words"])
    parents = cut(texts.where(fits).select("parent_id", "n"))
    set_id = set_id_of(parents, settings)
    log.info("read %s: %d parents, set %s", documents, parents.count(), set_id)
    if not manifest(spark, out).where(F.col("set_id") == set_id).isEmpty():
        log.info("set %s is whole, nothing to do", set_id)
        return set_id
    pools = {f: perturb.sentence_pool(texts.where(F.col("source").isin(*settings[k])), "n") for f, k in (("generated_splice", "splice_generated"), ("human_splice", "splice_human"))}
    rows = conditions.condition_rows(parents, pools, settings).withColumn("set_id", F.lit(set_id))
    # each condition's tasks write its rows where they are made: dealing them anew would shuffle the whole set
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy("set_id", "condition").parquet(f"{out}/rows")
    counted = spark.read.schema(ROWS).parquet(f"{out}/rows").where(F.col("set_id") == set_id).groupBy("condition").agg(F.count("*").alias("n"))
    plan = spark.createDataFrame(conditions.planned(settings), "condition string, family string, group string, kind string, role string, dose double, dose_kind string")
    told = plan.join(counted, "condition", "left").withColumns({"n": F.coalesce("n", F.lit(0)), "status": F.when(F.col("n") > 0, "included").otherwise("skipped"), "set_id": F.lit(set_id)})
    told.coalesce(1).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("set_id").json(f"{out}/manifest")
    log.info("wrote %s: %s", out, {r.condition: r.n for r in manifest(spark, out).where(F.col("set_id") == set_id).orderBy("condition").collect()})
    return set_id


def main(argv: list[str] | None = None) -> None:
    args, settings = common.arguments(__doc__.split("\n")[0], CONFIG, {"documents": "a Parquet table of doc_id, text, source", "out": "the sets' folder"}, argv)
    spark = common.session("counterfactual_set")
    try:
        run(spark, args.documents, args.out, settings)
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
