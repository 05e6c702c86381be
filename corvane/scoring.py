"""Scores a corpus of generated texts against a human one, from files:

    python -m corvane.scoring --generated PATH --reference PATH [--pool PATH] [--vocabulary PATH] [--draws N] [--out PATH]

Files are JSON lines, JSON or Parquet, by their suffix; a folder of JSON lines may end in .jsonl, too. Blank texts are dropped, the others
become histograms over the most frequent tokens of the vocabulary texts (those of the reference unless given), and the squared MMD
between the two sides is set against draws from the pool (the reference unless given).
"""

from __future__ import annotations

import argparse
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from corvane.operators import mmd, vectors
from corvane.sources.shared import stored
from corvane.sources.tables import filled_texts, load_records


def words_of(spark: SparkSession, path: str, key: str = "text", mode: str = "whitespace", again: bool = True) -> DataFrame:
    """(id, words) of a file's texts that aren't blank; an error where there is none. What is read again is written, so ids hold and no text is cut into words twice."""
    rows = load_records(spark, path, StructType([StructField(key, StringType())])).select(F.col(key).alias("text"))
    words = vectors.worded(filled_texts(rows, "text", mode).withColumn("id", F.monotonically_increasing_id()), ["id"], "text")  # white space between words is none of theirs
    return stored(words, "words") if again else words


def score_files(spark: SparkSession, generated: str, reference: str, pool: str | None = None, vocabulary: str | None = None, size: int = 4096, key: str = "text", mode: str = "whitespace", bandwidth: float | None = None, draws: int = 0, seed: int = 17) -> DataFrame:
    """One row, as mmd.score() gives it, of the texts in two files.

    The bandwidth is the median distance within the pool, or the reference without one, unless given.
    """
    again = bool(draws) or not bandwidth  # whether vectors are read more than once
    sides = {"generated": words_of(spark, generated, key, mode, again), "reference": words_of(spark, reference, key, mode, again or not vocabulary)}
    if pool:
        sides["pool"] = words_of(spark, pool, key, mode)
    words = words_of(spark, vocabulary, key, mode, False) if vocabulary else sides["reference"]
    tokens = stored(vectors.vocabulary(vectors.word_counts(words), size), "vocabulary")
    told = {n: vectors.shares(t, ["id"], tokens, size) for n, t in sides.items()}
    told = {n: stored(f, "features") for n, f in told.items()} if again else told
    return mmd.score(told["generated"], told["reference"], "id", "vec", told.get("pool"), bandwidth, draws, seed)


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description=__doc__.split("\n")[0])
    for name in ("generated", "reference"):
        parser.add_argument(f"--{name}", required=True)
    for name in ("pool", "vocabulary", "out"):
        parser.add_argument(f"--{name}")
    parser.add_argument("--text-key", default="text")
    parser.add_argument("--normalization", choices=("whitespace", "none"), default="whitespace")
    parser.add_argument("--size", type=int, default=4096, help="tokens of the vocabulary")
    parser.add_argument("--bandwidth", type=float)
    parser.add_argument("--draws", type=int, default=0, help="draws that the score is calibrated on")
    parser.add_argument("--seed", type=int, default=17)
    a = parser.parse_args(argv)
    spark = SparkSession.builder.appName("score").getOrCreate()
    try:
        out = score_files(spark, a.generated, a.reference, a.pool, a.vocabulary, a.size, a.text_key, a.normalization, a.bandwidth, a.draws, a.seed)
        if a.out:
            out = stored(out, "score")
            out.coalesce(1).write.mode("overwrite").json(a.out)
        print(json.dumps(out.first().asDict()))
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
