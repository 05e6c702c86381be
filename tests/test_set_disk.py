"""A set's rows are written where they are made: what is shuffled is far less than the rows."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from jobs import counterfactual_set


def shuffled(spark) -> int:
    gateway = spark.sparkContext._gateway
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), gateway.jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


def test_the_set_is_not_shuffled(spark, tmp_path):
    r = random.Random(3)
    word = lambda: "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(7))  # noqa: E731  letters that don't compress much
    text = lambda: " ".join(" ".join(word() for _ in range(12)).capitalize() + "." for _ in range(12))
    docs = [(k, text(), f"src{k % 40}") for k in range(400)]
    spark.createDataFrame(docs, "doc_id long, text string, source string").write.parquet(str(tmp_path / "docs"))
    before = shuffled(spark)
    made = counterfactual_set.run(spark, str(tmp_path / "docs"), str(tmp_path / "out"))
    sent = shuffled(spark) - before
    rows = counterfactual_set.read_set(spark, str(tmp_path / "out"), made)
    n, size = rows.agg(F.count("*"), F.sum(F.length("text"))).first()
    assert n > 10 * len(docs) and sent < 0.5 * size, (sent, size)
