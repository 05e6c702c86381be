"""Edits of a long text take time by its length, not by its length times the edited places."""

from __future__ import annotations

import time

from corvane.functions import text as T
from corvane.operators import perturb
from pyspark.sql import functions as F


def test_a_text_of_many_words(spark):
    text = " ".join(["walker", "the", "house"] * 20_000)
    short = spark.createDataFrame([(1, "walker the house")], "id long, n string")
    long = spark.createDataFrame([(1, text)], "id long, n string")
    edit = lambda df, f: f(df, "id", "n", 0.25, 3).select("n_edited", "edited", T.apply_spans(F.col("n"), F.slice("spans", 1, 50)).alias("some"), F.size("spans").alias("n")).first()
    for f, n in ((perturb.inflection_error, 10_000), (perturb.article_delete, 5_000)):
        edit(short, f)
        start = time.monotonic()
        r = edit(long, f)
        assert r.n_edited == r.n == n and time.monotonic() - start < 15
        assert len(r.edited) == len(text) + (n if f is perturb.inflection_error else -4 * n)
