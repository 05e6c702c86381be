"""Rows with equal keys and texts are one document to the suffix operator."""

from __future__ import annotations

import brute
from pyspark.sql import functions as F
from test_edges import PART, prose

from corvane.llm import suffix_dedup


def test_repeated_rows_keep_what_one_would(spark):
    alone = prose(60, 51)
    rows = [(1, prose(80, 50)), (2, PART), (3, PART + " " + alone), (4, "short"), (5, None)]
    want = {i: x for i, *x in brute.repeats(rows)}
    assert want[2][1] == 0 and want[3][1] == len(PART)
    many = rows * 3 + [(None, alone), (None, alone), (None, prose(70, 52)), (None, prose(70, 52))]
    df = spark.createDataFrame(many, "doc_id long, text string").repartition(5)
    out = suffix_dedup.remove_repeats(df).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept")).collect()
    assert len(out) == len(many)
    for r in out:
        if r.doc_id is not None:
            assert [r.n_bytes, r.n_removed, r.n_spans, r.kept] == want[r.doc_id]
    free = sorted((r.n_bytes, r.n_removed) for r in out if r.doc_id is None)
    size = len(prose(70, 52))
    assert free == sorted([(len(alone), len(alone))] * 2 + [(size, 0)] * 2)
