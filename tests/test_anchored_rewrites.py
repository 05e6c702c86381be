"""The gate of anchors decides about rows of rewrite_rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from corvane import registry
from corvane.operators import quality
from corvane.plans import files  # noqa: F401  (registers the query)

DIR = "/root/testdata/sf0.001"


def test_contradictions_need_their_anchor(spark, monkeypatch):
    run = lambda: {(r.kind, int(r.parent)) for r in registry.queries()["rewrite_rows"](spark, DIR).collect()}
    gated = {p for k, p in run() if k == "pert_contradiction"}
    assert gated and not any(p % 4 != 3 or p % 7 < 2 or p % 5 == 0 for p in gated)
    assert {p % 7 for p in gated} == {2, 3, 4, 5, 6}  # sentences as they stand, and with a word more
    monkeypatch.setattr(quality, "anchor_survives", lambda rows, evidence, perturbed, clean, out: rows.withColumn(out, F.lit(True)))
    every = {p for k, p in run() if k == "pert_contradiction"}
    assert gated < every and {p % 7 for p in every - gated} >= {0, 1}
