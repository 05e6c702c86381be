"""Gates of rewrites are tested once, and anchors only where a family needs one."""

from __future__ import annotations

from corvane.operators import conditions
from corvane.sources.tables import PASSAGE


def test_what_is_counted_is_read_from_one_table(spark, monkeypatch):
    made, real = [], conditions.stored
    monkeypatch.setattr(conditions, "stored", lambda df, name: made.append(name) or real(df, name))
    row = {"clean_text": "It rains. So we stay.", "perturbed_text": "It rains, and so we go out.", "perturbation": "causal_reverse", "generator": "model", "changed_spans": [(0, 21, "It rains. So we stay.", "It rains, and so we go out.")], "validation": '{"operation_evidence": "x"}', "severity": "mild", "domain": "d"}
    told = [row | {"sample_id": "a:1"}, row | {"sample_id": "a:2"}, row | {"sample_id": "a:3", "perturbation": "topic_drift"}, row | {"sample_id": "a:4", "perturbation": None}]
    records = spark.createDataFrame([tuple(t.get(f.name) for f in PASSAGE) for t in told], PASSAGE)
    rows, counts = conditions.rewrite_rows(records, records.select("sample_id", "clean_text", "domain").where("sample_id = 'a:1'"))
    assert made == ["gated"]
    assert sorted(map(tuple, counts.collect())) == [("", "family", 2), ("pert_causal_reverse", "kept", 1)]
    assert sorted(r.kind for r in rows.collect()) == ["clean_parent", "pert_causal_reverse"]
