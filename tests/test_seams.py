from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from corvane.operators import conditions, generation
from corvane.plans import config
from corvane.sources.tables import PASSAGE
from corvane.streaming import bans


def test_editor_seam(spark):
    docs = spark.createDataFrame([("a", "One is here now. Two is the second sentence in this. Three."), ("b", "Only."), ("c", "")], "id string, n string")
    rows = generation.targets(docs, "id", "n", 2, 5)
    got = {r.id: r for r in rows.collect()}
    assert len(got["a"].targets) == 2 and [t["index"] for t in got["a"].targets] == sorted(t["index"] for t in got["a"].targets)
    assert got["a"].anchor not in [t.sentence for t in got["a"].targets] and got["c"].targets == []
    tasks = rows.withColumn("prompt", generation.rewrite_prompt("Rewrite.", F.col("n"), F.col("targets")))

    def connect():
        def client(prompt):
            if "Only." in prompt:
                return "no json"
            return "<think>{x}</think>" + json.dumps({"rewrites": [{"index": 0, "sentence": "New."}]})

        return client

    out = {r.id: r for r in generation.generate(tasks.where("id <> 'b'"), "id", "prompt", connect).collect()}
    assert json.loads(out["a"].answer)["rewrites"][0]["sentence"] == "New." and out["a"].error is None
    waits = []
    calls = iter(["", "{}", '{"rewrites": []}'])
    assert generation.answer(lambda p: next(calls), "p", "rewrites", sleep=waits.append) == {"rewrites": []} and len(waits) == 2
    with pytest.raises(generation.Retry):
        generation.answer(lambda p: (_ for _ in ()).throw(generation.Retry()), "p", "rewrites", tries=2, sleep=waits.append)


def test_conditions(spark):
    parents = spark.createDataFrame([("p", "The clean text stands here. It is fine."), ("q", "Another.")], "parent_id string, text string")
    edits = [("p", "benign_paraphrase", "dose1", "Fine, the clean text stands.", None), ("p", "benign_paraphrase", "severe", "A text.", None), ("p", "topic_drift", "mild", " The clean  text stands here. It is fine.", None), ("q", "internal_contradiction", "dose2", "Another one.", '{"anchor_sentence": "not in the text at all"}'), ("p", "internal_contradiction", "dose2", "The clean text stands here. It is not.", '{"anchor_sentence": "The clean text stands here."}')]
    rows = conditions.conditions(spark.createDataFrame(edits, "parent_id string, family string, severity string, text string, validation string"), parents)
    got = {(r.condition, r.role) for r in rows.collect()}
    assert got == {("benign_paraphrase__dose1", "benign_dose"), ("benign_paraphrase__dose3", "benign_anchor"), ("internal_contradiction__dose2", "harmful")}
    assert conditions.with_benign(rows, parents).count() == 3 and conditions.with_benign(rows.where("role = 'harmful'"), parents).count() == 3


def test_rewrite_rows(spark):
    clean = "The first sentence is here today. The second one follows it at once."
    edit = clean.replace("at once", "never")
    base = {"clean_text": clean, "perturbation": "causal_reverse", "generator": "model", "changed_spans": [{"start": len(clean) - 8, "end": len(clean) - 1, "before": "at once", "after": "never"}], "validation": '{"operation_evidence": "x"}', "domain": "d", "parent_sample_id": "p", "severity": "dose1"}
    rows = [base | {"sample_id": "p:1", "perturbed_text": edit}, base | {"sample_id": "p:2", "perturbed_text": edit}, base | {"sample_id": "p:3", "perturbed_text": clean}, base | {"sample_id": "p:4", "perturbed_text": edit, "perturbation": "topic_drift"}]
    records = spark.createDataFrame([tuple(r.get(f.name) for f in PASSAGE.fields) for r in rows], PASSAGE)
    out, report = conditions.rewrite_rows(records, spark.createDataFrame([("p", clean, "d")], "sample_id string, clean_text string, domain string"))
    assert sorted((r.kind, r.source) for r in out.collect()) == [("clean_parent", None), ("pert_causal_reverse", "dose1")]
    assert {(r.status, r.n) for r in report.collect()} == {("kept", 1), ("invalid", 1), ("family", 1)}


def test_config(tmp_path, monkeypatch):
    (tmp_path / "base.json").write_text('{"a": {"x": 1, "y": 2}, "b": "${HOME_X:-none}"}')
    (tmp_path / "top.json").write_text('{"extends": "base.json", "a": {"y": 3}}')
    assert config.load(tmp_path / "top.json") == {"a": {"x": 1, "y": 3}, "b": "none"}
    assert config.config_hash({"a": 1, "_b": 2}) == config.config_hash({"a": 1})
    with pytest.raises(KeyError):
        config.expanded("${NOT_SET_ANYWHERE}")


def test_stream(spark, tmp_path):
    good = "This is one sentence. Here is another one! Is this a third? Yes it is."
    rows = spark.createDataFrame([(1, good), (2, "short."), (3, good.upper()), (4, good + " More.")], "id long, text string")
    rows.write.parquet(str(tmp_path / "in"))
    ban = spark.createDataFrame([(good.lower(),)], "text string")
    stream = bans.admitted(bans.read_texts(spark, str(tmp_path / "in"), rows.schema), ban, 4, 5, 100)
    q = stream.writeStream.format("memory").queryName("admitted").outputMode("append").option("checkpointLocation", str(tmp_path / "state")).start()
    q.processAllAvailable()
    q.stop()
    assert [r.id for r in spark.sql("select id from admitted").collect()] == [4]
