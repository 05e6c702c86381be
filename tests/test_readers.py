"""Readers of texts, and what samples and orders rows."""

from __future__ import annotations

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane.operators import generation, sampling, vectors
from corvane.plans import config
from corvane.sources import texts


def test_paths(spark, tmp_path):
    for n in ("b.jsonl", "a.jsonl", "c.txt"):
        (tmp_path / n).write_text('{"text": "%s"}\n{"text": " "}\n{"other": 1}\nno json\n' % n)
    found = texts.expand(spark, [f"{tmp_path}/*.jsonl", f"{tmp_path}/a.*"])
    assert [x.rpartition("/")[2] for x in found] == ["a.jsonl", "b.jsonl"]
    assert sorted(r.text for r in texts.eval_texts(spark, f"{tmp_path}/*.jsonl").collect()) == ["a.jsonl", "b.jsonl"]
    with pytest.raises(FileNotFoundError):
        texts.eval_texts(spark, f"{tmp_path}/*.none")


def test_texts_in_file_order(spark, tmp_path):
    for k in range(3):
        (tmp_path / f"{k}.jsonl").write_text("".join('{"body": "%d"}\n' % (10 * k + i) for i in range(10)))
    some = texts.jsonl_texts(spark, f"{tmp_path}/*.jsonl", "body", 14)
    assert [int(r.text) for r in some.collect()] == list(range(14))
    assert texts.jsonl_texts(spark, f"{tmp_path}/*.jsonl", "body").count() == 30


def test_stream(spark, tmp_path):
    for k in (1, 0):
        spark.createDataFrame([(i, None if i == 3 else "" if i == 4 else f"{k}-{i}") for i in range(6)], "i int, body string").coalesce(1).write.parquet(f"{tmp_path}/shard-{k}")
    out = texts.stream_dataset(spark, f"{tmp_path}/shard-*/*.parquet", "body").orderBy("ordinal").collect()
    assert [r.text for r in out] == [f"{k}-{i}" for k in (0, 1) for i in (0, 1, 2, 5)]


def test_null_matches_null(spark):
    df = spark.createDataFrame([("x", "en"), (None, "en"), ("y", None)], "a string, b string")
    assert df.where(texts.matches({"a": None})).count() == 1 and df.where(texts.matches({"a": ["x", None], "b": "en"})).count() == 2
    assert df.where(texts.matches({})).count() == 3


def test_parents_and_vocabulary(spark):
    df = spark.createDataFrame([(5, None, "e"), (1, "p", "a"), (3, None, "c")], "o int, parent_id string, text string").repartition(3)
    assert sorted(map(tuple, texts.parents(df, "o").collect())) == [("p", "a"), ("par-1", "c"), ("par-2", "e")]
    lines = spark.createDataFrame([('{"text": "t"}',), (" plain ",), ("  ",), ('{"x": 1}',), ("[1]",)], "value string")
    assert [r.text for r in texts.vocabulary_texts(lines).collect()] == ["t", "plain", '{"x": 1}', "[1]"]


def test_samples(spark):
    df = spark.range(30).withColumn("d", F.concat(F.lit("d"), F.col("id") % 3))
    assert sampling.sample_exactly(df, 5, ["id"], 1, {"d": ["d0"]}).where("d = 'd0'").count() == 0
    with pytest.raises(ValueError):
        sampling.sample_exactly(df, 21, ["id"], 1, {"d": ["d0"]})
    with pytest.raises(ValueError):
        sampling.three_way(df, "d", "id", ("d0", "d9"), 2, 2, None, 1, strict=True)
    split = sampling.val_and_pool(df, "d", "id", 4, 9).groupBy("d", "part").count().collect()
    assert {(r.d, r.part): r["count"] for r in split} == {(f"d{k}", p): n for k in range(3) for p, n in (("val", 4), ("pool", 6))}
    order = sampling.final_order(df, "id", 3).orderBy("place").collect()
    assert [r.place for r in order] == list(range(30)) and [r.id for r in order] != list(range(30))


def test_epochs():
    base, schedule = {"repeat_kinds": {"k": 2}}, [{"epochs": [1, 2], "repeat_kinds": {"k": 5, "l": 3}}, {"epochs": [2, 9], "repeat_sources": {"s": 4}}]
    assert [sampling.scheduled(e, base, schedule) for e in (0, 1, 2, 3)] == [({"k": 2}, {}), ({"k": 5, "l": 3}, {}), ({"k": 5, "l": 3}, {"s": 4}), ({"k": 2}, {"s": 4})]


def test_generators_are_told_by_their_parts():
    a, b = sampling.seeded_rng(1, "x").random(3), sampling.seeded_rng(1, "y").random(3)
    seed = [int(hashlib.sha256(p.encode()).hexdigest()[:8], 16) for p in ("1", "x")]
    assert a.tolist() == np.random.default_rng(seed).random(3).tolist() != b.tolist()


def test_prompts_and_protocols(spark):
    df = spark.createDataFrame([("p", [(0, "One.")])], "t string, s array<struct<index:int,sentence:string>>")
    told = df.select(generation.whole_prompt("T", "f", "mild", generation.rubric_with_constraints("R", ["c"], "late", 9), F.col("t"), F.col("s"))).first()[0]
    for x in ("Edit: f", "R\n1. c\n2. Change only the late third of the passage.\n3. Keep at least 9 words.", "[0] One.", "Passage:\np\n"):
        assert x in told
    assert "Change each" not in df.select(generation.whole_prompt("T", "f", "mild", "R", F.col("t"))).first()[0]
    payload = vectors.protocol_payload({"name": "n", "other": 1}, "v2")
    assert payload["name"] == "n" and payload["layer"] is None and payload["implementation_version"] == "v2" and "other" not in payload and len(payload) == len(vectors.PROTOCOL) + 1


def test_vectors_are_checked(spark):
    good = spark.createDataFrame([([1.0, 2.0],), ([0.0, 1.0],)], "v array<double>")
    assert vectors.checked_vectors(good, "v").count() == 2
    for bad in ([1.0], None, [1.0, None], [float("nan"), 1.0], [float("inf"), 1.0]):
        rows = good.unionByName(spark.createDataFrame([(bad,)], "v array<double>"))
        with pytest.raises(Exception, match="finite"):
            vectors.checked_vectors(rows, "v").collect()
    with pytest.raises(ValueError):
        vectors.checked_vectors(good.limit(0), "v")


def test_settings(tmp_path, monkeypatch):
    monkeypatch.setenv("CORVANE_X", "v")
    assert config.expanded({"a": ["${CORVANE_X}-${NO_SUCH:-d}", 3, {"b": "$5"}], "c": {}, "d": None}) == {"a": ["v-d", 3, {"b": "$5"}], "c": {}, "d": None}
    (tmp_path / "a.json").write_text('{"extends": "b.json", "k": {"x": {}}}')
    (tmp_path / "b.json").write_text('{"extends": "a.json"}')
    with pytest.raises(ValueError):
        config.load(tmp_path / "a.json")
    assert config.resolve_path("/x", "/r").as_posix() == "/x" and config.resolve_path("x", "/r").as_posix() == "/r/x"
    assert len(config.stable_hash({"a": 1}, 8)) == 8
