from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from corvane.operators import corpus
from corvane.sources import tables


def test_jsonl(spark, tmp_path):
    p = tmp_path / "a.jsonl"
    p.write_text('{"text": " a  b\\n c "}\n\n{"text": "d"}\n')
    rows = tables.read_jsonl(spark, str(p), tables.CORPUS_ROW)
    assert [r.text for r in tables.checked_texts(rows, mode="whitespace").collect()] == ["a b c", "d"]
    tables.write_jsonl(rows.select("text", F.lit("k").alias("kind")), str(tmp_path / "out"))
    lines = [json.loads(x) for f in (tmp_path / "out").glob("part-*") for x in f.read_text().splitlines()]
    assert [list(x) for x in lines] == [["kind", "text"]] * 2
    p.write_text('{"text": "a"}\n{"text": \n')
    with pytest.raises(Exception):
        tables.read_jsonl(spark, str(p), tables.CORPUS_ROW).collect()
    p.write_text('{"text": " "}\n')
    with pytest.raises(Exception, match="blank"):
        tables.checked_texts(tables.read_jsonl(spark, str(p), tables.CORPUS_ROW)).collect()
    with pytest.raises(ValueError):
        tables.non_empty_texts(tables.read_jsonl(spark, str(p), tables.CORPUS_ROW))


def test_runs(spark, tmp_path):
    (tmp_path / "s.jsonl").write_text('{"text": "x"}\n{"text": "y"}\n')
    m = tmp_path / "runs.jsonl"
    m.write_text('{"run_id": "a", "samples_path": "s.jsonl"}\n{"run_id": "b", "samples_path": "gone.jsonl"}\n')
    assert tables.load_runs(spark, str(m), str(tmp_path), require=False).count() == 2
    with pytest.raises(FileNotFoundError):
        tables.load_runs(spark, str(m), str(tmp_path))
    m.write_text('{"run_id": "a", "samples_path": "s.jsonl"}\n{"run_id": "a", "samples_path": "s.jsonl"}\n')
    with pytest.raises(ValueError, match="twice"):
        tables.load_runs(spark, str(m), str(tmp_path))


def test_windows_drop_an_exact_last_one(spark):
    from pyspark.sql.functions import split

    for n, windows in ((7, 1), (8, 2), (9, 2)):  # tokens with the end mark: 8, 9, 10 by windows of 4
        docs = spark.createDataFrame([(1, " ".join("abcdefghij"[:n]))], "id long, t string")
        assert corpus.packed_windows(docs, ["id"], split("t", " "), 4, "<e>").count() == windows


def test_layers_stop_at_their_limit(spark):
    rows = spark.createDataFrame([(i, f"text {i % 6}") for i in range(12)], "id long, text string")
    out = corpus.assemble(None, [corpus.Layer("a", rows, "id", limit=3), corpus.Layer("b", rows, "id")], spark.createDataFrame([("TEXT  4",)], "text string"))
    got = [(r.layer, r.ordinal, r.status) for r in out.orderBy("layer", "ordinal").collect()]
    assert got[:3] == [(0, 0, "added"), (0, 1, "added"), (0, 2, "added")] and got[3:9] == [(1, 0, "dup"), (1, 1, "dup"), (1, 2, "dup"), (1, 3, "added"), (1, 4, "banned"), (1, 5, "added")]


def test_sample_files(spark):
    df = spark.createDataFrame([("x\n--- Sample 1 ---\na b\n--- Sample 2 ---\nc\n", "p|q", "l1\nl2")], "m string, s string, l string")
    r = df.select(corpus.split_samples(F.col("m")).alias("m"), corpus.split_samples(F.col("s"), "|").alias("s"), corpus.split_samples(F.col("l")).alias("l")).first()
    assert [x.strip() for x in r.m] == ["a b", "c"] and r.s == ["p", "q"] and r.l == ["l1", "l2"]
