"""The jobs over growing input, cut-off runs, reruns and odd rows."""

from __future__ import annotations

import json
import os
import subprocess
import sys
from pathlib import Path

import pytest
from compare import compare
from pyspark.sql import functions as F

from corvane import registry
from jobs import common, counterfactual_set, queries, source_pool  # noqa: F401

ROOT = Path(__file__).resolve().parents[1]
SF = "/root/testdata/sf0.001"
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def passage(seed: int, words: int = 120) -> str:
    names = [f"{a}{b}" for a in ("river", "stone", "cloud", "amber", "field", "lamp", "north", "quiet") for b in ("side", "work", "light", "man", "land", "fall")]
    out = [names[(seed * 31 + k * k * 7 + k * (seed % 11)) % len(names)] for k in range(words)]
    return " ".join(w.capitalize() if k % 10 == 0 else w + "." * (k % 10 == 9) for k, w in enumerate(out))


def put(spark, rows, path: str, mode: str = "append") -> None:
    spark.createDataFrame(rows, COLUMNS).coalesce(1).write.mode(mode).parquet(path)


def told(df) -> dict:
    return {r.doc_id: (r.status, r.batch) for r in df.collect()}


@pytest.fixture
def places(spark, tmp_path):
    ban = passage(900)
    spark.createDataFrame([(0, ban), (1, None), (2, "short")], "item_id long, text string").write.parquet(str(tmp_path / "bans"))
    return {"documents": str(tmp_path / "docs"), "bans": str(tmp_path / "bans"), "out": str(tmp_path / "out"), "checkpoint": str(tmp_path / "mark")}


def rows_of(df) -> list:
    return sorted(map(repr, df.collect()))


def test_source_pool_takes_only_what_is_new(spark, places):
    a, b, c = passage(1), passage(2), passage(3)
    grams = passage(4) + " " + " ".join(passage(900).split()[5:40])
    first = [(1, a, "en", "s", 0), (2, a.upper(), "en", "s", 0), (3, passage(900), "en", "s", 0), (4, grams, "fr", "s", 0), (5, None, "en", "s", 0), (6, "too short", None, None, 0), (None, b, "", None, 0)]
    put(spark, first, places["documents"])
    one = source_pool.run(spark, **places)
    want = {1: ("admit", 0), 2: ("duplicate", 0), 3: ("eval_exact", 0), 4: ("eval_ngram", 0), 5: ("not_viable", 0), 6: ("not_viable", 0), None: ("admit", 0)}
    assert told(one) == want
    before = rows_of(one)
    put(spark, [(0, "  " + a + "\n", "en", "s", 0), (7, c, "en", "s", 0), (7, c, "en", "s", 0), (8, b, "en", "s", 0), (9, passage(900), "en", "s", 0)], places["documents"])
    two = source_pool.run(spark, **places)
    assert rows_of(two.where("batch = 0")) == before
    assert sorted((r.doc_id, r.status) for r in two.where("batch = 1").collect()) == [(0, "duplicate"), (7, "admit"), (7, "duplicate"), (8, "duplicate"), (9, "eval_exact")]
    assert rows_of(source_pool.run(spark, **places)) == rows_of(two)
    admitted = two.where("status = 'admit'").collect()
    assert all(r.text and r.part in ("pool", "val") for r in admitted) and two.where("status <> 'admit' and (text is not null or part is not null)").isEmpty()
    assert {r.domain for r in admitted} == {"en", "none"}


def test_source_pool_makes_a_batch_that_was_cut_off_again(spark, places, monkeypatch):
    put(spark, [(k, passage(k % 9), "en", "s", 0) for k in range(12)], places["documents"])
    real = source_pool.take

    def fails(*args):
        real(*args)
        raise RuntimeError("lost after writing")

    monkeypatch.setattr(source_pool, "take", fails)
    with pytest.raises(Exception, match="lost after writing"):
        source_pool.run(spark, **places)
    half = rows_of(source_pool.decisions(spark, places["out"]))
    monkeypatch.setattr(source_pool, "take", real)
    assert rows_of(source_pool.run(spark, **places)) == half
    put(spark, [(50, passage(3), "en", "s", 0)], places["documents"])
    monkeypatch.setattr(source_pool, "take", lambda *a: (_ for _ in ()).throw(RuntimeError("lost before writing")))
    with pytest.raises(Exception, match="lost before writing"):
        source_pool.run(spark, **places)
    monkeypatch.setattr(source_pool, "take", real)
    assert told(source_pool.run(spark, **places))[50] == ("duplicate", 1)


def test_source_pool_in_one_run_or_many_admits_the_same_texts(spark, places, tmp_path):
    for k in range(3):
        put(spark, [(100 * k + j, passage((7 * k + j) % 13), "en", "s", 0) for j in range(8)], places["documents"])
    many = source_pool.run(spark, **places, settings={"files_per_batch": 1})
    one = source_pool.run(spark, **(places | {"out": str(tmp_path / "o2"), "checkpoint": str(tmp_path / "m2")}))
    keys = lambda df: sorted(r.key for r in df.where("status = 'admit'").collect())
    assert many.agg(F.max("batch")).first()[0] == 2 and keys(many) == keys(one) == sorted(set(keys(one)))


def test_counterfactual_set_is_read_only_when_whole(spark, tmp_path, monkeypatch):
    docs, out = str(tmp_path / "docs"), str(tmp_path / "out")
    put(spark, [(k, passage(k), "en", f"src{k % 3}", 0) for k in range(9)] + [(9, None, "en", "src1", 0), (None, passage(20), "en", "src2", 0), (10, "", "en", None, 0)], docs)
    real = counterfactual_set.common.read_there
    calls = []

    def stops(spark, path, *args):  # the run ends between rows and manifest
        calls.append(path)
        if len(calls) > 1:
            raise RuntimeError("lost")
        return real(spark, path, *args)

    plan = counterfactual_set.conditions.planned
    monkeypatch.setattr(counterfactual_set.conditions, "planned", lambda s: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError, match="lost"):
        counterfactual_set.run(spark, docs, out)
    half = spark.read.parquet(f"{out}/rows")
    (made,) = {r.set_id for r in half.select("set_id").distinct().collect()}
    assert counterfactual_set.read_set(spark, out, made).isEmpty()
    monkeypatch.setattr(counterfactual_set.conditions, "planned", plan)
    assert counterfactual_set.run(spark, docs, out) == made
    rows = counterfactual_set.read_set(spark, out, made)
    told = {r.condition: r for r in counterfactual_set.manifest(spark, out).collect()}
    assert rows.count() == sum(r.n for r in told.values()) and told["clean_candidates"].n == 10
    clean = {r.parent_id: r.text for r in rows.where("condition = 'clean_candidates'").collect()}
    assert "none" in clean and all(r.text != clean[r.parent_id] for r in rows.where("condition <> 'clean_candidates'").collect())
    before = rows_of(rows)
    monkeypatch.setattr(counterfactual_set.conditions, "condition_rows", None)  # a whole set isn't made again
    assert counterfactual_set.run(spark, docs, out) == made and rows_of(counterfactual_set.read_set(spark, out, made)) == before
    monkeypatch.undo()
    put(spark, [(30, passage(30), "en", "src1", 0)], docs)
    other = counterfactual_set.run(spark, docs, out)
    assert other != made and rows_of(counterfactual_set.read_set(spark, out, made)) == before
    assert counterfactual_set.read_set(spark, out, other).where("condition = 'clean_candidates'").count() == 11


def test_counterfactual_set_without_parents(spark, tmp_path):
    docs, out = str(tmp_path / "docs"), str(tmp_path / "out")
    put(spark, [(1, "short", "en", "src1", 0)], docs)
    made = counterfactual_set.run(spark, docs, out)
    assert counterfactual_set.read_set(spark, out, made).isEmpty()
    assert {r.status for r in counterfactual_set.manifest(spark, out).collect()} == {"skipped"}


def test_command_lines(tmp_path):
    if not os.path.isdir(SF):
        pytest.skip("no tables")
    env = os.environ | {"PYTHONPATH": str(ROOT)}
    call = [sys.executable, str(ROOT / "jobs/source_pool.py"), "--documents", f"{SF}/documents.parquet", "--bans", f"{SF}/benchmark.parquet", "--out", str(tmp_path / "out"), "--checkpoint", str(tmp_path / "mark"), "--set", "val_share=0.5"]
    for batch in ("batch 0", None):
        done = subprocess.run(call, env=env, capture_output=True, text=True, timeout=300)
        assert done.returncode == 0, done.stderr[-2000:]
        assert ("batch 0: read 200 texts" in done.stderr) == (batch is not None)
    assert "holds {" in done.stderr
    assert subprocess.run([*call, "--set", "nothing=1"], env=env, capture_output=True, text=True).returncode == 2


def test_settings_file():
    for config in (source_pool.CONFIG, counterfactual_set.CONFIG):
        assert json.loads((ROOT / "jobs" / config).read_text()) == common.defaults(config)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
@pytest.mark.parametrize("name", ["job1_source_pool", "job2_counterfactual_set"])
def test_query(spark, name):
    conf = {r.key: r.value for r in spark.sql("set").collect()}
    assert compare(spark, SF, name, registry.queries()[name], registry.oracle_sql()[name]).startswith("equal")
    assert {r.key: r.value for r in spark.sql("set").collect()} == conf
