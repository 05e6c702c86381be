"""Runs, shards, requests and samples where they are large, cut off, or not there."""

from __future__ import annotations

import json
import threading
import time

import pytest
from pyspark.sql import functions as F

from corvane.functions import text as T
from corvane.operators import dedup, generation, sampling
from corvane.operators.quality import viable
from corvane.sources import tables, texts
from test_jobs import passage


def test_many_runs_are_one_scan(spark, tmp_path):
    lines = []
    for k in range(300):
        (tmp_path / f"r {k}.jsonl").write_text(f'{{"text": "t{k}", "body": "b{k}", "n": 1}}\n\n{{"text": null, "body": "{k}"}}\n')
        lines.append(json.dumps({"run_id": f"run{k}", "samples_path": f"r {k}.jsonl", **({"text_key": "body"} if k % 2 else {})}))
    (tmp_path / "d" / "e").mkdir(parents=True)
    (tmp_path / "d" / "e" / "x.jsonl").write_text('{"text": "inner"}\n')
    lines += [json.dumps({"run_id": "folder", "samples_path": str(tmp_path / "d" / "e") + "/"}), json.dumps({"run_id": "same", "samples_path": "r 0.jsonl"})]
    (tmp_path / "m.jsonl").write_text("\n".join(lines))
    start = time.time()
    rows = tables.load_runs(spark, str(tmp_path / "m.jsonl"), str(tmp_path))
    assert time.time() - start < 30 and rows._jdf.queryExecution().optimizedPlan().toString().count("Relation [value") == 1
    got = {}
    for r in rows.orderBy("run_id", "row_id").collect():
        got.setdefault(r.run_id, []).append(r.text)
    assert got == {f"run{k}": [f"b{k}", str(k)] if k % 2 else [f"t{k}", None] for k in range(300)} | {"folder": ["inner"], "same": ["t0", None]}
    (tmp_path / "r 0.jsonl").write_text("{not json\n")
    with pytest.raises(Exception, match="MALFORMED|Malformed"):
        tables.load_runs(spark, str(tmp_path / "m.jsonl"), str(tmp_path)).collect()


def test_shards_behind_the_need_stay_closed(spark, tmp_path):
    for k in range(6):
        rows = [(10 * k + j, passage(7 * k + j % 5) if j % 2 else "short") for j in range(10)]
        spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / f"s{k}"))
    files = [f for k in range(6) for f in texts.expand(spark, f"{tmp_path}/s{k}/*.parquet")]
    ban = spark.createDataFrame([("nothing",)], "text string")
    told = lambda names, need: dedup.admit_shards(spark, {"en": names}, ban, need, viable(F.col("n"), 4, 100, 400), prepare=lambda r: r.withColumn("n", T.normalize(F.col("text"))), first=1)
    whole = spark.read.parquet(*files).withColumns({"n": T.normalize(F.col("text")), "lang": F.lit("en")})
    for need in (1, 3, 7, 100):
        want = dedup.admit(whole, ban, ("en",), need, viable(F.col("n"), 4, 100, 400))
        assert sorted((r.doc_id, r.status) for r in told(files, need).collect()) == sorted((r.doc_id, r.status) for r in want.collect()), need
    for f in files[3:]:
        with open(f.removeprefix("file:"), "wb") as out:
            out.write(b"not parquet")
    assert told(files, 4).where("status = 'admit'").count() == 4
    with pytest.raises(Exception):
        told(files, 100).collect()


def answering(log: str):
    """A slow service that notes in a file when each call began and ended."""

    def connect():
        lock = threading.Lock()

        def note(what: str) -> None:
            with lock, open(log, "a") as f:
                f.write(what + "\n")

        def client(prompt: str) -> str:
            note(f"+ {prompt}")
            time.sleep(0.05)
            note(f"- {prompt}")
            if prompt.startswith("bad"):
                raise generation.Retry("503")
            return json.dumps({"rewrites": [prompt]})

        return client

    return connect


def most_at_once(log) -> int:
    now = most = 0
    for line in log.read_text().splitlines():
        now += 1 if line[0] == "+" else -1
        most = max(most, now)
    return most


def test_calls_are_under_way_together_up_to_a_bound(spark, tmp_path):
    tasks = spark.createDataFrame([(k, f"p{k}") for k in range(40)], "id long, prompt string")
    for in_flight in (1, 4):
        log = tmp_path / f"log{in_flight}"
        out = generation.generate(tasks, "id", "prompt", answering(str(log)), concurrency=1, in_flight=in_flight).collect()
        assert sorted((r.id, json.loads(r.answer)["rewrites"]) for r in out) == [(k, [f"p{k}"]) for k in range(40)]
        assert most_at_once(log) == in_flight


def test_retries_of_a_partition_are_bounded(spark, tmp_path):
    tasks = spark.createDataFrame([(k, f"bad{k}") for k in range(10)] + [(10, "good"), (11, None)], "id long, prompt string")
    log = tmp_path / "log"
    out = {r.id: r for r in generation.generate(tasks, "id", "prompt", answering(str(log)), concurrency=1, in_flight=2, retries=5, base=0.001).collect()}
    assert len(out) == 12 and out[10].error is None and out[11].error == "no prompt" and all(out[k].error == "503" for k in range(10))
    assert log.read_text().count("+ bad") == 10 + 5


def test_a_killed_run_resumes_without_repeats(spark, tmp_path, monkeypatch):
    tasks = spark.createDataFrame([(k, "bad one" if k == 7 else f"p{k}") for k in range(60)], "id long, prompt string")
    log, at, real, n = tmp_path / "log", str(tmp_path / "out"), generation.generate, []

    def dies(*args, **how):
        n.append(1)
        if len(n) > 2:
            raise RuntimeError("killed")
        return real(*args, **how)

    how = {"parts": 5, "retries": 0, "concurrency": 2}
    monkeypatch.setattr(generation, "generate", dies)
    with pytest.raises(RuntimeError, match="killed"):
        generation.generate_into(tasks, "id", "prompt", answering(str(log)), at, **how)
    asked = {x[2:] for x in log.read_text().splitlines() if x[0] == "+"}
    assert 0 < len(asked) < 60
    monkeypatch.setattr(generation, "generate", real)
    out = generation.generate_into(tasks, "id", "prompt", answering(str(log)), at, **how).collect()
    again = [x[2:] for x in log.read_text().splitlines() if x[0] == "+" and x[2:5] != "bad"]
    assert len(again) == len({*again}) == 59
    assert sorted(r.id for r in out if r.error is None) == [k for k in range(60) if k != 7] and {r.id for r in out if r.error} == {7}
    size = log.stat().st_size
    assert generation.generate_into(tasks.where("id <> 7"), "id", "prompt", answering(str(log)), at, **how).where("error is null").count() == 59 and log.stat().st_size == size


@pytest.mark.parametrize("top", [1, 3, 50])
def test_large_samples_end_at_a_hash(spark, monkeypatch, top):
    rows = spark.createDataFrame([(k, k % 5) for k in range(400)] + [(7, 9)] * 3, "id long, x long").repartition(6)
    want = {n: sorted(map(tuple, sampling.sample(rows, n, ["id", "x"], 3).collect())) for n in (1, 2, 60, 399, 402, 500)}
    monkeypatch.setattr(sampling, "TOP", top)
    for n, w in want.items():
        got = sorted(map(tuple, sampling.sample(rows, n, ["id", "x"], 3).collect()))
        assert {*w} == {*got} and len(w) <= len(got) <= len(w) + 2 and (len(got) == len(w) or (7, 9) in w), n
