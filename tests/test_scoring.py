"""Scores of files, from Python and from the command line."""

from __future__ import annotations

import json
import os
import subprocess
import sys
from pathlib import Path

import pytest
from test_jobs import passage

from corvane import scoring

ROOT = Path(__file__).resolve().parents[1]


@pytest.fixture(scope="module")
def files(tmp_path_factory):
    at = tmp_path_factory.mktemp("score")
    human = [passage(k) for k in range(40)]
    (at / "human.jsonl").write_text("\n".join(json.dumps({"text": t}) for t in human) + '\n{"text": "  "}\n')
    (at / "more.json").write_text(json.dumps([{"text": passage(k)} for k in range(100, 140)]))
    (at / "odd.jsonl").write_text("\n".join(json.dumps({"body": "one two three " * (k + 5)}) for k in range(30)))
    (at / "blank.jsonl").write_text('{"text": " "}\n')
    return at


def test_scores(spark, files):
    human, more = str(files / "human.jsonl"), str(files / "more.json")
    same = scoring.score_files(spark, human, human, size=64, draws=6).first()
    near = scoring.score_files(spark, more, human, size=64, draws=6).first()
    assert abs(same.raw_mmd) < 1e-12 and (near.n_generated, near.n_reference) == (40, 40) and near.raw_mmd > same.raw_mmd
    assert scoring.score_files(spark, more, human, pool=human, size=64, bandwidth=0.5).first().bandwidth == 0.5
    with pytest.raises(ValueError, match="no text"):
        scoring.score_files(spark, str(files / "blank.jsonl"), human)


def test_command_line(files):
    call = [sys.executable, "-m", "corvane.scoring", "--generated", str(files / "human.jsonl"), "--reference", str(files / "more.json"), "--size", "64", "--out", str(files / "out")]
    done = subprocess.run(call, env=os.environ | {"PYTHONPATH": str(ROOT)}, cwd=ROOT, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-1500:]
    told = json.loads(done.stdout.strip().splitlines()[-1])
    assert told["n_generated"] == 40 and told["raw_mmd"] > 0 and told["z_score"] is None
    (out,) = (files / "out").glob("part-*.json")
    assert json.loads(out.read_text())["raw_mmd"] == told["raw_mmd"]
