"""Every node of a graph can be reached, and few candidates are all found."""

from __future__ import annotations

import numpy as np
import pytest

from corvane.llm import ann


def shapes():
    r = np.random.default_rng(4)
    yield "cloud", r.normal(size=(900, 8))
    yield "clusters", np.repeat(r.normal(size=(30, 8)) * 50, 30, 0) + r.normal(size=(900, 8)) / 100
    yield "line", np.linspace(0, 1, 700)[:, None] * np.ones(5)
    yield "scales", r.normal(size=(600, 6)) * np.exp(r.normal(size=(600, 1)) * 4)
    yield "two", r.normal(size=(2, 3))
    yield "one", r.normal(size=(1, 3))


@pytest.mark.parametrize("degree", [2, 32])
@pytest.mark.parametrize("name, x", list(shapes()))
def test_all_nodes_are_reached(name, x, degree, monkeypatch):
    monkeypatch.setattr(ann, "DEGREE", degree)
    monkeypatch.setattr(ann.prune, "__defaults__", (degree, ann.ALPHA))
    data = ann.equal_norms(x)
    graph, start = ann.build(data)
    assert ann.reached(graph, start).all() and (graph[-1] < 0).all()
    found, _ = ann.beam_search(data, graph, start, data[:5], len(data))
    assert all(sorted(f) == list(range(len(data))) for f in found.tolist())


def test_cut_off_nodes_are_joined():
    x = ann.equal_norms(np.random.default_rng(5).normal(size=(40, 4)))
    graph = np.full((41, 2), -1, np.int64)
    graph[0] = [1, 2]
    graph[30] = [31, 32]
    graph = ann.joined(x, graph, 0)
    assert ann.reached(graph, 0).all() and (graph[-1] < 0).all()


@pytest.mark.parametrize("n", [1, 2, 15, 21, 60])
def test_few_candidates_are_all_found(spark, n):
    r = np.random.default_rng(n)
    x = r.normal(size=(n, 6)) * np.exp(r.normal(size=(n, 1)) * 3)
    df = spark.createDataFrame([(20 * i, x[i].tolist()) for i in range(n)], "vec_id long, embedding array<double>")
    out = ann.search(df, df, shard=16).collect()
    got = {}
    for o in sorted(out, key=lambda o: o["rank"]):
        got.setdefault(o.query_id, []).append(o.vec_id)
    for i in range(n):
        score = x @ x[i]
        want = [20 * j for j in sorted(range(n), key=lambda j: (-score[j], j)) if j != i][:20]
        assert got.get(20 * i, []) == want
