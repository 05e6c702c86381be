"""Exact quantiles, sums of outer products and digests against plain versions."""

from __future__ import annotations

import hashlib
import math
import random

import numpy as np
import pytest

from corvane.operators import digests, gram, linalg
from corvane.operators.quantiles import quantiles

SHARES = {"q0": 0.0, "q1": 0.1, "q5": 0.5, "q73": 0.73, "q999": 0.999, "q10": 1.0}


def frame(spark, rows):
    return spark.createDataFrame(rows, "g string, v double").repartition(5)


def plain(values, share: float) -> float:
    return float(np.quantile(values, share))


@pytest.mark.parametrize("pivots", [2, 3, 64])
def test_quantiles_of_many_shapes(spark, pivots):
    r = random.Random(pivots)
    groups = {"a": [r.gauss(0, 1) for _ in range(700)], "b": [7.0] * 300 + [r.random() for _ in range(40)], "c": [1.5], "d": [2.0, 1.0], None: [10.0 ** r.uniform(-300, 300) for _ in range(200)], "": [-0.0, 0.0, -5e-324, 5e-324, 1.0]}
    rows = [(g, v) for g, vs in groups.items() for v in vs] + [("a", None), ("a", float("nan")), ("nothing", None)]
    got = {x.g: x for x in quantiles(frame(spark, rows), "g", "v", SHARES, pivots).collect()}
    assert set(got) == set(groups)
    for g, vs in groups.items():
        assert got[g].n == len(vs)
        for name, share in SHARES.items():
            want = plain(vs, share)
            assert got[g][name] == pytest.approx(want, rel=1e-12, abs=1e-300), (g, name)


def test_quantiles_of_nothing(spark):
    assert quantiles(frame(spark, [("a", None)]), "g", "v", SHARES).collect() == []
    assert quantiles(frame(spark, []), "g", "v", SHARES).columns == ["g", "n", *SHARES]


def vectors(spark, x):
    return spark.createDataFrame([(k, [float(v) for v in row]) for k, row in enumerate(x)], "id long, v array<double>").repartition(3)


def test_moments_by_blocks(spark):
    x = np.random.default_rng(0).normal(size=(150, 37)) + 3
    for block in (1, 8, 37, 64):
        n, mean, scatter = gram.moments(vectors(spark, x), "v", 37, block)
        c = x - x.mean(0)
        assert n == 150 and np.allclose(mean, x.mean(0)) and np.allclose(scatter, c.T @ c)
    told = {(r.i, r.j): r.value for r in gram.entries(vectors(spark, x), "v", 37, 8).collect()}
    assert len(told) == 37 * 38 // 2 and all(math.isclose(v, (x.T @ x)[k]) for k, v in told.items())


def test_moments_of_odd_rows(spark):
    n, mean, scatter = gram.moments(vectors(spark, np.zeros((0, 3))), "v", 3)
    assert n == 0 and not mean.any() and not scatter.any()
    for rows in ([(1, [1.0, 2.0])], [(1, None)], [(1, [1.0, None, 2.0])]):
        with pytest.raises(Exception, match="width|null"):
            gram.moments(spark.createDataFrame(rows, "id long, v array<double>"), "v", 3)


def test_pca_of_wide_rows(spark):
    r = np.random.default_rng(1)
    x = r.normal(size=(90, 20)) @ r.normal(size=(20, 700)) + r.normal(size=(90, 700)) / 10
    told = linalg.pca_fit(vectors(spark, x), "v", 700, 12)
    s = np.linalg.svd(x - x.mean(0), compute_uv=False) ** 2
    assert told["retained"] == pytest.approx(s[:12].sum() / s.sum(), abs=1e-9)


def test_corpus_hashes(spark):
    rows = [(g, k, f"text {k} of {g}" if k % 7 else None) for g in ("a", "b", None, "") for k in range(50)]
    random.Random(3).shuffle(rows)
    got = {r.g: (r.corpus_hash, r.n) for r in digests.corpus_hashes(spark.createDataFrame(rows, "g string, o long, t string").repartition(6), "g", "o", "t").collect()}
    sha = lambda t: hashlib.sha256((t or "").encode()).hexdigest()
    for g in ("a", "b", None, ""):
        mine = sorted((k, t) for x, k, t in rows if x == g)
        assert got[g] == (hashlib.sha256("\n".join(sha(t) for _, t in mine).encode()).hexdigest(), 50)
    assert digests.corpus_hashes(spark.createDataFrame([], "g string, o long, t string"), "g", "o", "t").collect() == []
