from __future__ import annotations

import numpy as np
import pytest

from corvane.operators import linalg, mmd, sampling


def frame(spark, x, side="g", start=0):
    return spark.createDataFrame([(start + i, side, [float(v) for v in r]) for i, r in enumerate(x)], "id long, side string, v array<double>")


def gauss(n, shift=0.0, seed=0):
    return np.random.default_rng(seed).normal(shift, 1, (n, 16))


def value(spark, a, b, block=1024, unbiased=False):
    both = frame(spark, a).unionByName(frame(spark, b, "r", len(a)))
    return mmd.squared_mmd(mmd.kernel_sums(both, both, "side", "id", "v", 4.0, block), "g", "r", unbiased).first().mmd2


def test_identity_shift_and_blocks(spark):
    a = gauss(64)
    assert abs(value(spark, a, a)) < 1e-12
    near, far = value(spark, a, gauss(70, 0.2, 1)), value(spark, a, gauss(70, 2.0, 1))
    assert near < far
    assert value(spark, a, gauss(70, 2.0, 1), block=16) == pytest.approx(far, rel=1e-10)


def test_bandwidth(spark):
    x = gauss(90)
    s = mmd.median_bandwidth(frame(spark, x), "id", "v")
    assert s > 0 and mmd.median_bandwidth(frame(spark, 3 * x), "id", "v") == pytest.approx(3 * s, rel=1e-9)
    with pytest.raises(ValueError):
        mmd.median_bandwidth(frame(spark, np.ones((5, 4))), "id", "v")


def test_null_calibration(spark):
    ref = frame(spark, gauss(200, 0, 2), "r")
    same = mmd.score(frame(spark, gauss(100, 0, 3)), ref, "id", "v", draws=8).first()
    far = mmd.score(frame(spark, gauss(100, 1.5, 4)), ref, "id", "v", draws=8).first()
    assert far.z_score > 10 * max(abs(same.z_score), 1)
    assert mmd.score(frame(spark, gauss(20)), ref, "id", "v").first().z_score is None


def test_frechet_and_pca(spark):
    x, y = gauss(300), gauss(300, 0.5, 1)
    assert mmd.frechet(frame(spark, x), frame(spark, x), "v", 16)["distance"] == pytest.approx(0, abs=1e-6)
    d = mmd.frechet(frame(spark, x), frame(spark, y), "v", 16)
    assert d["mean_term"] == pytest.approx(((x.mean(0) - y.mean(0)) ** 2).sum()) and d["trace_a"] == pytest.approx(np.trace(np.cov(x.T)))
    basis = linalg.pca_fit(frame(spark, x), "v", 16, 5)
    w = np.linalg.svd(x - x.mean(0), compute_uv=False) ** 2
    assert basis["retained"] == pytest.approx(w[:5].sum() / w.sum())
    with pytest.raises(ValueError):
        linalg.pca_fit(frame(spark, np.ones((4, 16))), "v", 16, 3)
    with pytest.raises(ValueError):
        mmd.frechet(frame(spark, x[:1]), frame(spark, y), "v", 16)


def test_ridge(spark):
    x = gauss(200)
    y = x @ np.random.default_rng(5).normal(size=(16, 3)) + 1
    df = spark.createDataFrame([(r.tolist(), s.tolist()) for r, s in zip(x, y)], "x array<double>, y array<double>")
    fit = linalg.ridge_fit(df, "x", "y", 16, 3, 0.01)
    xc, yc = x - x.mean(0), y - y.mean(0)
    assert np.allclose(fit["w"], np.linalg.solve(xc.T @ xc + 0.01 * 200 * np.eye(16), xc.T @ yc))
    assert fit["r2"] == pytest.approx(1 - ((yc - xc @ fit["w"]) ** 2).sum() / (yc**2).sum())


def test_samples_are_stable(spark):
    rows = spark.range(100).withColumnRenamed("id", "k")
    a = {r.k for r in sampling.sample(rows, 10, ["k"], 3).collect()}
    assert a == {r.k for r in sampling.sample(rows.repartition(7), 10, ["k"], 3).collect()} and len(a) == 10
    assert a != {r.k for r in sampling.sample(rows, 10, ["k"], 4).collect()}
    assert sampling.distribute(11, 4) == [3, 3, 3, 2]
