"""The probe is fitted on all rows of one half and scored on all of the other."""

from __future__ import annotations

import numpy as np
import pytest

from corvane.operators import linalg
from corvane.operators.sampling import hashed


def plain(rows: list[tuple], steps: int) -> float:
    x, y = np.array([r[1] for r in rows]), np.array([r[2] for r in rows])
    half = len(x) // 2
    fit = half
    mean, spread = x[:fit].mean(0), x[:fit].std(0) + 1e-6
    z = np.concatenate([(x - mean) / spread, np.ones((len(x), 1))], 1)
    w = np.zeros(z.shape[1])
    for _ in range(steps):
        miss = 1 / (1 + np.exp(-z[:fit] @ w)) - y[:fit]
        w = w - 0.1 * (z[:fit].T @ miss / fit + np.append(np.full(x.shape[1], 1e-3), 0.0) * w)
    return float(((z[half:] @ w > 0) == (y[half:] > 0.5)).mean())


@pytest.mark.parametrize("n", [2, 61, 400, 1001])
def test_all_rows_count(spark, n, monkeypatch):
    monkeypatch.setattr(linalg, "PROBE_ROWS", 50)
    r = np.random.default_rng(3)
    y = r.integers(0, 2, n)
    x = r.normal(size=(n, 4)) + 0.4 * y[:, None]
    df = spark.createDataFrame([(i, x[i].tolist(), float(y[i])) for i in range(n)], "k long, v array<double>, y double").repartition(3)
    rows = [(q.k, q.v, q.y) for q in df.withColumn("h", hashed(7, "k")).orderBy("h").collect()]
    assert linalg.probe_accuracy(df, "k", "v", "y", 7, 30) == pytest.approx(plain(rows, 30), abs=1e-12)
