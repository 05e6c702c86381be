"""PCA, ridge regression and the figures that training is watched by."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvane.sources.shared import stored

from .gram import moments
from .mmd import median_bandwidth, weighted_rows, weighted_sums
from .sampling import hashed


def pca_fit(vectors: DataFrame, vec: str, width: int, k: int) -> dict:
    """mu, proj (width * k, signs set by the largest entry) and the retained share of variance; an error where k exceeds the rank."""
    n, mu, scatter = moments(vectors, vec, width)
    w, v = np.linalg.eigh(scatter)
    w, v = np.maximum(w[::-1], 0), v[:, ::-1]
    if k > min(n, int((w > 1e-10 * max(w[0], 1e-300)).sum())):
        raise ValueError("more components than the rank has")
    proj = v[:, :k] * np.sign(v[np.abs(v[:, :k]).argmax(0), np.arange(k)])
    return {"mu": mu, "proj": proj, "retained": float(w[:k].sum() / w.sum())}


def pca_apply(vectors: DataFrame, key: str, vec: str, basis: dict) -> DataFrame:
    """(key, vec): (x - mu) * proj; rows of another width are an error. The basis goes to workers once."""
    sent = vectors.sparkSession.sparkContext.broadcast((basis["mu"], basis["proj"]))
    kind = vectors.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mu, proj = sent.value
        for b in batches:
            if b.num_rows:
                x = np.stack(b.column(1).to_numpy(zero_copy_only=False))
                if x.shape[1] != len(mu):
                    raise ValueError("vectors of another width than the basis")
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(list((x - mu) @ proj), pa.list_(pa.float64()))], names=[key, "vec"])

    return vectors.select(key, F.col(vec).cast("array<double>").alias("vec")).mapInArrow(run, f"`{key}` {kind}, vec array<double>")


def ridge_fit(rows: DataFrame, x: str, y: str, wide: int, high: int, lam: float) -> dict:
    """w, mean_x, mean_y and r2 of the ridge regression of y on x with intercept, the penalty being lam times the number of rows."""
    both = rows.select(F.concat(F.col(x).cast("array<double>"), F.col(y).cast("array<double>")).alias("z"))
    n, mu, s = moments(both, "z", wide + high)
    xx, xy, yy = s[:wide, :wide], s[:wide, wide:], s[wide:, wide:]
    w = np.linalg.solve(xx + lam * n * np.eye(wide), xy)
    sse = np.trace(yy) - 2 * np.trace(w.T @ xy) + np.trace(w.T @ xx @ w)
    return {"w": w, "mean_x": mu[:wide], "mean_y": mu[wide:], "r2": float(1 - sse / np.trace(yy))}


def decomposition(anchor: DataFrame, pools: DataFrame, group: str, key: str, vec: str) -> DataFrame:
    """(group, n, bandwidth, kbb, kab): mean kernels within each pool and between it and the anchor, at the anchor's bandwidth."""
    sigma = median_bandwidth(anchor, key, vec, seed=0)
    rows = weighted_rows(pools, group, vec)  # once for both sums
    within = weighted_sums(rows, rows, group, sigma, within=True).select(F.col("g1").alias(group), F.col("n1").alias("n"), (F.col("total") / (F.col("n1") * F.col("n1"))).alias("kbb"))
    one = weighted_rows(anchor.select(F.lit(-1).cast(pools.schema[group].dataType).alias(group), vec), group, vec)
    across = weighted_sums(one, rows, group, sigma).select(F.col("g2").alias(group), (F.col("total") / (F.col("n1") * F.col("n2"))).alias("kab"))
    return within.join(across, group).select(group, "n", F.lit(sigma).alias("bandwidth"), "kbb", "kab")


def group_means(told: DataFrame, group: str) -> DataFrame:
    """(group, n_pools, kbb, kab): means over the pools of each group, each pool alike whatever its size."""
    return told.groupBy(group).agg(F.count("*").alias("n_pools"), F.avg("kbb").alias("kbb"), F.avg("kab").alias("kab"))


#: Rows of a block that gradients are taken over at once.
PROBE_ROWS = 4096


def packed_rows(rows: DataFrame) -> DataFrame:
    """(x, y) blocks of the rows (v, y) as doubles, in the tasks where they lie."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, PROBE_ROWS):
                part = b.slice(k, PROBE_ROWS)
                yield pa.RecordBatch.from_arrays([pa.array([part.column(0).flatten().to_numpy(zero_copy_only=False).tobytes()], pa.binary()), pa.array([part.column(1).to_numpy(zero_copy_only=False).tobytes()], pa.binary())], names=["x", "y"])

    return rows.select("v", "y").mapInArrow(pack, "x binary, y binary")


def total(blocks: DataFrame, f) -> np.ndarray:
    """The sum of f(x, y) over all blocks: by task where they lie, then by the square root of the tasks, then on the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = None
        for b in batches:
            for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                y = np.frombuffer(y)
                g = f(np.frombuffer(x).reshape(len(y), -1), y)
                s = g if s is None else s + g
        if s is not None:
            yield pa.RecordBatch.from_arrays([pa.array([s.tobytes()], pa.binary())], names=["s"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = None
        for b in batches:
            for g in b.column(0).to_pylist():
                s = np.frombuffer(g) if s is None else s + np.frombuffer(g)
        if s is not None:
            yield pa.RecordBatch.from_arrays([pa.array([s.tobytes()], pa.binary())], names=["s"])

    parts, tasks = blocks.mapInArrow(run, "s binary"), blocks.rdd.getNumPartitions()
    if tasks > 64:
        parts = parts.repartition(int(tasks**0.5)).mapInArrow(add, "s binary")
    return sum(np.frombuffer(g) for g in parts.toArrow()["s"].to_pylist())


def probe_accuracy(rows: DataFrame, key: str, vec: str, label: str, seed: int, steps: int = 300) -> float:
    """Accuracy on the held-out half of all rows of a logistic probe, by full gradient steps on all rows of the other half.

    The halves go by seeded order, rows without a key first and rows of one key together. Rows are packed into blocks and kept where they lie; a
    step sends the weights there and the sums of gradients back, so what moves has the width of a vector whatever the number of rows.
    """
    data = stored(rows.select(F.coalesce(hashed(seed, key), F.lit("")).alias("h"), F.col(vec).cast("array<double>").alias("v"), F.col(label).cast("double").alias("y")), "probe")
    # the hash at which the held-out half begins, found by counts of its first digits
    digits = F.substring("h", 1, 4)
    counts = sorted((r.k, r.n) for r in data.groupBy(digits.alias("k")).agg(F.count("*").alias("n")).collect())
    half = sum(n for _, n in counts) // 2
    if not half:
        return float("nan")
    before, k = 0, ""
    for k, n in counts:
        if before + n > half:
            break
        before += n
    edge = data.where(digits == k).select("h").orderBy("h").limit(half - before + 1).agg(F.max("h")).first()[0]
    known = data.where(F.col("h") < edge)
    fit = known.count()
    if not fit:
        return float("nan")
    tasks = min(known.rdd.getNumPartitions(), -(-fit // PROBE_ROWS))
    blocks = packed_rows(known.coalesce(tasks)).persist()
    try:
        mean = total(blocks, lambda x, y: x.sum(0)) / fit
        spread = np.sqrt(total(blocks, lambda x, y: ((x - mean) ** 2).sum(0)) / fit) + 1e-6
        w, decay = np.zeros(len(mean) + 1), np.append(np.full(len(mean), 1e-3), 0.0)
        for _ in range(steps):

            def gradient(x: np.ndarray, y: np.ndarray, w: np.ndarray = w) -> np.ndarray:
                z = (x - mean) / spread
                miss = 1 / (1 + np.exp(-(z @ w[:-1] + w[-1]))) - y
                return np.append(z.T @ miss, miss.sum())

            w = w - 0.1 * (total(blocks, gradient) / fit + decay * w)
    finally:
        blocks.unpersist()

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                told = (np.stack(b.column(0).to_numpy(zero_copy_only=False)) - mean) / spread @ w[:-1] + w[-1] > 0
                right = told == (b.column(1).to_numpy(zero_copy_only=False) > 0.5)
                yield pa.RecordBatch.from_arrays([pa.array([int(right.sum())], pa.int64()), pa.array([b.num_rows], pa.int64())], names=["right", "n"])

    right, n = data.where(F.col("h") >= edge).select("v", "y").mapInArrow(score, "right long, n long").agg(F.sum("right"), F.sum("n")).first()
    return right / n


def best_checkpoints(evals: DataFrame, step: str, val: str, ratio: str, tolerance: float) -> DataFrame:
    """(kind, step): `best` has the least mean validation loss, `best_clean` the least ratio among those within the tolerance of the best loss so far; ties to the earlier."""
    running = F.min(val).over(Window.orderBy(step).rowsBetween(Window.unboundedPreceding, 0))
    told = evals.withColumn("__ok", F.col(val) <= tolerance * running)
    best = told.agg(F.min(F.struct(val, step)).alias("x"), F.min(F.when(F.col("__ok"), F.struct(ratio, step))).alias("y"))
    return best.select(F.explode(F.array(F.struct(F.lit("best").alias("kind"), F.col(f"x.{step}").alias("step")), F.struct(F.lit("best_clean").alias("kind"), F.col(f"y.{step}").alias("step")))).alias("z")).select("z.*")
