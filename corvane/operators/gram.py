"""Sums of outer products of wide rows, by blocks of columns.

A task adds up its rows and sends the blocks of the upper triangle one at a time; a shuffle brings equal blocks together, where they are
added as they come. So a task holds one matrix and a row of the exchange one block, whatever the width, and what is sent grows with the
tasks, which are few, and not with the rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Columns of a block.
BLOCK = 256
#: Rows that are multiplied at once.
ROWS = 1024
PART = "i int, j int, n long, data binary"


def _rows(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[np.ndarray]:
    """Matrices of up to ROWS rows."""
    held: list[np.ndarray] = []
    for b in batches:
        for cell in (b.slice(k, ROWS).column(0) for k in range(0, b.num_rows, ROWS)):
            if (cell.value_lengths().to_numpy(zero_copy_only=False) != width).any():
                raise ValueError("vectors of another width")
            held.append(cell.flatten().to_numpy(zero_copy_only=False).reshape(-1, width))
        if sum(map(len, held)) >= ROWS:
            yield np.concatenate(held)
            held = []
    if held:
        yield np.concatenate(held)


def blocks(vectors: DataFrame, vec: str, width: int, block: int = BLOCK) -> DataFrame:
    """(i, j, n, data): for column blocks i <= j the sum of outer products as doubles row by row, and for i = -1 the sums of columns; n counts the rows.

    Null vectors are an error, and so is another width; an empty table gives sums of 0.
    """
    edges = list(range(0, width, block))

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, s, q = 0, np.zeros(width), np.zeros((width, width))
        for x in _rows(batches, width):
            n, s = n + len(x), s + x.sum(0)
            for a in edges:  # the upper triangle alone
                q[a : a + block, a:] += x[:, a : a + block].T @ x[:, a:]
        told = lambda i, j, m: pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([j], pa.int32()), pa.array([n], pa.int64()), pa.array([np.ascontiguousarray(m).tobytes()], pa.binary())], names=["i", "j", "n", "data"])
        yield told(-1, -1, s)
        for i, a in enumerate(edges):
            for j, b in enumerate(edges[i:], i):
                yield told(i, j, q[a : a + block, b : b + block])

    def together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: dict[tuple[int, int], int] = {}
        total: dict[tuple[int, int], np.ndarray] = {}
        for b in batches:
            for i, j, k, data in zip(*(b.column(c).to_pylist() for c in range(4)), strict=True):
                m = np.frombuffer(data)
                n[i, j], total[i, j] = n.get((i, j), 0) + k, total[i, j] + m if (i, j) in total else m.copy()
        for (i, j), m in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([j], pa.int32()), pa.array([n[i, j]], pa.int64()), pa.array([m.tobytes()], pa.binary())], names=["i", "j", "n", "data"])

    spark = vectors.sparkSession
    v = F.when(F.col(vec).isNotNull() & ~F.exists(F.col(vec), lambda x: x.isNull()), F.col(vec)).otherwise(F.raise_error(F.lit("a null vector or entry")))
    parts = vectors.select(v.cast("array<double>").alias("v")).coalesce(spark.sparkContext.defaultParallelism).mapInArrow(add_up, PART)
    return parts.repartition(min(len(edges) * (len(edges) + 1) // 2 + 1, spark.sparkContext.defaultParallelism), "i", "j").mapInArrow(together, PART)


def moments(vectors: DataFrame, vec: str, width: int, block: int = BLOCK) -> tuple[int, np.ndarray, np.ndarray]:
    """Rows, mean and centred scatter matrix; the driver gets the upper triangle, width * width / 2 numbers."""
    n, s, q = 0, np.zeros(width), np.zeros((width, width))
    for i, j, k, data in blocks(vectors, vec, width, block).toLocalIterator():
        m = np.frombuffer(data)
        if i < 0:
            n, s = k, m
            continue
        a, b = i * block, j * block
        m = m.reshape(min(block, width - a), -1)
        q[a : a + block, b : b + block] = m
        q[b : b + block, a : a + block] = m.T
    if n:
        q -= np.outer(s, s) / n
    return n, s / max(n, 1), q


def entries(vectors: DataFrame, vec: str, width: int, block: int = BLOCK) -> DataFrame:
    """(i, j, value): the sum over all rows of column i times column j, i <= j, from 0."""

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, data in zip(*(b.column(c).to_pylist() for c in (0, 1, 3)), strict=True):
                if i >= 0:
                    m = np.frombuffer(data).reshape(min(block, width - i * block), -1)
                    r, c = np.indices(m.shape)
                    r, c, m = r.ravel() + i * block, c.ravel() + j * block, m.ravel()
                    up = r <= c
                    yield pa.RecordBatch.from_arrays([pa.array(r[up], pa.int32()), pa.array(c[up], pa.int32()), pa.array(m[up])], names=["i", "j", "value"])

    return blocks(vectors, vec, width, block).mapInArrow(spell, "i int, j int, value double")
