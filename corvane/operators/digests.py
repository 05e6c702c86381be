"""Digests of ordered corpora."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def corpus_hashes(rows: DataFrame, group: str, order: str, text: str) -> DataFrame:
    """(group, corpus_hash, n): the SHA-256 of the lines that the SHA-256s of a group's texts make, in order.

    Texts are hashed where they lie; their digests, 64 characters each, are sorted and run through one state, so a task holds a batch
    of them whatever the group's size. The digest of a group is a chain, so one task makes it; groups are dealt to all. Null
    texts count as empty; equal orders go by digest; null groups are one.
    """
    digests = rows.select(F.col(group).alias("g"), F.col(order).alias("o"), F.sha2(F.coalesce(F.col(text), F.lit("")), 256).alias("h"))
    kind = rows.schema[group].dataType.simpleString()
    sorted_ = digests.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "g").sortWithinPartitions("g", "o", "h").select("g", "h")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, now, n = None, None, 0

        def told() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([now], sort), pa.array([state.hexdigest()]), pa.array([n], pa.int64())], names=["g", "corpus_hash", "n"])

        for b in batches:
            sort = b.schema.field(0).type
            for g, h in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if state is None or g != now:
                    if state is not None:
                        yield told()
                    state, now, n = hashlib.sha256(), g, 0
                else:
                    state.update(b"\n")
                state.update(h.encode())
                n += 1
        if state is not None:
            yield told()

    return sorted_.mapInArrow(run, f"g {kind}, corpus_hash string, n long").withColumnRenamed("g", group)
