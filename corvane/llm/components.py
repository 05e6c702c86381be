"""Connected components of a table of links, by alternating large and small stars over locally contracted links."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import erase, release, written

#: Links that a task holds at once to contract them.
LOCAL_LINKS = 1 << 18


class Union:
    """Disjoint sets of nodes, each named by its smallest."""

    def __init__(self):
        self.up: dict = {}

    def find(self, x):
        while (y := self.up.get(x, x)) != x:
            self.up[x] = x = self.up.get(y, y)
        return x

    def join(self, x, y) -> None:
        x, y = self.find(x), self.find(y)
        if x != y:
            self.up[max(x, y)] = min(x, y)


def contracted(edges: DataFrame) -> DataFrame:
    """Fewer links (u > v) with the same components: every LOCAL_LINKS links of a task become stars around their smallest nodes. Nothing is shuffled."""

    def stars(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        sets = Union()
        for b in held:
            for u, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                sets.join(u, v)
        nodes = list(sets.up)
        return pa.RecordBatch.from_arrays([pa.array(nodes, held[0].schema.field(0).type), pa.array([sets.find(x) for x in nodes], held[0].schema.field(1).type)], names=["u", "v"])

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in rows:
            held.append(b)
            n += b.num_rows
            if n >= LOCAL_LINKS:
                yield stars(held)
                held, n = [], 0
        if held:
            yield stars(held)

    return edges.select("u", "v").mapInArrow(run, edges.select("u", "v").schema)


def stars_only(edges: DataFrame) -> bool:
    """Whether every node of the links (u > v) has either one smaller neighbour or larger ones alone, as the smallest of a component."""
    none = F.lit(None).cast(edges.schema["v"].dataType)
    ends = edges.select(F.col("u").alias("x"), "v", F.lit(0).alias("down")).unionByName(edges.select(F.col("v").alias("x"), none.alias("v"), F.lit(1).alias("down")))
    return ends.groupBy("x").agg(F.min("v").alias("v0"), F.max("v").alias("v1"), F.max("down").alias("down")).where("v0 <> v1 or v0 is not null and down = 1").isEmpty()


def _fewer(edges: DataFrame) -> tuple[DataFrame, str, bool]:
    """Contracted where they lie, and again in as many tasks as blocks of LOCAL_LINKS: a table with its path, and whether one block held all links, which makes them stars.

    With more blocks, links are dealt by hash first, so that they meet others than before.
    """
    spark = edges.sparkSession
    once, path = written(contracted(edges), "links")
    blocks = once.count() // LOCAL_LINKS + 1
    if blocks == 1:
        out, at = written(contracted(once.coalesce(1)), "links")
    else:
        out, at = written(contracted(once.distinct()), "links")
    erase(spark, path)
    return out, at, blocks == 1


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of the links (u, v); root is the smallest node reachable.

    Each round sends every node's larger neighbours, then its smaller ones, to its smallest neighbour, until
    only stars are left or one block of LOCAL_LINKS holds what is left of the links; the number of rounds grows with the logarithm of the number of nodes. Minima have partial
    sums and are written before the joins back to them, so that adaptive execution can split the rows of a node with very many links.
    Links of a node to itself and repeated links change nothing; an empty table gives an empty one.
    """
    spark = links.sparkSession
    edges, at, whole = _fewer(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v"))
    while not whole and not stars_only(edges):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least, path1 = written(both.groupBy("u").agg(F.least("u", F.min("v")).alias("m")), "least")
        large, path2 = written(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large")
        least, path3 = written(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        told = small.unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        last = at
        edges, at, whole = _fewer(told)
        erase(spark, path1, path2, path3, last)
        del both, least, large, small, told
        release(spark)
    roots = edges.select(F.col("u").alias("node"), F.col("v").alias("root")).distinct()
    return roots.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
