"""Mixing sources to target weights by subset-sum budget fitting.

Documents are counted by source and exact size. Each source's target is whole passes over it plus a
remaining budget; bounded-knapsack dynamic programming over the counts says how many documents of
each size the remaining budget takes, and a seeded order picks them. Only counts meet in one place;
documents of one source and size, however many, are ranked in seeded slices.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, words_of

WEIGHTS = (5, 2, 1)
#: No document is taken more often.
MOST_PASSES = 3
#: Seeded slices of the documents of one source and size.
SLICES = 4096
#: The part of a budget that dynamic programming fits exactly, in words.
DP_WORDS = 1 << 16


def fit(sizes: np.ndarray, counts: np.ndarray, budget: int, dp_words: int = DP_WORDS) -> np.ndarray:
    """How many documents of each size (distinct, positive) to take so that their words come nearest to the budget from below.

    The table has dp_words places. What a budget has beyond them is taken as the same share of every size, and what rounding leaves beyond
    them as whole documents; the table fits the rest. So budgets within it are met as well as any choice can.
    """
    total = sum(int(s) * int(c) for s, c in zip(sizes, counts, strict=True))
    if budget >= total:
        return counts.copy()
    beyond = max(0, budget - dp_words)
    take = np.array([int(c) * beyond // total for c in counts], np.int64)
    spare = counts - take
    rest = budget - sum(int(s) * int(t) for s, t in zip(sizes, take, strict=True))
    for i in np.argsort(-sizes, kind="stable"):  # what is beyond the table goes to whole documents, large ones first
        if rest <= dp_words:
            break
        t = min(int(spare[i]), (rest - dp_words) // int(sizes[i]))
        take[i] += t
        spare[i] -= t
        rest -= t * int(sizes[i])
    reached, by = np.zeros(rest + 1, bool), np.full(rest + 1, -1, np.int64)
    reached[0] = True
    items: list[tuple[int, int]] = []  # size index and number of documents: each count in binary parts
    for i in np.nonzero((spare > 0) & (sizes <= rest))[0]:
        left, part = min(int(spare[i]), rest // int(sizes[i])), 1
        while left and not reached[rest]:
            n = min(part, left)
            w = n * int(sizes[i])
            if w <= rest:
                new = np.nonzero(reached[: rest + 1 - w] & ~reached[w:])[0] + w
                by[new] = len(items)
                reached[new] = True
                items.append((int(i), n))
            left, part = left - n, part * 2
        if reached[rest]:
            break
    at = int(np.nonzero(reached)[0][-1])
    while at:  # a sum was first reached from one that earlier parts reach
        i, n = items[by[at]]
        take[i] += n
        at -= n * int(sizes[i])
    return take


def numbered(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """rows with their numbers from 0 in order: those within ranges behind the counts of the ranges before, of which there are as many as partitions."""
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    ranged = cut(ranged.withColumns({"__part": F.spark_partition_id(), "__in": F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)}))
    counts = ranged.groupBy("__part").agg(F.count("*").alias("__n"))
    ahead = counts.select("__part", (F.sum("__n").over(Window.orderBy("__part")) - F.col("__n")).alias("__ahead"))
    return ranged.join(F.broadcast(ahead), "__part").withColumn(name, F.col("__ahead") + F.col("__in")).drop("__part", "__in", "__ahead")


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_PASSES) -> DataFrame:
    """sources (__none, __src, source_size) with `target`: shares by weight of the sum of sizes, none above `most` times its size.

    Sources in code point order, null last, take the weights in turn. What is above a cap is shared again by weight among the others
    until none is: each round sums the caps that the level fills and the weights of the others. Sources are never in one task; the
    driver gets two sums a round.
    """
    told = numbered(sources, ["__none", "__src"], "__k")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("__k") % len(weights) + 1).cast("int"))
    told = cut(told.select("__none", "__src", "source_size", weight.alias("__w"), (F.col("source_size") * float(most)).alias("__cap")))
    everything, level, last = told.agg(F.coalesce(F.sum("source_size"), F.lit(0)).cast("double")).first()[0], 0.0, -1.0
    while level > last:  # it rises with each source that fills, and stays once none does
        full = F.col("__cap") < F.lit(level) * F.col("__w")
        caps, open_ = told.agg(F.coalesce(F.sum(F.when(full, F.col("__cap"))), F.lit(0.0)), F.coalesce(F.sum(F.when(~full, F.col("__w"))), F.lit(0.0))).first()
        last, level = level, (everything - caps) / open_ if open_ else level
    return told.select("__none", "__src", "source_size", F.least(F.col("__cap"), F.lit(level) * F.col("__w")).alias("target"))


def mix(docs: DataFrame, seed: int = 0, text: str = "text", source: str = "source", key: str = "doc_id", weights: tuple[int, ...] = WEIGHTS, most: int = MOST_PASSES, dp_words: int = DP_WORDS) -> DataFrame:
    """key, size, source_size, target, taken for each row of docs.

    Null texts have size 0; null sources form one source, last in order; equal rows are ranked in any
    order, which leaves the same rows; an empty table gives an empty result. taken is a multiple of
    size, from 0 to `most` times it. The same seed takes the same documents.
    """
    t = F.col(text)
    rows = docs.select(F.col(key).alias("__key"), F.col(source).isNull().alias("__none"), F.coalesce(F.col(source), F.lit("")).alias("__src"), F.size(words_of(t)).cast("long").alias("size"), F.xxhash64(F.lit(seed), F.col(key), t).alias("__order"))
    rows = cut(rows.withColumn("__slice", F.pmod("__order", F.lit(SLICES)).cast("int")))
    sliced = rows.groupBy("__none", "__src", "size", "__slice").agg(F.count("*").alias("__n"))
    counts = cut(rows.groupBy("__none", "__src", "size").agg(F.count("*").alias("__c")))
    sources = counts.groupBy("__none", "__src").agg(F.sum(F.col("size") * F.col("__c")).alias("source_size"))
    goals = cut(targets(sources, weights, most))

    def plan(p: pd.DataFrame) -> pd.DataFrame:
        total, target = int(p["source_size"].iloc[0]), float(p["target"].iloc[0])
        passes = min(int(target // total), most) if total else 0
        budget = round(target) - passes * total if passes < most else 0
        use = (p["size"] > 0).to_numpy()
        extra = np.zeros(len(p), np.int64)
        extra[use] = fit(p["size"].to_numpy(np.int64)[use], p["__c"].to_numpy(np.int64)[use], max(0, budget), dp_words) if total else 0
        return p.assign(__passes=passes, __extra=extra)

    schema = "__none boolean, __src string, size long, __c long, source_size long, target double, __passes long, __extra long"
    plans = counts.join(goals, ["__none", "__src"]).select("__none", "__src", "size", "__c", "source_size", "target")
    plans = plans.groupBy("__none", "__src").applyInPandas(lambda p: plan(p.sort_values("size", kind="stable")), schema)
    run = Window.partitionBy("__none", "__src", "size").orderBy("__slice")
    until = sliced.withColumn("__until", F.sum("__n").over(run)).join(plans, ["__none", "__src", "size"])
    quota = until.select("__none", "__src", "size", "__slice", "source_size", "target", "__passes", (F.col("__extra") - (F.col("__until") - F.col("__n"))).alias("__quota"))
    ranked = rows.withColumn("__rank", F.row_number().over(Window.partitionBy("__none", "__src", "size", "__slice").orderBy("__order", "__key")))
    out = ranked.join(quota, ["__none", "__src", "size", "__slice"])
    taken = F.col("size") * (F.col("__passes") + (F.col("__rank") <= F.col("__quota")).cast("long"))
    return out.select(F.col("__key").alias(key), "size", "source_size", "target", taken.alias("taken"))
