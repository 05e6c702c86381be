"""Seeded ranks, samples and splits.

Order is that of a hash of seed and key, so the same rows are taken however they are partitioned. It
gives the sizes and the independence that draws from a generator have, not the same draws.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.sources.shared import cut


def hashed(seed: int | str, *keys: Column | str) -> Column:
    told = [F.lit(str(seed))]
    for k in keys:
        told += [F.lit(":"), (F.col(k) if isinstance(k, str) else k).cast("string")]
    return F.sha2(F.concat(*told), 256)


def rank(by: list[str], seed: int | str, keys: list[str]) -> Column:
    """1-based places within the groups `by`, in seeded order, ties by the last key."""
    return F.row_number().over(Window.partitionBy(*by).orderBy(hashed(seed, *by, *keys), *keys))


def with_rank(rows: DataFrame, by: list[str], seed: int | str, keys: list[str], name: str) -> DataFrame:
    """rows with `name`, the place that rank() gives less 1, for groups of any size.

    A group is cut by the first three digits of the hash; a slice is ranked by itself and moved up by the counts of the slices before.
    """
    cut = rows.withColumn("__h", hashed(seed, *by, *keys)).withColumn("__s", F.substring("__h", 1, 3))
    counts = cut.groupBy(*by, "__s").agg(F.count("*").alias("__c"))
    shifts = counts.withColumn("__b", F.sum("__c").over(Window.partitionBy(*by).orderBy("__s")) - F.col("__c")).select(*(F.col(c).alias(f"__by{i}") for i, c in enumerate(by)), F.col("__s").alias("__t"), "__b")
    inner = F.row_number().over(Window.partitionBy(*by, "__s").orderBy("__h", *keys)) - 1
    same = F.col("__s") == F.col("__t")
    for i, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"__by{i}"))
    out = cut.withColumn("__i", inner).join(shifts, same)
    return out.withColumn(name, F.col("__i") + F.col("__b")).drop("__h", "__s", "__t", "__b", "__i", *(f"__by{i}" for i in range(len(by))))


#: Rows that one task sorts for a sample, at most.
TOP = 100_000


def sample(rows: DataFrame, n: int, keys: list[str], seed: int | str) -> DataFrame:
    """n rows in seeded order, or all where there are fewer.

    Of up to TOP rows Spark takes the first n of each task and of those the first. For more the hash at which the sample ends is found
    by counts of its first digits, four more at a time, until the rows in doubt are few; the rows are filtered by it where they lie. Rows
    that equal the last one in all keys come with it then.
    """
    told = rows.withColumn("__h", hashed(seed, *keys))
    if n <= TOP:
        return told.orderBy("__h", *keys).limit(n).drop("__h")
    begin, left = "", n
    while True:
        within = told.where(F.col("__h").startswith(begin)) if begin else told
        counts = sorted((r.p, r.c) for r in within.groupBy(F.substring("__h", 1, len(begin) + 4).alias("p")).agg(F.count("*").alias("c")).collect())  # 65,536 rows at most
        for p, c in counts:
            if c >= left:
                break
            left -= c
        else:
            return rows  # all of them
        begin = p
        if c <= TOP or len(begin) == 64:
            break
    tie = F.struct("__h", *keys)
    last = told.where(F.col("__h").startswith(begin)).orderBy("__h", *keys).limit(left).agg(F.max(tie).alias("last"))
    return told.join(F.broadcast(last), tie <= F.col("last")).drop("__h", "last")  # a row


def sample_exactly(rows: DataFrame, n: int, keys: list[str], seed: int | str, forbidden: dict[str, list] | None = None) -> DataFrame:
    """sample() of rows without those that hold a forbidden value; fewer than n such rows are an error."""
    for name, values in (forbidden or {}).items():
        rows = rows.where(~F.coalesce(F.col(name).isin(*values), F.lit(False)))
    found = rows.limit(n).count()
    if found < n:
        raise ValueError(f"{n} rows are asked for, {found} are there")
    return sample(rows, n, keys, seed)


def places(rows: DataFrame, order: str, name: str = "place") -> DataFrame:
    """rows with their place from 0 in order of a column. Rows are dealt by ranges of it; only the ranges' counts meet."""
    dealt = rows.repartitionByRange(order).sortWithinPartitions(order).withColumn("__task", F.spark_partition_id())
    held = cut(dealt)
    counts = held.groupBy("__task").agg(F.count("*").alias("__c"))
    shift = counts.select("__task", (F.sum("__c").over(Window.orderBy("__task")) - F.col("__c")).alias("__b"))  # a row for each range
    inner = F.row_number().over(Window.partitionBy("__task").orderBy(order)) - 1
    return held.withColumn("__i", inner).join(F.broadcast(shift), "__task").withColumn(name, F.col("__i") + F.col("__b")).drop("__task", "__i", "__b")


def val_and_pool(rows: DataFrame, domain: str, key: str, val_per_domain: int, seed: int) -> DataFrame:
    """rows with `part`: `val` for the first of each domain in seeded order, `pool` for the others."""
    first = rows.select(domain, key).withColumn("__n", rank([domain], seed, [key])).where(F.col("__n") <= val_per_domain).select(F.col(domain).alias("__d"), F.col(key).alias("__k"))
    same = F.col(domain).eqNullSafe(F.col("__d")) & F.col(key).eqNullSafe(F.col("__k"))
    return rows.join(first, same, "left").withColumn("part", F.when(F.col("__k").isNotNull(), "val").otherwise("pool")).drop("__d", "__k")


def final_order(rows: DataFrame, key: str, seed: int, name: str = "place") -> DataFrame:
    """rows with their place from 0 in a seeded order of all."""
    return with_rank(rows, [], seed, [key], name)


def scheduled(epoch: int, base: dict, schedule: list[dict]) -> tuple[dict, dict]:
    """Repeats by kind and by source in an epoch: the base ones, overridden by every entry of the schedule whose first and last epoch (both count) hold it."""
    told = [base, *(x for x in schedule if x["epochs"][0] <= epoch <= x["epochs"][1])]
    kinds, sources = ({k: v for x in told for k, v in (x.get(n) or {}).items()} for n in ("repeat_kinds", "repeat_sources"))
    return kinds, sources


def epochs(rows: DataFrame, number: int, base: dict, schedule: list[dict], kind: str, source: str) -> DataFrame:
    """rows of each epoch, from 0, with `epoch` and `copy`, each as often as the epoch's repeats ask."""
    out = None
    for e in range(number):
        some = repeats(rows, *scheduled(e, base, schedule), kind, source).withColumn("epoch", F.lit(e))
        out = some if out is None else out.unionByName(some)
    return out


def seeded_rng(*parts) -> np.random.Generator:
    """A generator that any process makes alike, for each sequence of parts its own."""
    return np.random.default_rng([int.from_bytes(hashlib.sha256(str(p).encode()).digest()[:4], "big") for p in parts])


def distribute(total: int, bins: int) -> list[int]:
    """total in bins that differ by at most one, the larger ones first."""
    return [total // bins + (i < total % bins) for i in range(bins)]


def choose_count(total: Column, rate: float) -> Column:
    """The number to choose of `total` at a rate: at least one where there is any and the rate isn't 0."""
    if rate <= 0:
        return F.lit(0)
    return F.when(total == 0, F.lit(0)).otherwise(F.least(total, F.greatest(F.lit(1), F.ceil(total * F.lit(rate)).cast("int"))))


def three_way(rows: DataFrame, domain: str, key: str, domains: tuple[str, ...], parents: int, reference: int, cap: int | None, seed: int, strict: bool = False) -> DataFrame:
    """rows with `part` (mev, ref, unused) and `parent_id`: of each domain in seeded order, its share of parents, its share of references, and the rest up to a cap.

    strict: a domain with fewer rows than its two shares is an error.
    """
    p, r = distribute(parents, len(domains)), distribute(reference, len(domains))
    spec = F.create_map(*[F.lit(x) for i, d in enumerate(domains) for x in (d, p[i])]), F.create_map(*[F.lit(x) for i, d in enumerate(domains) for x in (d, r[i])])
    if strict:
        have = {r_[0]: r_[1] for r_ in rows.where(F.col(domain).isin(*domains)).groupBy(domain).count().collect()}  # a row for each named domain
        few = [d for i, d in enumerate(domains) if have.get(d, 0) < p[i] + r[i]]
        if few:
            raise ValueError(f"too few rows in {few}")
    ranked = rows.where(F.col(domain).isin(*domains)).withColumn("__rank", rank([domain], seed, [key]))
    if cap is not None:  # a bound that tasks apply before the shuffle
        ranked = ranked.where(F.col("__rank") <= max(p) + max(r) + cap)
    ranked = ranked.withColumns({"__n": F.col("__rank") - 1, "__p": spec[0][F.col(domain)], "__q": spec[1][F.col(domain)]}).drop("__rank")
    n, a, b = F.col("__n"), F.col("__p"), F.col("__p") + F.col("__q")
    part = F.when(n < a, "mev").when(n < b, "ref").otherwise("unused")
    place = F.when(n < a, n).when(n < b, n - a).otherwise(n - b)
    out = ranked if cap is None else ranked.where(n < b + cap)
    return out.withColumn("part", part).withColumn("parent_id", F.format_string("%s-%s-%04d", part, F.col(domain), place)).drop("__n", "__p", "__q")


def third(start: Column, end: Column, length: Column, position: str | None) -> Column:
    """Whether a span's middle lies in the named third of the text."""
    if position in (None, "uniform"):
        return F.lit(True)
    thirds = {"early": (0.0, 1 / 3), "middle": (1 / 3, 2 / 3), "late": (2 / 3, 1.01)}
    if position not in thirds:
        raise ValueError(f"unknown position: {position}")
    low, high = thirds[position]
    middle = (start + end) / 2.0 / F.greatest(length, F.lit(1))
    return (middle >= low) & (middle < high)


def cap_kinds(rows: DataFrame, caps: dict[str, int], kind: str, key: str, seed: int, drop: tuple[str, ...] = ()) -> DataFrame:
    """Rows without the dropped kinds, and of capped ones a seeded sample."""
    kept = rows.where(~F.coalesce(F.col(kind).isin(*drop), F.lit(False))) if drop else rows
    if not caps:
        return kept
    most = F.create_map(*[F.lit(x) for kv in caps.items() for x in kv])
    capped = F.coalesce(F.col(kind).isin(*caps), F.lit(False))
    # the largest cap bounds what a task sends of a kind; kinds without a cap aren't ranked
    some = kept.where(capped).withColumn("__n", rank([kind], seed, [key])).where(F.col("__n") <= max(caps.values())).where(F.col("__n") <= most[F.col(kind)]).drop("__n")
    return some.unionByName(kept.where(~capped))


def repeats(rows: DataFrame, by_kind: dict[str, int], by_source: dict[str, int], kind: str, source: str) -> DataFrame:
    """Each row as often as its kind or source asks, whichever is more, at least once; `copy` numbers the copies."""
    times = lambda spec, c: F.coalesce(F.create_map(*[F.lit(x) for kv in spec.items() for x in kv])[F.col(c)], F.lit(1)) if spec else F.lit(1)
    n = F.greatest(F.lit(1), times(by_kind, kind), times(by_source, source))
    return rows.withColumn("copy", F.explode(F.sequence(F.lit(1), n)))


def block_order(rows: DataFrame, groups: list[str], key: str, block: int, seed: int) -> DataFrame:
    """rows with `block`, `block_rank` (a hash that orders blocks) and `in_block`: groups in seeded order cut into blocks."""
    ranked = with_rank(rows, groups, seed, [key], "__n").withColumn("block", (F.col("__n") / block).cast("int"))
    return ranked.withColumn("in_block", (F.col("__n") % block).cast("int")).withColumn("block_rank", hashed(f"{seed}b", *groups, "block")).drop("__n")


def next_walk(rows: DataFrame, key: str, k: int, draws: int, seed: int, n: int) -> DataFrame:
    """(draw, key): `draws` takes of k rows without replacement, in a new order whenever fewer than k are left of n."""
    per = max(1, n // k)
    cycles = -(-draws // per)
    spread = rows.select(key, F.explode(F.sequence(F.lit(0), F.lit(cycles - 1))).alias("cycle"))
    ranked = with_rank(spread, ["cycle"], seed, [key], "__n")
    out = ranked.where(F.col("__n") < per * k).withColumn("draw", (F.col("cycle") * per + F.floor(F.col("__n") / k)).cast("int"))
    return out.where(F.col("draw") < draws).select("draw", key)
