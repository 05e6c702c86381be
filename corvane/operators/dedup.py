"""Ordered dedup, bans and the admission of source texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions import text as T
from corvane.sources.shared import cut, stored

#: Rows of a ban up to which it is broadcast.
BROADCAST_ROWS = 100_000


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if it counts at most `rows` rows; beyond that, joins shuffle."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def first_seen(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The first row of each key in the given order. A minimum with partial results, joined back: a key with very many rows meets in no single task.

    Rows of keys and order alone are written once, so their keys aren't computed twice.
    """
    if {*rows.columns} == {*keys, order}:
        rows = cut(rows)
    firsts = rows.groupBy(*keys).agg(F.min(order).alias(order))
    return rows.join(firsts, [*keys, order], "left_semi")


def without(rows: DataFrame, ban: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose keys the ban doesn't hold."""
    return rows.join(small(ban.select(*keys).distinct()), keys, "left_anti")


def ban_grams(texts: DataFrame, text: str = "text", n: int = 13) -> DataFrame:
    """The distinct n-grams of all texts of a ban."""
    return texts.select(F.explode(T.ngrams(F.col(text), n)).alias("g")).distinct()


def sharing_grams(rows: DataFrame, ban: DataFrame, key: str, text: str = "text", n: int = 13) -> DataFrame:
    """The keys of rows that share an n-gram with the ban. Grams meet as hashes first; the few texts that hit are compared in full."""
    grams = ban_grams(ban, text, n)
    hashes = small(grams.select(F.xxhash64("g").alias("h")).distinct())
    mine = rows.select(key, F.explode(F.transform(T.ngrams(F.col(text), n), lambda g: F.struct(F.xxhash64(g).alias("h"), g.alias("g")))).alias("x")).select(key, "x.h", "x.g")
    return mine.join(hashes, "h", "left_semi").join(small(grams), "g", "left_semi").select(key).distinct()


def admit(docs: DataFrame, ban: DataFrame, domains: tuple[str, ...], need: int, ok: Column, order: str = "doc_id", domain: str = "lang", text: str = "text", seen: DataFrame | None = None) -> DataFrame:
    """docs read in order, domain after domain, with `status`: not_viable, duplicate, eval_exact, eval_ngram or admit.

    seen: (__k) keys that were admitted before.
    A domain stops once `need` texts are admitted; rows after that aren't read. Only admitted texts are
    remembered, over all domains. A text that isn't viable is told so whatever it shares with the ban, so
    n-grams are made of the others alone, which are written once. The domains are few and go one after another on the driver. The first
    of equal texts is a minimum with partial results, and the row that fills the need a top-k, so no task
    holds a domain or a large group of copies.
    """
    told = docs.withColumns({"__k": T.folded_key(F.col(text)), "__ok": ok})
    asked = F.when(F.coalesce(F.col("__ok"), F.lit(True)), F.col(text))
    told = stored(told.select(order, domain, "__k", "__ok", asked.alias("__text")), "told")
    grams = sharing_grams(told.where("__text is not null"), ban.select(F.col(text).alias("__text")), order, "__text").withColumn("__gram", F.lit(True))
    exact = small(ban.select(T.folded_key(F.col(text)).alias("__k")).distinct()).withColumn("__exact", F.lit(True))
    told = told.drop("__text").join(exact, "__k", "left").join(grams, order, "left")
    told = cut(told.withColumns({"__exact": F.coalesce("__exact", F.lit(False)), "__gram": F.coalesce("__gram", F.lit(False))}))
    out = None
    for d in domains:
        rows = told.where(F.col(domain) == d)
        rows = rows.join(seen.withColumn("__seen", F.lit(True)), "__k", "left") if seen is not None else rows.withColumn("__seen", F.lit(None).cast("boolean"))
        fresh = F.col("__ok") & ~F.col("__exact") & ~F.col("__gram")
        rows = rows.join(rows.where(fresh).groupBy("__k").agg(F.min(order).alias("__first")), "__k", "left")
        status = F.when(~F.col("__ok"), "not_viable").when(F.col("__seen").isNotNull() | (fresh & (F.col(order) != F.col("__first"))), "duplicate").when(F.col("__exact"), "eval_exact").when(F.col("__gram"), "eval_ngram").otherwise("admit")
        rows = rows.withColumn("status", status)
        # the row that fills the need: the need-th smallest in order among the admitted
        last = rows.where("status = 'admit'").select(order).orderBy(order).limit(need).agg(F.max(order).alias("last"), F.count("*").alias("n"))
        rows = cut(rows.crossJoin(F.broadcast(last)).where((F.col("n") < need) | (F.col(order) <= F.col("last"))).select(order, domain, "__k", "status"))
        out = rows if out is None else out.unionByName(rows)
        mine = rows.where("status = 'admit'").select("__k")
        seen = mine if seen is None else seen.unionByName(mine)
    return out


def admit_shards(spark: SparkSession, shards: dict[str, list[str]], ban: DataFrame, need: int, ok: Column, order: str = "doc_id", domain: str = "lang", text: str = "text", prepare=None, first: int | None = None) -> DataFrame:
    """What admit() tells of the Parquet shards of each domain, read in the order given and no further than the need is met.

    Shards are taken in growing batches: `first` of them (one for each core unless given), then as many as the need asks for at the rate so
    far, at most twice the last batch. So files behind the batch that meets the need are never opened. prepare: what is done to the rows of a batch before `ok` can look at them.
    """
    out = seen = None
    for d, files in shards.items():
        got, at, step = 0, 0, first or spark.sparkContext.defaultParallelism
        while at < len(files) and got < need:
            rows = spark.read.parquet(*files[at : at + step]).withColumn(domain, F.lit(d))
            at += step
            told = admit(prepare(rows) if prepare else rows, ban, (d,), need - got, ok, order, domain, text, seen)
            mine = told.where("status = 'admit'").select("__k")
            got += mine.count()
            out = told if out is None else out.unionByName(told)
            seen = mine if seen is None else seen.unionByName(mine)
            step = max(1, min(2 * step, -(-(need - got) * at // max(got, 1))))
    return out
