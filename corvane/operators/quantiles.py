"""Exact quantiles of groups of any size, by ranges that are refined over counts.

Each round takes pivots of the open ranges from a sketch, counts the rows at and between them, and goes on in the ranges that hold a
wanted rank. What meets in one task are counts, some hundred of a range, so neither a large group nor a value that most of its rows have does.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvane.sources.shared import cut

from .dedup import BROADCAST_ROWS

#: Pivots of a range; a round leaves about this part of its rows.
PIVOTS = 64


def quantiles(rows: DataFrame, group: str, value: str, shares: dict[str, float], pivots: int = PIVOTS) -> DataFrame:
    """(group, n, a column for each share): the value at share * (n - 1) of the group's n sorted values, between two values in proportion.

    Nulls and NaN are left out (between an infinity and another value stands NaN), and so are groups without other values; a null group is one. The values are written once, as doubles, and
    read twice a round; the rounds are the logarithm of the rows to the base of the pivots, each at least takes the pivots away.
    """
    data = cut(rows.select(F.struct(F.col(group).alias("g")).alias("g"), F.col(value).cast("double").alias("v")).where("v is not null and not isnan(v)"))  # a struct equals itself with a null in it, too
    sizes = cut(data.groupBy("g").agg(F.count("*").alias("n")))
    few = BROADCAST_ROWS // (2 * len(shares))  # a group has two ranges for each share at most
    near = F.broadcast if sizes.limit(few + 1).count() <= few else lambda d: d
    wanted = F.array(*[F.struct(F.lit(i).alias("i"), (F.lit(float(s)) * (F.col("n") - 1)).alias("at")) for i, s in enumerate(shares.values())])
    places = sizes.select("g", F.explode(wanted).alias("w")).select("g", "w.i", "w.at", F.floor("w.at").alias("low"), F.ceil("w.at").alias("high"))
    nothing = F.lit(None).cast("double")
    now = cut(places.select("g", F.explode(F.array("low", "high")).alias("rank")).distinct().select("g", "rank", F.lit(0).cast("long").alias("below"), nothing.alias("lo"), nothing.alias("hi")))
    found = now.select("g", "rank", nothing.alias("value")).where("false")
    inside = (F.col("lo").isNull() | (F.col("v") > F.col("lo"))) & (F.col("hi").isNull() | (F.col("v") < F.col("hi")))
    levels = F.lit([(k + 0.5) / pivots for k in range(pivots)])
    smaller = F.aggregate("p", F.lit(0), lambda a, x: a + (x < F.col("v")).cast("int"))
    slot = (2 * smaller + F.coalesce(F.get("p", smaller) == F.col("v"), F.lit(False)).cast("int")).alias("slot")  # even: between pivots, odd: at one
    while not now.isEmpty():
        ranges = near(now.select("g", "below", "lo", "hi").distinct())
        pivot = F.array_sort(F.array_distinct(F.percentile_approx("v", levels, F.lit(20 * pivots)))).alias("p")
        cuts = near(cut(data.join(ranges, "g").where(inside).groupBy("g", "below", "lo", "hi").agg(pivot)))
        counted = data.join(cuts, "g").where(inside).select("g", "below", "lo", "hi", "p", slot).groupBy("g", "below", "lo", "hi", "p", "slot").agg(F.count("*").alias("c"))
        upto = F.col("below") + F.sum("c").over(Window.partitionBy("g", "below").orderBy("slot"))
        counted = counted.select("g", "below", "lo", "hi", "p", "slot", (upto - F.col("c")).alias("first"), upto.alias("end"))
        k = F.floor(F.col("slot") / 2).cast("int")
        moved = now.select("g", "rank", "below").join(counted, ["g", "below"]).where("rank >= first and rank < end")
        moved = cut(moved.select("g", "rank", F.col("first").alias("below"), F.coalesce(F.when(k > 0, F.get("p", k - 1)), F.col("lo")).alias("lo"), F.coalesce(F.get("p", k), F.col("hi")).alias("hi"), F.when(F.col("slot") % 2 == 1, F.get("p", k)).alias("value")))
        found = found.unionByName(moved.where("value is not null").select("g", "rank", "value"))
        now = moved.where("value is null").drop("value")
    told = places.join(found.select("g", F.col("rank").alias("low"), F.col("value").alias("a")), ["g", "low"]).join(found.select("g", F.col("rank").alias("high"), F.col("value").alias("b")), ["g", "high"])
    between = F.when(F.col("a") == F.col("b"), F.col("a")).otherwise(F.col("a") + (F.col("b") - F.col("a")) * (F.col("at") - F.col("low")))
    wide = told.groupBy("g").agg(*[F.max(F.when(F.col("i") == i, between)).alias(name) for i, name in enumerate(shares)])
    return sizes.join(wide, "g").select(F.col("g.g").alias(group), "n", *shares)
