"""Assembly of a corpus from layers, packed windows, sample files, and the layers of edits."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions import text as T

from corvane.sources.shared import cut, stored

from .dedup import first_seen, small
from .perturb import numbered_pool


@dataclass
class Layer:
    """A source of rows (order column, text, and kept fields) and how its rows are taken."""

    kind: str
    rows: DataFrame
    order: str
    domain: str = ""
    limit: int | None = None
    least_words: int = 0
    keep: tuple[str, ...] = ()


def assemble(base: DataFrame | None, layers: list[Layer], ban: DataFrame | None) -> DataFrame:
    """(text, domain, kind, ordinal, layer, status) of all rows that were read, `added` or why not: short, banned, dup.

    Base rows (text, domain, kind, ordinal) are taken as they are; their keys count as seen. A layer
    stops once it has added `limit` rows, and rows after that aren't read, nor seen by later layers.
    The layers of a recipe are few and go one after another; each is distributed.
    """
    key = T.folded_key(F.col("text"))
    out = base.select("text", "domain", "kind", F.col("ordinal").cast("long").alias("ordinal"), F.lit(-1).alias("layer"), F.lit("added").alias("status")) if base is not None else None
    seen = cut(base.select(key.alias("k"))) if base is not None else None
    bans = small(ban.select(T.folded_key(F.col("text")).alias("k")).distinct()).withColumn("__ban", F.lit(True)) if ban is not None else None
    for i, layer in enumerate(layers):
        # texts are normalized and written once; what decides reads keys alone and meets the texts again by row
        n = F.size(T.split_words(F.col("__n")))
        keyed = layer.rows.select("text", F.col(layer.order).cast("long").alias("ordinal"), T.normalize(F.col("text")).alias("__n"), F.monotonically_increasing_id().alias("row"))
        keyed = stored(keyed.select("text", "ordinal", "row", F.sha2(F.lower("__n"), 256).alias("k"), F.coalesce((n == 0) | (n < layer.least_words), F.lit(True)).alias("short")), "layer")
        rows = keyed.drop("text")
        rows = rows.join(bans, "k", "left") if bans is not None else rows.withColumn("__ban", F.lit(None).cast("boolean"))
        rows = rows.join(small(seen.distinct()).withColumn("__seen", F.lit(True)), "k", "left") if seen is not None else rows.withColumn("__seen", F.lit(None).cast("boolean"))
        fresh = ~F.col("short") & F.col("__ban").isNull() & F.col("__seen").isNull()
        rows = rows.join(rows.where(fresh).groupBy("k").agg(F.min("ordinal").alias("__first")), "k", "left")
        status = F.when(F.col("short"), "short").when(F.col("__ban").isNotNull(), "banned").when(F.col("__seen").isNotNull() | (fresh & (F.col("ordinal") != F.col("__first"))), "dup").otherwise("added")
        rows = stored(rows.select("row", "ordinal", "k", status.alias("status")), "status")
        if layer.limit is not None:
            last = rows.where("status = 'added'").select("ordinal").orderBy("ordinal").limit(layer.limit).agg(F.max("ordinal").alias("last"), F.count("*").alias("n"))
            rows = rows.crossJoin(F.broadcast(last)).where((F.col("n") < layer.limit) | (F.col("ordinal") <= F.col("last")))
        added = rows.where("status = 'added'").select("k")
        seen = added if seen is None else seen.unionByName(added)
        told = keyed.select("row", "text").join(rows.select("row", "ordinal", "status"), "row")
        told = told.select("text", F.lit(layer.domain).alias("domain"), F.lit(layer.kind).alias("kind"), "ordinal", F.lit(i).alias("layer"), "status")
        out = told if out is None else out.unionByName(told)
    return out


def dry_run(layers: list[Layer]) -> DataFrame:
    """(layer, kind, domain, least_words, most, n_rows, n_texts) of a recipe, without a text being normalized: rows of each layer, those with a text, and its limit (null: none)."""
    out = None
    for i, layer in enumerate(layers):
        told = layer.rows.agg(F.count("*").alias("n_rows"), F.count_if(F.coalesce(F.col("text"), F.lit("")) != "").alias("n_texts"))
        told = told.select(F.lit(i).alias("layer"), F.lit(layer.kind).alias("kind"), F.lit(layer.domain).alias("domain"), F.lit(layer.least_words).alias("least_words"), F.lit(layer.limit).cast("int").alias("most"), "n_rows", "n_texts")
        out = told if out is None else out.unionByName(told)
    return out


def layer_counts(rows: DataFrame) -> DataFrame:
    """(kind, domain, n): rows of each kind and domain."""
    return rows.groupBy("kind", "domain").agg(F.count("*").alias("n"))


def prefix_sums(rows: DataFrame, order: list[str], size: Column, width: int = 4096) -> DataFrame:
    """rows with `before`: the sum of sizes of all rows before, in order. The first order column is a number; stretches of `width` of it add up by themselves, and only their totals meet."""
    ranged = rows.withColumn("__size", size).withColumn("__r", F.floor(F.col(order[0]) / width))
    inner = F.sum("__size").over(Window.partitionBy("__r").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    totals = ranged.groupBy("__r").agg(F.sum("__size").alias("t"))
    shifts = totals.select("__r", (F.sum("t").over(Window.orderBy("__r")) - F.col("t")).alias("__shift"))
    summed = ranged.withColumn("__in", F.coalesce(inner, F.lit(0))).join(shifts, "__r")
    return summed.withColumn("before", (F.col("__in") + F.col("__shift")).cast("long")).drop("__size", "__r", "__in", "__shift")


def packed_windows(docs: DataFrame, order: list[str], tokens: Column, window: int, end: str) -> DataFrame:
    """(window, text): token streams of all documents in order, each closed by `end`, cut into full windows; the one that would end the stream exactly is left out. `end` is left out of texts."""
    rows = prefix_sums(docs.withColumn("__t", F.concat(tokens, F.array(F.lit(end)))), order, F.size(F.concat(tokens, F.array(F.lit(end)))))
    total = rows.agg(F.max(F.col("before") + F.size("__t")).alias("total"))
    # a document meets the windows from its first to its last token, and sends each its slice
    first, last = F.floor(F.col("before") / window), F.floor((F.col("before") + F.size("__t") - 1) / window)
    cut = rows.withColumn("window", F.explode(F.sequence(first, last)))
    start = F.greatest(F.col("window") * window - F.col("before"), F.lit(0))
    stop = F.least((F.col("window") + 1) * window - F.col("before"), F.size("__t"))
    parts = cut.select("window", "before", F.slice("__t", (start + 1).cast("int"), (stop - start).cast("int")).alias("x"))
    whole = parts.groupBy("window").agg(F.array_sort(F.collect_list(F.struct("before", "x"))).alias("p"))
    told = whole.crossJoin(F.broadcast(total)).where((F.col("window") + 1) * window < F.col("total"))
    flat = F.flatten(F.transform("p", lambda p: p["x"]))
    return told.select("window", F.array_join(F.filter(flat, lambda t: t != end), " ").alias("text"))


def sample_rows(rows: DataFrame, order: list[str], text: str, model: str, run_id: str, seed: int) -> DataFrame:
    """(sample_id, text, model, run_id, seed) of non-empty texts, numbered in order after the empty ones are gone."""
    kept = rows.withColumn("__t", T.normalize(F.col(text))).where("__t <> ''")
    numbered = prefix_sums(kept, order, F.lit(1))
    return numbered.select(F.format_string("%s:%06d", F.lit(run_id), F.col("before")).alias("sample_id"), F.col("__t").alias("text"), F.lit(model).alias("model"), F.lit(run_id).alias("run_id"), F.lit(seed).alias("seed"))


def split_samples(content: Column, separator: str | None = None) -> Column:
    """The samples of a file's text: by separator; else by lines `--- Sample N ---`; else line by line."""
    if separator:
        return F.split(content, f"\\Q{separator}\\E", -1)
    marked = F.split(content, r"(?m)^--- Sample \d+ ---[ \t]*$", -1)
    return F.when(F.size(marked) > 1, F.slice(marked, F.lit(2), F.greatest(F.size(marked) - 1, F.lit(1)))).otherwise(F.split(content, r"\r?\n", -1))


def splice_mix(parents: DataFrame, sources: DataFrame, key: str, normal: str, low: float, high: float, sizes: tuple[int, ...], per_parent: int, seed: int, least_words: int = 5) -> DataFrame:
    """(key, round, domain, text): of each parent of four sentences or more, `per_parent` texts with a share of sentences replaced by those of two or three sources by turns.

    sources: (model, sentence). Sentences are numbered within each source; draws are by number.
    """
    from .sampling import hashed

    models = sorted(r["model"] for r in sources.select("model").distinct().collect())  # sources have names, few
    pools, totals = None, {}
    for m in models:
        pool, totals[m] = numbered_pool(sources.where((F.col("model") == m) & (F.size(T.split_words(F.col("sentence"))) >= least_words)).select("sentence", "ordinal"), ["ordinal"], F.floor(F.col("ordinal") / 4096))
        pool = pool.select(F.lit(m).alias("model"), "n", "sentence")
        pools = pool if pools is None else pools.unionByName(pool)
    unit = lambda tag, *k: F.conv(F.substring(hashed(f"{seed}{tag}", *k), 1, 8), 16, 10).cast("long")
    rows = parents.select(key, T.sentences(F.col(normal)).alias("s")).where(F.size("s") >= 4).withColumn("round", F.explode(F.sequence(F.lit(0), F.lit(per_parent - 1))))
    n = F.size("s")
    share = F.lit(low) + (high - low) * (unit("u", key, "round") % 10000) / 10000.0
    k = F.least(F.greatest(F.lit(2), F.bround(n * share).cast("int")), n - 1)
    many = F.get(F.array(*map(F.lit, sizes)), (unit("n", key, "round") % len(sizes)).cast("int"))
    order = lambda items, tag: F.transform(F.array_sort(F.transform(items, lambda x: F.struct(F.sha2(F.concat(F.lit(f"{seed}{tag}:"), F.col(key).cast("string"), F.lit(":"), F.col("round").cast("string"), F.lit(":"), x.cast("string")), 256).alias("h"), x.alias("x")))), lambda x: x["x"])
    rows = rows.withColumn("m", F.slice(order(F.array(*map(F.lit, models)), "m"), F.lit(1), F.least(many, F.lit(len(models))))).withColumn("c", F.slice(order(F.sequence(F.lit(0), n - 1), "c"), F.lit(1), k))
    draws = rows.select(key, "round", "m", F.posexplode("c").alias("j", "i")).withColumn("model", F.get("m", F.col("j") % F.size("m")))
    sizes_of = F.create_map(*[F.lit(x) for kv in totals.items() for x in kv])
    draws = draws.withColumn("n", (unit("d", key, "round", "i") % sizes_of[F.col("model")]).cast("long")).join(pools, ["model", "n"])
    new = draws.groupBy(key, "round").agg(F.map_from_entries(F.collect_list(F.struct("i", "sentence"))).alias("d"))
    out = rows.join(new, [key, "round"]).withColumn("text", F.array_join(F.transform("s", lambda s, i: F.coalesce(F.col("d")[i], s)), " "))
    return out.select(key, "round", F.array_join("m", "+").alias("domain"), "text")


def edit_layer(parents: DataFrame, edits: DataFrame, reserve: float, per_family: int, seed: int, benign: str = "benign_paraphrase") -> DataFrame:
    """(text, domain, kind) of trained parents, capped harmful edits of each family and benign edits, without repeats.

    parents: (parent_id, text, domain); edits: (parent_id, family, ordinal, text). A seeded share of parents is reserved, and so are its edits.
    """
    from .sampling import rank, sample

    total = parents.count()
    n = max(1, round(reserve * total))
    reserved = sample(parents.select("parent_id"), n, ["parent_id"], seed)
    trained = parents.join(small(reserved), "parent_id", "left_anti")
    changed = edits.join(trained.select("parent_id", F.col("text").alias("clean")), "parent_id").where(T.normalize(F.col("text")) != T.normalize(F.col("clean")))
    harmful = changed.where(F.col("family") != benign).withColumn("k", rank(["family"], seed, ["parent_id", "ordinal"])).where(F.col("k") <= per_family)
    rows = trained.select("text", "domain", F.lit("clean_parent").alias("kind"), F.lit(0).alias("o1"), F.col("parent_id").cast("string").alias("o2"), F.lit(0).cast("long").alias("o3"))
    rows = rows.unionByName(harmful.select("text", F.lit("perturbed").alias("domain"), F.concat(F.lit("pert_"), "family").alias("kind"), F.lit(1).alias("o1"), F.col("family").alias("o2"), F.col("k").cast("long").alias("o3")))
    rows = rows.unionByName(changed.where(F.col("family") == benign).select("text", F.lit("perturbed").alias("domain"), F.lit(benign).alias("kind"), F.lit(2).alias("o1"), F.col("parent_id").cast("string").alias("o2"), F.col("ordinal").cast("long").alias("o3")))
    rows = cut(rows)
    keyed = rows.withColumns({"k": T.folded_key(F.col("text")), "o": F.struct("o1", "o2", "o3")})
    return first_seen(keyed, ["k"], "o").select("text", "domain", "kind")
