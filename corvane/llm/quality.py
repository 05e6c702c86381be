"""Quality rules: per-text counts and the frequency of lines across the documents of a host.

Only built-in column expressions are used; no Python runs on executors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD_SPACE, cut, small_or_shuffled, words_of

#: A line that more than so many distinct documents of one host hold is boilerplate.
LINE_LIMIT = 20
#: A document that boilerplate lines leave fewer words than this is depleted; the base rules reject texts of fewer.
LEAST_WORDS = 20
#: Rows of a table, or hashes of lines in its rows, up to which it is broadcast.
BROADCAST_ROWS = 100_000
#: Boilerplate lines of all hosts up to which documents are judged where they lie, so that no text is shuffled.
HELD_LINES = 20_000
WINDOW = 8


def let(value: Column, body) -> Column:
    """body(value) with value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def repeat_words(words: Column, n: Column) -> Column:
    """Words that lie in a WINDOW-word window found twice or more, the first included.

    Chained hashes of windows decide whether any can repeat (equal windows have equal hashes);
    only then the windows themselves are sorted and compared.
    """

    def chain(step: int):
        return lambda h: F.transform(h, lambda x, i: F.xxhash64(x, F.get(h, i + F.lit(step))))

    def exact() -> Column:
        keyed = F.array_sort(F.transform(F.sequence(F.lit(0), n - WINDOW), lambda i: F.struct(F.array_join(F.slice(words, i + 1, F.lit(WINDOW)), " ").alias("k"), i.alias("p"))))

        def counted(s: Column) -> Column:
            at = F.array_sort(F.transform(F.filter(s, lambda x, i: (x["k"] == F.get(s, i + 1)["k"]) | (x["k"] == F.get(s, i - 1)["k"])), lambda x: x["p"]))
            zero = F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("end"))
            return F.aggregate(at, zero, lambda a, p: F.struct((a["n"] + F.least(F.lit(WINDOW), p + WINDOW - a["end"])).alias("n"), (p + WINDOW).alias("end")))["n"]

        return let(keyed, counted)

    ones = F.transform(words, lambda w: F.xxhash64(w))
    hashes = let(let(let(ones, chain(1)), chain(2)), chain(4))
    distinct = F.size(F.array_distinct(F.slice(hashes, F.lit(1), F.greatest(n - (WINDOW - 1), F.lit(0)))))
    return F.when(n < WINDOW, F.lit(0)).when(distinct == n - (WINDOW - 1), F.lit(0)).otherwise(F.coalesce(exact(), F.lit(0))).cast("long")


def base_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed (columns of these names are replaced).

    Words and lines are bound within their expressions: were they columns, a filter on the result would carry them into the functions over their elements.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(t, "\n", -1), lambda x: F.btrim(x, F.lit(WORD_SPACE)) != "")
    counted = let(words_of(F.col(text)), lambda w: F.struct(F.size(w).alias("n"), repeat_words(w, F.size(w)).alias("r")))
    return (
        docs.withColumn("__c", counted)
        .withColumns(
            {
                "n_words": F.col("__c.n").cast("long"),
                "word_chars": F.length(F.translate(t, WORD_SPACE, "")).cast("long"),
                "n_symbols": (F.length(t) - F.length(F.translate(t, "#*$%&|<>", ""))).cast("long"),
                "n_dup_lines": let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
                "n_repeat_words": F.col("__c.r"),
            }
        )
        .drop("__c")
        .withColumn("base_failed", (F.col("n_words") < 20) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 30))
    )


def identity(text: str, host: str) -> list[Column]:
    """What the line rule knows a document by: its host and two hashes of its text. Copies on a host are one document."""
    t = F.coalesce(F.col(text), F.lit(""))
    return [F.coalesce(F.col(host), F.lit("")).alias("__host"), F.xxhash64(t).alias("__h1"), F.xxhash64(F.lit(1), t).alias("__h2")]


def normal_lines(t: Column) -> Column:
    """The lines of t, empty ones too, in lower case with single spaces between words."""
    normal = F.lower(F.translate(t, "\t\x0b\x0c\r", "    "))
    return F.transform(F.split(normal, "\n", -1), lambda x: F.array_join(F.array_remove(F.split(x, " ", -1), ""), " "))


def common_lines(each: DataFrame, limit: int) -> DataFrame:
    """(__host, __h, __c): hashes of lines that more than `limit` distinct documents of a host hold, with their counts.

    each: one row for each distinct document of a host, __l: its lines. Counts are summed in part before the shuffle.
    """
    held = each.select("__host", F.explode(F.array_distinct(F.transform("__l", lambda x: x["h"]))).alias("__h"))
    return held.groupBy("__host", "__h").agg(F.count("*").alias("__c")).where(F.col("__c") > limit)


def hashed_lines(text: Column) -> Column:
    """Hash and number of words of each line with a word."""
    return F.transform(F.filter(normal_lines(F.coalesce(text, F.lit(""))), lambda x: x != ""), lambda x: F.struct(F.xxhash64(x).alias("h"), F.size(F.split(x, " ", -1)).alias("n")))


def distinct_documents(docs: DataFrame, text: str, host: str) -> DataFrame:
    """(__host, __h1, __h2, __l: hash and number of words of each line) of the distinct documents of each host that have lines."""
    each = docs.select(*identity(text, host), hashed_lines(F.col(text)).alias("__l")).where(F.size("__l") > 0)
    return each.dropDuplicates(["__host", "__h1", "__h2"])


def lines_found(docs: DataFrame, text: str, host: str, limit: int) -> tuple[DataFrame, DataFrame]:
    """Distinct documents with their lines, and the boilerplate lines of the hosts (__host, __h); both are written, as they are read twice."""
    each = cut(distinct_documents(docs, text, host))
    return each, cut(common_lines(each, limit).select("__host", "__h"))


def line_rule(docs: DataFrame, text: str = "text", host: str = "source", limit: int = LINE_LIMIT, found: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """(__host, __h1, __h2, __gone, __common) of the distinct documents that hold boilerplate lines: whether those leave fewer than LEAST_WORDS words, and their hashes.

    A line counts once for each distinct document of the host; documents are distinct where their texts are. found: what lines_found() gives, if it was asked before.
    """
    each, common = found or lines_found(docs, text, host, limit)
    common = small_or_shuffled(common.withColumn("__found", F.col("__h")), BROADCAST_ROWS)
    told = each.select("__host", "__h1", "__h2", F.explode("__l").alias("__x")).select("__host", "__h1", "__h2", F.col("__x.h").alias("__h"), F.col("__x.n").alias("__n"))
    left = F.sum(F.when(F.col("__found").isNull(), F.col("__n")).otherwise(0))
    sums = told.join(common, ["__host", "__h"], "left").groupBy("__host", "__h1", "__h2").agg((left < LEAST_WORDS).alias("__gone"), F.collect_set("__found").alias("__common"))
    return sums.where(F.size("__common") > 0)


def judged(docs: DataFrame, common: DataFrame, text: str, host: str) -> DataFrame:
    """docs with __gone and __common as line_rule() has them, null for documents without boilerplate lines. common is broadcast, a row for each host."""
    held = F.broadcast(common.groupBy("__host").agg(F.collect_list("__h").alias("__held")))

    def told(lines: Column) -> Column:
        def rule(c: Column) -> Column:
            left = F.aggregate(F.filter(lines, lambda x: ~F.array_contains(c, x["h"])), F.lit(0).cast("long"), lambda a, x: a + x["n"])
            return F.when(F.size(c) > 0, F.struct((left < LEAST_WORDS).alias("gone"), c.alias("common")))

        return let(F.array_intersect(F.transform(lines, lambda x: x["h"]), F.col("__held")), rule)

    rule = F.when(F.col("__held").isNotNull(), let(hashed_lines(F.col(text)), told))
    out = docs.withColumn("__host", identity(text, host)[0]).join(held, "__host", "left").drop("__host")
    out = out.select("*", F.explode(F.array(rule)).alias("__rule"))  # its parts are used several times; a generated column is made once
    return out.withColumns({"__gone": F.col("__rule.gone"), "__common": F.col("__rule.common")}).drop("__held", "__rule")


def depleted(docs: DataFrame, text: str = "text", host: str = "source", limit: int = LINE_LIMIT) -> DataFrame:
    """(__host, __h1, __h2) of the documents that hold boilerplate lines and fewer than LEAST_WORDS words outside them."""
    return line_rule(docs, text, host, limit).where("__gone").select("__host", "__h1", "__h2")


def quality_rules(docs: DataFrame, text: str = "text", host: str = "source", limit: int = LINE_LIMIT, clean: bool = False) -> DataFrame:
    """docs with the base counts and `kept`: false where the base rules fail or the document is depleted.

    With `clean` also clean_text, the text without its boilerplate lines, and n_removed_lines; up to HELD_LINES boilerplate lines go to all documents,
    beyond that documents and their own lines are joined by shuffles, with the same result. Else only depleted documents are joined.
    Null texts count as empty and fail, clean_text being null; null hosts form one host; repeated rows get the same verdict;
    an empty table gives an empty result; other columns pass through, those of the operator's own names too (columns of these names are replaced).
    """
    own = {c: f"own {k}" for k, c in enumerate(docs.columns) if c.startswith("__")}
    if own:
        out = quality_rules(docs.withColumnsRenamed(own), own.get(text, text), own.get(host, host), limit, clean)
        return out.withColumnsRenamed({v: k for k, v in own.items()})
    found = lines_found(docs, text, host, limit)
    if clean and found[1].limit(HELD_LINES + 1).count() <= HELD_LINES:
        out = judged(base_counts(docs, text), found[1], text, host)
    else:
        rule = line_rule(docs, text, host, limit, found)
        rule = cut(rule if clean else rule.where("__gone").drop("__common"))
        rule = small_or_shuffled(rule, BROADCAST_ROWS, F.size("__common") if clean else None)
        host_key, h1, h2 = identity(text, host)  # kept takes both sides of the join, so that no part of it is filtered before
        keyed = base_counts(docs, text).withColumns({"__host": host_key, "__h1": h1, "__h2": h2})
        out = keyed.join(rule, ["__host", "__h1", "__h2"], "left")
    out = out.withColumn("kept", F.when(F.col("__gone"), F.lit(False)).otherwise(~F.col("base_failed")))
    if clean:
        lines = F.split(F.col(text), "\n", -1)
        stay = F.filter(F.arrays_zip(lines.alias("x"), normal_lines(F.col(text)).alias("y")), lambda z: ~F.array_contains(F.col("__common"), F.xxhash64(z["y"])))
        told = let(stay, lambda s: F.struct(F.array_join(F.transform(s, lambda z: z["x"]), "\n").alias("t"), (F.size(lines) - F.size(s)).cast("long").alias("n")))
        out = out.withColumn("__told", F.when(F.col("__common").isNotNull(), told))
        out = out.withColumns({"clean_text": F.when(F.col("__common").isNull(), F.col(text)).otherwise(F.col("__told.t")), "n_removed_lines": F.coalesce("__told.n", F.lit(0).cast("long"))})
    return out.drop("__host", "__h1", "__h2", "__gone", "__common", "__told")
