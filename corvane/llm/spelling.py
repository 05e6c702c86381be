"""Spelling variants of words, by a symmetric-delete join.

Every word emits itself and its strings with one letter deleted, and rows meet on equal strings. Two words that differ by one replaced
letter meet with the same deletion at the same position, two that differ by one inserted letter meet where the longer one's deletion is the
shorter one. So the key and the position prove the distance, each near pair meets exactly once, and the words that meet on a key
are bounded by the alphabet and the key's length. What is kept of a meeting is a count and the best other word, not its pairs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, release

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LEAST_LETTERS = 5
LEAST_COUNT = 3
#: One run in so many loses a letter.
EVERY = 97
#: A form is at least so many times as frequent.
RATIO = 2
#: Longer strings stand for themselves by their MD5 in keys, so that a row is small for words of any length.
PLAIN_LETTERS = 32
#: The strings that longer words emit are told by sums of their letters modulo three primes, which each deletion changes in one step.
LONG_LETTERS = 64
PRIMES = (2147483647, 2147483629, 2147483587)
BASES = (911382323, 972663749, 1540483477)


def words(docs: DataFrame, key: str = "doc_id", text: str = "text", every: int | None = EVERY, least_letters: int = LEAST_LETTERS, least_count: int = LEAST_COUNT) -> DataFrame:
    """word and n (its occurrences in all texts): runs of Latin letters, A-Z in lower case, of enough letters and occurrences.

    If `every` divides the crc32 of `<key>:<run>`, the run loses the letter at crc32 % length. Null texts have no words, null keys are
    empty strings there; repeated rows count each; other columns play no part. Runs too short to be words are not counted at all.
    """
    t = F.translate(F.coalesce(F.col(f"`{text}`"), F.lit("")), UPPER, LOWER)
    run, key = F.col("run"), F.coalesce(F.col(f"`{key}`").cast("string"), F.lit(""))
    runs = docs.select(key.alias("key"), F.explode(F.regexp_extract_all(t, F.lit(rf"[a-zÀ-ÿ]{{{least_letters},}}"), F.lit(0))).alias("run"))
    if every is None:
        word = run
    else:
        h = F.crc32(F.concat("key", F.lit(":"), run))
        at = (h % F.length(run)).cast("int")
        word = F.when(h % every == 0, F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length(run)))).otherwise(run)
    counted = runs.select(word.alias("word")).where(F.length("word") >= least_letters).groupBy("word").agg(F.count("*").alias("n"))
    return counted.where(F.col("n") >= least_count)


def short(s: Column) -> Column:
    """The string, or what stands for a long one; # is no letter."""
    return F.when(F.length(s) <= PLAIN_LETTERS, s).otherwise(F.concat(F.lit("#"), F.md5(s.cast("binary"))))


@lru_cache(maxsize=3)
def powers(prime: int, base: int, bits: int) -> np.ndarray:
    """The first 2 ** bits powers of the base."""
    out, step = np.ones(1, np.int64), base % prime
    for _ in range(bits):
        out, step = np.concatenate([out, out * step % prime]), step * step % prime
    return out


def sums(letters: np.ndarray) -> np.ndarray:
    """For a word's code points, a column each for the word itself and for it without each of its letters; a row for each prime."""
    out = []
    for prime, base in zip(PRIMES, BASES, strict=True):
        ahead = np.concatenate([[0], np.cumsum(letters * powers(prime, base, int(len(letters)).bit_length())[: len(letters)] % prime)])
        rest = (ahead[-1] - ahead[1:]) % prime * pow(base, -1, prime) % prime
        out.append(np.concatenate([ahead[-1:] % prime, (ahead[:-1] + rest) % prime]))
    return np.array(out)


def long_rows(vocabulary: DataFrame) -> DataFrame:
    """What near() has a word emit, for the long ones: in time and rows by a word's length. Words of just LONG_LETTERS emit themselves, too, for longer ones to meet."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for word, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                letters = np.frombuffer(word.encode("utf-32-le"), np.uint32).astype(np.int64)
                size, told = len(word), sums(letters)
                last = size if size > LONG_LETTERS else 0
                once = np.append(letters[1:] != letters[:-1], True)
                name = "#" + hashlib.md5(word.encode()).hexdigest()
                for k in range(0, last + 1, 1 << 14):
                    p = np.arange(k, min(k + (1 << 14), last + 1))
                    keys = [f"~{size - (x > 0)}:{a}:{b_}:{c}" for x, a, b_, c in zip(p.tolist(), *told[:, p].tolist(), strict=True)]
                    columns = [keys, p, [word[x - 1] if x else None for x in p.tolist()], (p > 0) & once[p - 1], np.full(len(p), n), [name] * len(p)]
                    kinds = [pa.string(), pa.int32(), pa.string(), pa.bool_(), pa.int64(), pa.string()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["key", "p", "letter", "once", "n", "id"])

    return vocabulary.where(F.length("word") >= LONG_LETTERS).select("word", "n").mapInArrow(run, "key string, p int, letter string, once boolean, n long, id string")


def near(vocabulary: DataFrame) -> DataFrame:
    """word, n, n_near and form of (word, n) rows with distinct words: n_near counts the words at distance one, form is the most
    frequent of them (the smallest in code-point order of equal ones), null without any. vocabulary must be a written table.

    At position p > 0 the p-th letter is deleted, at 0 none. Of a run of equal letters the last position stands for the deletion; all
    of them stand for places where another word may have another letter.
    """
    word, p = F.col("word"), F.col("p")
    rows = vocabulary.where(F.length(word) <= LONG_LETTERS).select("word", "n", F.explode(F.sequence(F.lit(0), F.length(word))).alias("p"))
    letter, after = F.when(p > 0, F.substring(word, p, F.lit(1))), F.substring(word, p + 1, F.lit(1))
    deleted = F.when(p == 0, word).otherwise(F.concat(F.substring(word, F.lit(1), p - 1), F.substring(word, p + 1, F.length(word))))
    rows = rows.select(short(deleted).alias("key"), "p", letter.alias("letter"), (p > 0).__and__(letter != after).alias("once"), "n", short(word).alias("id"))
    rows = rows.unionByName(long_rows(vocabulary)).repartition("key")
    whole = F.max(F.when(p == 0, F.col("id"))).over(Window.partitionBy("key"))
    place = Window.partitionBy("key", "p").orderBy(F.desc("n"), "letter")
    met = rows.select(
        "id", "p", "once", whole.alias("whole"), F.count("*").over(place.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("k"),
        F.first("id").over(place.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("best"), F.lead("id").over(place).alias("next"),
    )
    link = lambda a, k, b: F.struct(a.alias("id"), k.cast("long").alias("k"), b.alias("other"))
    replaced = F.when((p > 0) & (F.col("k") > 1), link(F.col("id"), F.col("k") - 1, F.when(F.col("best") == F.col("id"), F.col("next")).otherwise(F.col("best"))))
    longer = F.when(F.col("once") & F.col("whole").isNotNull(), link(F.col("id"), F.lit(1), F.col("whole")))
    shorter = F.when(F.col("once") & F.col("whole").isNotNull(), link(F.col("whole"), F.lit(1), F.col("id")))
    links = met.select(F.explode(F.array_compact(F.array(replaced, longer, shorter))).alias("l")).select("l.*")
    known = vocabulary.select(short(word).alias("other"), word.alias("form"), F.col("n").alias("m"))
    best = links.join(known, "other").groupBy("id").agg(F.sum("k").alias("n_near"), F.min(F.struct((-F.col("m")).alias("m"), "form")).alias("best"))
    out = vocabulary.withColumn("id", short(word)).join(best, "id", "left")
    return out.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.col("best.form").alias("near_form"), (-F.col("best.m")).alias("near_n"))


def roots(forms: DataFrame) -> DataFrame:
    """word and root for each (word, form) row whose form is not null: the end of the chain of forms. Chains must end.

    Each round doubles the steps of the chains that have not ended and joins only these, so a chain of k forms takes about log2(k)
    rounds. A form is at least twice as frequent as its word, so no chain has more than 63.
    """
    spark = forms.sparkSession
    step = forms.where("form is not null").select("word", "form")
    ahead = step.select(F.col("word").alias("form"), F.col("form").alias("to"))
    now = cut(step.join(ahead, "form", "left").select("word", F.coalesce("to", "form").alias("root"), F.col("to").isNull().alias("ended")))
    while not now.where("not ended").isEmpty():
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("to"), F.col("ended").alias("done"))
        moved = now.where("not ended").join(ahead, "root", "left").select("word", F.coalesce("to", "root").alias("root"), F.coalesce("done", F.lit(True)).alias("ended"))
        now = cut(now.where("ended").unionByName(moved))
        release(spark)
    return now.select("word", "root")


def spellings(docs: DataFrame, key: str = "doc_id", text: str = "text", every: int | None = EVERY, least_letters: int = LEAST_LETTERS, least_count: int = LEAST_COUNT, ratio: float = RATIO) -> DataFrame:
    """word, form, root, n, n_near and form_n of each word of the texts.

    form: the most frequent word at distance one (ties: the smallest in code-point order) if it is at least `ratio` times as frequent,
    else null. root: the end of the chain of forms, the word itself without one. Null and empty texts add no words; an empty table
    gives none. Words may be of any length; a word's rows are small, their number and the time to make them grow with its length.
    """
    vocabulary = cut(words(docs, key, text, every, least_letters, least_count))
    found = cut(near(vocabulary))
    form = F.when(F.col("near_n") >= ratio * F.col("n"), F.col("near_form"))
    told = found.select("word", form.alias("form"), "n", "n_near", F.when(form.isNotNull(), F.col("near_n")).alias("form_n"))
    out = told.join(roots(told), "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
