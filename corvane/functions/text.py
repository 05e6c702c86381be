"""Scalars over texts, as columns. Everything here stays in the JVM but for the two Arrow UDFs at the end."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.functions.blocks import changes

#: Fixed values. A word: letters, digits and underscores, with apostrophes and hyphens inside. A run: the part between word boundaries.
WORD = r"[\p{L}\p{N}_](?:[\p{L}\p{N}_'-]*[\p{L}\p{N}_])?"
RUN = r"[\p{L}\p{N}_]+"
#: White space, as Unicode has it, with the information separators; the same text in Java's patterns and DuckDB's.
SPACES = r"\x09-\x0d\x1c-\x20\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
TOKEN = WORD + r"|[^\p{L}\p{N}_" + SPACES + "]"
SPLIT = "\x01"


def let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


#: The characters of SPACES, so that Java tests most others with one look into a table and one range: small ones one by one, the rest behind a range.
SPACE = r"[\x09\x0a\x0b\x0c\x0d\x1c\x1d\x1e\x1f\x20\x85\xa0[\x{1680}-\x{3000}&&[\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]]]"
#: Runs of white space that aren't a single space; the others need no change.
UNEVEN = rf"{SPACE}(?:{SPACE}++|(?<!\x20))"


def normalize(text: Column) -> Column:
    """White space collapsed to single spaces, none at the ends."""
    return F.btrim(F.regexp_replace(text, UNEVEN, " "))


def folded(text: Column) -> Column:
    """Text in folded case: ß as ss, every sigma alike; a dotless i stays. What lies between the two cases keeps the optimizer from dropping the upper one."""
    return F.translate(F.lower(F.translate(F.upper(F.translate(text, "\u0131", "\ue000")), "\ue001", "\ue001")), "\u03c2\ue000", "\u03c3\u0131")


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def tokens(text: Column) -> Column:
    """Words, and each mark that is no white space by itself."""
    return F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))


def split_words(normal: Column) -> Column:
    """The pieces of a normalized text between spaces."""
    return F.array_remove(F.split(normal, " ", -1), "")


def sentences(normal: Column) -> Column:
    """The sentences of a normalized text: cut at spaces after . ! ?"""
    return F.array_remove(F.split(normal, r"\s(?<=[.!?]\s)\s*+", -1), "")  # the space first: few characters are one, so the look behind is rare


def sentence_spans(raw: Column) -> Column:
    """Structs (start, end) of the sentences as they stand in the raw text, each found behind the one before; a sentence that isn't found there is left out."""
    state = F.struct(F.lit(0).alias("cursor"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))

    def step(a: Column, s: Column) -> Column:
        at = F.position(s, raw, a["cursor"] + 1)
        end = at - 1 + F.length(s)
        return F.when(at > 0, F.struct(end.alias("cursor"), F.concat(a["spans"], F.array(F.struct((at - 1).alias("start"), end.alias("end")))).alias("spans"))).otherwise(a)

    return F.aggregate(sentences(normalize(raw)), state, step)["spans"]


def latin_share(text: Column) -> Column:
    """Latin letters by letters; null without letters. Runs of ASCII letters, which are both, are counted by what the text is shorter without them."""

    def share(rest: Column) -> Column:
        ascii = F.length(text) - F.length(rest)
        return (ascii + F.regexp_count(rest, F.lit(r"\p{IsLatin}"))) / F.nullif(ascii + F.regexp_count(rest, F.lit(r"\p{L}")), F.lit(0))

    return let(F.regexp_replace(text, "[A-Za-z]++", ""), share)


def looks_latin(text: Column, threshold: float = 0.85) -> Column:
    """A test of script, not of language; false without letters."""
    return F.coalesce(latin_share(text) >= threshold, F.lit(False))


def exact_key(text: Column) -> Column:
    """The key of texts that are equal but for white space."""
    return F.sha2(normalize(text), 256)


def folded_key(text: Column) -> Column:
    """The key of texts that are equal but for white space and case."""
    return F.sha2(F.lower(normalize(text)), 256)


def stable_seed(*parts: Column | str | int) -> Column:
    """A seed of 31 bits from the SHA-256 of the parts as compact JSON."""
    told = []
    for p in parts:
        if isinstance(p, str):
            told.append(F.lit('"' + p.replace("\\", "\\\\").replace('"', '\\"') + '"'))
        elif isinstance(p, int):
            told.append(F.lit(str(p)))
        else:
            told.append(p)
    json = F.concat(F.lit("["), F.concat_ws(",", *told), F.lit("]"))
    return F.conv(F.substring(F.sha2(json, 256), 9, 8), 16, 10).cast("long").bitwiseAND(F.lit(2147483647))


def quoted(text: Column) -> Column:
    """A text as a JSON string, for stable_seed()."""
    return F.regexp_extract(F.to_json(F.array(text)), r"^\[(.*)\]$", 1)


def ngrams(text: Column, n: int = 13) -> Column:
    """The distinct n-grams of the lower-cased pieces between white space; none in shorter texts."""
    return let(split_words(normalize(F.lower(text))), lambda w: F.when(F.size(w) >= n, F.array_distinct(F.transform(F.sequence(F.lit(1), F.size(w) - n + 1), lambda i: F.array_join(F.slice(w, i, F.lit(n)), " ")))).otherwise(F.array().cast("array<string>")))


def lead_passage(normal: Column, target: int, most: int, least: int = 100) -> Column:
    """The whole text up to `most` pieces; else whole sentences, ending before one that would exceed `target` once `least` pieces are taken."""
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("n"), F.lit(False).alias("done"))

    def step(a: Column, s: Column) -> Column:
        k = F.size(split_words(s))
        stop = a["done"] | ((a["n"] + k > target) & (a["n"] >= least))
        return F.struct(F.when(stop, a["out"]).otherwise(F.concat(a["out"], F.when(a["n"] > 0, F.lit(" ")).otherwise(F.lit("")), s)).alias("out"), F.when(stop, a["n"]).otherwise(a["n"] + k).alias("n"), stop.alias("done"))

    return F.when(F.size(split_words(normal)) <= most, normal).otherwise(F.aggregate(sentences(normal), start, step)["out"])


def forum_post(prompt: Column) -> Column:
    """What follows the first POST: (or all of it), up to the first TL;DR:"""
    body = F.when(F.contains(prompt, F.lit("POST:")), F.substr(prompt, F.position(F.lit("POST:"), prompt) + 5)).otherwise(prompt)
    return F.btrim(F.substring_index(body, "TL;DR:", 1), F.lit(" \t\n\x0b\x0c\r"))


def as_sentence(text: Column) -> Column:
    """White space collapsed, a small first letter raised, a full stop where no end mark stands."""

    def raised(n: Column) -> Column:
        small = lambda x: (x == F.lower(x)) & (x != F.upper(x))
        return let(F.substring(n, 1, 1), lambda x: F.when(small(x), F.concat(F.upper(x), F.substr(n, F.lit(2)))).otherwise(n))

    def ended(n: Column) -> Column:
        return F.when(n == "", n).otherwise(F.concat(raised(n), F.when(F.substring(n, -1, 1).isin(".", "!", "?"), F.lit("")).otherwise(F.lit("."))))

    return let(normalize(text), ended)


def like_case(before: Column, after: Column) -> Column:
    """after in the case of before: all capitals, a capital first, or as it is."""
    first = F.substring(before, 1, 1)
    upper = (before == F.upper(before)) & (before != F.lower(before))
    raised = F.concat(F.upper(F.substring(after, 1, 1)), F.lower(F.substr(after, F.lit(2))))
    return F.when(upper, F.upper(after)).when((first == F.upper(first)) & (first != F.lower(first)), raised).otherwise(after)


#: The other number of irregular words.
IRREGULAR = {
    "is": "are", "are": "is", "was": "were", "were": "was", "has": "have", "have": "has", "does": "do", "do": "does", "goes": "go", "go": "goes",
    "says": "say", "say": "says", "children": "child", "child": "children", "people": "person", "person": "people", "men": "man", "man": "men", "women": "woman", "woman": "women",
}


def wrong_inflection(word: Column) -> Column:
    """A word in a wrong form; null for short ones without an irregular form."""
    low = F.lower(word)
    n = F.length(low)
    cut = lambda k: F.substring(low, F.lit(1), n - k)
    regular = (
        F.when(low.endswith("ies") & (n > 4), F.concat(cut(3), F.lit("y")))
        .when(low.endswith("s") & (n > 3) & ~low.endswith("ss"), cut(1))
        .when(low.endswith("ed") & (n > 4), cut(2))
        .when(low.endswith("ing") & (n > 5), F.concat(cut(3), F.lit("s")))
        .when(n > 3, F.concat(low, F.lit("s")))
    )
    irregular = F.create_map(*[F.lit(x) for kv in IRREGULAR.items() for x in kv])
    return like_case(word, F.coalesce(irregular[low], regular))


def apply_spans(text: Column, spans: Column) -> Column:
    """The text with spans (start, end, before, after) replaced, the last first; an error where before isn't what stands there."""
    def step(out: Column, s: Column) -> Column:
        here = F.substr(out, s["start"] + 1, s["end"] - s["start"])
        wrong = F.raise_error(F.concat(F.lit("changed span does not match source at "), s["start"].cast("string")))
        return F.when(here == s["before"], F.concat(F.substr(out, F.lit(1), s["start"]), s["after"], F.substr(out, s["end"] + 1))).otherwise(wrong)

    return F.aggregate(F.reverse(F.array_sort(spans)), text, step)


def dose_label(requested: Column, sample_id: Column, severity: Column) -> Column:
    """dose and the requested number; without one, dose and the last part of the id, or the severity where the id has one part."""
    tail = F.when(F.contains(sample_id, F.lit(":")), F.element_at(F.split(sample_id, ":", -1), -1)).otherwise(severity)
    return F.concat(F.lit("dose"), F.when(F.coalesce(requested, F.lit(0.0)) != 0, requested.cast("int").cast("string")).otherwise(tail))


_TOKEN = re.compile(r"\b[\w'-]+\b|[^\w\s]")


@F.pandas_udf(T.DoubleType())
def token_edit_ratio(before: pd.Series, after: pd.Series) -> pd.Series:
    """Changed tokens by tokens before, after a longest-matching-block comparison."""
    out = []
    for b, a in zip(before.fillna(""), after.fillna(""), strict=True):
        x, y = _TOKEN.findall(b), _TOKEN.findall(a)
        out.append(sum(max(i1 - i0, j1 - j0) for i0, i1, j0, j1 in changes(x, y)) / max(1, len(x)))
    return pd.Series(out, dtype="float64")


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("before", T.StringType()), T.StructField("after", T.StringType())])))
def changed_spans(before: pd.Series, after: pd.Series) -> pd.Series:
    """Spans that turn before into after, by characters."""
    both = zip(before.fillna(""), after.fillna(""), strict=True)
    return pd.Series([[{"start": i0, "end": i1, "before": b[i0:i1], "after": a[j0:j1]} for i0, i1, j0, j1 in changes(b, a)] for b, a in both])


@F.pandas_udf(T.StringType())
def case_folded(text: pd.Series) -> pd.Series:
    """White space collapsed and full case folding, which lower() isn't for letters like ß."""
    return text.map(lambda t: None if t is None else " ".join(t.split()).casefold())
