"""Filters of passages and gates of edits."""

from __future__ import annotations

import difflib
import re
from collections import Counter
from collections.abc import Iterable
from functools import reduce
from operator import or_

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from corvane.functions import text as T

#: What leaked instructions hold, families of edits, and ways to say that there is no error.
LEAKS = ("system prompt", "as an ai language model", "<|im_start|>", "<|assistant|>")
PARAPHRASES = ("para_lexical", "para_syntactic", "para_discourse")
ERRORS = ("broken_transition", "topic_drift", "internal_contradiction", "contradiction", "causal_reverse", "key_omission", "agreement_error_llm", "tense_inconsistency", "pronoun_reference_error")
NO_ERROR = ("n/a", "na", "no error", "no error introduced", "none", "none.", "not applicable")
LEAST_ANCHOR = 15


def viable(normal: Column, least_sentences: int, least_words: int, most_words: int) -> Column:
    """A non-empty normalized text in Latin script with enough sentences and words within bounds, the cheap tests first. Words are counted once for both bounds."""
    within = F.abs(2 * F.regexp_count(normal, F.lit(T.WORD)) - (least_words + most_words)) <= most_words - least_words
    return (normal != "") & within & (F.size(T.sentences(normal)) >= least_sentences) & T.looks_latin(normal)


def filled(x: Column) -> Column:
    return F.coalesce(F.btrim(x), F.lit("")) != ""


def validate_edits(edits: DataFrame, least_ratio: float = 0.5, most_ratio: float = 1.75, bounds: tuple[float, float] | None = None, enforce: bool = False, evidence: bool = False, ratio: bool = True) -> DataFrame:
    """edits (clean_text, perturbed_text, perturbation, generator, requested_rate, realized_rate, changed_spans, validation as JSON) with a column for each check and `passed`.

    Checks that don't apply are null. `ratio` False leaves out token_edit_ratio, the only one that runs Python.
    """
    text, clean = F.coalesce("perturbed_text", "clean_text"), F.col("clean_text")
    edited = F.col("perturbation") != "clean"
    note = lambda k: F.get_json_object("validation", f"$.{k}")
    shown = filled(note("operation_evidence"))
    length = F.size(T.words(text)) / F.greatest(F.size(T.words(clean)), F.lit(1))
    spans = F.coalesce(F.size("changed_spans"), F.lit(0)) > 0
    rule, model = F.col("generator") == "rule", (F.col("generator") != "rule") & edited
    error = F.lower(F.btrim(F.coalesce(note("introduced_error"), F.lit(""))))
    fits = F.coalesce(F.forall("changed_spans", lambda s: F.substr(clean, s["start"] + 1, s["end"] - s["start"]) == s["before"]), F.lit(True))
    rebuilt = F.aggregate(F.reverse(F.array_sort(F.coalesce("changed_spans", F.array()))), clean, lambda out, s: F.concat(F.substr(out, F.lit(1), s["start"]), s["after"], F.substr(out, s["end"] + 1)))
    checks = {
        "non_empty": F.btrim(text) != "",
        "english": T.looks_latin(text),
        "no_instruction_leakage": ~reduce(or_, (F.contains(F.lower(text), F.lit(m)) for m in LEAKS)),
        "bounded_length_ratio": length.between(least_ratio, most_ratio),
        "text_changed": F.when(edited, text != clean),
        "has_documented_change": F.when(edited, spans & (~rule | (F.col("requested_rate") == 0) | spans | (F.col("realized_rate") == 0))),
        "span_reconstruction": F.when(edited, F.when(fits, rebuilt == text).otherwise(F.lit(False))),
        "operation_evidence_documented": F.when(model & F.lit(evidence), shown),
        "preserved_facts_documented": F.when(model & F.col("perturbation").isin(*PARAPHRASES), filled(note("preserved_facts")) & ~F.coalesce(note("preserved_facts").isin("[]", "{}", "false", "0"), F.lit(False)) | shown),
        "introduced_error_documented": F.when(model & F.col("perturbation").isin(*ERRORS), ((error != "") & ~error.isin(*NO_ERROR)) | shown),
    }
    out = edits.withColumns({"length_ratio": length} | checks)
    if ratio:
        out = out.withColumn("token_edit_ratio", F.when(edited, T.token_edit_ratio(clean, text)))
        if bounds:
            out = out.withColumn("bounded_token_edit_ratio", F.when(edited, F.col("token_edit_ratio").between(*bounds)))
    names = [*checks, *["bounded_token_edit_ratio"] * bool(ratio and bounds and enforce)]
    passed = F.lit(True)
    for n in names:
        passed = passed & F.coalesce(F.col(n), F.lit(True))
    return out.withColumn("passed", passed)


#: Fixed value: where an editor quotes the sentence that an edit contradicts.
ANCHOR = r'(?is)ANCHOR\s*:\s*["“]?(.+?)["”]?\s*(?:\|\||NEW\s*:|$)'


def anchor(evidence: Column) -> Column:
    return T.folded(T.normalize(F.regexp_extract(evidence, ANCHOR, 1)))


def _unchanged(perturbed: Column, clean: Column) -> Column:
    """Sentences of the edited text, normalized, that stand in the clean one too."""
    cut = lambda t: F.transform(F.filter(F.split(t, r"\s(?<=[.!?]\s)\s*+", -1), lambda s: s != ""), lambda s: T.folded(T.normalize(s)))
    return F.array_intersect(cut(perturbed), cut(clean))


def anchor_exact(evidence: Column, perturbed: Column, clean: Column) -> Column:
    """Whether the quoted sentence is, or is within, an unchanged one."""
    a = anchor(evidence)
    return F.coalesce((F.length(a) >= LEAST_ANCHOR) & F.exists(_unchanged(perturbed, clean), lambda s: F.contains(s, a)), F.lit(False))


#: Fixed value: the ratio from which a quote is close to a sentence.
CLOSE = 0.85


def _any_close(quoted: str, sentences: Iterable[str]) -> bool:
    """Whether a sentence is close to the quote. What two texts share is at most the shorter one, and at most the letters they have in common; only where that suffices are they compared."""
    letters = Counter(quoted)
    for s in sentences:
        both = len(quoted) + len(s)
        if both and 2.0 * min(len(quoted), len(s)) / both < CLOSE:
            continue
        if both and 2.0 * sum((letters & Counter(s)).values()) / both < CLOSE:
            continue
        if difflib.SequenceMatcher(a=quoted, b=s).ratio() >= CLOSE:
            return True
    return False


@F.pandas_udf(BooleanType())
def _close(quoted: pd.Series, sentences: pd.Series) -> pd.Series:
    return pd.Series([_any_close(q, ss) for q, ss in zip(quoted, sentences, strict=True)])


def anchor_survives(rows: DataFrame, evidence: str, perturbed: str, clean: str, out: str = "anchor_ok") -> DataFrame:
    """As anchor_exact, or the quoted sentence is close to an unchanged one; only rows in doubt go through Python."""
    long = lambda a: F.length(a) >= LEAST_ANCHOR
    exact = lambda a, u: F.coalesce(long(a) & F.exists(u, lambda s: F.contains(s, a)), F.lit(False))
    unchanged = lambda a: F.when(long(a), _unchanged(F.col(perturbed), F.col(clean)))
    # quote and sentences are bound, so that each is made once
    told = T.let(anchor(F.col(evidence)), lambda a: T.let(unchanged(a), lambda u: F.struct(a.alias("quoted"), u.alias("sentences"), exact(a, u).alias("exact"))))
    rows = rows.withColumn("__told", told)
    quoted, sentences, found = (F.col(f"__told.{n}") for n in ("quoted", "sentences", "exact"))
    doubt = F.coalesce(F.when(~found & long(quoted), sentences), F.array().cast("array<string>"))
    return rows.withColumn(out, found | F.coalesce(_close(F.coalesce(quoted, F.lit("")), doubt), F.lit(False))).drop("__told")


def contradiction_ok(sentence: Column, exact: Column, perturbed: Column) -> Column:
    """A recorded anchor must stand in the edited text; where none is recorded, `exact` decides."""
    a = T.folded(T.normalize(F.coalesce(sentence, F.lit(""))))
    return F.when(a != "", (F.length(a) >= LEAST_ANCHOR) & F.contains(T.folded(T.normalize(perturbed)), a)).otherwise(exact)


def not_pinned(revision: str | None) -> bool:
    """Whether a model's revision names no fixed state."""
    return not revision or re.fullmatch(r"(?i)main|master|latest|api|unpinned|head", revision.strip()) is not None


def rewrite_parents(rows: DataFrame, per_domain: int, least_sentences: int, least_words: int, most_words: int, order: str = "doc_id", text: str = "text", domain: str = "domain") -> DataFrame:
    """rows with `picked` and, for those, `sample_id`: the first `per_domain` of each domain within the bounds; the others are the rest."""
    from pyspark.sql import Window

    from .dedup import small

    t = F.col(text)
    fits = (F.size(T.sentences(T.normalize(t))) >= least_sentences) & F.size(T.words(t)).between(least_words, most_words)
    first = rows.where(fits).select(domain, order).withColumn("__n", F.row_number().over(Window.partitionBy(domain).orderBy(order))).where(F.col("__n") <= per_domain)
    told = rows.join(small(first.select(order, "__n")), order, "left")
    return told.withColumn("picked", F.col("__n").isNotNull()).withColumn("sample_id", F.when(F.col("picked"), F.format_string("relgen-%s-%04d", F.col(domain), F.col("__n")))).drop("__n")
