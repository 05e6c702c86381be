"""Spans, positions and records of seeded edits; white space and case beyond ASCII."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from corvane.functions import text as T
from corvane.operators import perturb, quality
from corvane.sources.tables import PASSAGE

PASSAGE_TEXT = (
    "The old house stands by the river. She walks to it every day because she likes this place. They have a dog and it has a bone! "
    "Do these people know that he is here? We are waiting for the bus in the rain. It does not come. That is a long story with an odd end."
)


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, " ".join(PASSAGE_TEXT.split(". ")[i % 3 :]) if i % 4 else PASSAGE_TEXT) for i in range(12)] + [(50, ""), (51, "Alone"), (52, None)]
    return spark.createDataFrame(rows, "doc_id long, text string").withColumn("n", T.normalize(F.col("text")))


@pytest.mark.parametrize("rule", [*perturb.RULES, "case_lower"])
def test_spans_rebuild_the_text(docs, rule):
    rows = perturb.case_lower(docs, "n") if rule == "case_lower" else perturb.RULES[rule](docs, "doc_id", "n", 0.6, 3)
    out = rows.select("n", "edited", "spans", T.apply_spans(F.col("n"), F.col("spans")).alias("again")).collect()
    assert any(r.spans for r in out)
    for r in out:
        if r.n is None:
            assert not r.spans
            continue
        assert r.again == r.edited and (r.edited == r.n) == (not r.spans)
        ends = [(s.start, s.end) for s in r.spans]
        assert ends == sorted(ends) and all(r.n[s.start : s.end] == s.before != s.after for s in r.spans)


@pytest.mark.parametrize("position", ["early", "middle", "late"])
@pytest.mark.parametrize("rule", ["article_delete", "function_word_repeat", "inflection_error", "agreement_error", "sentence_repeat"])
def test_positions_are_thirds(docs, rule, position):
    low, high = {"early": (0, 1 / 3), "middle": (1 / 3, 2 / 3), "late": (2 / 3, 1.01)}[position]
    size = (lambda s: len(s.before.rstrip())) if rule == "article_delete" else (lambda s: s.end - s.start)
    rows = perturb.RULES[rule](docs, "doc_id", "n", 1.0, 3, position=position).collect()
    found = [(s.start + size(s) / 2) / len(r.n) for r in rows if r.n for s in r.spans]
    assert found and all(low <= x < high for x in found)
    every = perturb.RULES[rule](docs, "doc_id", "n", 1.0, 3).collect()
    assert len(found) == sum(low <= (s.start + size(s) / 2) / len(r.n) < high for r in every if r.n for s in r.spans)


def test_records_are_whole_and_pass_the_gate(spark, docs):
    rules = {r: {"mild": 0.2, "severe": 0.6} for r in ("article_delete", "function_word_repeat", "sentence_repeat")}
    some = docs.where("length(n) > 60")
    records = perturb.rule_records(some, "doc_id", "n", rules, 5, positions=(None, "early"), given={"domain": "text"}).cache()
    assert records.schema.names == PASSAGE.names
    out = records.collect()
    assert len({r.sample_id for r in out}) == len(out) > 50 and {r.position for r in out} == {None, "early"}
    for r in out:
        assert r.perturbed_text != r.clean_text and r.changed_spans and r.word_count == len(r.perturbed_text.split()) and r.seed >= 0
        assert r.sample_id.split(":")[:3] == [r.parent_sample_id, r.perturbation, r.severity]
    rebuilt = records.where(T.apply_spans(F.col("clean_text"), F.col("changed_spans")) != F.col("perturbed_text"))
    assert rebuilt.count() == 0
    half = records.where("severity = 'mild'").select("sample_id")
    rest = perturb.rule_records(some, "doc_id", "n", rules, 5, done=half, positions=(None, "early"))
    assert {r.severity for r in rest.select("severity").collect()} == {"severe"}
    records.unpersist()


def test_changed_spans_agree_with_the_comparison(spark):
    df = spark.createDataFrame([("a b c", "a x c"), ("same", "same"), ("", "new"), (None, "x")], "b string, a string")
    for r in df.select("b", "a", T.changed_spans("b", "a").alias("s")).collect():
        text = r.b or ""
        for s in reversed(r.s):
            assert text[s.start : s.end] == s.before
            text = text[: s.start] + s.after + text[s.end :]
        assert text == r.a


SPACED = ["a b  c", "　x\x1fy\x85", "   ", "a​b", "﻿z"]


def test_white_space_is_unicodes(spark):
    df = spark.createDataFrame([(t,) for t in SPACED], "t string")
    out = df.select("t", T.normalize(F.col("t")).alias("n"), T.tokens(F.col("t")).alias("k"), T.exact_key(F.col("t")).alias("x")).collect()
    assert [r.n for r in out] == [" ".join(r.t.split()) for r in out]
    assert all(not x.isspace() for r in out for x in r.k)
    import duckdb

    from corvane.plans import sqltext

    for r in out:
        assert duckdb.execute(f"select {sqltext.norm('$t')}, len({sqltext.tokens('$t')})", {"t": r.t}).fetchone() == (r.n, len(r.k))


def test_case_is_folded(spark):
    texts = ["Straße", "STRASSE", "ΣΊΣΥΦΟΣ", "σίσυφος", "ﬁne", "Éa", "dıŞ", "MASSE maße"]
    out = spark.createDataFrame([(t,) for t in texts], "t string").select("t", T.folded(F.col("t")).alias("f")).collect()
    assert [r.f for r in out] == [r.t.casefold() for r in out]


def test_anchors_match_in_folded_case(spark):
    clean = "Die Straße ist sehr lang heute. Der Hund schläft."
    rows = [("ANCHOR: DIE STRASSE IST SEHR LANG HEUTE. || NEW: x", clean + " Neu.", clean)]
    df = spark.createDataFrame(rows, "e string, p string, c string")
    assert df.select(quality.anchor_exact(F.col("e"), F.col("p"), F.col("c"))).first()[0]
