from __future__ import annotations

import difflib
import hashlib
import json
import re

import pytest
from pyspark.sql import functions as F

from corvane.functions import text as T
from corvane.operators import perturb, quality

PASSAGE = "The first sentence is here. She is at the door! Does it matter? They have gone home. This was the last one."


def one(spark, text, *columns):
    return spark.createDataFrame([(text,)], "t string").select(*columns).first()


@pytest.mark.parametrize("text", ["", "   ", "Café d'été naïve one-two x", "a\n b\t c", "Ünï_code 12 -- 'quoted' end"])
def test_words_and_tokens(spark, text):
    w, t, n = one(spark, text, T.words(F.col("t")), T.tokens(F.col("t")), T.normalize(F.col("t")))
    assert w == re.findall(r"\b[\w'-]+\b", text)
    assert n == " ".join(text.split())
    assert [x for x in t if x in w] == w


def test_spans_agree_with_sentences(spark):
    s, spans = one(spark, PASSAGE, T.sentences(T.normalize(F.col("t"))), T.sentence_spans(F.col("t")))
    assert [PASSAGE[a.start : a.end] for a in spans] == s and len(s) == 5
    s, spans = one(spark, "One two.\nThree\nfour. Five.", T.sentences(T.normalize(F.col("t"))), T.sentence_spans(F.col("t")))
    assert len(s) == 3 and len(spans) == 2  # the one over a line break isn't found


def test_script(spark):
    assert [one(spark, t, T.looks_latin(F.col("t")))[0] for t in ("abc", "123 !", "привет мир", "abc déf", "")] == [True, False, False, True, False]


def test_seed(spark):
    parts = [7, 'a "b"', "x:y"]
    want = int(hashlib.sha256(json.dumps(parts, separators=(",", ":")).encode()).hexdigest()[:16], 16) & 0x7FFFFFFF
    assert one(spark, 'a "b"', T.stable_seed(7, T.quoted(F.col("t")), "x:y"))[0] == want


@pytest.mark.parametrize("word,wrong", [("IS", "ARE"), ("Children", "Child"), ("cities", "city"), ("glass", "glasss"), ("walked", "walk"), ("moving", "movs"), ("going", "goings"), ("cat", None), ("Trees", "Tree"), ("dog", None), ("door", "doors")])
def test_inflection(spark, word, wrong):
    assert one(spark, word, T.wrong_inflection(F.col("t")))[0] == wrong


@pytest.mark.parametrize("n,most", [(12, 0), (13, 1), (14, 2)])
def test_ngrams(spark, n, most):
    assert len(one(spark, " ".join(map(str, range(n))), T.ngrams(F.col("t")))[0]) == most


def test_as_sentence_and_post(spark):
    assert one(spark, " a  b", T.as_sentence(F.col("t")))[0] == "A b." and one(spark, "", T.as_sentence(F.col("t")))[0] == ""
    assert one(spark, "x POST: body POST: b TL;DR: z", T.forum_post(F.col("t")))[0] == "body POST: b"


def test_edits_keep_their_promises(spark):
    docs = spark.createDataFrame([("p0", PASSAGE), ("p1", "Only one."), ("p2", "")], "id string, n string")
    got = {r.id: r for r in perturb.sentence_permute(docs, "id", "n", 1.0, 3).collect()}
    assert sorted(re.split(r"(?<=[.!?])\s+", got["p0"].edited)) == sorted(re.split(r"(?<=[.!?])\s+", PASSAGE)) and got["p0"].edited != PASSAGE and got["p0"].realized == 1.0
    assert got["p1"].edited == "Only one." and got["p2"].edited == ""
    again = perturb.sentence_permute(docs.repartition(3), "id", "n", 1.0, 3).collect()
    assert {r.id: r.edited for r in again} == {k: r.edited for k, r in got.items()}
    for f in perturb.RULES.values():
        assert {r.id: r.edited for r in f(docs, "id", "n", 0.0 if f is not perturb.sentence_permute else 0.1, 1).collect()}["p2"] == ""
    deleted = {r.id: r.edited for r in perturb.article_delete(docs, "id", "n", 1.0, 3).collect()}["p0"]
    assert deleted == "first sentence is here. She is at door! Does it matter? They have gone home. was last one."
    wrong = {r.id: r.edited for r in perturb.agreement_error(docs, "id", "n", 1.0, 3).collect()}["p0"]
    assert "She are at" in wrong and "They has gone" in wrong


def test_spans_apply(spark):
    span = "array(named_struct('start', 0, 'end', 3, 'before', 'The', 'after', 'A'), named_struct('start', 26, 'end', 27, 'before', '.', 'after', '!'))"
    assert one(spark, PASSAGE, T.apply_spans(F.col("t"), F.expr(span)))[0] == "A" + PASSAGE[3:26] + "!" + PASSAGE[27:]
    with pytest.raises(Exception, match="does not match"):
        one(spark, "xyz" * 20, T.apply_spans(F.col("t"), F.expr(span)))


def test_difflib(spark):
    a, b = "a b c d.", "a x c d e."
    rows = spark.createDataFrame([(a, b)], "a string, b string").select(T.token_edit_ratio("a", "b").alias("r"), T.changed_spans("a", "b").alias("s")).first()
    codes = difflib.SequenceMatcher(a=re.findall(r"\w+|[^\w\s]", a), b=re.findall(r"\w+|[^\w\s]", b), autojunk=False).get_opcodes()
    assert rows.r == sum(max(i1 - i0, j1 - j0) for op, i0, i1, j0, j1 in codes if op != "equal") / 5
    out = a
    for s in reversed(rows.s):
        out = out[: s.start] + s.after + out[s.end :]
    assert out == b


def test_anchor(spark):
    rows = [('ANCHOR: "She is at the door!" || NEW: x', PASSAGE.replace("last", "best"), PASSAGE), ('ANCHOR: "short"', PASSAGE, PASSAGE), ("none", PASSAGE, PASSAGE), ('ANCHOR: "The first sentence is her."', PASSAGE, PASSAGE), (None, PASSAGE, PASSAGE)]
    df = spark.createDataFrame(rows, "e string, p string, c string")
    assert [r.ok for r in quality.anchor_survives(df, "e", "p", "c", "ok").collect()] == [True, False, False, True, False]
