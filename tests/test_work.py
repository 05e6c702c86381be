"""What edits and comparisons cost: places told once, long blocks found by pieces, far quotes not compared, words counted without cutting."""

from __future__ import annotations

import difflib
import random

from corvane.functions import blocks
from corvane.functions import text as T
from corvane.operators import perturb, quality
from corvane.plans import edits
from pyspark.sql import functions as F


def test_pools_share_the_chosen_places(spark, monkeypatch):
    asked, real = [], perturb.with_sentences
    monkeypatch.setattr(perturb, "with_sentences", lambda *a, **k: asked.append(a) or real(*a, **k))
    assert edits.matched_splice(spark, "/root/testdata/sf0.001").count() == 400
    assert len(asked) == 1


def test_long_blocks_need_no_automaton(monkeypatch):
    r = random.Random(5)
    sentences = ["".join(r.choice("abcdefghij ") for _ in range(60)) + "." for _ in range(300)]
    before, after = " ".join(sentences), " ".join(f"{s} {s}" if k % 4 == 0 else s for k, s in enumerate(sentences))
    read, real = [], blocks.substrings
    monkeypatch.setattr(blocks, "substrings", lambda b, low, high: read.append(high - low) or real(b, low, high))
    told = blocks.changes(before, after)
    assert sum(read) < len(after)  # it was read some ten times
    out = before
    for i0, i1, j0, j1 in reversed(told):
        out = out[:i0] + after[j0:j1] + out[i1:]
    assert out == after


def test_blocks_equal_the_standard_library():
    r = random.Random(6)
    for letters in ("ab", "abcdefgh ", "abcdefghijklmnopqrstuvwxyz ,."):
        for _ in range(150):
            words = ["".join(r.choice(letters) for _ in range(r.randrange(1, 30))) for _ in range(r.randrange(12))]
            other = [x for w in words for x in r.choice([[w], [w], [w, w], [], [w[::-1]]])]
            a, b = " ".join(words), " ".join(other)
            assert blocks.matching_blocks(a, b) == [(*m,) for m in difflib.SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks()][:-1]


def test_far_sentences_are_not_compared(monkeypatch):
    near = "the house stands by the river where it always stood"
    far = ["short one", "zzzz qqqq xxxx wwww vvvv kkkk jjjj zzzz qqqq xxxx ww", near * 3]
    made, real = [], difflib.SequenceMatcher
    monkeypatch.setattr(quality.difflib, "SequenceMatcher", lambda *a, **k: made.append(k) or real(*a, **k))
    assert not quality._any_close(near, far) and not made
    assert quality._any_close(near, [*far, f"{near} so"]) and len(made) == 1
    assert quality._any_close("", [""]) and not quality._any_close("a", [""])


def test_two_words_as_pieces_tell(spark):
    r = random.Random(7)
    rows = spark.createDataFrame([("".join(r.choice("ab'-. \x01é1") for _ in range(r.randrange(14))),) for _ in range(2000)], "t string")
    assert rows.where(perturb._two_words(F.col("t")) != (F.size(perturb._ascii(F.col("t"))) >= 5)).count() == 0


def test_white_space_as_its_definition_says(spark):
    r = random.Random(8)
    rows = spark.createDataFrame([("".join(r.choice(" \t\n\x0b\x1c\x85\xa0  ​   　ab.!?ß\U0001f600") for _ in range(r.randrange(30))),) for _ in range(2000)], "t string")
    plain = F.btrim(F.regexp_replace("t", f"[{T.SPACES}]+", " "))
    assert rows.where(plain != T.normalize(F.col("t"))).count() == 0
    cut = F.array_remove(F.split("t", r"(?<=[.!?])\s+", -1), "")
    assert rows.where(cut != T.sentences(F.col("t"))).count() == 0


def test_sharp_s_is_raised_as_the_reference_does(spark):
    assert spark.createDataFrame([("ßber das",)], "t string").select(T.as_sentence(F.col("t"))).first()[0] == "ßber das"[0].upper() + "ber das."
