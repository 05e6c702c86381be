"""Shares of tokens are told text by text: no count of a text's token is shuffled, and blank texts are told by their first characters."""

from __future__ import annotations

import pytest

from corvane.operators import vectors
from corvane.sources import tables


def test_shares_are_those_of_histograms_without_a_shuffle(spark):
    texts = [(0, "The cat, the dog: THE END."), (1, None), (2, "..."), (3, "a rock-'n'-roll a b c"), (4, "'tis x_1 cat"), (5, "")]
    docs = spark.createDataFrame(texts, "id long, text string")
    counts = vectors.token_counts(docs, "id", "text")
    vocab = vectors.vocabulary(counts, 3)
    words = vectors.worded(docs, ["id"], "text")
    assert sorted(map(tuple, vectors.vocabulary(vectors.word_counts(words), 3).collect())) == sorted(map(tuple, vocab.collect()))
    out = vectors.shares(words, ["id"], vocab, 3)
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
    want = vectors.dense(vectors.histograms(counts, vocab, "id", 3), docs, "id", 3)
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, want.collect()))


def test_blank_texts(spark):
    rows = spark.createDataFrame([(0, "  \n"), (1, "  a"), (2, None), (3, ""), (4, "​")], "id long, text string")
    for mode, kept in (("whitespace", [1, 4]), ("none", [0, 1, 4])):
        assert sorted(r.id for r in tables.filled_texts(rows, mode=mode).collect()) == kept == sorted(r.id for r in tables.non_empty_texts(rows, mode=mode).collect())
        with pytest.raises(ValueError, match="no text"):
            tables.filled_texts(rows.where("id > 1 and id < 4"), mode=mode)
