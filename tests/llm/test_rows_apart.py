"""Rows that share an id, rows without one, and words whose letters add up alike."""

from __future__ import annotations

import pyarrow as pa
from test_edges import prose

import corpus_pipeline
from corvane.llm import minhash
from corvane.llm.shingles import shingle_sets

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def deduped(spark, rows) -> list[tuple]:
    df = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], COLUMNS).repartition(3)
    return sorted(((r.doc_id, r.text) for r in corpus_pipeline.near_dedup(spark, df, "").collect()), key=repr)


def test_a_row_goes_by_its_own_text(spark):
    a, b, c = prose(90, 1), prose(90, 2), prose(90, 3)
    assert deduped(spark, [(1, a), (2, a), (2, b)]) == sorted([(1, a), (2, b)], key=repr)
    assert deduped(spark, [(2, a), (2, b), (1, b + " end"), (3, c), (3, c), (3, None), (3, "")]) == sorted([(2, a), (1, b + " end"), (3, c), (3, None), (3, "")], key=repr)


def test_rows_without_an_id_stay(spark):
    a, b = prose(90, 4), prose(90, 5)
    alone = [(None, a), (None, a), (None, None), (None, None)]
    assert deduped(spark, alone) == sorted(alone, key=repr)
    assert deduped(spark, [*alone, (7, a), (7, a), (8, b)]) == sorted([*alone, (7, a), (8, b)], key=repr)


def word(n: int, other: bool) -> str:
    """The first n letters of the Thue-Morse word over a and b, or of its complement."""
    return "".join("ab"[(bin(k).count("1") + other) % 2] for k in range(n))


def test_words_whose_letters_add_up_alike(spark):
    for n in (8, 64, 1024, 4096):
        x, y = (shingle_sets(pa.array([" ".join([word(n, o)] * 6)]))[0] for o in (False, True))
        assert len(x) == 1 and x[0] != y[0]
    sets = shingle_sets(pa.array(["a\0 b c d e", "a b c d e", "a\0\0 b c d e", "abcdefgh b c d e", "abcdefghi b c d e", "b abcdefgh c d e"]))
    assert len({s[0] for s in sets}) == len(sets)
    rows = [(1, " ".join([word(1024, False)] * 5)), (2, " ".join([word(1024, True)] * 5))]
    out = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.component_id, r.kept) for r in out) == [(1, 1, True), (2, 2, True)]
