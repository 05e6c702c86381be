"""The line rule of the quality operator on planted templates."""

from __future__ import annotations

from test_edges import prose

from corvane.llm import quality

SCHEMA = "doc_id long, text string, source string"
TEMPLATE = [prose(40, 8000 + k) for k in range(3)]


def templated(n: int, own: int) -> list[tuple]:
    """Documents of a fixed template of three lines and one line of their own."""
    return [(i, "\n".join([*TEMPLATE, " ".join(f"w{i}x{k}" for k in range(own))]), "h") for i in range(n)]


def test_lines_count_by_distinct_documents(spark):
    rows = templated(100, 5)
    df = spark.createDataFrame(rows + rows[:30], SCHEMA).repartition(3)
    counts = quality.common_lines(quality.distinct_documents(df, "text", "source"), 20).collect()
    assert sorted(r["__c"] for r in counts) == [100] * 3  # copies don't count
    told = quality.quality_rules(df).collect()
    assert len(told) == 130 and not any(r.base_failed or r.kept for r in told)
    assert all(r.kept for r in quality.quality_rules(spark.createDataFrame(templated(20, 5), SCHEMA)).collect())


def test_a_document_of_few_own_words_is_depleted(spark):
    few, enough = templated(40, 19), [(100 + i, t, s) for i, t, s in templated(40, 20)]
    long = [(200 + i, "\n".join(TEMPLATE * 80) + f"\nown {i} " + prose(18, 600 + i), "h") for i in range(3)]
    kept = {r.doc_id: r.kept for r in quality.quality_rules(spark.createDataFrame(few + enough, SCHEMA)).collect()}
    assert not any(kept[i] for i in range(40)) and all(kept[100 + i] for i in range(40))
    gone = quality.depleted(spark.createDataFrame(few + enough + long, SCHEMA)).count()
    assert gone == 40  # 20 words of their own stand, of however many


def test_boilerplate_lines_are_removed(spark):
    rows = [(i, f"{TEMPLATE[0]}\n\n  Own {i} {prose(30, 40 + i)}\n\t{TEMPLATE[1].upper()}  \nEnd {i}", "h") for i in range(30)]
    rows += [(100, None, "h"), (101, f"{TEMPLATE[0]}\n{prose(30, 99)}", "other"), (102, TEMPLATE[0], "h")]
    out = {r.doc_id: r for r in quality.quality_rules(spark.createDataFrame(rows, SCHEMA), clean=True).collect()}
    for i, t, _ in rows[:30]:
        assert out[i].kept and out[i].n_removed_lines == 2 and out[i].clean_text == "\n".join(t.split("\n")[1:3] + [f"End {i}"])
    assert (out[100].clean_text, out[100].n_removed_lines) == (None, 0) and out[101].clean_text == rows[31][1]
    assert (out[102].clean_text, out[102].n_removed_lines, out[102].kept) == ("", 1, False)

    import corpus_pipeline

    docs = spark.createDataFrame([(i, t, "en", s, len(t) if t else None) for i, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long")
    staged = corpus_pipeline.quality(spark, docs, "").collect()
    assert {r.doc_id: (r.text, r.n_chars) for r in staged} == {i: (out[i].clean_text, len(out[i].clean_text)) for i in [*range(30), 101]}
