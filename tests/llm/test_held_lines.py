"""With few boilerplate lines no text is shuffled to be cleaned, however many documents hold them; results are those of the shuffled way."""

from __future__ import annotations

import pytest
from test_lines import SCHEMA, TEMPLATE, templated

from corvane.llm import quality

ROWS = [*templated(40, 19), *((100 + i, t + f"\n\n{TEMPLATE[1].upper()}\t\n", s) for i, t, s in templated(40, 20)), *((200 + i, t, None) for i, t, _ in templated(25, 30))]
ROWS += [*ROWS[:3], (300, None, "h"), (301, "", "h"), (302, " \n \n", None), (303, TEMPLATE[0], "h"), (304, TEMPLATE[0], "other"), (305, TEMPLATE[0] + "\n" + TEMPLATE[0], None)]


@pytest.mark.parametrize("limit", [20, 10_000])
def test_both_ways_agree(spark, monkeypatch, limit):
    df = spark.createDataFrame(ROWS, SCHEMA).repartition(3)
    lain = quality.quality_rules(df, limit=limit, clean=True)
    monkeypatch.setattr(quality, "HELD_LINES", -1)
    joined = quality.quality_rules(df, limit=limit, clean=True)
    assert lain.schema == joined.schema
    got, want = (sorted(map(tuple, x.collect()), key=repr) for x in (lain, joined))
    assert got == want and len(got) == len(ROWS)
    assert any(r[-1] for r in got) == (limit == 20)


def test_texts_stay_where_they_lie(spark, monkeypatch):
    monkeypatch.setattr(quality, "BROADCAST_ROWS", 10)
    plan = quality.quality_rules(spark.createDataFrame(ROWS, SCHEMA), clean=True)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "hashpartitioning(__h1" not in plan and "BroadcastHashJoin" in plan
