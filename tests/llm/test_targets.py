"""Targets of sources, and what the mix takes of each, against plain versions."""

from __future__ import annotations

import random

import pytest
from brute import WORD
from test_edges import prose

from corvane.llm import mixing


def plain_targets(sizes: list[int], weights=(5, 2, 1), most: int = 3) -> list[float]:
    """Shares by weight; what is above a cap is shared again among the others until none is."""
    n, out, free = len(sizes), [0.0] * len(sizes), set(range(len(sizes)))
    rest = float(sum(sizes))
    while free:
        total = sum(weights[k % 3] for k in free)
        over = {k for k in free if rest * weights[k % 3] / total > most * sizes[k] + 1e-9}
        if not over:
            for k in free:
                out[k] = rest * weights[k % 3] / total
            break
        for k in over:
            out[k] = float(most * sizes[k])
        rest -= sum(out[k] for k in over)
        free -= over
    assert n == len(out)
    return out


def test_targets_agree_with_the_plain_ones(spark):
    r = random.Random(31)
    for _ in range(12):
        sizes = [r.choice([0, 1, 5, 40, 300, 1000]) for _ in range(r.randint(1, 9))]
        df = spark.createDataFrame([(False, f"s{k}", s) for k, s in enumerate(sizes)], "__none boolean, __src string, source_size long")
        got = {x["__src"]: x["target"] for x in mixing.targets(df).collect()}
        assert [got[f"s{k}"] for k in range(len(sizes))] == pytest.approx(plain_targets(sizes)), sizes


def test_sources_come_near_their_targets(spark):
    r = random.Random(32)
    rows, k = [], 0
    for source, n in (("B", 40), ("a", 300), ("ä", 3), ("z", 120), (None, 60), ("", 25)):
        for _ in range(n):
            rows.append((k, prose(r.randint(0, 30), k) if k % 17 else None, source))
            k += 1
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    out = mixing.mix(df).collect()
    size = {i: len(WORD.findall(t or "")) for i, t, _ in rows}
    order = ["", "B", "a", "z", "ä", None]
    totals = [sum(size[i] for i, _, s in rows if s == x) for x in order]
    want = dict(zip(order, plain_targets(totals)))
    source = {i: s for i, _, s in rows}
    for x, total in zip(order, totals):
        mine = [o for o in out if source[o.doc_id] == x]
        assert {o.source_size for o in mine} == {total} and {round(o.target, 6) for o in mine} == {round(want[x], 6)}
        assert abs(sum(o.taken for o in mine) - want[x]) <= 1.5
    assert all(o.size == size[o.doc_id] and o.taken <= 3 * o.size for o in out)
    other = {o.doc_id: o.taken for o in mixing.mix(df, seed=1).collect()}
    assert other != {o.doc_id: o.taken for o in out}


def test_a_rest_beyond_the_table_is_met(spark):
    import numpy as np

    r = random.Random(33)
    for _ in range(60):
        sizes = np.array(sorted(r.sample(range(1, 400), 6)))
        counts = np.array([r.randint(1, 40) for _ in sizes])
        budget = r.randint(0, int((sizes * counts).sum()))
        for words in (16, 400, 1 << 16):
            take = mixing.fit(sizes, counts, budget, words)
            gap = budget - int((take * sizes).sum())
            assert (take >= 0).all() and (take <= counts).all() and 0 <= gap <= (400 if words == 16 else 200)
            if budget <= words:  # the best that any choice can do
                sums = {0}
                for s, c in zip(sizes.tolist(), counts.tolist()):
                    sums = {x + s * k for x in sums for k in range(c + 1) if x + s * k <= budget}
                assert budget - gap == max(sums)


def test_many_sources_of_every_size(spark):
    r = random.Random(34)
    sizes = [round(2 ** r.uniform(0, 30)) for _ in range(700)]
    df = spark.createDataFrame([(False, f"h{k:04d}", s) for k, s in enumerate(sizes)], "__none boolean, __src string, source_size long").repartition(6)
    got = {x["__src"]: x["target"] for x in mixing.targets(df).collect()}
    assert [got[f"h{k:04d}"] for k in range(len(sizes))] == pytest.approx(plain_targets(sizes))
    assert mixing.targets(df.limit(0)).count() == 0
