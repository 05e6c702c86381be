"""Pairs that share a bucket but whose sizes rule a link out are dropped before full sets are sent."""

from __future__ import annotations

from corvane.llm import minhash


def test_unfit_pairs_get_no_sets(spark, monkeypatch):
    words = [f"w{i}" for i in range(400)]
    texts = [" ".join(words[:n]) for n in (204, 400, 208)] + [" ".join(words[:204]) + " end"]  # sets of 200, 396, 204 and 201
    asked, real = [], minhash.confirm
    monkeypatch.setattr(minhash, "confirm", lambda pairs, sets, percent: asked.append((pairs.collect(), sets.collect())) or real(pairs, sets, percent))
    docs = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")
    told = {r.doc_id: r.component_id for r in minhash.near_duplicates(docs).collect()}
    assert told == {0: 0, 1: 1, 2: 0, 3: 0}
    pairs, sets = asked[0]
    size = {bytes(r.node): len(r.set) // 8 for r in sets}
    assert 396 in size.values()  # it shares buckets with the others
    assert pairs and all(396 not in (size[bytes(r.u)], size[bytes(r.v)]) for r in pairs)
