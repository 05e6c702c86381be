"""Admission makes n-grams of texts that they can still reject, and tells the same of all others."""

from __future__ import annotations

from pyspark.sql import functions as F

from corvane.functions import text as T
from corvane.operators import dedup


def test_grams_are_made_of_viable_texts_alone(spark, monkeypatch):
    item = " ".join(f"w{i}" for i in range(20))
    texts = [f"ok a {item}", f"bad b {item}", "ok c", "ok c", "bad c", item, None, "ok d " + "x " * 30]
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    asked, real = [], dedup.sharing_grams
    monkeypatch.setattr(dedup, "sharing_grams", lambda rows, *a: asked.append(rows) or real(rows, *a))
    ok = F.coalesce(F.col("text").startswith("ok") | (F.col("text") == item), F.lit(False))
    told = dedup.admit(docs, spark.createDataFrame([(item,)], "text string"), ("en",), 9, ok)
    status = {r.doc_id: r.status for r in told.collect()}
    assert [status[i] for i in range(8)] == ["eval_ngram", "not_viable", "admit", "duplicate", "not_viable", "eval_exact", "not_viable", "admit"]
    assert sorted(r.doc_id for r in asked[0].select("doc_id").collect()) == [0, 2, 3, 5, 7]


def test_latin_share_of_mixed_scripts(spark):
    rows = spark.createDataFrame([(x,) for x in (None, "", "12 !", "aä𝒜Жb", "ß ﬀ ª º ʰ ⅷ K", "日本 text", "𐐀ab")], "x string")
    plain = F.regexp_count("x", F.lit(r"\p{IsLatin}")) / F.nullif(F.regexp_count("x", F.lit(r"\p{L}")), F.lit(0))
    assert rows.where(~plain.eqNullSafe(T.latin_share(F.col("x")))).count() == 0
