"""Nulls, empty and very long texts, ties, repeated rows, empty tables, and extra columns with clashing names, for every operator and stage."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import brute
import pytest
from pyspark.sql import functions as F

from corvane.llm import ann, bpe, chat, html, minhash, mixing, quality, secrets, suffix_dedup, warc

RND = random.Random(4)
VOCABULARY = ["".join(RND.choice("abcdefghij") for _ in range(RND.randint(1, 7))) for _ in range(300)]


def prose(n: int, seed: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(VOCABULARY) for _ in range(n))


LONG = prose(20_000, 1)
PART = prose(60, 2)
TEXTS = [
    (1, prose(40, 3), "b"), (2, prose(40, 3), "b"), (3, None, "b"), (4, "", None), (5, " \n\t ", ""), (6, "one", "a"), (7, "one two three four", "a"),
    (8, LONG, "a"), (9, LONG[:4000] + " changed " + LONG[4000:], "a"), (10, PART + " " + prose(30, 5), None), (11, prose(25, 6) + " " + PART, "b"), (12, "x" * 90_000, "b"),
    (13, "ab" * 200, "a"), (14, "Ünï Straße Σ <|endoftext|> I'm\x1f ok\x85" * 9, "b"), (15, "\n".join(["same line here"] * 30), "a"), (16, PART, "a"), (17, "PASSWORD = 'abcdef123' AKIA" + "A" * 20 + " " + "0f" * 14, "a"),
]
SCHEMA = "doc_id long, text string, source string"


def docs(spark, rows=None):
    """With columns that clash with those that operators make."""
    df = spark.createDataFrame(TEXTS if rows is None else rows, SCHEMA).repartition(3)
    return df.withColumns({n: F.lit("clash") for n in ("size", "target", "taken", "kept", "n_words", "component_id", "node", "key", "d", "t", "h", "ids", "decoded", "spans", "n_bytes", "text_", "lang", "n_chars", "__c", "base_failed")})


def got(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def test_suffix_dedup(spark):
    cols = ("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256))
    rows = [(i, t) for i, t, _ in TEXTS]
    assert got(suffix_dedup.remove_repeats(docs(spark)), *cols) == sorted(brute.repeats(rows), key=repr)
    assert got(suffix_dedup.remove_repeats(docs(spark, [])), *cols) == []
    twice = suffix_dedup.remove_repeats(docs(spark, TEXTS + TEXTS[:3] + [(None, PART, "a"), (16, prose(50, 9), "a")]))
    out = got(twice, *cols)
    assert len(out) == len(TEXTS) + 5 and out.count(out[0]) >= 1
    assert [r[2] for r in out if r[0] is None] == [len(PART)]  # rows without a key come last in order


def test_gsaca():
    from corvane.llm.gsaca import suffix_array

    r = random.Random(3)
    for _ in range(2000):
        t = "".join(r.choice("abĀ\0"[: r.randint(1, 4)]) for _ in range(r.randint(0, 30)))
        assert suffix_array(t) == sorted(range(len(t)), key=lambda i: t[i:])


def test_secrets(spark):
    out = {r.doc_id: r for r in secrets.scan(docs(spark)).collect()}
    for i, t, _ in TEXTS:
        assert (out[i].n_assign, out[i].n_access, out[i].n_hex, out[i].base_sha256) == brute.secrets_base(t)
    assert out[17].spans.startswith("assign:0:")
    assert secrets.scan(docs(spark, [])).count() == 0
    clean = {r.doc_id: r.text for r in secrets.redacted(spark.createDataFrame(TEXTS, SCHEMA)).collect()}
    assert clean[17] == "PASSWORD = '[REDACTED]' [REDACTED] [REDACTED]" and clean[3] is None and clean[8] == LONG
    for text, want in [('client_key = "x"', ""), ('aws_secret_key = "wJalrXUtnFEMI/K7MDENG"', "literal:18:39"), ('k = "Zk39fLq0aPw8"\ndb_pwd = k', "literal:5:17"), ("Author: John Smith = fine", "")]:
        assert secrets.told(secrets.spans_of(text)) == want


def test_neighbours(spark):
    r = random.Random(8)
    x = [[r.gauss(0, 1) for _ in range(6)] for _ in range(400)]
    rows = [(i, v) for i, v in enumerate(x)] + [(i, x[0]) for i in range(400, 460)] + [(500, None), (520, [0.0] * 6), (540, [float("nan")] * 6), (560, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (None, x[1]), (580, []), (600, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit("clash")).repartition(3)
    out = ann.search(df, df.where("vec_id % 20 = 0"), shard=128).collect()
    good = {i: v for i, v in rows if i is not None and v and len(v) == 6 and all(c is not None and c == c for c in v) and any(v)}
    hits = total = 0
    for q in [i for i in good if i % 20 == 0]:
        want = sorted((-sum(a * b for a, b in zip(good[q], v)), i) for i, v in good.items() if i != q)[:20]
        mine = sorted((r.rank, r.vec_id, r.score) for r in out if r.query_id == q)
        assert [m[0] for m in mine] == list(range(1, 21))
        assert [(-m[2], m[1]) for m in mine] == sorted((-m[2], m[1]) for m in mine)
        hits += len({m[1] for m in mine} & {i for _, i in want})
        total += 20
    assert hits / total >= 0.9
    assert not [r for r in out if r.query_id in (500, 520, 540, 560, 580)]
    assert ann.search(df.limit(0), df.limit(0)).count() == 0


def test_html(spark):
    page = "<html><head><title>t</title></head><body><nav><a href=x>menu</a></nav><div class='cookie-notice'>ok?</div><article><header><h1>A &amp; B</h1></header><p>one\n two<p>three<br>four<aside>side</aside><form>f</form><script>var p='</p>';</script><div id=comments><p>hi</div></article><footer>foot</footer>"
    rows = [(1, page), (2, None), (3, ""), (4, "plain & text"), (5, "<p>" * 3000 + "deep"), (6, "<b>un<i>closed" + "x" * 50_000), (7, "<script>only</script>"), (1, page)]
    df = spark.createDataFrame(rows, "page_id long, html string").withColumn("text", F.lit("clash")).withColumn("url", F.lit(None).cast("string"))
    out = html.extract(df).collect()
    told = {r.page_id: r.text for r in out}
    assert len(out) == len(rows) and told[1] == "A & B\n\none two\n\nthree four" and told[2] == told[3] == told[7] == "" and told[4] == "plain & text" and told[5] == "deep"
    assert all(r.n_chars == len(r.text) for r in out)
    assert html.extract(df.limit(0)).count() == 0


def test_mixing(spark):
    rows = TEXTS + TEXTS[:2] + [(None, PART, "a")]
    out = mixing.mix(docs(spark, rows)).collect()
    assert len(out) == len(rows)
    again = mixing.mix(docs(spark, rows).repartition(5)).collect()
    assert Counter(map(tuple, out)) == Counter(map(tuple, again))
    size = {s: sum(len(brute.WORD.findall(t or "")) for _, t, x in rows if x == s) for s in ("", "a", "b", None)}
    assert {r.source_size for r in out} == set(size.values())
    for r in out:
        assert 0 <= r.taken <= 3 * r.size and (r.taken % r.size == 0 if r.size else r.taken == 0)
    assert sum({(r.source_size, r.target): r.target for r in out}.values()) == pytest.approx(sum(size.values()))
    assert mixing.mix(docs(spark, [])).count() == 0


def test_budget_is_met():
    import itertools

    import numpy as np

    r = random.Random(5)
    for _ in range(200):
        sizes = np.array(sorted(r.sample(range(1, 40), r.randint(1, 4))))
        counts = np.array([r.randint(1, 3) for _ in sizes])
        budget = r.randint(0, int((sizes * counts).sum()) + 3)
        take = mixing.fit(sizes, counts, budget)
        assert (take <= counts).all() and (take >= 0).all()
        best = max(s for s in (sum(int(a) * b for a, b in zip(sizes, k)) for k in itertools.product(*(range(c + 1) for c in counts))) if s <= budget)
        assert int((take * sizes).sum()) <= budget and best - int((take * sizes).sum()) <= int(sizes.max())


def test_minhash(spark):
    cols = ("doc_id", "n_shingles", "component_id", "kept")
    r = random.Random(6)
    near = []
    for g in range(12):
        words = prose(r.randint(5, 80), 100 + g).split()
        for k in range(6):
            copy = words[:]
            for _ in range(r.randint(0, 2)):
                copy[r.randrange(len(copy))] = "edit"
            near.append((100 + 10 * g + k, " ".join(copy), "a"))
    rows = TEXTS + near
    assert got(minhash.near_duplicates(docs(spark, rows)), *cols) == sorted(brute.near([(i, t) for i, t, _ in rows]), key=repr)
    assert minhash.near_duplicates(docs(spark, [])).count() == 0
    out = got(minhash.near_duplicates(docs(spark, TEXTS + TEXTS[:2] + [(None, PART, "a")])), *cols)
    assert len(out) == len(TEXTS) + 3 and [x for x in out if x[0] is None] == [(None, 56, None, True)]


def test_warc(spark):
    body = "é" * 700
    rows = [(1, "http://a/ b\r\n", body), (2, None, body), (3, "u", "short"), (4, "u", "short"), (5, "u", None), (6, "u", ""), (7, "u", "y" * 3_000_000), (None, "u", body), (2, None, body)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("payload", F.lit("clash")).repartition(2)
    out = warc.round_trip(df).collect()
    assert len(out) == len(rows)
    for r in out:
        text = (next(h for i, _, h in rows if i == r.page_id) or "").encode()
        assert r.payload_bytes == len(text) and r.payload_digest == hashlib.sha1(text).hexdigest()
    told = sorted((r.page_id, r.record_type, r.refers_to) for r in out if r.page_id in (1, 2))
    assert told == [(1, "revisit", 2), (2, "response", None), (2, "response", None)]
    assert warc.round_trip(df.limit(0)).count() == 0
    archive = warc.write_archive([warc.record(1, "u", b"abc" * 500, None, False)] * 3)
    assert [warc.read_record(f)["payload"] for f in warc.frames(archive)] == [b"abc" * 500] * 3
    for bad in (archive[4:], archive[:-3], archive[:20], b""):
        with pytest.raises(warc.BadArchive):
            list(warc.frames(bad))
    whole = warc.record(1, "u", b"abc", None, False)
    for bad in (whole[:-1], whole.replace(b"abc\r\n\r\n", b"abd\r\n\r\n"), whole.replace(b"Content-Length: 3", b"Content-Length: 4"), whole.replace(b"WARC-Date", b"X-Date"), b"x" + whole):
        with pytest.raises(warc.BadArchive):
            warc.read_record(bad)


def test_chat(spark):
    rows = [(c, t, ("user", "assistant")[t % 2], prose(8 + 20 * (t % 2), 10 * c + t) + "?" * (t % 2 == 0)) for c in range(40) for t in range(6)] + [(50, 0, None, None), (51, None, "user", "x"), (None, 1, "user", "y"), (52, 0, "user", LONG), (53, 0, "user", "a"), (53, 0, "user", "a")]
    rows += [(60, t, ("user", "assistant")[t % 2], f"turn {t}") for t in range(600)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("n", F.lit("clash")).repartition(3)
    labelled = chat.transcripts(df)
    model = chat.fit(labelled.where(chat.fitting()))
    out = chat.agreement(chat.format_chats(labelled, model), labelled, model.roles).collect()
    scored = [r for r in out if r.conv_id is not None and r.conv_id < 50 and r.held_out]
    assert len(scored) > 10 and sum(r.n_right for r in scored) / sum(r.n_lines for r in scored) > 0.9  # the model wasn't fitted on these
    assert all((r.n_right is None) != r.held_out for r in out)
    assert sorted(r.part for r in out if r.conv_id == 60) == [0, 1, 2]
    assert chat.format_chats(labelled.limit(0), model).count() == 0
    assert chat.fit(labelled.limit(0)).turns("User: hi")[0]
    assert chat.canonical([("user", "a")]) == "<|user|>\na\n<|end|>\n"


def test_quality(spark):
    out = {r.doc_id: r for r in quality.quality_rules(docs(spark)).collect()}
    for i, t, _ in TEXTS:
        r = out[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute.quality(t)
    assert quality.quality_rules(docs(spark, [])).count() == 0
    line = "terms of use apply to all pages of this site"
    rows = [(i, f"{line}\n{line}s\n" + prose(200 if i % 2 else 10, 900 + i), "h") for i in range(60)]
    rows += [(100 + i, prose(50, 1), "h") for i in range(60)]  # copies of one document are one document
    kept = {r.doc_id: r.kept for r in quality.quality_rules(docs(spark, rows)).collect()}
    assert all(kept[i] for i in range(60) if i % 2) and all(kept[100 + i] for i in range(60))
    boiler = [prose(9, 7000 + k) for k in range(6)]
    rich = [(1000 + i, "\n".join([*random.Random(i).sample(boiler, 4), *(prose(30, 5000 + 9 * i + k) for k in range(4))]), "h") for i in range(120)]
    bare = [(i, "\n".join([*random.Random(i).sample(boiler, 4), f"w{i}"]), "h") for i in range(60)]
    told = quality.quality_rules(docs(spark, rich + bare)).collect()
    assert not any(r.base_failed for r in told) and {r.doc_id for r in told if r.kept} == {i for i, _, _ in rich}


def test_bpe(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(bpe.default_path())
    t.no_truncation()
    t.no_padding()
    out = {r.doc_id: r for r in bpe.encode_decode(docs(spark)).collect()}
    told = {r.doc_id: r for r in bpe.digests(docs(spark)).collect()}
    for i, text, _ in TEXTS:
        ids = t.encode(text or "", add_special_tokens=False).ids
        assert out[i].ids == ids and out[i].decoded == t.decode(ids, skip_special_tokens=False)
        assert (told[i].n_tokens, told[i].ids_sha256, told[i].decoded_sha256) == (len(ids), brute.sha(" ".join(map(str, ids))), brute.sha(out[i].decoded))
        assert bpe.codec(bpe.default_path()).decode(ids) == out[i].decoded
    assert bpe.encode_decode(docs(spark, [])).count() == 0


def test_pipeline(spark, tmp_path):
    import corpus_pipeline as p

    rows = [(i, t, "en", s, len(t) if t else None) for i, t, s in TEXTS + [(30, TEXTS[0][1], "a"), (1, TEXTS[0][1], "b"), (None, prose(30, 77), None)]]
    for name, some in (("full", rows), ("none", [])):
        spark.createDataFrame(some, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/{name}/documents.parquet")
        df = spark.read.parquet(f"{tmp_path}/{name}/documents.parquet")
        for c in ("__row", "__n", "__times", "__c", "kept", "size", "taken", "n_words", "__host", "component_id", "ids", "decoded", "clean_text"):
            df = df.withColumn(c, F.concat(F.lit(f"{c} of "), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))))
        seen = [df]
        for k, (n, stage) in enumerate(p.STAGES):
            stage(spark, df, f"{tmp_path}/{name}").write.parquet(f"{tmp_path}/{name}/{k}")
            df = spark.read.parquet(f"{tmp_path}/{name}/{k}")
            seen.append(df)
        columns = [d.columns for d in seen]
        assert all(c == columns[0] for c in columns[:-1])
        for d in seen[:-1]:
            assert d.where("kept <> concat('kept of ', coalesce(cast(doc_id as string), 'none')) or __n <> concat('__n of ', coalesce(cast(doc_id as string), 'none'))").isEmpty()
        if some:
            base = {(i, t) for i, t, *_ in rows if not brute.quality(t)[5]}
            assert {(r.doc_id, r.text) for r in seen[1].collect()} == base
            keyed = [(i, t) for i, t in base if i is not None]
            stay = {i for i, _, _, kept in brute.near(sorted(keyed)) if kept}
            left = [(r.doc_id, r.text) for r in seen[2].collect()]
            assert {i for i, _ in left if i is not None} == stay and len(left) == len(set(left)) == len(stay) + 1
            assert "PASSWORD = '[REDACTED]'" not in {t for _, t in left}
            taken = Counter(r.doc_id for r in seen[4].collect())
            assert set(taken) <= {i for i, _ in left} and max(taken.values()) <= 3
            assert Counter(r.doc_id for r in seen[5].collect()) == taken
    assert p.run(spark, f"{tmp_path}/full").count() == seen[0].sparkSession.read.parquet(f"{tmp_path}/full/4").count()
