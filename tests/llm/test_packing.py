"""Packing against the tokenizers library, bounds on the number of sequences, and edge cases."""

from __future__ import annotations

import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from test_edges import prose

from corvane.llm import packing
from corvane.llm.bpe import default_path

ODD = [None, "", " ", "a<|endoftext|>b", "ΑΣ ΟΔΟΣ Σ", "x\x1cy　r", "don't I'LL", "\U0001f600 ok", "a" * 3000, "w " * 5000]


def best_fit(counts) -> int:
    """Sequences that best fit decreasing needs, piece by piece."""
    size, gaps, made = len(counts) - 1, defaultdict(int), 0
    for length in range(size, 0, -1):
        for _ in range(int(counts[length])):
            gap = min((g for g in gaps if g >= length and gaps[g]), default=0)
            if gap:
                gaps[gap] -= 1
            else:
                gap, made = size, made + 1
            gaps[gap - length] += 1
    return made


@pytest.mark.parametrize("seed", range(4))
def test_plan_places_each_piece_once(seed):
    r = np.random.default_rng(seed)
    size = 64
    counts = np.zeros(size + 1, np.int64)
    for x in np.minimum(r.lognormal(2.8, [0.9, 0.3, 0.6, 2.0][seed], 3000).astype(int) + 1, size):
        counts[x] += 1
    made = packing.plan(counts)
    room, seen = np.zeros(made.n_sequences, int), np.zeros(size + 1, np.int64)
    for length in range(1, size + 1):
        mine = np.flatnonzero(made.length == length)
        for rank in range(counts[length]):
            k = mine[np.searchsorted(made.first[mine], rank, "right") - 1]
            room[made.sequence[k] + (rank - made.first[k]) // made.copies[k]] += length
            seen[length] += 1
    assert (seen == counts).all() and room.max() <= size and room.min() > 0
    least = -(-int((counts * np.arange(size + 1)).sum()) // size)
    assert least <= made.n_sequences <= max(best_fit(counts), least) * 1.01 + 1


def test_fit_is_near_the_histogram_where_patterns_can_be():
    counts = np.zeros(65, np.int64)
    counts[[10, 20, 34, 30, 54]] = [500, 400, 300, 100, 80]
    rows = packing.patterns(counts)
    x = packing.fit(rows, counts, 3000)
    used = sum(np.bincount(rows[:, k], x, 65) for k in range(3))
    a, b, c = np.meshgrid(np.arange(0, 400.0, 5), np.arange(0, 200.0, 5), np.arange(0, 200.0, 5), indexing="ij")  # 10 + 20 + 34, 10 + 54, 30 + 34
    want = ((300 - a - c) ** 2 + (400 - a) ** 2 + (500 - a - b) ** 2 + (80 - b) ** 2 + (100 - c) ** 2).min()
    assert ((used - counts)[1:] ** 2).sum() <= want * 1.01 and (x >= 0).all()


def test_pieces_agree_with_the_library(spark):
    from tokenizers import Tokenizer

    r = random.Random(5)
    texts = [*ODD, *(prose(r.randint(0, 900), k) for k in range(60))]
    rows = [(k, t, f"s{k}", k) for k, t in enumerate(texts)] + [(3, "twice", "x", 1), (3, "twice", "x", 1), (None, "no id", None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, sequence_id string, task long").repartition(5)
    got = packing.pack(df)
    out = got.collect()
    library, want = Tokenizer.from_file(default_path()), []
    for i, t, *_ in rows:
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 0]
        for p, s in enumerate(range(0, len(ids), 2048)):
            mine = ids[s : s + 2048]
            want.append((i, p, s, len(mine), zlib.crc32(np.array(mine, "<u4").tobytes()), mine))
    key = lambda x: (x[0] is None, x[0] or 0, *x[1:])
    assert sorted([(o.doc_id, o.piece, o.start, o.length, o.ids_crc32, list(o.ids)) for o in out], key=key) == sorted(want, key=key)
    held = defaultdict(list)
    for o in out:
        held[o.sequence_id].append((o.offset, o.length))
    for x in held.values():
        at = 0
        for offset, length in sorted(x):
            assert offset == at
            at += length
        assert at <= 2048
    total = sum(o.length for o in out)
    assert len(held) <= -(-total // 2048) + 1
    made = {s.sequence_id: s for s in packing.sequences(got).collect()}
    assert set(made) == set(held) and sum(len(s.ids) for s in made.values()) == total
    some = next(s for s in made.values() if len(s.starts) > 1)
    assert list(some.starts) == sorted(o for o, _ in held[some.sequence_id])


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert packing.pack(df, ids=False).collect() == []


def test_one_length_alone(spark):
    df = spark.createDataFrame([(k, "") for k in range(5000)], "doc_id long, text string").repartition(7)
    out = packing.pack(df, ids=False).collect()
    assert len(out) == 5000 and len({o.sequence_id for o in out}) == 3 and len({(o.sequence_id, o.offset) for o in out}) == 5000
