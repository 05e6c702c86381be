"""Components, shingles and the candidate tables by themselves."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
from brute import shingles
from test_edges import prose

from corvane.llm import components, minhash
from corvane.llm.shingles import shingle_sets


def plain(links: list[tuple]) -> dict:
    sets = components.Union()
    for u, v in links:
        sets.join(u, v)
    return {x: sets.find(x) for link in links for x in link}


def test_components(spark, monkeypatch):
    monkeypatch.setattr(components, "LOCAL_LINKS", 7)
    r = random.Random(2)
    chain = [(i, i + 1) for i in range(200)]
    star = [(500, 501 + i) for i in range(300)]
    loose = [(1000 + r.randrange(150), 1000 + r.randrange(150)) for _ in range(90)]
    for links in (chain + star + loose + [(3, 3)], [(i, i - 7) for i in range(2000, 2100)] * 2):
        rows = r.sample(links, len(links))
        df = spark.createDataFrame(rows, "u long, v long").repartition(5)
        want = {x: y for x, y in plain(links).items() if sum(v == y for v in plain(links).values()) > 1}
        got = components.components(df).collect()
        assert {(g.node, g.root) for g in got} == set(want.items()) and len(got) == len(want)
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_shingles():
    texts = [None, "", " \t", "One two", "one TWO", "a b c d e", "a b c d e a b c d e", prose(300, 1), "Ünï x y z w v"]
    sets = shingle_sets(pa.array(texts))
    assert [len(s) for s in sets] == [len(shingles(t)) for t in texts]
    assert sets[3].tolist() == sets[4].tolist() and sets[5].tolist() != sets[6].tolist()


def near_pair(r: np.random.Generator, size: int, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Two sets of hashes whose similarity is as near to the percentage from above as whole numbers allow."""
    both = -(-size * percent // 100)
    x = r.integers(0, 1 << 63, size, dtype=np.uint64)
    one = (size - both) // 2
    return np.sort(x[: both + one]), np.sort(np.append(x[:both], x[both + one :]))


def test_tables_miss_few_links():
    """At similarity 0.75 a pair is in no common table once in some 3200 times; at 0.8 hardly ever."""
    r = np.random.Generator(np.random.PCG64(9))
    for percent, most in ((75, 9), (80, 2)):
        pairs = [near_pair(r, 200, percent) for _ in range(5000)]
        low = [minhash.signatures([p[k] for p in pairs]).reshape(len(pairs), 2, minhash.HASHES, minhash.ROWS) for k in (0, 1)]
        met = (low[0] == low[1]).all(3).any(2).all(1)
        assert (~met).sum() <= most


def test_blocks_lose_no_link():
    r = np.random.Generator(np.random.PCG64(10))
    sets = [x for size in (4, 40, 41, 300, 900) for _ in range(30) for x in near_pair(r, size, int(r.integers(60, 95)))]
    rows = [(k % 2, b"%04d" % k, b"%04d" % k, s.tobytes()) for k, s in enumerate(sets)]
    for some in (rows, [x for x in rows if x[0]]):
        some = sorted(some, key=lambda x: x[0])
        two = some[0][0] != some[-1][0]
        every = [(x[1], y[1]) for i, x in enumerate(some) for y in some[i + 1 :] if not (two and x[0] == y[0]) and minhash.similar(np.frombuffer(x[3], np.uint64), np.frombuffer(y[3], np.uint64), 75)]
        got = minhash.linked(some, 75)
        assert set(got) <= set(every) and plain(got) == plain(every)
