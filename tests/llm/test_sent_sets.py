"""Full sets are sent only for pairs and classes that bitmaps of the sets don't rule out, and no link is lost by them."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from brute import near
from corvane.llm import minhash
from corvane.llm.shingles import shingle_sets


def share(s, t):
    both = len(np.intersect1d(s, t))
    return 100 * both / (len(s) + len(t) - both)


def family(rng, size, changed):
    """Texts of one length: the first, and copies whose last words are others, so that each has 100 * (n - c) / (n + c) of their union with it."""
    first = [f"w{x}" for x in rng.integers(0, 10**9, size + 4)]
    return [" ".join(first[: len(first) - c] + [f"x{x}" for x in rng.integers(0, 10**9, c)]) for c in (0, *changed)]


def test_unlike_pairs_get_no_sets(spark, monkeypatch):
    rng = np.random.default_rng(5)
    texts = [t for _ in range(6) for t in family(rng, 300, (20, 100, 110))]  # similar to the first by 88, 50 and 46 percent
    asked, real = [], minhash.confirm
    monkeypatch.setattr(minhash, "confirm", lambda pairs, sets, percent: asked.extend(pairs.collect()) or real(pairs, sets, percent))
    told = minhash.near_duplicates(spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in told) == sorted(near([*enumerate(texts)]))
    sets = {minhash.class_key(s): s for s in shingle_sets(pa.array(texts))}
    assert asked and all(share(sets[bytes(r.u)], sets[bytes(r.v)]) > 60 for r in asked)


def test_opened_loses_no_link_and_leaves_the_others():
    rng = np.random.default_rng(7)
    texts = [t for n in (1, 3, 12, 40, 64, 65, 200, 900) for t in family(rng, n, {0, n // 20, n // 8, n // 3, n // 2} - {0})] + ["a b c", "d e"]
    texts += [" ".join(t.split()[: len(t.split()) * 3 // 4 + 2]) for t in texts]  # shorter ones, whose bitmaps may be narrower
    sets = list({minhash.class_key(s): s for s in shingle_sets(pa.array(texts))}.items())
    order = rng.permutation(len(sets))
    for two in (False, True):
        rows = sorted((k % 2 if two else 0, *sets[k], b"%d" % (k if k % 7 else 0)) for k in order.tolist())
        rows = [(b, node, r, s) for b, node, s, r in sorted(((b, node, s, r) for b, node, s, r in rows), key=lambda x: x[:2])]
        got = {x[0] for x in minhash.opened([(b, node, r, len(s), minhash.bitmap(s)) for b, node, r, s in rows], 75)}
        pairs = [(x, y) for x, y in combinations(rows, 2) if x[2] != y[2] and (not two or x[0] != y[0])]
        links = {z[1] for x, y in pairs if minhash.similar(x[3], y[3], 75) for z in (x, y)}
        alone = {x[1] for x in rows} - {z[1] for x, y in pairs if share(x[3], y[3]) >= 50 for z in (x, y)}
        assert links <= got and links
        assert sum(len(dict((n, s) for _, n, _, s in rows)[n]) > 30 for n in alone & got) == 0


def test_bitmaps_fold_and_bound():
    rng = np.random.default_rng(1)
    for n in (1, 8, 9, 500, 513):
        s = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
        bits = np.frombuffer(minhash.bitmap(s), np.uint64)
        assert len(bits) * 64 >= minhash.SENT_SPREAD * len(s) and len(bits) * 8 <= max(8, 2 * len(s))
        assert minhash.possible(bits, bits, len(s), len(s), 100)
        assert (minhash.folded(bits, 1) == np.bitwise_or.reduce(bits)).all()
