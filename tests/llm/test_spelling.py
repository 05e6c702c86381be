"""Spelling variants against a plain version, and edge cases."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter

from corvane.llm import spelling

RUN = re.compile("[A-Za-zÀ-ÿ]+")


def plain_words(rows) -> Counter:
    n = Counter()
    for i, t in rows:
        for run in RUN.findall(t or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            n[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 97 == 0 else run] += 1
    return Counter({w: k for w, k in n.items() if len(w) >= 5 and k >= 3})


def one_apart(a: str, b: str) -> bool:
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain(n: Counter) -> list[tuple]:
    near = {w: [v for v in n if abs(len(v) - len(w)) < 2 and one_apart(w, v)] for w in n}
    form = {}
    for w, vs in near.items():
        best = min(vs, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return sorted(out)


def told(df) -> list[tuple]:
    return sorted((r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect())


def texts(seed: int) -> list[tuple]:
    r = random.Random(seed)
    base = ["banana", "bananna", "banan", "aaaaa", "aaaaaa", "aabaa", "abaaa", "élève", "eleve", "élèves", "ÿÿÿÿÿ", "straße", "x×÷yz", "colour", "color", "colours", "x" * 40, "x" * 39, "x" * 20 + "y" + "x" * 19, "y" * 700, "y" * 701]
    letters = "abé"
    words = base + ["".join(r.choice(letters) for _ in range(r.randint(4, 7))) for _ in range(120)]
    rows = []
    for i in range(150):
        chosen = [r.choice(words) if r.random() < 0.7 else r.choice(base) for _ in range(r.randint(0, 60))]
        rows.append((i, r.choice([" ", "-", "\n", "1", "_"]).join(w.upper() if w.isascii() and r.random() < 0.1 else w for w in chosen)))
    return rows


def test_agrees_with_the_plain_version(spark):
    for seed in range(3):
        rows = [*texts(seed), (7, None), (None, "banana banana banana"), (8, ""), (8, "colour"), (8, "colour")]
        df = spark.createDataFrame([(i, t, 1, "w") for i, t in rows], "doc_id long, text string, n int, word string").repartition(5)
        assert told(spelling.spellings(df)) == plain(plain_words(rows))


def test_chains_are_followed_to_their_end(spark):
    chain = ["b" * 5 + "a" * k for k in range(12)]
    rows = [(i, " ".join([w] * (3 * 2**k))) for k, w in enumerate(chain) for i in [k]]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = plain(Counter({w: 3 * 2**k for k, w in enumerate(chain)}))
    assert told(spelling.spellings(df, every=None)) == want and {x[2] for x in want} == {chain[-1]}


def test_a_word_with_all_its_variants(spark):
    letters = "abcdefghijklmnopqrstuvwxyz"
    n = Counter({"middle": 5000})
    for k in range(6):
        for c in letters:
            n["middle"[:k] + c + "middle"[k:]] = 7
            n["middle"[:k] + c + "middle"[k + 1 :]] = max(n["middle"[:k] + c + "middle"[k + 1 :]], 9)
    df = spark.createDataFrame([(0, " ".join(w for w, k in n.items() for _ in range(k)))], "doc_id long, text string")
    assert told(spelling.spellings(df, every=None)) == plain(n)


def test_long_words(spark):
    r = random.Random(21)
    n = Counter()
    for size in (62, 63, 64, 65, 66, 67, 130, 400):
        base = "".join(r.choice("abcé") for _ in range(size))
        n[base] = 40 + size
        for _ in range(12):
            k, c = r.randrange(size), r.choice("abcdé")
            for w in (base[:k] + c + base[k + 1 :], base[:k] + c + base[k:], base[:k] + base[k + 1 :]):
                n[w] = max(n[w], r.randint(3, 12))
            n[base[:k] + base[k + 1 :] + c] = 3
    for size in range(60, 70):
        n["a" * size] = 5 * size
    df = spark.createDataFrame([(0, " ".join(w for w, k in n.items() for _ in range(k)))], "doc_id long, text string")
    assert told(spelling.spellings(df, every=None)) == plain(n)


def test_a_word_of_a_million_letters(spark):
    r = random.Random(22)
    word = "".join(r.choices("abcdefgh", k=1_000_000))
    other = word[:500_000] + "x" + word[500_001:]
    df = spark.createDataFrame([(k, w) for w, times in ((word, 6), (other, 3), (word + "z", 3)) for k in range(times)], "doc_id long, text string").repartition(3)
    assert told(spelling.spellings(df, every=None)) == sorted([(word, None, word, 6, 2, None), (other, word, word, 3, 1, 6), (word + "z", word, word, 3, 1, 6)])


def test_empty_table(spark):
    assert spelling.spellings(spark.createDataFrame([], "doc_id long, text string")).collect() == []
