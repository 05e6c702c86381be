"""Matching blocks against the standard library on short pairs, and on long texts by what they must fulfil."""

from __future__ import annotations

import difflib
import random
import time

import pytest

from corvane.functions.blocks import changes, matching_blocks


@pytest.mark.parametrize("letters", ["ab", "abcd", "abcdefghijklmnopqrstuvwxyz "])
def test_blocks_are_those_of_the_standard_library(letters):
    r = random.Random(len(letters))
    for _ in range(400):
        a = "".join(r.choices(letters, k=r.randint(0, 60)))
        b = "".join(r.choices(letters, k=r.randint(0, 60))) if r.random() < 0.5 else "".join(c for c in a if r.random() < 0.8) + r.choice(letters)
        m = difflib.SequenceMatcher(a=a, b=b, autojunk=False)
        assert matching_blocks(a, b) == [tuple(x) for x in m.get_matching_blocks()[:-1]], (a, b)
        assert changes(a, b) == [tuple(x[1:]) for x in m.get_opcodes() if x[0] != "equal"]
        x, y = a.split(" "), b.split(" ")
        assert changes(x, y) == [tuple(c[1:]) for c in difflib.SequenceMatcher(a=x, b=y, autojunk=False).get_opcodes() if c[0] != "equal"]


def test_long_texts_in_time():
    r = random.Random(9)
    a = " ".join(r.choice("the of and river stone a in cloud to".split()) for _ in range(20_000))
    parts = a.split(" ")
    for k in r.sample(range(len(parts)), 60):
        parts[k] = r.choice(["changed", "", "x" * 9])
    b, start = " ".join(parts), time.process_time()
    out, at = [], 0
    for i0, i1, j0, j1 in changes(a, b):
        assert i0 >= at and a[i0:i1] != b[j0:j1]
        out += [a[at:i0], b[j0:j1]]
        at = i1
    assert "".join([*out, a[at:]]) == b and time.process_time() - start < 60
    assert changes("a" * 50_000, "a" * 49_000) == [(49_000, 50_000, 49_000, 49_000)]
