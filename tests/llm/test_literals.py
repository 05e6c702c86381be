"""Long literals and names that reach many."""

from __future__ import annotations

import random
import time

from corvane.llm import secrets

R = random.Random(12)
BASE64 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"


def key(n: int) -> str:
    return "".join(R.choice(BASE64) for _ in range(n))


def test_long_literals_are_found():
    for n in (4096, 4097, 5000, 200_000):
        text = f'private_key = "{key(n)}"'
        assert secrets.told(secrets.literal_spans(text)) == f"literal:15:{15 + n}"
        assert secrets.redact(text, secrets.spans_of(text)) == 'private_key = "[REDACTED]"'
    for bad in ("x" * 5000, "-" * 5000, "your_" + key(5000), "<" + key(5000) + ">", "https://" + key(5000), key(2500) + " " + key(2500)):
        assert secrets.literal_spans(f'private_key = "{bad}"') == []


def test_names_reach_any_number_of_literals():
    for n in (64, 65, 3000):
        text = "pwd = " + " + ".join(f'"{key(6)}"' for _ in range(n))
        assert len(secrets.literal_spans(text)) == n
        steps = f'k = "{key(6)}"\n' + "".join(f'k = k + "{key(6)}"\n' for _ in range(n - 1)) + "db_pwd = k\n"
        assert len(secrets.literal_spans(steps)) == n
    start = time.perf_counter()
    doubled = f'a0 = "{key(12)}"\n' + "".join(f"a{i + 1} = a{i} + a{i}\n" for i in range(300)) + "db_pwd = a300\n"
    assert len(secrets.literal_spans(doubled)) == 1 and time.perf_counter() - start < 5
    assert secrets.literal_spans('a = "https:"\nb = "//host/Abc123xyz"\ndb_pwd = a + b') == []
