"""Literals that base spans cover, against each base span by itself, and long dumps of settings."""

from __future__ import annotations

import random
import time

from corvane.llm import secrets


def plain(text: str) -> list:
    base = secrets.base_spans(text)
    return sorted(base + [s for s in secrets.literal_spans(text) if not any(b.start <= s.start and s.end <= b.end for b in base)])


def dump(r: random.Random, n: int) -> str:
    names = ["password", "db_secret", "api_key", "color", "auth_token", "width", "credential", "SECRET_KEY"]
    value = lambda: "".join(r.choices("abcdef0123456789XYZ+/$% ", k=r.randint(3, 60)))
    return "\n".join(r.choice(['{}: "{}"', "{} = '{}'", '{} := "{}"', "export {}='{}'", 'note "{}" {}']).format(r.choice(names) + str(r.randint(0, 9)), value()) for _ in range(n))


def test_spans_agree_with_the_plain_version():
    r, more = random.Random(12), 0
    for _ in range(60):
        text = dump(r, r.randint(1, 40))
        assert secrets.spans_of(text) == plain(text)
        more += len(secrets.spans_of(text)) > len(secrets.base_spans(text))
    assert more > 20


def test_a_long_dump_takes_linear_time():
    took = []
    for n in (5_000, 20_000):
        text = "\n".join(f'db_password_{k} = "x9$kQ{k}!vT7#mZ"\napi_key{k} = "AbC{k}dEfGhIjKlMnOp"' for k in range(n))
        start = time.process_time()
        assert len(secrets.spans_of(text)) >= 2 * n
        took.append(time.process_time() - start)
    assert took[1] < 8 * took[0] + 1
