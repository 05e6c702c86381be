"""Plain Python versions of what the operators compute, for small inputs."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sha(x: str | bytes) -> str:
    return hashlib.sha256(x.encode() if isinstance(x, str) else x).hexdigest()


def quality(text: str | None) -> tuple:
    text = text or ""
    words, seen, dup = WORD.findall(text), set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    windows = defaultdict(list)
    for i in range(len(words) - 7):
        windows[tuple(words[i : i + 8])].append(i)
    at = {p for w in windows.values() if len(w) > 1 for i in w for p in range(i, i + 8)}
    n = len(words)
    return n, sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), dup, len(at), n < 20 or 100 * len(at) > 30 * n


def secrets_base(text: str | None) -> tuple:
    text = text or ""
    kinds = {
        "assign": [m for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.I | re.A) if len(m[2]) >= 6],
        "access": [m for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20],
        "hex": [m for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24],
    }
    spans = sorted((m.start(), k, m.end(), n) for k, (n, found) in enumerate(kinds.items()) for m in found)
    return *(len(x) for x in kinds.values()), sha(",".join(f"{n}:{s}:{e}" for s, _, e, n in spans))


def shingles(text: str | None) -> frozenset:
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if len(words) < 5:
        return frozenset([tuple(words)] if words else [])
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4))


def near(rows: list[tuple], percent: int = 75) -> list[tuple]:
    """(doc_id, n_shingles, component_id, kept) of (doc_id, text) rows with distinct ids."""
    sets = {i: shingles(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids, holders = sorted(sets), defaultdict(list)
    for i in ids:
        common = Counter(j for g in sets[i] for j in holders[g])
        for j, n in common.items():
            if 100 * n >= percent * (len(sets[i]) + len(sets[j]) - n):
                a, b = sorted((find(i), find(j)))
                root[b] = a
        for g in sets[i]:
            holders[g].append(i)
    return [(i, len(sets[i]), find(i), find(i) == i) for i in ids]


def repeats(rows: list[tuple], size: int = 100) -> list[tuple]:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of (doc_id, text) rows with distinct ids."""
    seen, out = set(), []
    for i, t in sorted(rows):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - size + 1):
            w = b[p : p + size]
            if w in seen:
                gone[p : p + size] = b"\1" * size
            seen.add(w)
        spans = sum(g and not (p and gone[p - 1]) for p, g in enumerate(gone))
        out.append((i, len(b), sum(gone), spans, sha(bytes(c for c, g in zip(b, gone, strict=True) if not g))))
    return out
