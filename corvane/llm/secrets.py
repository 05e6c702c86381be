"""Secret scans by assignment-aware lexing.

Besides fixed patterns (`assign`, `access`, `hex`), a text is read as assignments of terms to names (see
assignments). Names that terms refer to are followed until only literals are left; a literal is scored by how
sensitive the names it reaches are and how much the joined value looks like a key, and found ones are added as
kind `literal`.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame

from .assignments import Literal, assignments, resolved
from .common import batches

#: The base patterns. Keywords take letters in either case, ASCII only.
ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}", re.ASCII)
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "literal")
HINTS = ("password", "passwd", "secret", "token", "apikey", "api_key")
LEAST_ASSIGN = 6

#: Parts of names that ask for secrecy, with weights; a literal counts from LEAST_SCORE on.
SENSITIVE = {"password": 1.0, "passwd": 1.0, "passphrase": 1.0, "pwd": 1.0, "secret": 1.0, "token": 0.9, "apikey": 1.0, "credential": 0.9, "credentials": 0.9, "auth": 0.7, "bearer": 0.8, "signature": 0.6, "salt": 0.6, "pass": 0.8}
KEY_BEFORE = {"api", "private", "access", "secret", "signing", "encryption", "master", "service", "account", "auth", "session"}
LEAST_SCORE = 0.5
#: Characters up to which a value's joined text is kept; it holds every fixed placeholder.
SHORT = 64
PLACEHOLDER = re.compile(r"(?i)^(?:x+|\*+|\.+|-+|none|null|true|false|changeme|example|placeholder|your[_-].*|<.*>|todo|test|dummy)$")
#: Where a text in lower case may assign to a sensitive name: a part of it, the rest of the name, and what follows.
PART = re.compile(r"password|passwd|passphrase|pwd|secret|token|apikey|credential|auth|bearer|signature|salt|pass|key")
TAIL = re.compile(r"[a-z0-9_]*(?:[.\-][a-z0-9_]+)*")
ASSIGNS = re.compile(r"""["'`]\s*[,:=\]/>v)]|["'`\]]*\s*(?:\[[^\[\]\n]*\]\s*)?(?:[:=>?|+]|->)|\(|\s+[a-z][a-z0-9_.:\-]*\s*=|[ \t]+(?:string|str)\b""")
PEM = re.compile(r"-----BEGIN [A-Z ]*PRIVATE KEY-----")
PARTS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")


class Span(NamedTuple):
    start: int
    kind: int
    end: int
    value_start: int


def name_score(name: str) -> float:
    parts = [p.lower() for p in PARTS.findall(name)]
    best = max((SENSITIVE.get(p, 0.0) for p in parts), default=0.0)
    keyed = any(b == "key" and a in KEY_BEFORE for a, b in zip(parts, parts[1:]))
    return max(best, 0.9 if keyed else 0.0)


class Value:
    """What a name stands for: literals and other names' values, shared by reference, with what the score needs to know of their joined text."""

    def __init__(self, parts: list[Literal | Value]):
        self.parts = parts
        self.known = self.busy = self.found = False  # whether the figures below are there, or being made; whether the literals were found before

    def know(self) -> Value:
        """With size, counts of characters, the text where it is short, its first and last characters and whether it holds a "://". A value adds nothing to itself."""
        todo = [self]
        while todo:
            v = todo[-1]
            v.busy = True
            missing = [x for x in v.parts if isinstance(x, Value) and not x.known and not x.busy]
            if missing:
                todo.append(missing[0])
                continue
            todo.pop()
            if not v.known:
                v.join()
        return self

    def join(self) -> None:
        self.size, self.counts, self.text, self.head, self.tail, self.url, self.pem = 0, Counter(), "", "", "", False, False
        for x in self.parts:
            if isinstance(x, Value) and not x.known:
                continue
            self.pem |= x.pem if isinstance(x, Value) else PEM.search(x.text) is not None
            size, counts, text, head, tail, url = (x.size, x.counts, x.text, x.head, x.tail, x.url) if isinstance(x, Value) else (len(x.text), x.text, x.text, x.text[:SHORT], x.text[-2:], "://" in x.text)
            self.size += size
            self.counts.update(counts)
            self.url = self.url or url or "://" in self.tail + head[:2]
            self.text = self.text + text if self.size <= SHORT else ""
            self.head, self.tail = (self.head + head)[:SHORT], (self.tail + tail)[-2:]
        self.known = True

    def placeholder(self) -> bool:
        if self.size <= SHORT:
            return bool(PLACEHOLDER.match(self.text))
        head = self.head.lower()
        return set(self.counts) <= {"x", "X"} or len(self.counts) == 1 and head[0] in "*.-" or head.startswith(("your_", "your-")) or head[0] == "<" and self.tail[-1] == ">"

    def literals(self) -> Iterator[Literal]:
        """The literals that no call before this one gave."""
        todo = [self]
        while todo:
            v = todo.pop()
            if not v.found:
                v.found = True
                for x in v.parts:
                    if isinstance(x, Value):
                        todo.append(x)
                    else:
                        yield x


def value_score(value: Value) -> float:
    """From 0 to 1: long enough, of several kinds of characters, without runs of words."""
    n, counts = value.know().size, value.counts
    if value.pem:
        return 1.0
    if n < 8 or value.placeholder() or value.url or any(c.isspace() for c in counts):
        return 0.0
    entropy = -sum(c / n * math.log2(c / n) for c in counts.values())
    text = "".join(counts)
    kinds = sum(bool(re.search(k, text)) for k in ("[a-z]", "[A-Z]", "[0-9]", "[^A-Za-z0-9]"))
    if kinds == 1 and n < 20:  # one plain word
        return 0.0
    return min(1.0, entropy / 3.2) * (0.6 + 0.1 * kinds)


def base_spans(text: str) -> list[Span]:
    out = []
    low = text.lower()
    if any(h in low for h in HINTS):
        out += [Span(m.start(), 0, m.end(), m.start(2)) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_ASSIGN]
    if "AKIA" in text:
        out += [Span(m.start(), 1, m.end(), m.start()) for m in ACCESS.finditer(text)]
    out += [Span(m.start(), 2, m.end(), m.start()) for m in HEX.finditer(text)]
    return out


def may_assign(text: str) -> bool:
    """Whether a text has any place to read further for."""
    low, at = text.lower(), 0
    while m := PART.search(low, at):
        at = TAIL.match(low, m.end()).end()
        if ASSIGNS.match(low, at):
            return True
    return False


def literal_spans(text: str) -> list[Span]:
    """The literals that reach sensitive names and look like keys, through any number of names between, in any order."""
    if not may_assign(text):
        return []
    told = list(resolved(assignments(text)))
    values = [Value([]) for _ in told]
    for value, (_, terms) in zip(values, told, strict=True):
        value.parts = [values[t] if isinstance(t, int) else t for t in terms]
    out = {}
    for value, (name, _) in zip(values, told, strict=True):
        weight = name_score(name)
        if weight and weight * value_score(value) >= LEAST_SCORE:
            for x in value.literals():
                if x.end > x.start:
                    out[x.start, x.end] = Span(x.start, 3, x.end, x.start)
    return list(out.values())


def spans_of(text: str) -> list[Span]:
    """All spans by start, then kind; literals that a base span covers are left to it."""
    base = sorted(base_spans(text))
    starts, reach = [b.start for b in base], list(accumulate((b.end for b in base), max))  # how far the spans that begin so early go
    rest = [s for s in literal_spans(text) if not (k := bisect_right(starts, s.start)) or reach[k - 1] < s.end]
    return sorted(base + rest)


def told(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[s.kind]}:{s.start}:{s.end}" for s in spans)


def redact(text: str, spans: list[Span], mark: str = "[REDACTED]") -> str:
    """The text with the values of the spans replaced; a name that an assignment begins with stays."""
    out, at = [], 0
    for s in sorted(spans, key=lambda s: (s.value_start, -s.end)):
        if s.value_start >= at:
            out += [text[at : s.value_start], mark]
            at = s.end
        elif s.end > at:
            at = s.end
    return "".join([*out, text[at:]])


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_assign, n_access, n_hex, base_sha256, spans for each row.

    Null and empty texts have no span; null keys stay null; texts are scanned whole; repeated rows get equal results, an empty
    table an empty one; columns besides key and text play no part.
    """
    schema = f"`{key}` {docs.schema[key].dataType.simpleString()}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(rows):
            out: list[list] = [[], [], [], [], []]
            for t in b.column(1).to_pylist():
                spans = spans_of(t) if t else []
                for k in range(3):
                    out[k].append(sum(s.kind == k for s in spans))
                out[3].append(hashlib.sha256(told([s for s in spans if s.kind < 3]).encode()).hexdigest())
                out[4].append(told(spans))
            kinds = [pa.int64()] * 3 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(x, k) for x, k in zip(out, kinds, strict=True))], names=[key, "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return docs.select(f"`{key}`", f"`{text}`").mapInArrow(run, schema)


def redacted(docs: DataFrame, text: str = "text", length: str = "n_chars") -> DataFrame:
    """docs with found values replaced in `text`, and `length`, where docs has it, counted anew for changed texts. Nulls stay."""
    names = docs.columns
    at = names.index(text)
    size = names.index(length) if length in names else None
    schema = docs.schema

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(rows):
            texts = b.column(at).to_pylist()
            clean = [redact(t, spans) if t and (spans := spans_of(t)) else t for t in texts]
            columns = list(b.columns)
            columns[at] = pa.array(clean, b.schema.field(at).type)
            if size is not None:
                sizes = [n if a is b_ else len(b_) for n, a, b_ in zip(b.column(size).to_pylist(), texts, clean, strict=True)]
                columns[size] = pa.array(sizes, b.schema.field(size).type)
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.mapInArrow(run, schema)
