"""BPE encoding and decoding with the files of a public tokenizer of the word-end kind.

Each whole text is normalized as the file says (NFC, white space, lower case) and cut at white
space; no piece of the pre-tokenizer spans white space. A piece is merged by a
priority queue of merge ranks over a doubly linked list of symbols, and remembered in a table of
bounded size.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import batches

#: Entries of a worker's table of pieces; a full one makes way, and what is used of it moves over.
CACHE_ENTRIES = 120_000
#: Longer pieces are not remembered.
CACHE_PIECE = 64
#: The pieces of the pre-tokenizer, and Unicode's white space.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
SPACE = "\t\n\x0b\x0c\r \x85\xa0  -     　"
END = "</w>"


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies: itself, or the next free one from U+0100 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class Codec:
    """Encoder and decoder for one tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.strings = {i: s for s, i in self.vocab.items()}
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.strings |= {i: s for s, i in self.special.items()}
        self.ranks: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.ranks[self.vocab[a], self.vocab[b]] = (rank, self.vocab[a + b])
        symbols = byte_symbols()
        self.inner = [self.vocab[c] for c in symbols]
        self.last = [self.vocab[c + END] for c in symbols]
        self.pieces = regex.compile(PIECES)
        self.space = re.compile(f"[{SPACE}]+")
        self.odd_space = re.compile("[\x1c-\x1f]")
        self.cuts = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.known: dict[str, tuple[str, str]] = {}
        self.older: dict[str, tuple[str, str]] = {}

    def merge(self, piece: bytes) -> list[int]:
        """The ids of one piece: the pair of lowest rank merges first, the leftmost of equals."""
        ids = [self.inner[b] for b in piece]
        ids[-1] = self.last[piece[-1]]
        n = len(ids)
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        queue = []
        for i in range(n - 1):
            if found := self.ranks.get((ids[i], ids[i + 1])):
                queue.append((found[0], i, ids[i], ids[i + 1], found[1]))
        heapq.heapify(queue)
        while queue:
            _, i, a, b, made = heapq.heappop(queue)
            j = after[i]
            if ids[i] != a or j < 0 or ids[j] != b:
                continue  # stale: one side has merged meanwhile
            ids[i], ids[j] = made, -1
            after[i] = k = after[j]
            if k >= 0:
                before[k] = i
                if found := self.ranks.get((made, ids[k])):
                    heapq.heappush(queue, (found[0], i, made, ids[k], found[1]))
            if (h := before[i]) >= 0 and (found := self.ranks.get((ids[h], made))):
                heapq.heappush(queue, (found[0], h, ids[h], made, found[1]))
        return [x for x in ids if x >= 0]

    def piece(self, text: str) -> tuple[str, str]:
        """Decimal ids and vocabulary strings of a piece, each joined by one space."""
        if not (found := self.older.get(text)):
            ids = self.merge(text.encode())
            found = " ".join(map(str, ids)), " ".join(map(self.strings.__getitem__, ids))
        if len(text) <= CACHE_PIECE:
            if len(self.known) >= CACHE_ENTRIES:
                self.older, self.known = self.known, {}
            self.known[text] = found
        return found

    def chunk(self, text: str) -> tuple[str, str]:
        """The same of a chunk without white space. A piece alone is cut as it is within a chunk, so one table holds both."""
        if text.isalpha():
            return self.piece(text)
        known, piece = self.known.get, self.piece
        pieces = self.pieces.findall(text)
        if len(pieces) == 1:
            return piece(pieces[0])
        parts = [known(x) or piece(x) for x in pieces]
        return " ".join([x[0] for x in parts]), " ".join([x[1] for x in parts])

    def normal(self, text: str) -> str:
        if not text.isascii() and not unicodedata.is_normalized("NFC", text):
            text = unicodedata.normalize("NFC", text)
        return text.replace("Σ", "σ").lower()  # each letter by itself: no final sigma

    def parts(self, text: str) -> list[tuple[str, str]]:
        out = []
        for k, part in enumerate(self.cuts.split(text) if self.cuts and self.cuts.search(text) else [text]):
            if k % 2:
                out.append((str(self.special[part]), part))
                continue
            part = self.normal(part)
            chunks = [x for x in self.space.split(part) if x] if self.odd_space.search(part) else part.split()
            for x in chunks:
                out.append(self.known.get(x) or self.chunk(x))
        return out

    def encode(self, text: str) -> list[int]:
        return [int(x) for ids, _ in self.parts(text) for x in ids.split()]

    def decode(self, ids: list[int]) -> str:
        """The vocabulary strings, special tokens included; the file names no decoder, so a space stands between them."""
        return " ".join(map(self.strings.__getitem__, ids))

    def both(self, text: str) -> tuple[str, str]:
        parts = self.parts(text)
        return " ".join([x[0] for x in parts]), " ".join([x[1] for x in parts])


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


def encode_decode(docs: DataFrame, text: str = "text", path: str | None = None, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """docs with the columns `ids` (array of int) and `decoded` (string). Null texts count as empty and give no ids and an empty string.

    path: the tokenizer's file, at the same place on each machine. Columns named like the new ones are replaced, others pass
    through with their nulls. Texts are encoded whole; repeated rows get equal results, an empty table an empty one.
    """
    path = path or default_path()
    keep = [c for c in docs.columns if c not in (ids, decoded)]
    at = keep.index(text)
    schema = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep), f"`{ids}` array<int>, `{decoded}` string"])

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for b in batches(rows, max_bytes=1 << 20):
            both = [c.both(t or "") for t in b.column(at).to_pylist()]
            new = [pa.array([np.fromstring(x, np.int32, sep=" ") for x, _ in both], pa.list_(pa.int32())), pa.array([d for _, d in both], pa.string())]
            yield pa.RecordBatch.from_arrays([*b.columns, *new], names=[*keep, ids, decoded])

    return docs.select(*[f"`{c}`" for c in keep]).mapInArrow(run, schema)


def digests(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """key, n_tokens, ids_sha256, decoded_sha256: digests of what encode_decode gives, made where it is made.

    Null and empty texts have no token and the digests of the empty string; null keys stay null; columns besides key and text play no part.
    """
    path = path or default_path()
    schema = f"`{key}` {docs.schema[key].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string"

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, sha = codec(path), hashlib.sha256
        for b in batches(rows, max_bytes=1 << 20):
            n, i, d = [], [], []
            for t in b.column(1).to_pylist():
                x, y = c.both(t or "")
                n.append(x.count(" ") + 1 if x else 0)
                i.append(sha(x.encode()).hexdigest())
                d.append(sha(y.encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(i, pa.string()), pa.array(d, pa.string())], names=[key, "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(f"`{key}`", f"`{text}`").mapInArrow(run, schema)
