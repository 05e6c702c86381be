"""Packing documents into sequences of at most `size` tokens: patterns of a few lengths whose repeat counts are fitted by non-negative least squares.

A document is its token ids and an end id. Longer ones are cut into pieces of `size` tokens. What is packed are counts of lengths,
of which there are `size` at most, so the plan has the same size for any number of documents: patterns of two or three lengths that
fill a sequence get repeat counts that fit the histogram best, rounding carries remainders on, and the documents that are left go
length by length into the tightest gap. A piece finds its place by its rank among the pieces of its length.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import CACHE_PIECE, END, Codec, codec, default_path
from .common import batches, cut, small_or_shuffled, written

#: Patterns of three lengths that are enumerated at most; beyond it an even share of them is.
MOST_PATTERNS = 40_000
#: Steps of the fit.
STEPS = 150
#: Entries of a worker's table of chunks, in each of its two halves.
TABLE_ENTRIES = 600_000
#: Pieces that are encoded as one text.
TOGETHER = 64
#: Bytes of texts that are encoded together; a longer text goes alone.
BATCH_BYTES = 8 << 20
#: Counts of pieces by task and length up to which they are broadcast.
BROADCAST_ROWS = 200_000


class Words:
    """Token ids of texts as little-endian unsigned 32-bit numbers. Chunks between white space are looked up in a bounded table; the pieces of those it lacks are encoded many at a time."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.codec: Codec = codec(path)
        self.library = Tokenizer.from_file(path)
        self.library.no_padding()
        self.library.no_truncation()
        self.ends = np.zeros(max(self.codec.strings) + 1, bool)
        self.ends[[i for i, s in self.codec.strings.items() if s.endswith(END)]] = True
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def encoded(self, texts: list[str]) -> list[bytes]:
        return [struct.pack(f"<{len(e.ids)}I", *e.ids) for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def learn(self, chunks: list[str]) -> dict[str, bytes]:
        """Puts chunks that the table lacks into it and gives the long ones, which are not kept. What it still has of its older half moves over.

        Pieces are encoded `TOGETHER` at a time with spaces between; the last token of a piece is one that ends a word, which tells
        them apart. The common kinds of pieces are found without the pre-tokenizer's pattern.
        """
        if len(self.known) >= TABLE_ENTRIES:
            self.older, self.known = self.known, {}
        known, older, findall = self.known, self.older.get, self.codec.pieces.findall
        long: dict[str, bytes] = {}
        new: dict[str, None] = {}
        made: list[tuple[str, list[str]]] = []
        for x in dict.fromkeys(chunks):
            if (ids := older(x)) is not None:
                known[x] = ids
            elif x.isalpha():
                new[x] = None
            else:
                parts = [x[:-1], x[-1]] if x[-1] in ".,;:!?" and x[:-1].isalpha() else findall(x)
                made.append((x, parts))
                for p in parts:
                    if p not in known:
                        if (ids := older(p)) is not None:
                            known[p] = ids
                        else:
                            new[p] = None
        pieces = list(new)
        groups = [pieces[i : i + TOGETHER] for i in range(0, len(pieces), TOGETHER)]
        for group, ids in zip(groups, self.encoded([" ".join(g) for g in groups]), strict=True):
            cuts = (4 * np.flatnonzero(self.ends[np.frombuffer(ids, "<u4")]) + 4).tolist()
            known.update(zip(group, [ids[a:b] for a, b in zip([0, *cuts], cuts)] if len(cuts) == len(group) else self.encoded(group), strict=True))
        for x, parts in made:
            known[x] = b"".join([known[p] for p in parts])
        for x in [x for x in pieces if len(x) > CACHE_PIECE] + [x for x, _ in made if len(x) > CACHE_PIECE]:
            long[x] = known.pop(x)
        return long

    def apart(self, text: str) -> bytes:
        """The ids of a text with special tokens, or with characters that patterns and splitting take for white space and the library doesn't."""
        c = self.codec
        parts = c.cuts.split(text) if c.cuts else [text]
        return b"".join([c.special[p].to_bytes(4, "little") if k % 2 else b"".join(self.encoded([c.normal(p)])) for k, p in enumerate(parts)])

    def all(self, texts: list[str]) -> list[bytes]:
        """The ids of each text. The chunks of all texts are numbered, so each distinct one is looked up once, and the ids are gathered by number."""
        c = self.codec
        odd = [bool(c.odd_space.search(t) or c.cuts and c.cuts.search(t)) for t in texts]
        lists = pc.utf8_split_whitespace(pa.array(["" if o else c.normal(t) for o, t in zip(odd, texts)], pa.string()))
        numbered = lists.flatten().dictionary_encode()
        chunks, at = numbered.dictionary.to_pylist(), numbered.indices.to_numpy()
        got = list(map(self.known.get, chunks))
        lacking = [x for x, ids in zip(chunks, got) if ids is None and x]
        if lacking:
            long, known = self.learn(lacking), self.known.get
            got = [ids if ids is not None else known(x) or long.get(x, b"") for x, ids in zip(chunks, got)]
        got = [ids or b"" for ids in got]
        sizes = np.fromiter(map(len, got), np.int64, len(got)) // 4
        flat, starts = np.frombuffer(b"".join(got), "<u4"), np.cumsum(sizes) - sizes
        each = sizes[at] if len(at) else np.zeros(0, np.int64)
        ends = np.cumsum(each)
        ids = flat[np.repeat(starts[at] - ends + each, each) + np.arange(int(ends[-1]) if len(ends) else 0)] if len(flat) else flat
        edges = np.concatenate([[0], ends])[lists.offsets.to_numpy()]
        return [self.apart(t) if o else ids[a:b].tobytes() for o, t, a, b in zip(odd, texts, edges, edges[1:])]

    def ids(self, text: str) -> bytes:
        return self.all([text])[0]


@lru_cache(maxsize=1)
def words_of(path: str) -> Words:
    """One table for all tasks of a worker."""
    return Words(path)


def pieces(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None, size: int = 2048, end: int = 0, ids: bool = True) -> DataFrame:
    """A row for each piece: key, piece (from 0), start (tokens of its document before it), length, ids_crc32, `task` and `nth` (its
    rank among the pieces of its length in the task), and `ids` where asked for.

    Null texts are empty and give one piece of the end id; null keys stay null; repeated rows are documents of their own; other
    columns play no part. A text is encoded whole, in one task.
    """
    path = path or default_path()
    tail = end.to_bytes(4, "little")
    schema = f"`{key}` {docs.schema[key].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long, task int, nth long" + (", ids array<int>" if ids else "")

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, task, seen = words_of(path), TaskContext.get().partitionId(), np.zeros(size + 1, np.int64)
        for b in batches(rows, max_bytes=BATCH_BYTES):
            at, piece, start, length, crc, nth, kept = [], [], [], [], [], [], []
            for i, found in enumerate(words.all([t or "" for t in b.column(1).to_pylist()])):
                all_ids = found + tail
                for p, s in enumerate(range(0, len(all_ids), 4 * size)):
                    mine = all_ids[s : s + 4 * size]
                    n = len(mine) // 4
                    at.append(i)
                    piece.append(p)
                    start.append(s // 4)
                    length.append(n)
                    crc.append(zlib.crc32(mine))
                    nth.append(seen[n])
                    seen[n] += 1
                    if ids:
                        kept.append(np.frombuffer(mine, "<u4").astype(np.int32))
            out = [b.column(0).take(pa.array(at, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc)), pa.array([task] * len(at), pa.int32()), pa.array(nth, pa.int64())]
            names = [key, "piece", "start", "length", "ids_crc32", "task", "nth"]
            if ids:
                out, names = [*out, pa.array(kept, pa.list_(pa.int32()))], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(out, names=names)

    return docs.select(F.col(f"`{key}`"), F.col(f"`{text}`")).mapInArrow(run, schema)


def patterns(counts: np.ndarray, most: int = MOST_PATTERNS) -> np.ndarray:
    """Rows of three lengths, ascending, whose sum is the size of a sequence (0: none); only lengths that occur. All of two lengths, and of three an even share of about `most`."""
    size = len(counts) - 1
    there = np.flatnonzero(counts[:size])
    there = there[there > 0]
    has = np.zeros(size + 1, bool)
    has[there] = True
    two = there[(2 * there <= size) & has[size - there]]
    found = [np.stack([np.zeros_like(two), two, size - two], axis=1)]
    share = max(1, -(-len(there) ** 2 // 12 // most))
    for a in there[3 * there <= size]:
        b = there[(there >= a) & (there <= (size - a) // 2)]
        b = b[has[size - a - b] & ((b + 7 * a) % share == 0)]
        found.append(np.stack([np.full_like(b, a), b, size - a - b], axis=1))
    return np.concatenate(found)


def fit(rows: np.ndarray, counts: np.ndarray, steps: int = STEPS) -> np.ndarray:
    """Repeat counts x >= 0 of the patterns, so that the sum of squares of (documents used - documents there) over the lengths is small: multiplicative steps from a positive start."""
    h = counts.astype(float)
    h[0] = 0

    def gathered(v):  # the transposed matrix of patterns by v
        return v[rows[:, 0]] + v[rows[:, 1]] + v[rows[:, 2]]

    def used(x):
        out = sum(np.bincount(rows[:, k], x, len(h)) for k in range(3))
        out[0] = 0
        return out

    if not len(rows):
        return np.zeros(0)
    aim = gathered(h)
    x = aim / max(1.0, gathered(used(np.ones(len(rows)))).mean())
    for _ in range(steps):
        x *= aim / np.maximum(gathered(used(x)), 1e-12)
    return x


def rounded(rows: np.ndarray, x: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whole repeat counts, each remainder carried on to the next pattern, none beyond the documents there are; and the counts that are left."""
    left, times = counts.copy(), np.zeros(len(rows), np.int64)
    want = np.diff(np.floor(np.cumsum(x) + 1e-9), prepend=0.0).astype(np.int64)
    for k in np.flatnonzero(want):
        lengths, copies = np.unique(rows[k][rows[k] > 0], return_counts=True)
        times[k] = n = min(int(want[k]), int((left[lengths] // copies).min()))
        left[lengths] -= n * copies
    return times, left


@dataclass
class Plan:
    """Slots of pieces: those of a length whose rank is at least `first` lie `copies` a sequence from `sequence` on, from `offset` on."""

    length: np.ndarray
    first: np.ndarray
    copies: np.ndarray
    sequence: np.ndarray
    offset: np.ndarray
    n_sequences: int
    by_patterns: int


def plan(counts: np.ndarray) -> Plan:
    """Places for counts[l] pieces of each length l, 0 < l <= size = len(counts) - 1.

    Classes of equal sequences: (repeats, [(length, copies)...]). The length of longest pieces goes first into the tightest gap that
    holds it, as many copies as fit, as best fit decreasing does piece by piece.
    """
    counts = counts.astype(np.int64)
    size = len(counts) - 1
    rows = patterns(counts)
    times, left = rounded(rows, fit(rows, counts), counts)
    done = []
    for k in np.flatnonzero(times):
        lengths, copies = np.unique(rows[k][rows[k] > 0], return_counts=True)
        done.append((int(times[k]), [(int(a), int(c)) for a, c in zip(lengths, copies, strict=True)]))
    by_patterns = int(times.sum())
    gaps: list[list[tuple[int, list]]] = [[] for _ in range(size + 1)]

    def put(gap, repeats, held):
        (gaps[gap] if gap else done).append((repeats, held))

    for length in range(size, 0, -1):
        c = int(left[length])
        gap = length
        while c:
            while gap <= size and not gaps[gap]:
                gap += 1
            if gap > size:
                gaps[size].append((-(-c // (size // length)), []))
                gap = size
            repeats, held = gaps[gap].pop()
            copies = gap // length
            full = min(repeats, c // copies)
            if full:
                put(gap - copies * length, full, [*held, (length, copies)])
                c -= full * copies
            if full < repeats:
                rest = repeats - full
                if c:
                    put(gap - c * length, 1, [*held, (length, c)])
                    rest, c = rest - 1, 0
                if rest:
                    put(gap, rest, held)
            gap = length
    done.extend(x for g in gaps for x in g if x[1])
    used, slots, sequence = np.zeros(size + 1, np.int64), [], 0
    for repeats, held in done:
        offset = 0
        for length, copies in held:
            slots.append((length, int(used[length]), copies, sequence, offset))
            used[length] += repeats * copies
            offset += length * copies
        sequence += repeats
    if not (used == counts).all():
        raise AssertionError("pieces without a place")
    table = np.array(sorted(slots), np.int64).reshape(-1, 5)
    return Plan(*table.T, sequence, by_patterns)


def placed(told: DataFrame, size: int = 2048) -> tuple[DataFrame, Plan]:
    """pieces() with sequence_id and offset, and the plan; told must be a written table, for it is read three times.

    Ranks within a length are those within a task behind the counts of the tasks before it, so no task holds all pieces of a length.
    The driver gets a count for each length.
    """
    counted = cut(told.groupBy("task", "length").agg(F.count("*").alias("n")))
    counts = np.zeros(size + 1, np.int64)
    for length, n in counted.groupBy("length").agg(F.sum("n").alias("n")).collect():
        counts[length] = n
    made = plan(counts)
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    ahead = counted.select("task", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ahead"))
    ranked = told.join(small_or_shuffled(ahead, BROADCAST_ROWS), ["task", "length"])
    keep = [c for c in told.columns if c not in ("task", "nth")]
    bits = 62 - size.bit_length()
    edges, slots = (made.length << bits) + made.first, made

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows:
            length, rank = b.column(0).to_numpy(), b.column(1).to_numpy()
            at = np.searchsorted(edges, (length << bits) + rank, "right") - 1
            nth = rank - slots.first[at]
            sequence, offset = slots.sequence[at] + nth // slots.copies[at], slots.offset[at] + nth % slots.copies[at] * length
            yield pa.RecordBatch.from_arrays([*b.columns[2:], pa.array(sequence, pa.int64()), pa.array(offset, pa.int64())], names=[*keep, "sequence_id", "offset"])

    schema = ", ".join([*(f"`{c}` {told.schema[c].dataType.simpleString()}" for c in keep), "sequence_id long, offset long"])
    out = ranked.select(F.col("length").alias("__l"), (F.col("ahead") + F.col("nth")).alias("__r"), *[F.col(f"`{c}`") for c in keep]).mapInArrow(run, schema)
    return out, made


def pack(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None, size: int = 2048, end: int = 0, ids: bool = True) -> DataFrame:
    """A row for each piece of each document: what pieces() tells of it, sequence_id and offset.

    Sequences hold at most `size` tokens and have no gap before their last piece. Only documents of more than `size` tokens, the end
    id counted, are cut. Null texts are a document of the end id alone; repeated rows are packed each; an empty table gives none.
    """
    told, _ = written(pieces(docs, key, text, path, size, end, ids), "pieces")
    return placed(told, size)[0]


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id, ids (of all its pieces) and starts (where each piece begins) of what pack(ids=True) gives. A group holds one sequence."""
    held = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    grouped = packed.groupBy("sequence_id").agg(held.alias("held"))
    return grouped.select("sequence_id", F.flatten(F.col("held.ids")).alias("ids"), F.col("held.offset").alias("starts"))
