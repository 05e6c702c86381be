"""Removal of repeated byte strings of a fixed length, found by suffix arrays.

Every string of LENGTH bytes (a window) has an anchor, the leftmost smallest of its ANCHOR-byte grams
by hash, at a place that depends on the window alone; equal windows have equal anchors at equal places.
So windows are compared by anchor:

1. Anchors whose gram occurs once in the corpus are dropped with the windows that they stand for.
2. An occurrence of an anchor comes with the run of windows that it stands for. Of occurrences with
   equal runs the first stays; each other one's windows all start earlier elsewhere.
3. The runs that stay, where a gram has several, are cut into pieces of at most PIECE windows at fixed
   places from the anchor. The windows of a piece share a core; pieces of one core are put into one
   text, the core as one symbol between the few bytes left and right of it, and its suffix array
   (see gsaca) brings equal windows together. All but the first of them are removed.

Order is by (doc_id, hash of the text, start). Groups of copies collapse by partial aggregates before
anything is sorted; the joins back are split by adaptive execution where one gram is very common.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches, cut, erase, small_or_shuffled, written
from .gsaca import suffix_array
from .shingles import mix, text_bytes

LENGTH, ANCHOR, PIECE = 100, 32, 8
#: Words of the filters by which later readings skip what cannot matter. Their size is fixed; a full filter skips nothing.
FILTER_WORDS = 1 << 20
BATCH_BYTES = 1 << 18
#: Rows that a task gathers to drop its own repeats before they are shuffled.
LOCAL_ROWS = 1 << 19
#: Repeated rows' keys up to which they are broadcast.
BROADCAST_ROWS = 100_000
_U = np.uint64
_RNG = np.random.Generator(np.random.PCG64(100))
_BYTE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) | _U(1)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_MOST = 2**63 - 1
_CORE, _END = "ā", "Ā"


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, _U(base), np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class Prints:
    """Hashes of all substrings of some bytes by prefix sums."""

    def __init__(self, raw: np.ndarray):
        n = len(raw)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTE[raw] * _powers(_BASE, max(n, 1))[:n], out=self.sums[1:])
        self.back = _powers(_INVERSE, n + 1)

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.back[start] + (end - start).astype(np.uint64))

    def all(self, size: int) -> np.ndarray:
        return mix((self.sums[size:] - self.sums[: len(self.sums) - size]) * self.back[: len(self.sums) - size] + _U(size))


def _sliding(x: np.ndarray, n: int, which: np.ufunc) -> np.ndarray:
    """The least or most of every n neighbours."""
    have = 1
    while have * 2 <= n:
        x = which(x[:-have], x[have:])
        have *= 2
    return which(x[: -(n - have)], x[n - have :]) if n > have else x


def runs(raw: np.ndarray, at: np.ndarray) -> tuple[Prints, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Prints of the bytes and, for each run of windows with one anchor: text number, anchor, first window's start, last one's start + 1, hash of the anchor's gram."""
    prints, none = Prints(raw), np.zeros(0, np.int64)
    if len(raw) < LENGTH:
        return prints, none, none, none, none, none.astype(np.uint64)
    gram = prints.all(ANCHOR)
    order = (gram >> _U(32)).astype(np.uint32)
    least = _sliding(order, LENGTH - ANCHOR + 1, np.minimum)
    edge = np.zeros(LENGTH - ANCHOR, np.uint32)
    spot = _sliding(np.concatenate([edge, least, edge]), LENGTH - ANCHOR + 1, np.maximum) == order  # the least of some window
    ok = np.ones(len(least), bool)
    for x in at[1:-1]:
        ok[max(0, x - LENGTH + 1) : x] = False  # windows never cross texts
    starts = np.flatnonzero(ok)
    if not len(starts):
        return prints, none, none, none, none, none.astype(np.uint64)
    # the leftmost place of the least: the next spot from the start on that equals it
    spots = np.flatnonzero(spot)
    j = (np.cumsum(spot) - spot)[starts]
    todo = np.flatnonzero(order[spots[j]] != least[starts])
    while len(todo):
        j[todo] += 1
        todo = todo[order[spots[j[todo]]] != least[starts[todo]]]
    anchor = spots[j]
    new = np.append(True, (anchor[1:] != anchor[:-1]) | (starts[1:] != starts[:-1] + 1))
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(starts)) - 1
    begin, end, anchor = starts[first], starts[last] + 1, anchor[first]
    return prints, np.searchsorted(at, begin, side="right") - 1, anchor, begin, end, gram[anchor]


class Filter:
    """A set of 64-bit hashes, in a fixed number of bits; it may hold more than was put in."""

    @staticmethod
    def of(df: DataFrame, hashed: str) -> np.ndarray:
        h = F.col(hashed)
        place = F.pmod(F.shiftright(h, 6), F.lit(FILTER_WORDS)).cast("int")
        filled = df.groupBy(place.alias("k")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast({hashed} & 63 as int))")).alias("w")).toArrow()
        words = np.zeros(FILTER_WORDS, np.int64)
        words[filled["k"].to_numpy()] = filled["w"].to_numpy()
        return words

    @staticmethod
    def has(words: np.ndarray, h: np.ndarray) -> np.ndarray:
        h = h.astype(np.int64) if h.dtype == np.int64 else h.view(np.int64)
        return ((words[(h >> 6) % FILTER_WORDS] >> (h & 63)) & 1).astype(bool)


def _texts(docs: DataFrame, key: str, text: str) -> DataFrame:
    t = F.coalesce(F.col(text), F.lit(""))
    return docs.select(F.coalesce(F.col(key).cast("long"), F.lit(_MOST)).alias("d"), F.xxhash64(t).alias("t"), t.alias("text"))


def _distinct(texts: DataFrame) -> tuple[DataFrame, list[str]]:
    """One row for each (d, t), with the paths of tables that were written. Only repeated rows meet, of each task one at most."""
    again = cut(texts.groupBy("d", "t").agg(F.count("*").alias("n")).where("n > 1").select("d", "t"))
    if again.isEmpty():
        return texts, []
    again = small_or_shuffled(again, BROADCAST_ROWS)
    one = texts.join(again, ["d", "t"], "left_semi").dropDuplicates(["d", "t"])
    out, path = written(texts.join(again, ["d", "t"], "left_anti").unionByName(one), "texts")
    return out, [path]


def _batch(arrays: list, names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([a if isinstance(a, pa.Array) else pa.array(a.view(np.int64) if a.dtype == np.uint64 else a) for a in arrays], names=names)


def grams_of(texts: DataFrame) -> DataFrame:
    """(h, n): grams of anchors with their counts in a batch."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(rows, BATCH_BYTES):
            h, n = np.unique(runs(*text_bytes(b.column(0)))[5], return_counts=True)
            yield _batch([h, n.astype(np.int32)], ["h", "n"])

    return texts.select("text").mapInArrow(run, "h long, n int")


_RUN = {"d": pa.int64(), "t": pa.int64(), "h": pa.int64(), "c": pa.int64(), "p": pa.int32(), "s": pa.int32(), "e": pa.int32(), "first": pa.bool_()}
_PIECE = {"d": pa.int64(), "t": pa.int64(), "h": pa.int64(), "k": pa.int64(), "p": pa.int32(), "left": pa.binary(), "right": pa.binary(), "s": pa.int32(), "e": pa.int32(), "first": pa.bool_()}


def _ddl(kinds: dict) -> str:
    return ", ".join(f"`{n}` {({pa.int64(): 'long', pa.int32(): 'int', pa.binary(): 'binary', pa.bool_(): 'boolean'})[k]}" for n, k in kinds.items())


def _joined(d: np.ndarray, t: np.ndarray, s: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, ...]:
    """Overlapping or touching stretches s to e of the same text as one."""
    if not len(d):
        return d, t, s, e
    at = np.lexsort((s, t, d))
    d, t, s, e = d[at], t[at], s[at], e[at]
    new = np.append(True, (d[1:] != d[:-1]) | (t[1:] != t[:-1]))
    far = np.maximum.accumulate(e.astype(np.int64) + (np.cumsum(new) << 32)) - (np.cumsum(new) << 32)
    new[1:] |= s[1:] > far[:-1]
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(d)) - 1
    return d[first], t[first], s[first], far[last].astype(np.int32)


def _parted(table: pa.Table, by: list[str], kinds: dict) -> Iterator[pa.RecordBatch]:
    """The first row of each class by (d, t, p), marked; of the others only their stretches s to e, joined."""
    if not table.num_rows:
        return
    names = list(dict.fromkeys(["p", "t", "d", *reversed(by)]))
    keys = [table[n].to_numpy() if table.schema.field(n).type != pa.binary() else np.unique(np.array(table[n].to_pylist(), object), return_inverse=True)[1] for n in names]
    at = np.lexsort(keys)
    new = np.zeros(len(at), bool)
    new[0] = True
    for n, k in zip(names, keys, strict=True):
        if n in by:
            k = k[at]
            new[1:] |= k[1:] != k[:-1]
    firsts = table.take(pa.array(at[new])).append_column("first", pa.array(np.ones(int(new.sum()), bool)))
    yield from firsts.select(list(kinds)).to_batches(max_chunksize=20_000)
    gone = at[~new]
    d, t, s, e = _joined(*(table[n].to_numpy()[gone] for n in ("d", "t", "s", "e")))
    empty = {n: pa.nulls(len(d), k) for n, k in kinds.items()}
    rest = pa.table(empty | {"d": d, "t": t, "s": s, "e": e, "first": np.zeros(len(d), bool)}, schema=pa.schema(list(kinds.items())))
    yield from rest.to_batches(max_chunksize=20_000)


def _gathered(rows: Iterator[pa.RecordBatch], by: list[str], kinds: dict) -> Iterator[pa.RecordBatch]:
    held, n = [], 0
    for b in rows:
        held.append(b)
        n += b.num_rows
        if n >= LOCAL_ROWS:
            yield from _parted(pa.Table.from_batches(held), by, kinds)
            held, n = [], 0
    if held:
        yield from _parted(pa.Table.from_batches(held), by, kinds)


def runs_of(texts: DataFrame, repeated: np.ndarray) -> DataFrame:
    """Runs of windows whose anchor's gram may be repeated. c: hash of the run's bytes and of its place from the anchor p; s, e: its windows' starts.

    A task's own repeats are told apart here (first is false, and only d, t, s, e are set).
    """
    sent = texts.sparkSession.sparkContext.broadcast(repeated)

    def each(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(rows, BATCH_BYTES):
            raw, at = text_bytes(b.column(2))
            prints, row, p, s, e, h = runs(raw, at)
            keep = Filter.has(sent.value, h)
            row, p, s, e, h = row[keep], p[keep], s[keep], e[keep], h[keep]
            c = prints.of(s, e - 1 + LENGTH) ^ mix((p - s).astype(np.uint64) + _U(1))
            base = at[row]
            rows_ = pa.array(row)
            yield _batch([b.column(0).take(rows_), b.column(1).take(rows_), h, c, *((x - base).astype(np.int32) for x in (p, s, e))], ["d", "t", "h", "c", "p", "s", "e"])

    return texts.select("d", "t", "text").mapInArrow(lambda rows: _gathered(each(rows), ["h", "c"], _RUN), _ddl(_RUN))


def first_runs(found: DataFrame) -> DataFrame:
    """The same rows with one first run for each h and c in the corpus. A class has a row for each task before at most."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for b in rows:
            h, c, d, t, s, e = (b.column(n).to_numpy() for n in ("h", "c", "d", "t", "s", "e"))
            if not len(h):
                continue
            new = np.append(last != (h[0], c[0]), (h[1:] != h[:-1]) | (c[1:] != c[:-1]))
            last = h[-1], c[-1]
            kept = b.filter(pa.array(new))
            yield pa.RecordBatch.from_arrays([kept.column(n) for n in _RUN], schema=pa.schema(list(_RUN.items())))
            d, t, s, e = _joined(d[~new], t[~new], s[~new], e[~new])
            empty = {n: pa.nulls(len(d), k) for n, k in _RUN.items()}
            yield from pa.table(empty | {"d": d, "t": t, "s": s, "e": e, "first": np.zeros(len(d), bool)}, schema=pa.schema(list(_RUN.items()))).to_batches()

    rows = found.where("first").repartition("h", "c").sortWithinPartitions("h", "c", "d", "t", "p")
    return rows.mapInArrow(run, _ddl(_RUN))


def pieces_of(texts: DataFrame, wanted: DataFrame, held: np.ndarray) -> DataFrame:
    """The pieces of the wanted runs (d, t, w: array of h, p, s, e). k: hash of the core and its place from the anchor; p: where the core starts; left, right: the bytes beside it.

    A task's own repeats are told apart as in runs_of.
    """
    sent = texts.sparkSession.sparkContext.broadcast(held)

    def skip(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows:
            yield b.select(["d", "t", "text"]).filter(pa.array(Filter.has(sent.value, b.column(3).to_numpy())))

    def each(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(rows, BATCH_BYTES):
            raw, at = text_bytes(b.column(2))
            prints = Prints(raw)
            w = b.column(3)
            row = np.repeat(np.arange(b.num_rows), w.value_lengths().to_numpy())
            h, p, s, e = (x.to_numpy() for x in w.flatten().flatten())
            base = at[row]
            p, s, e = p + base, s + base, e + base
            # windows of a run by their distance l from the anchor, cut at multiples of PIECE
            low, high = (p - e + 1) // PIECE, (p - s) // PIECE
            n = high - low + 1
            of = np.repeat(np.arange(len(p)), n)
            part = low[of] + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            p, h, row = p[of], h[of], row[of]
            most, least = np.minimum(part * PIECE + PIECE - 1, p - s[of]), np.maximum(part * PIECE, p - e[of] + 1)
            a, z = p - part * PIECE, p - (part * PIECE + PIECE - 1) + LENGTH  # the core: what all windows of a full piece share
            k = prints.of(a, z) ^ mix(part.astype(np.uint64) + _U(1))
            first, last = p - most, p - least + LENGTH
            data = raw.tobytes()
            left = [data[x:y] for x, y in zip(first.tolist(), a.tolist(), strict=True)]
            right = [data[x:y] for x, y in zip(z.tolist(), last.tolist(), strict=True)]
            rows_, base = pa.array(row), at[row]
            starts = [(x - base).astype(np.int32) for x in (a, first, p - least + 1)]
            yield _batch([b.column(0).take(rows_), b.column(1).take(rows_), h, k, starts[0], pa.array(left, pa.binary()), pa.array(right, pa.binary()), *starts[1:]], list(_PIECE)[:-1])

    some = texts.select("d", "t", "text", F.xxhash64("d", "t").alias("x")).mapInArrow(skip, "d long, t long, text string")
    met = some.join(wanted, ["d", "t"]).select("d", "t", "text", "w")
    return met.mapInArrow(lambda rows: _gathered(each(rows), ["h", "k", "left", "right"], _PIECE), _ddl(_PIECE))


def repeated_windows(firsts: list[tuple]) -> list[tuple[int, int, int, int]]:
    """(d, t, s, e) of windows that start earlier elsewhere, of the pieces (d, t, place of the core, left, right) of one core.

    The text holds each piece as its left bytes, the core as one symbol, its right bytes and an end; a
    window is a suffix of it whose first PIECE symbols hold the core and no end.
    """
    parts, owner, first = [], [], []
    for i, (_, _, _, left, right) in enumerate(firsts):
        parts += [left.decode("latin-1"), _CORE, right.decode("latin-1"), _END]
        n = len(left) + 1 + len(right) + 1
        owner += [i] * n
        first += range(-len(left), n - len(left))
    text = "".join(parts)
    out, group, seen = [], [], ""

    def close() -> None:
        if len(group) > 1:
            told = sorted((*firsts[owner[i]][:2], firsts[owner[i]][2] + first[i]) for i in group)
            out.extend((d, t, s, s + 1) for d, t, s in told[1:])

    for i in suffix_array(text):
        w = text[i : i + PIECE]
        if len(w) == PIECE and _CORE in w and _END not in w:
            if w != seen:
                close()
                group, seen = [], w
            group.append(i)
    close()
    return out


def sorted_repeats(pieces: DataFrame) -> DataFrame:
    """(d, t, s, e) of repeated windows among pieces, one core after another.

    Of equal pieces the first stands for all; the pieces of a core that differ are sorted by suffix.
    A core has its few bytes left and right in as many variants as the corpus has, times the tasks before at most.
    """
    names = ["h", "k", "left", "right", "d", "t", "p", "s", "e"]

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, out = None, [], []

        def told() -> pa.RecordBatch:
            d, t, s, e = _joined(*(np.array([x[i] for x in out], k) for i, k in enumerate((np.int64, np.int64, np.int32, np.int32))))
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(d), pa.array(t), pa.array(s), pa.array(e)], names=["d", "t", "s", "e"])

        def close() -> None:
            firsts, last = [], None
            for left, right, d, t, p, s, e in held:
                if (left, right) == last:
                    out.append((d, t, s, e))
                else:
                    firsts.append((d, t, p, left, right))
                    last = left, right
            if len(firsts) > 1:
                out.extend(repeated_windows(firsts))

        for b in rows:
            h, k = b.column(0).to_numpy(), b.column(1).to_numpy()
            if not len(h):
                continue
            same = np.append(at == (h[0], k[0]), (h[1:] == h[:-1]) & (k[1:] == k[:-1]))
            lonely = ~same & ~np.append(same[1:], False)
            lonely[-1] = False  # the next batch may go on with it
            if lonely[0] and len(held) > 1:
                close()
                held = []
            keep = np.flatnonzero(~lonely)
            for i, row in zip(keep.tolist(), zip(*(b.column(n).take(pa.array(keep)).to_pylist() for n in names[2:]), strict=True), strict=True):
                if not same[i]:
                    if len(held) > 1:
                        close()
                    held = []
                held.append(row)
            at = h[-1], k[-1]
            if len(out) > 20_000:
                yield told()
        if len(held) > 1:
            close()
        yield told()

    rows = pieces.select(*names).repartition("h", "k").sortWithinPartitions("h", "k", "left", "right", "d", "t", "p")
    return rows.mapInArrow(run, "d long, t long, s int, e int")


def _merged(s: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(s, kind="stable")
    s, e = s[order], np.maximum.accumulate(e[order])
    new = np.append(True, s[1:] > e[:-1])
    return s[new], e[np.append(np.flatnonzero(new)[1:] - 1, len(e) - 1)]


def removed_spans(docs: DataFrame, key: str = "doc_id", text: str = "text") -> tuple[DataFrame, str]:
    """(d, t, w: array of s, e): starts of windows, s to e exclusive, that start earlier elsewhere; d, t name the texts as _texts does. With the path of the table."""
    spark = docs.sparkSession
    texts, paths = _distinct(_texts(docs, key, text))
    repeated = Filter.of(grams_of(texts).groupBy("h").agg(F.sum("n").alias("n")).where("n > 1"), "h")
    found, path1 = written(runs_of(texts, repeated), "runs")
    runs_, path2 = written(first_runs(found), "runs")
    firsts = runs_.where("first")
    several = firsts.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h")
    wanted, path3 = written(firsts.join(several, "h").groupBy("d", "t").agg(F.collect_list(F.struct("h", "p", "s", "e")).alias("w")), "wanted")
    pieces, path4 = written(pieces_of(texts, wanted, Filter.of(wanted.select(F.xxhash64("d", "t").alias("x")), "x")), "pieces")
    spans = [x.where("not first").select("d", "t", "s", "e") for x in (found, runs_, pieces)]
    every = sorted_repeats(pieces.where("first")).unionByName(spans[0]).unionByName(spans[1]).unionByName(spans[2])
    out, path = written(every.groupBy("d", "t").agg(F.collect_list(F.struct("s", "e")).alias("w")), "spans")
    erase(spark, path1, path2, path3, path4, *paths)
    return out, path


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_bytes, n_removed, n_spans, kept (binary: the remaining bytes) for each row of docs.

    Null and empty texts have nothing to remove. Rows without a key come last in order. Rows with equal
    keys and texts are one document and get equal results; rows with equal keys and different texts are
    ordered by a hash of the text. Other columns play no part.
    """
    texts = _texts(docs, key, text)
    spans, _ = removed_spans(docs, key, text)
    held = texts.sparkSession.sparkContext.broadcast(Filter.of(spans.select(F.xxhash64("d", "t").alias("x")), "x"))
    rows = docs.select(F.col(key).alias("key")).schema["key"].dataType.simpleString()
    whole = docs.select(F.col(key).alias("key"), F.coalesce(F.col(key).cast("long"), F.lit(_MOST)).alias("d"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("t"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("body"))
    whole = whole.withColumn("x", F.xxhash64("d", "t"))

    def choose(some: bool):
        def run(batches_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches_:
                has = Filter.has(held.value, b.column(4).to_numpy())
                yield b.select(["key", "d", "t", "body"]).filter(pa.array(has if some else ~has))

        return run

    schema = f"key {rows}, d long, t long, body binary"
    out = f"key {rows}, n_bytes long, n_removed long, n_spans long, kept binary"

    def run(batches_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches_:
            removed, spans_, kept = [], [], []
            for body, w in zip(b.column(1), b.column(2), strict=True):
                data = body.as_py()
                if not w.is_valid:
                    removed.append(0)
                    spans_.append(0)
                    kept.append(data)
                    continue
                s, e = (x.to_numpy() for x in w.values.flatten())
                s, e = _merged(s, e - 1 + LENGTH)
                removed.append(int((e - s).sum()))
                spans_.append(len(s))
                cuts = [0, *np.stack([s, e], 1).ravel().tolist(), len(data)]
                kept.append(b"".join(data[x:y] for x, y in zip(cuts[::2], cuts[1::2], strict=True)))
            sizes = [len(x) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans_, pa.int64()), pa.array(kept, pa.binary())], names=["key", "n_bytes", "n_removed", "n_spans", "kept"])

    plain = whole.mapInArrow(choose(False), schema).select("key", F.length("body").cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), F.col("body").alias("kept"))
    touched = whole.mapInArrow(choose(True), schema).join(spans, ["d", "t"], "left").select("key", "body", "w").mapInArrow(run, out)
    return plain.unionByName(touched).withColumnRenamed("key", key)
