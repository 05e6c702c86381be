"""MinHash near-dedup by tensored banding, with links confirmed on full shingle sets.

Two small collections of HASHES band values each stand for HASHES * HASHES tables: the key of a table
is a pair of one value from either, so a text needs 2 * HASHES * ROWS minhashes in all. Documents with
equal shingle sets form one class, which takes part once. A class whose values are all its own in one
collection meets nobody and leaves before any pair of values is formed.

First each class is compared with the smallest of each of its buckets. Then, only for buckets that
still span several components, classes of different components are compared block by block in memory,
which gives no row for a pair that isn't a link. Every link is confirmed on both full sets. Before, bitmaps
of an eighth to a quarter of a set's bytes bound intersections from above, so full sets are sent only where a link is possible.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches, erase, release, written
from .components import components
from .shingles import mix, shingle_sets

#: Band values in either collection, and minhashes in each: at similarity 0.75 a pair is missed by all 256 tables once in about 3200 times,
#: one at 0.2 is a candidate once in 70 times, one at 0.1 once in 4000.
HASHES, ROWS = 16, 3
#: Two classes are linked from this percentage of their union on.
PERCENT = 75
#: Classes, and bytes of their sets, in a block of those compared in memory.
BLOCK, BLOCK_BYTES = 1024, 4 << 20
#: Bits for each member of a set in the bitmaps that bound intersections there.
SPREAD = 16
#: Bits at least for each member of a set in the bitmap that is sent before the set.
SENT_SPREAD = 8
#: Words of the filters by which the second reading skips texts that have no candidate, and sets without a possible link stay where they lie. Their size is fixed; a full filter skips none.
FILTER_WORDS = 1 << 20
_N = 2 * HASHES * ROWS
_RNG = np.random.Generator(np.random.PCG64(75))
_XOR, _MUL = _RNG.integers(1, 1 << 63, (2, _N), dtype=np.uint64)
_MUL |= np.uint64(1)
_FOLD = _RNG.integers(1, 1 << 63, ROWS, dtype=np.uint64) | np.uint64(1)


def class_key(s: np.ndarray) -> bytes:
    """128 bits that stand for a set."""
    return np.array([mix(s).sum(), (mix(s ^ _XOR[0]) * _MUL[0]).sum() ^ np.uint64(len(s))], np.uint64).tobytes()


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """A row of minhashes for each set; none may be empty."""
    every = np.concatenate(sets)
    at = np.append(0, np.cumsum([len(s) for s in sets])[:-1])
    return np.stack([np.minimum.reduceat((every ^ x) * m, at) for x, m in zip(_XOR, _MUL, strict=True)], 1)


def sketches(docs: DataFrame, key: str, text: str) -> DataFrame:
    """doc_id, n_shingles, node (null without words), a and b (band values of the collections)."""
    schema = f"doc_id {docs.schema[key].dataType.simpleString()}, n_shingles long, node binary, a array<long>, b array<long>"

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = np.arange(2 * HASHES, dtype=np.uint64)
        for b in batches(rows, max_bytes=2 << 20):
            sets = shingle_sets(b.column(1))
            some = [i for i, s in enumerate(sets) if len(s)]
            node, bands = [None] * len(sets), [None] * len(sets)
            if some:
                low = signatures([sets[i] for i in some])
                values = mix((mix(low).reshape(len(some), 2 * HASHES, ROWS) * _FOLD).sum(2) + place).view(np.int64)
                for k, i in enumerate(some):
                    node[i], bands[i] = class_key(sets[i]), values[k].tolist()
            halves = [[x and x[h : h + HASHES] for x in bands] for h in (0, HASHES)]
            columns = [b.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(node, pa.binary()), *(pa.array(h, pa.list_(pa.int64())) for h in halves)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_shingles", "node", "a", "b"])

    return docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, schema)


def shared_values(classes: DataFrame, column: str) -> DataFrame:
    """(node, values: array) of the classes that share a value of the collection in `column` with another, and which they share."""
    each = classes.select("node", F.explode(column).alias("x"))
    shared = each.groupBy("x").agg(F.count("*").alias("n")).where("n > 1").select("x")
    return each.join(shared, "x").groupBy("node").agg(F.collect_list("x").alias(column))


def buckets(classes: DataFrame) -> tuple[DataFrame, list[str]]:
    """(key, node, leader, n) of the tables' buckets that hold two classes or more, with the paths of the tables written.

    A class whose values are all its own in the first collection meets nobody; only the others' second values are dealt out.
    """
    spark = classes.sparkSession
    first, path1 = written(shared_values(classes, "a"), "first")
    release(spark)
    second = shared_values(classes.select("node", "b").join(first.select("node"), "node", "left_semi"), "b")
    pairs = first.join(second, "node").select("node", F.explode("a").alias("x"), "b").select("node", "x", F.explode("b").alias("y"))
    keyed, path2 = written(pairs.select(F.xxhash64("x", "y").alias("key"), "node"), "keys")
    release(spark)
    tops = keyed.groupBy("key").agg(F.min("node").alias("leader"), F.count("*").alias("n")).where("n > 1")
    met, path3 = written(keyed.join(tops, "key"), "members")
    erase(spark, path1, path2)
    return met, [path3]


def placed(rows: DataFrame, column: str) -> DataFrame:
    """rows with the word k and the bit b of the column's place in a filter."""
    hashed = F.xxhash64(column)
    return rows.withColumns({"k": F.pmod(F.shiftright(hashed, 6), F.lit(FILTER_WORDS)).cast("int"), "b": hashed.bitwiseAND(F.lit(63)).cast("int")})


def filter_of(rows: DataFrame, column: str) -> np.ndarray:
    """A filter of fixed size that holds the column's values."""
    words = np.zeros(FILTER_WORDS, np.int64)
    filled = placed(rows, column).groupBy("k").agg(F.bit_or(F.expr("shiftleft(1L, b)")).alias("w")).toArrow()  # FILTER_WORDS rows at most
    words[filled["k"].to_numpy()] = filled["w"].to_numpy()
    return words


def passing(held: np.ndarray, b: pa.RecordBatch) -> pa.RecordBatch:
    """The rows whose k and b, the last columns, the filter holds."""
    keep = (held[b.column("k").to_numpy()] >> b.column("b").to_numpy().astype(np.int64)) & 1
    return b.filter(pa.array(keep.astype(bool)))


def bitmap(s: np.ndarray) -> bytes:
    """Bits of a set, one set for each member; a power of two of them, so that halves fold onto each other."""
    bits = np.zeros(max(64, 1 << (SENT_SPREAD * len(s) - 1).bit_length()), bool)
    bits[s & np.uint64(len(bits) - 1)] = True
    return np.packbits(bits).tobytes()


def folded(bits: np.ndarray, n: int) -> np.ndarray:
    """The bitmap of the same set in n words."""
    return np.bitwise_or.reduce(bits.reshape(-1, n), 0) if len(bits) > n else bits


def possible(x: np.ndarray, y: np.ndarray, size_x, size_y, percent: int):
    """Whether sets of these sizes can be linked: a member whose bit the other lacks isn't in it. Bitmaps of one width; y and size_y may be many."""
    most = np.minimum(size_x - np.bitwise_count(x & ~y).sum(-1, dtype=np.int64), size_y - np.bitwise_count(y & ~x).sum(-1, dtype=np.int64))
    return 100 * most >= percent * (size_x + size_y - most)


def full_sets(docs: DataFrame, key: str, text: str, wanted: DataFrame) -> tuple[DataFrame, str]:
    """(node, size, bits, set), with the table's path, of the classes in wanted (node, rep): the texts are read again; a filter of fixed size skips most of the others.

    Nothing is shuffled, so a class may have several equal rows, and some that aren't wanted are among them: see one_each().
    """
    sent = docs.sparkSession.sparkContext.broadcast(filter_of(wanted, "rep"))
    hashed = placed(docs.select(F.col(key).alias("rep"), F.col(text).alias("text")).where(F.col("rep").isNotNull()), "rep").select("text", "k", "b")

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = sent.value
        for b in batches(rows, max_bytes=2 << 20):
            sets = [s for s in shingle_sets(passing(held, b).column(0)) if len(s)]
            for i in range(0, len(sets), 256):
                part = sets[i : i + 256]
                columns = [pa.array([f(s) for s in part], pa.binary()) for f in (class_key, bitmap, np.ndarray.tobytes)]
                yield pa.RecordBatch.from_arrays([columns[0], pa.array([len(s) for s in part], pa.int64()), *columns[1:]], names=["node", "size", "bits", "set"])

    return written(hashed.mapInArrow(run, "node binary, size long, bits binary, set binary"), "sets")


def one_each(sets: DataFrame, *columns: str, among: DataFrame | None = None) -> DataFrame:
    """node and the columns of each class; with `among` (node), most of the other classes are left out before anything is shuffled."""
    sets = sets.select("node", *columns)
    if among is not None:
        sent, names = sets.sparkSession.sparkContext.broadcast(filter_of(among, "node")), sets.columns

        def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in rows:
                yield passing(sent.value, b).select(names)

        sets = placed(sets, "node").mapInArrow(run, sets.schema)
    return sets.dropDuplicates(["node"])


def similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets have 100 * intersection >= percent * union."""
    if min(len(x), len(y)) * 100 < percent * max(len(x), len(y)):
        return False
    both = np.sort(np.concatenate([x, y]), kind="stable")  # two runs: merged
    n = int((both[1:] == both[:-1]).sum())
    return 100 * n >= percent * (len(both) - n)


def bitmaps(sets: list[np.ndarray]) -> np.ndarray:
    """A row of bits for each set, one set for each member; wide enough that few members share one."""
    bits = 1 << max(9, int(SPREAD * np.mean([len(s) for s in sets])).bit_length())
    out = np.zeros((len(sets), bits // 64), np.uint64)
    for row, s in zip(out, sets, strict=True):
        at = s % np.uint64(bits)
        np.bitwise_or.at(row, (at >> np.uint64(6)).astype(np.int64), np.uint64(1) << (at & np.uint64(63)))
    return out


def fitting(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The pairs (u, v) whose sizes let them be linked; others need no full sets."""
    a, b = (classes.select(F.col("node").alias(c), F.col("size").alias(f"size_{c}")) for c in ("u", "v"))
    most, least = F.greatest("size_u", "size_v"), F.least("size_u", "size_v")
    return pairs.join(a, "u").join(b, "v").where(100 * least >= percent * most).select("u", "v")


def close(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (u, v) that bitmaps of their sets don't rule out; others need no full sets."""
    told = one_each(sets, "size", "bits")
    one, two = (told.select(F.col("node").alias(c), F.col("size").alias(f"size_{c}"), F.col("bits").alias(f"bits_{c}")) for c in ("u", "v"))

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows:
            keep = []
            for m, n, s, t in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), b.column(4), b.column(5), strict=True):
                x, y = (np.frombuffer(z.as_buffer(), np.uint64) for z in (s, t))
                words = min(len(x), len(y))
                keep.append(bool(possible(folded(x, words), folded(y, words), m, n, percent)))
            yield b.select(["u", "v"]).filter(pa.array(keep, pa.bool_()))

    return pairs.join(one, "u").join(two, "v").select("u", "v", "size_u", "size_v", "bits_u", "bits_v").mapInArrow(run, "u binary, v binary")


def confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (u, v) that are linked on their full sets. pairs is read twice: write it first."""
    sets = one_each(sets, "set", among=pairs.select(F.explode(F.array("u", "v")).alias("node")))
    one = sets.select(F.col("node").alias("u"), F.col("set").alias("s"))
    two = sets.select(F.col("node").alias("v"), F.col("set").alias("t"))

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows:
            keep = []
            for s, t in zip(b.column(2), b.column(3), strict=True):
                keep.append(similar(np.frombuffer(s.as_buffer(), np.uint64), np.frombuffer(t.as_buffer(), np.uint64), percent))
            yield b.select(["u", "v"]).filter(pa.array(keep, pa.bool_()))

    return pairs.join(one, "u").join(two, "v").select("u", "v", "s", "t").mapInArrow(run, "u binary, v binary")


def linked(rows: list[tuple[int, bytes, bytes, bytes]], percent: int) -> list[tuple[bytes, bytes]]:
    """Confirmed links that join different components among (block, node, component, set) rows; between two blocks where there are two.

    A member whose bit another set lacks isn't in it, so bitmaps bound the intersection of two sets from above: no
    pair that the bound rules out can be linked. What is joined already isn't tried.
    """
    sets = [np.frombuffer(x[3], np.uint64) for x in rows]
    bits = bitmaps(sets)
    size, block = np.array([len(s) for s in sets]), np.array([x[0] for x in rows])
    name = {r: i for i, r in enumerate(dict.fromkeys(x[2] for x in rows))}
    of, two, out = np.array([name[x[2]] for x in rows]), block[0] != block[-1], []
    for i in range(len(rows) - 1):
        fit = (of[i + 1 :] != of[i]) & (100 * np.minimum(size[i + 1 :], size[i]) >= percent * np.maximum(size[i + 1 :], size[i]))
        j = np.flatnonzero(fit & (block[i + 1 :] != block[i]) if two else fit) + i + 1
        if not len(j):
            continue
        most = np.minimum(size[i] - np.bitwise_count(bits[i] & ~bits[j]).sum(1), size[j] - np.bitwise_count(bits[j] & ~bits[i]).sum(1))
        near = 100 * most >= percent * (size[i] + size[j] - most)
        for k in j[near][np.argsort(-most[near], kind="stable")].tolist():
            if of[i] != of[k] and similar(sets[i], sets[k], percent):
                of[of == of[k]] = of[i]
                out.append((rows[i][1], rows[k][1]))
    return out


def opened(rows: list[tuple[int, bytes, bytes, int, bytes]], percent: int) -> list[tuple[bytes]]:
    """The nodes among (block, node, component, size, bits) rows that bitmaps let be linked with one of another component; between two blocks where there are two."""
    bits = [np.frombuffer(x[4], np.uint64) for x in rows]
    words, size, block = (np.array(x) for x in ([len(x) for x in bits], [x[3] for x in rows], [x[0] for x in rows]))
    name = {r: i for i, r in enumerate(dict.fromkeys(x[2] for x in rows))}
    of, two, mark = np.array([name[x[2]] for x in rows]), block[0] != block[-1], np.zeros(len(rows), bool)
    for n in np.unique(words):
        own = np.flatnonzero(words == n)
        wide = np.flatnonzero((words >= n) & (100 * size[own].max() >= percent * size))  # narrower ones have met these before
        every = np.stack([folded(bits[j], n) for j in wide])
        for i in own:
            fit = (of[wide] != of[i]) & (100 * np.minimum(size[wide], size[i]) >= percent * np.maximum(size[wide], size[i]))
            fit &= ~mark[wide] if mark[i] else True
            j = np.flatnonzero(fit & (block[wide] != block[i]) if two else fit)
            j = j[possible(bits[i], every[j], size[i], size[wide[j]], percent)]
            mark[wide[j]] = True
            mark[i] |= len(j) > 0
    return [(rows[i][1],) for i in np.flatnonzero(mark)]


def dealt(rows: DataFrame, each: int) -> tuple[DataFrame, str]:
    """rows (g, node, size, ...) with i, j and block, once for each block of their group, with the path of a table written; `each`: bytes sent for a member."""
    sizes, path = written(rows.groupBy("g").agg(F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("size") * each / BLOCK_BYTES)).cast("int").alias("blocks")), "sizes")
    rows = rows.join(sizes, "g").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return rows.withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")}), path


def met(rows: DataFrame, work: Callable[[list[tuple]], list[tuple]], names: list[str]) -> DataFrame:
    """What work gives for the rows of every two blocks (g, i, j), which one task holds at a time; its binary columns are `names`."""

    def run(batches_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, at, out = [], None, []
        for b in batches_:
            for g, i, j, *row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if (g, i, j) != at:
                    out += work(held) if len(held) > 1 else []
                    held, at = [], (g, i, j)
                held.append(tuple(row))
        out += work(held) if len(held) > 1 else []
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.binary()) for k in range(len(names))], names=names)

    return rows.repartition("g", "i", "j").sortWithinPartitions("g", "i", "j", "block").mapInArrow(run, ", ".join(f"{x} binary" for x in names))


def rest_links(members: DataFrame, sets: DataFrame, roots: DataFrame, percent: int) -> tuple[DataFrame, list[str]]:
    """Links (u, v) between components so far, of classes that share buckets, with the paths of the tables that they are read from.

    Buckets that still span components are joined to groups by the classes they share. A group is dealt
    into blocks of bounded size, and every two blocks meet in one task, which tries their pairs in
    memory: first on bitmaps, which tell the classes that can have a link, then those alone on full sets, which gives
    confirmed links only. Rows stream in order of group and blocks; a set is sent once for each block of its group.
    """
    spark = members.sparkSession
    named = members.select("key", "node").join(roots.withColumnRenamed("root", "r"), "node", "left").withColumn("r", F.coalesce("r", "node"))
    mixed, path1 = written(named.groupBy("key").agg(F.min("r").alias("r0"), F.max("r").alias("r1"), F.min("node").alias("u")).where("r0 <> r1").select("key", "u"), "mixed")
    release(spark)
    rows, path2 = written(named.join(mixed, "key").select("u", "node", "r").distinct(), "spanning")
    release(spark)
    groups = components(rows.select("u", F.col("node").alias("v"))).withColumnRenamed("root", "g")
    rows, path3 = written(rows.select("node", "r").distinct().join(groups, "node").join(one_each(sets, "size"), "node"), "grouped")
    erase(spark, path1, path2)
    blocks, path4 = dealt(rows, SENT_SPREAD // 4)  # a bitmap has twice SENT_SPREAD bits a member at most
    blocks = blocks.join(one_each(sets, "bits"), "node").select("g", "i", "j", "block", "node", "r", "size", "bits")
    some, path5 = written(met(blocks, lambda held: opened(held, percent), ["node"]), "open")
    release(spark)
    rows, path6 = written(rows.join(some.distinct(), "node", "left_semi"), "opened")
    blocks, path7 = dealt(rows, 8)
    blocks = blocks.join(one_each(sets, "set", among=rows), "node").select("g", "i", "j", "block", "node", "r", "set")
    return met(blocks, lambda held: linked(held, percent), ["u", "v"]), [path3, path4, path5, path6, path7]


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", percent: int = PERCENT) -> DataFrame:
    """key, n_shingles, component_id, kept for each row of docs.

    component_id is the smallest key reachable over links, the row's own included; kept says whether it is the row's own.
    A text without words is linked with nothing; so is a row without a key, whose component_id is null
    and which is kept. Rows with equal keys and texts get equal results; an empty table an empty one.
    """
    spark = docs.sparkSession
    wide, path1 = written(sketches(docs, key, text), "sketches")
    grouped = wide.where("node is not null and doc_id is not null").groupBy("node")
    banded, path2 = written(grouped.agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("size"), F.first("a").alias("a"), F.first("b").alias("b")), "classes")
    rows, _ = written(wide.select("doc_id", "n_shingles", "node"), "rows")  # band values, most of the bytes, go as soon as they aren't needed
    erase(spark, path1)
    release(spark)
    members, paths = buckets(banded)
    classes, _ = written(banded.select("node", "rep", "size"), "classes")
    erase(spark, path2)
    release(spark)
    wanted = members.select("node").distinct().join(classes.select("node", "rep"), "node")
    sets, path = full_sets(docs, key, text, wanted)
    release(spark)
    stars = members.where("node <> leader").select(F.col("leader").alias("u"), F.col("node").alias("v")).distinct()
    pairs, path0 = written(close(fitting(stars, classes, percent), sets, percent), "close")
    release(spark)  # what made the pairs, before full sets are sent
    links, path1 = written(confirm(pairs, sets, percent), "links")
    release(spark)
    roots, path2 = written(components(links), "roots")
    rest, more_paths = rest_links(members, sets, roots, percent)
    more, path3 = written(rest, "links")
    if not more.isEmpty():
        roots, _ = written(components(roots.select(F.col("node").alias("u"), F.col("root").alias("v")).unionByName(more)), "roots")
        more_paths.append(path2)
    erase(spark, path, path0, path1, path3, *paths, *more_paths)
    release(spark)
    named = classes.select("node", "rep").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = named.groupBy("root").agg(F.min("rep").alias("component"))
    labels = named.select("node", "root").join(least, "root").select("node", "component")
    out = rows.select("doc_id", "n_shingles", "node").join(labels, "node", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return out.select(F.col("doc_id").alias(key), "n_shingles", component.alias("component_id")).withColumn("kept", F.col(key).eqNullSafe(F.col("component_id")))
