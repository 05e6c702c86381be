"""Approximate nearest neighbours by a robust-pruned directed graph in each shard.

Vectors that are equal form one class. Classes are dealt into shards of bounded size; a shard's graph
is built in growing rounds: a beam search over the graph so far proposes neighbours, and relaxed
pruning keeps a near one only if no kept one is nearer to it by the factor ALPHA. Every query class
is searched by beam in every shard, and what it finds is scored again in double precision.

Inner products become distances by one more coordinate that gives all vectors of a shard equal norms.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: Classes in a shard, queries in a block, neighbours of a node, beam while building and while searching, slack of pruning.
SHARD, QUERIES, DEGREE, BUILD_BEAM, SEARCH_BEAM, ALPHA = 8192, 32768, 32, 64, 144, 1.2
#: Nodes of a building round at most; nodes whose neighbours one search step reads.
ROUND, STEP = 1024, 4


def equal_norms(x: np.ndarray) -> np.ndarray:
    square = (x.astype(np.float64) ** 2).sum(1)
    return np.concatenate([x, np.sqrt(np.maximum(square.max() - square, 0))[:, None]], 1).astype(np.float32)


def beam_search(data: np.ndarray, graph: np.ndarray, start: int, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and squared distances of the `beam` nearest nodes found for each query, nearest first; -1 and inf where there are fewer."""
    n, q = len(data), len(queries)
    ids = np.full((q, beam), -1, np.int64)
    dist = np.full((q, beam), np.inf, np.float32)
    fresh = np.zeros((q, beam), bool)
    seen = np.zeros((q, n), bool)
    ids[:, 0], fresh[:, 0], seen[:, start] = start, True, True
    dist[:, 0] = ((queries - data[start]) ** 2).sum(1)
    live = np.arange(q)
    while len(live):
        order = np.argsort(~fresh[live], axis=1, kind="stable")[:, :STEP]  # the nearest ones that haven't been read
        rows = live[:, None]
        take = fresh[rows, order]
        near = graph[np.where(take, ids[rows, order], -1)]  # row -1 of the graph holds no neighbours
        fresh[rows, order] = False
        near = near.reshape(len(live), -1)
        r, c = np.nonzero(near >= 0)
        node = near[r, c]
        new = ~seen[live[r], node]
        r, c, node = r[new], c[new], node[new]
        _, once = np.unique(r * n + node, return_index=True)
        r, c, node = r[once], c[once], node[once]
        seen[live[r], node] = True
        d = np.full(near.shape, np.inf, np.float32)
        diff = data[node] - queries[live[r]]
        d[r, c] = np.einsum("ij,ij->i", diff, diff)
        all_d = np.concatenate([dist[live], d], 1)
        all_i = np.concatenate([ids[live], near], 1)
        all_f = np.concatenate([fresh[live], d < np.inf], 1)
        best = np.argsort(all_d, axis=1, kind="stable")[:, :beam]
        lines = np.arange(len(live))[:, None]
        dist[live], ids[live], fresh[live] = all_d[lines, best], np.where(all_d[lines, best] < np.inf, all_i[lines, best], -1), all_f[lines, best]
        live = live[fresh[live].any(1)]
    return ids, dist


def prune(data: np.ndarray, points: np.ndarray, near: np.ndarray, degree: int = DEGREE, alpha: float = ALPHA) -> np.ndarray:
    """For each point, up to `degree` of its candidates (-1: none): the nearest, then only such as no kept one is nearer to by the factor alpha."""
    vectors = data[near]
    base = data[points]
    d = np.einsum("pkd,pkd->pk", vectors - base[:, None], vectors - base[:, None])
    d[(near < 0) | (near == points[:, None])] = np.inf
    order = np.argsort(d, axis=1, kind="stable")
    lines = np.arange(len(points))[:, None]
    near, d, vectors = near[lines, order], d[lines, order], vectors[lines, order]
    out = np.full((len(points), degree), -1, np.int64)
    lines = np.arange(len(points))
    for k in range(degree):
        first = np.argmin(np.isinf(d), axis=1)
        ok = np.isfinite(d[lines, first])
        if not ok.any():
            break
        out[ok, k] = near[lines, first][ok]
        diff = vectors - vectors[lines, first][:, None]
        between = np.einsum("pkd,pkd->pk", diff, diff)
        d[(alpha * alpha * between <= d) | (near == out[:, k][:, None])] = np.inf
        d[lines[ok], first[ok]] = np.inf
    return out


def build(data: np.ndarray, seed: int = 0) -> tuple[np.ndarray, int]:
    """The graph, a row of neighbours (-1: none) for each node and an empty last row, and the node that searches start from."""
    n = len(data)
    graph = np.full((n + 1, DEGREE), -1, np.int64)
    start = int(((data - data.mean(0)) ** 2).sum(1).argmin())
    order = np.random.Generator(np.random.PCG64(seed)).permutation(n)
    order = order[order != start]
    at = 0
    while at < len(order):
        mine = order[at : at + min(ROUND, max(16, at))]
        at += len(mine)
        found, _ = beam_search(data, graph, start, data[mine], BUILD_BEAM)
        graph[mine] = prune(data, mine, found)
        # the way back: each new neighbour takes the node, and is pruned where it has too many
        frm, to = np.repeat(mine, DEGREE), graph[mine].ravel()
        frm, to = frm[to >= 0], to[to >= 0]
        by = np.argsort(to, kind="stable")
        frm, to = frm[by], to[by]
        nodes, first, count = np.unique(to, return_index=True, return_counts=True)
        room = DEGREE - (graph[nodes] >= 0).sum(1)
        slot = np.arange(len(to)) - np.repeat(first, count)
        fits = np.repeat(count <= room, count)
        graph[to[fits], np.repeat(DEGREE - room, count)[fits] + slot[fits]] = frm[fits]
        full = np.flatnonzero(count > room)
        full = full[np.argsort(count[full])]
        for part in np.array_split(full, -(-len(full) // 512)) if len(full) else []:
            near = np.full((len(part), int(count[part].max())), -1, np.int64)
            for i, k in enumerate(part.tolist()):
                near[i, : count[k]] = frm[first[k] : first[k] + count[k]]
            graph[nodes[part]] = prune(data, nodes[part], np.concatenate([graph[nodes[part]], near], 1))
    return joined(data, graph, start), start


def reached(graph: np.ndarray, start: int) -> np.ndarray:
    """Whether each node can be reached from the start."""
    out = np.zeros(len(graph), bool)
    out[start], now = True, np.array([start])
    while len(now):
        near = np.unique(graph[now])
        now = near[(near >= 0) & ~out[near]]
        out[now] = True
    return out[:-1]


def joined(data: np.ndarray, graph: np.ndarray, start: int) -> np.ndarray:
    """The graph with an edge to each node that pruning had cut off, from the nearest node that a search finds, in columns of their own; all nodes can be reached then."""
    while len(lost := np.flatnonzero(~reached(graph, start))):
        lost = lost[: max(1, len(lost) // 2)]  # the others may hang on these
        found, _ = beam_search(data, graph, start, data[lost], BUILD_BEAM)
        frm = found[:, 0]
        by = np.argsort(frm, kind="stable")
        frm, lost = frm[by], lost[by]
        nodes, first, count = np.unique(frm, return_index=True, return_counts=True)
        more = np.full((len(graph), int(count.max())), -1, np.int64)
        more[frm, np.arange(len(frm)) - np.repeat(first, count)] = lost
        graph = np.concatenate([graph, more], 1)
    return graph


def classes(vectors: DataFrame, key: str, vector: str, top: int) -> DataFrame:
    """(v: bytes of doubles, ids: the top + 1 smallest keys) for each distinct usable vector.

    Null keys and vectors that are null or zero or hold null or non-finite components take no part.
    """
    kept = vectors.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("x")).where("id is not null and x is not null and size(x) > 0")

    def first(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows:
            held: dict[bytes, list[int]] = {}
            for i, x in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                v = x.values.to_numpy(zero_copy_only=False)
                if np.isfinite(v).all() and v.any():  # nulls come as nan
                    held.setdefault((v + 0.0).tobytes(), []).append(i)
            yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array([sorted(set(x))[: top + 1] for x in held.values()], pa.list_(pa.int64()))], names=["v", "ids"])

    part = kept.mapInArrow(first, "v binary, ids array<long>")
    # at most top + 1 keys of a vector come from a batch; they merge two levels deep
    some = F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))), 1, top + 1).alias("ids")
    salted = part.withColumn("salt", F.pmod(F.xxhash64(F.get("ids", F.lit(0))), F.lit(64))).groupBy("v", "salt").agg(some)
    return salted.groupBy("v").agg(some)


_NEAR = "q binary, vec_id long, score double"


def search(vectors: DataFrame, queries: DataFrame, key: str = "vec_id", vector: str = "embedding", top: int = 20, shard: int = SHARD, beam: int = SEARCH_BEAM) -> DataFrame:
    """query_id, rank, vec_id, score: for each row of queries (key, vector) the `top` nearest rows of vectors found, its own key aside.

    Largest inner product first, ties to the smaller key; all candidates where there are no more than `top`, for every node of a graph can be
    reached and a beam ends only when it is full or has read all. Vectors are compared with those of their own length only. Rows with equal keys and vectors count once.
    """
    spark = vectors.sparkSession
    found, _ = written(classes(vectors, key, vector, top), "classes")
    counts = {r["n"]: r["c"] for r in found.groupBy(F.length("v").alias("n")).agg(F.count("*").alias("c")).collect()}  # a row for each length of vectors
    asked, _ = written(queries.select(F.col(key).cast("long").alias("query_id"), F.col(vector).cast("array<double>").alias("x")).where("query_id is not null and x is not null").mapInArrow(_plain, "query_id long, q binary").distinct(), "queries")
    distinct = asked.select("q").distinct()
    blocks = max(1, -(-distinct.count() // QUERIES))
    out = None
    for length, count in sorted(counts.items()):
        shards = -(-count // shard)
        mine = found.where(F.length("v") == length).withColumn("shard", F.pmod(F.xxhash64("v"), F.lit(shards)).cast("int"))
        index = mine.repartition(shards, "shard").groupBy("shard").applyInArrow(_index, "shard int, data binary, graph binary, start int, ids binary, sizes binary")
        index, _ = written(index, "index")
        index = index.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        sent = distinct.where(F.length("q") == length).withColumn("block", F.pmod(F.xxhash64("q", F.lit(1)), F.lit(blocks)).cast("int"))
        sent = sent.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
        some = index.repartition(shards * blocks, "shard", "block").groupBy("shard", "block").cogroup(sent.repartition(shards * blocks, "shard", "block").groupBy("shard", "block")).applyInArrow(_searcher(top, beam), _NEAR)
        out = some if out is None else out.unionByName(some)
    if out is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    best = Window.partitionBy("q").orderBy(F.col("score").desc(), "vec_id")
    near = out.withColumn("k", F.row_number().over(best)).where(F.col("k") <= top + 1)
    lists = near.groupBy("q").agg(F.array_sort(F.collect_list(F.struct("k", "vec_id", "score"))).alias("near"))
    own = F.filter("near", lambda x: x["vec_id"] != F.col("query_id"))
    told = asked.join(lists, "q").select("query_id", F.posexplode(F.slice(own, 1, top)).alias("rank", "x"))
    return told.select("query_id", (F.col("rank") + 1).cast("int").alias("rank"), "x.vec_id", "x.score")


def _plain(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in rows:
        ids, out = [], []
        for i, x in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            v = x.values.to_numpy(zero_copy_only=False)
            if len(v) and np.isfinite(v).all() and v.any():
                ids.append(i)
                out.append((v + 0.0).tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(out, pa.binary())], names=["query_id", "q"])


def _index(table: pa.Table) -> pa.Table:
    table = table.sort_by("v")
    data = np.frombuffer(b"".join(table["v"].to_pylist()), np.float64).reshape(table.num_rows, -1)
    graph, start = build(equal_norms(data))
    ids = table["ids"].combine_chunks()
    columns = [table["shard"][0].as_py(), data.tobytes(), graph.astype(np.int32).tobytes(), start, ids.flatten().to_numpy().astype(np.int64).tobytes(), ids.value_lengths().to_numpy().astype(np.int64).tobytes()]
    kinds = [pa.int32(), pa.binary(), pa.binary(), pa.int32(), pa.binary(), pa.binary()]
    return pa.table([pa.array([c], k) for c, k in zip(columns, kinds, strict=True)], names=["shard", "data", "graph", "start", "ids", "sizes"])


def _searcher(top: int, beam: int):
    def run(index: pa.Table, asked: pa.Table) -> pa.Table:
        none = pa.table({"q": pa.array([], pa.binary()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        if not index.num_rows or not asked.num_rows:
            return none
        x = {c: index[c][0].as_py() for c in index.column_names}
        sizes = np.frombuffer(x["sizes"], np.int64)
        data = np.frombuffer(x["data"], np.float64).reshape(len(sizes), -1)
        graph = np.frombuffer(x["graph"], np.int32).reshape(len(sizes) + 1, -1).astype(np.int64)
        ids, at = np.frombuffer(x["ids"], np.int64), np.append(0, np.cumsum(sizes))
        flat = equal_norms(data)
        keys = asked["q"].to_pylist()
        queries = np.frombuffer(b"".join(keys), np.float64).reshape(len(keys), -1)
        out_q, out_i, out_s = [], [], []
        for k in range(0, len(keys), 512):
            q = queries[k : k + 512]
            if len(sizes) <= beam:  # a beam as wide as the shard finds all of it
                near = np.tile(np.arange(len(sizes)), (len(q), 1))
            else:
                near, _ = beam_search(flat, graph, x["start"], np.concatenate([q, np.zeros((len(q), 1))], 1).astype(np.float32), beam)
            for i, nodes in enumerate(near):
                nodes = nodes[nodes >= 0]
                score = (data[nodes] * q[i]).sum(1)
                many = sizes[nodes]
                who = np.concatenate([ids[at[a] : at[a + 1]] for a in nodes.tolist()])
                score = np.repeat(score, many)
                best = np.lexsort((who, -score))[: top + 1]
                out_q += [keys[k + i]] * len(best)
                out_i.append(who[best])
                out_s.append(score[best])
        return pa.table({"q": pa.array(out_q, pa.binary()), "vec_id": np.concatenate(out_i), "score": np.concatenate(out_s)})

    return run
