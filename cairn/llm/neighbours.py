"""Approximate nearest neighbours with a robust-pruned directed graph per shard.

Vectors are dealt to shards by a hash of their components; equal vectors meet there and become one node that carries its
``copies`` smallest vec_ids (more can't be among the nearest of any query).  A shard is built by one task of its own.  There
are as many shards as the cluster has shuffle partitions, but none has more than ``most_rows`` vectors or, where there are
several, fewer than ``least_rows``: a query costs a beam search, whose length grows with the logarithm of its shard, for every
``most_rows`` vectors.  In a shard, nodes join the graph in batches:
a greedy beam search from the medoid proposes neighbours, and robust pruning keeps the nearest and drops every candidate
that a kept one is closer to by the factor ``alpha`` - a relaxed rule that leaves long edges.  Back edges are added and
pruned likewise.  Queries are sent, in blocks, to every shard,
where a beam search answers them; the answers are merged.

Distances of the results are computed in double precision from the stored components.

Vectors that are null, zero, or hold a null or non-finite component take no part; vectors of another length are searched
among their like; ties go to the smaller vec_id; rows with equal vec_id and components count once; a vec_id of several vectors is
one candidate, at its smallest distance, and one query, whose answers are merged; a null vec_id takes no part; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cairn.llm.shared import sized, trim, written

DEGREE, BEAM, ALPHA, BATCH = 32, 48, 1.2, 128


def squared(a: np.ndarray, b: np.ndarray, a2: np.ndarray, b2: np.ndarray) -> np.ndarray:
    """Squared distances of a[i] and b[i, j] by their norms and products."""
    return np.maximum(a2[:, None] + b2 - 2 * np.einsum("id,ijd->ij", a, b, optimize=False), 0)


class Graph:
    """Neighbour lists over distinct vectors; -1 fills unused places."""

    def __init__(self, vectors: np.ndarray, edges: np.ndarray | None = None, degree: int = DEGREE):
        self.x = np.ascontiguousarray(vectors, np.float32)
        self.norm = np.einsum("ij,ij->i", self.x, self.x)
        self.degree = degree
        self.edges = np.full((len(vectors), degree), -1, np.int32) if edges is None else edges
        centre = self.x.mean(0) if len(vectors) else np.zeros(0)
        self.start = int(np.argmin(self.norm - 2 * self.x @ centre)) if len(vectors) else 0

    def search(self, q: np.ndarray, beam: int, joined: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Beam search of many queries at once: (nodes, squared distances), nearest first; -1 and inf fill unused places."""
        m = len(q)
        q2 = np.einsum("ij,ij->i", q, q)
        nodes = np.full((m, beam), -1, np.int64)
        dist = np.full((m, beam), np.inf, np.float32)
        done = np.zeros((m, beam), bool)
        nodes[:, 0] = self.start
        dist[:, 0] = squared(q, self.x[nodes[:, :1]], q2, self.norm[nodes[:, :1]])[:, 0]
        seen = np.zeros((m, len(self.x)), bool)
        seen[:, self.start] = True
        live = np.arange(m)
        while len(live):
            open_ = np.where(done[live] | (nodes[live] < 0), np.inf, dist[live])
            # the two nearest nodes not yet expanded, of each query
            best = np.argpartition(open_, 1, axis=1)[:, :2] if beam > 2 else np.argmin(open_, 1)[:, None]
            some = np.isfinite(np.take_along_axis(open_, best, 1))
            go = some.any(1)
            live, best, some = live[go], best[go], some[go]
            if not len(live):
                break
            rows = live[:, None]
            done[rows, best] |= some
            around = np.where(some[:, :, None], self.edges[nodes[rows, best]], -1).reshape(len(live), -1)
            around = np.sort(around, axis=1)
            fresh = around >= 0
            fresh[:, 1:] &= around[:, 1:] != around[:, :-1]
            fresh &= ~seen[rows, np.maximum(around, 0)]
            width = int(fresh.sum(1).max(initial=0))
            if not width:
                continue
            order = np.argsort(~fresh, axis=1, kind="stable")[:, :width]
            around, fresh = np.take_along_axis(around, order, 1), np.take_along_axis(fresh, order, 1)
            around = np.where(fresh, around, 0)
            r, c = np.nonzero(fresh)
            seen[live[r], around[r, c]] = True
            d = np.where(fresh, squared(q[live], self.x[around], q2[live], self.norm[around]), np.inf).astype(np.float32)
            all_n = np.concatenate([nodes[live], np.where(fresh, around, -1)], 1)
            all_d = np.concatenate([dist[live], d], 1)
            all_o = np.concatenate([done[live], np.zeros(fresh.shape, bool)], 1)
            keep = np.argsort(all_d, axis=1, kind="stable")[:, :beam]
            nodes[live], dist[live], done[live] = (np.take_along_axis(x, keep, 1) for x in (all_n, all_d, all_o))
        return nodes, dist

    def prune(self, at: np.ndarray, nodes: np.ndarray, dist: np.ndarray, alpha: float) -> np.ndarray:
        """Robust pruning of each node's candidates: (len(at), degree) neighbours, -1 where fewer are kept."""
        order = np.argsort(dist, axis=1, kind="stable")
        nodes, dist = np.take_along_axis(nodes, order, 1), np.take_along_axis(dist, order, 1)
        left = np.isfinite(dist) & (nodes != at[:, None]) & (nodes >= 0)
        left[:, 1:] &= nodes[:, 1:] != nodes[:, :-1]
        safe = np.maximum(nodes, 0)
        vectors, norms = self.x[safe], self.norm[safe]
        between = norms[:, :, None] + norms[:, None, :] - 2 * (vectors @ vectors.transpose(0, 2, 1))
        out = np.full((len(at), self.degree), -1, np.int32)
        every = np.arange(len(at))
        for place in range(self.degree):
            if not left.any():
                break
            first = np.argmax(left, 1)
            has = left[every, first]
            out[has, place] = nodes[has, first[has]]
            left &= ~(has[:, None] & (alpha * alpha * between[every, first] <= dist))
            left[every, first] = False
        return out

    def connect(self, at: np.ndarray, alpha: float, beam: int) -> None:
        """Neighbours of the nodes at by search and pruning, and the back edges."""
        nodes, dist = self.search(self.x[at], beam)
        old = self.edges[at]
        old_d = np.where(old >= 0, squared(self.x[at], self.x[np.maximum(old, 0)], self.norm[at], self.norm[np.maximum(old, 0)]), np.inf)
        # nodes of one batch can't find each other through the graph: they are candidates by their distances
        mates = np.broadcast_to(at, (len(at), len(at)))
        mate_d = np.maximum(self.norm[at][:, None] + self.norm[at] - 2 * self.x[at] @ self.x[at].T, 0)
        near = np.argsort(mate_d, axis=1)[:, : min(len(at), 16)]
        nodes = np.concatenate([nodes, old, np.take_along_axis(mates, near, 1)], 1)
        dist = np.concatenate([dist, old_d, np.take_along_axis(mate_d, near, 1)], 1).astype(np.float32)
        self.edges[at] = self.prune(at, nodes, dist, alpha)
        source = np.repeat(at, self.degree)
        target = self.edges[at].ravel()
        source, target = source[target >= 0], target[target >= 0]
        order = np.argsort(target, kind="stable")
        source, target = source[order], target[order]
        cuts = np.flatnonzero(np.diff(target, prepend=-1))
        full: list[tuple[int, np.ndarray]] = []
        for a, b in zip(cuts, [*cuts[1:], len(target)]):
            node, new = int(target[a]), source[a:b]
            row = self.edges[node]
            new = new[~np.isin(new, row)]
            used = int((row >= 0).sum())
            if used + len(new) <= self.degree:
                row[used : used + len(new)] = new
            else:
                full.append((node, np.concatenate([row[:used], new])))
        for k in range(0, len(full), BATCH):
            part = full[k : k + BATCH]
            width = max(len(c) for _, c in part)
            at_ = np.array([n for n, _ in part])
            cand = np.full((len(part), width), -1, np.int64)
            for i, (_, c) in enumerate(part):
                cand[i, : len(c)] = c
            safe = np.maximum(cand, 0)
            d = np.where(cand >= 0, squared(self.x[at_], self.x[safe], self.norm[at_], self.norm[safe]), np.inf).astype(np.float32)
            self.edges[at_] = self.prune(at_, cand, d, alpha)

    def build(self, alpha: float = ALPHA, beam: int = BEAM) -> Graph:
        order = np.random.default_rng(7).permutation(len(self.x))
        order = order[order != self.start]
        done, size = 0, 8
        while done < len(order):  # small batches first, while the graph is small
            self.connect(order[done : done + size], alpha, beam)
            done, size = done + size, min(BATCH, 2 * size)
        return self


def usable(rows: DataFrame) -> DataFrame:
    """(vec_id, v, dim) of the vectors that take part."""
    v = F.col("embedding").cast("array<float>")
    fine = v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return rows.filter(F.col("vec_id").isNotNull()).filter(fine).select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"), F.size(v).alias("dim"))


def build_index(vectors: DataFrame, least_rows: int = 4_096, most_rows: int = 131_072, copies: int = 11, degree: int = DEGREE, beam: int = BEAM) -> DataFrame:
    """(dim, shard, x, edges, ids): one row per shard; written."""
    # equal vectors: the smallest ids of each salted part, then of all parts, so that no task holds a hot vector's rows; a repeated row is one id
    salted = vectors.withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.lit(64)))
    ranked = salted.withColumn("r", F.dense_rank().over(Window.partitionBy("v", "salt").orderBy("vec_id"))).filter(F.col("r") <= copies)
    nodes = written(ranked.groupBy("dim", "v").agg(F.slice(F.sort_array(F.collect_set("vec_id")), 1, copies).alias("ids")), "neighbours-nodes")
    partitions = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counts = nodes.groupBy("dim").agg(F.count("*").alias("n"))
    counts = counts.withColumn("shards", F.greatest(F.ceil(F.col("n") / most_rows), F.least(F.ceil(F.col("n") / least_rows), F.lit(partitions))))
    before = Window.orderBy("dim").rowsBetween(Window.unboundedPreceding, -1)  # one row per dimension
    counts = written(counts.withColumn("first", F.coalesce(F.sum("shards").over(before), F.lit(0))), "neighbours-shards")
    total = counts.agg(F.sum("shards")).first()[0] or 1
    placed = nodes.join(sized(counts), "dim").withColumn("shard", F.pmod(F.xxhash64("v"), F.col("shards")).cast("int"))
    alone = placed.select((F.col("first") + F.col("shard")).cast("int").alias("at"), "dim", "shard", "v", "ids").repartitionById(int(total), "at")  # a partition is a shard

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        table = pa.Table.from_batches(got)
        x = np.asarray(table["v"].combine_chunks().flatten(), np.float32).reshape(table.num_rows, -1)
        graph = Graph(x, degree=min(degree, max(1, len(x) - 1))).build(beam=beam)
        yield pa.RecordBatch.from_arrays([pa.array([table["dim"][0].as_py()], pa.int32()), pa.array([table["shard"][0].as_py()], pa.int32()), pa.array([x.tobytes()], pa.binary()), pa.array([graph.edges.tobytes()], pa.binary()), pa.array([table["ids"].to_pylist()], pa.list_(pa.list_(pa.int64())))], names=["dim", "shard", "x", "edges", "ids"])
        del graph, x, table, got
        trim()

    return written(alone.mapInArrow(build, "dim int, shard int, x binary, edges binary, ids array<array<bigint>>"), "neighbours-index")


def _first_ids(found: list[tuple[float, int]], own: int, k: int) -> list[tuple[float, int]]:
    """The k smallest (distance, id), each id once and the query's own left out."""
    out: dict[int, float] = {}
    for s, v in sorted(found):
        if v != own and v not in out:
            out[v] = s
            if len(out) == k:
                break
    return [(s, v) for v, s in out.items()]


def search_index(index: DataFrame, queries: DataFrame, k: int = 10, beam: int = 128, block: int = 256) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest of each query found in all shards, the query's own id left out.

    Chunks of 64 blocks of queries are dealt to every shard; a task holds one shard and one chunk."""
    chunks = max(1, -(-queries.count() // (64 * block)))
    dealt = queries.withColumn("chunk", F.pmod(F.xxhash64("vec_id"), F.lit(chunks)).cast("int")).join(F.broadcast(index.groupBy("dim").agg(F.max("shard").alias("last"))), "dim")
    dealt = dealt.select("dim", F.explode(F.sequence(F.lit(0), "last")).alias("shard"), "chunk", "vec_id", "v")
    shards = index.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))

    def answer(key: tuple, shard: pa.Table, asked: pa.Table) -> pa.Table:
        dim, out = key[0].as_py(), []
        if shard.num_rows:
            x = np.frombuffer(shard["x"][0].as_py(), np.float32).reshape(-1, dim)
            graph = Graph(x, np.frombuffer(shard["edges"][0].as_py(), np.int32).reshape(len(x), -1))
            ids = shard["ids"][0].as_py()
            for at in range(0, asked.num_rows, block):
                part = asked.slice(at, block)
                q = np.asarray(part["v"].combine_chunks().flatten(), np.float32).reshape(-1, dim)
                nodes, _ = graph.search(q, min(beam, max(2, len(x))))
                for own, vector, found in zip(part["vec_id"].to_pylist(), q.astype(np.float64), nodes):
                    found = found[found >= 0]
                    d = np.sqrt(((x[found].astype(np.float64) - vector) ** 2).sum(1)).tolist()
                    out += [(own, v, s) for s, v in _first_ids([(s, v) for s, n in zip(d, found.tolist()) for v in ids[n]], own, k)]
        columns = zip(*out) if out else ((), (), ())
        return pa.table([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.float64()))], names=["query_id", "vec_id", "score"])

    found = shards.groupBy("dim", "shard", "chunk").cogroup(dealt.groupBy("dim", "shard", "chunk")).applyInArrow(answer, "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score")).withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def nearest(rows: DataFrame, is_query, k: int = 10) -> DataFrame:
    """The k nearest of the rows for which the column is_query holds, among all other rows."""
    vectors = usable(rows)
    return search_index(build_index(vectors, copies=k + 1), vectors.filter(is_query).dropDuplicates(["vec_id", "v"]), k)
