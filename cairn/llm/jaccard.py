"""n-gram Jaccard join by T-occurrence search (DivideSkip), and the groups that its links make.

A document's set holds the 64-bit hashes of its distinct k-word shingles.  Two documents link when
``den * |intersection| >= num * |union|``.

1. One pass makes each set's size and 128-bit digest; documents with equal sets are one node.  The same pass counts
   shingles into a fixed number of cells, which gives a global order: rare cells first.
2. Linked sets share at least ``l`` of the first ``n - ceil(num/den n) + l`` shingles of this order, for every l; here l
   grows with n.  Postings (shingle, node, size) of these prefixes are rows; shingles of one node go, and a node with fewer
   postings left than l allows can't link and goes too, which removes what shares by chance.  The nodes left in a shingle's
   list whose sizes can link are put in a block named after its smallest node, the pivot.  So every link joins two nodes of
   some block, and near copies, which share most lists, share a pivot.  Lists are counted with partial sums and joined
   back, so a frequent shingle's rows never meet in one task.
3. A block is searched by T-occurrence: two sets of a and b shingles link when they share T = ceil(num (a + b) / (num + den)),
   so a query's partners are the nodes in at least T of the inverted lists of its shingles.  DivideSkip merges the short
   lists with a heap and counts, and probes the ``L`` longest ones, by binary search, only for candidates that reached the
   threshold less L.  The pivot is the first query.  What it doesn't link with is searched against the whole block: there
   each set is its difference from the pivot's set - what it lacks of it and what it adds - and an overlap of T shingles is
   an overlap of ``T - |p| + |lacks x| + |lacks y|`` differences, so that groups of near copies cost their differences, not
   all pairs.
4. A block of more than ``part_bytes`` is cut into chunks: the pivot queries each chunk, and only the nodes that it doesn't
   link with are searched against all chunks, in chunks of such queries; no task holds more than two chunks of ``block_bytes``.
5. Links are joined to components in rounds over written edges.

Null and empty texts have an empty set and link with nothing; texts of fewer than k words have one shingle, the whole
sequence; very long texts are whole; rows with equal doc_id are one node, which links as any of its texts does, and all of
them stay; a null doc_id links with nothing; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import heapq
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm.shared import components, discard, rows_of, sized, texts, trim, written

CELLS_BITS, CELL_CHUNKS, TOKEN_BITS = 22, 64, 40
HEAP, SLAB = 1 << 13, 64  # entries of lists that the interpreted heap merges, or that are probed together; lists probed together
_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], np.uint64)


def shingles(text: bytes, k: int) -> np.ndarray:
    """Sorted distinct hashes of the k-word shingles of a UTF-8 text."""
    words = text.lower().split()  # A-Z only; at [\x20\x09-\x0D]
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    width = min(k, len(words))
    with np.errstate(over="ignore"):
        x = h[: len(h) - width + 1] * _FACTORS[0] + np.uint64(width)
        for i in range(1, width):
            x = (x ^ (x >> np.uint64(29))) * _FACTORS[i % 8] + h[i : len(h) - width + 1 + i]
        x = (x ^ (x >> np.uint64(32))) * _FACTORS[1]
    return np.unique(x ^ (x >> np.uint64(29)))


def _packed(cells: np.ndarray) -> bytes:
    """Counts of one task, most of them small: bytes where these suffice, compressed."""
    return zlib.compress((cells.astype(np.uint8) if cells.max() < 256 else cells).tobytes(), 1)


def _unpacked(packed: bytes) -> np.ndarray:
    raw = zlib.decompress(packed)
    return np.frombuffer(raw, np.uint8 if len(raw) == (1 << CELLS_BITS) // CELL_CHUNKS else np.uint32)


def _profile(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """(doc_id, n, d1, d2) of each text, and at the end of a task the rows (chunk, cells) of its counts."""
    cells = np.zeros(1 << CELLS_BITS, np.uint32)
    shift = np.uint64(64 - CELLS_BITS)
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("d1", pa.int64()), ("d2", pa.int64()), ("chunk", pa.int32()), ("cells", pa.binary())])
    some = False
    for batch in batches:
        for part in rows_of(batch):
            n, d1, d2 = [], [], []
            for text in part.column(1).cast(pa.binary()).to_pylist():
                s = shingles(text, k)
                n.append(len(s))
                if len(s):
                    cells[(s >> shift).astype(np.int64)] += 1
                    both = np.frombuffer(xxhash.xxh3_128_digest(s.tobytes()), "<i8")
                    d1.append(int(both[0]))
                    d2.append(int(both[1]))
                    some = True
                else:
                    d1.append(None)
                    d2.append(None)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(d1, pa.int64()), pa.array(d2, pa.int64()), pa.nulls(len(n), pa.int32()), pa.nulls(len(n), pa.binary())], schema=schema)
    if some:
        for i, x in enumerate(np.split(cells, CELL_CHUNKS)):
            yield pa.RecordBatch.from_arrays([*[pa.nulls(1, pa.int64())] * 4, pa.array([i], pa.int32()), pa.array([_packed(x)])], schema=schema)


def _sum_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each chunk: eighths of the binary logarithm of its counts, one byte a cell."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for chunk, cells in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            sums[chunk] = sums.get(chunk, 0) + _unpacked(cells).astype(np.uint64)
    for chunk, x in sums.items():
        yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int32()), pa.array([np.minimum(255, np.log2(x + np.float64(1)) * 8).astype(np.uint8).tobytes()])], names=["chunk", "cells"])


def shared_least(n):
    """How many shingles of their prefixes two linked sets share at least, both having n shingles or more."""
    return 1 + n // 16


def prefix_size(n: int, num: int, den: int) -> int:
    return n - -(-num * n // den) + shared_least(n)


def _postings(batches: Iterator[pa.RecordBatch], order, k: int, num: int, den: int) -> Iterator[pa.RecordBatch]:
    """(token, node, size) of the prefixes.  A token is the first bits of a shingle's hash: shingles that share one by chance
    only add nodes to compare."""
    cells = order.value
    shift, cut = np.uint64(64 - CELLS_BITS), np.uint64(64 - TOKEN_BITS)
    for batch in batches:
        for part in rows_of(batch, 256):
            tokens, nodes, sizes = [], [], []
            for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).cast(pa.binary()).to_pylist()):
                s = shingles(text, k)
                if doc_id is None or not len(s):
                    continue
                p = prefix_size(len(s), num, den)
                rank = cells[(s >> shift).astype(np.int64)]
                tokens.append(s[np.lexsort((s, rank))[:p]])
                nodes.append(doc_id)
                sizes.append(len(s))
            if tokens:
                n = [len(x) for x in tokens]
                columns = [(np.concatenate(tokens) >> cut).astype(np.int64), np.repeat(np.array(nodes, np.int64), n), np.repeat(np.array(sizes, np.int32), n)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["token", "node", "size"])
    trim()


def divide_skip(lists: list[np.ndarray], least: int, mu: float = 0.0085) -> tuple[np.ndarray, np.ndarray]:
    """(members, counts) of what is in at least ``least`` of the sorted lists.

    The long lists are only probed: L of them, by the usual estimate, and never so many that no count is asked of the short."""
    lists = sorted((x for x in lists if len(x)), key=len)
    if len(lists) < least:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    long = min(least - 1, int(least / (mu * math.log2(len(lists[-1]) + 1) + 1)))
    short, probed = lists[: len(lists) - long], lists[len(lists) - long :]
    n = sum(map(len, short))
    if n <= HEAP:
        merged = np.fromiter(heapq.merge(*(x.tolist() for x in short)), np.int64, n)
    else:  # the same merge of sorted runs, compiled
        merged = np.sort(np.concatenate(short), kind="stable")
    first = np.flatnonzero(np.diff(merged, prepend=-1))
    counts = np.diff(np.append(first, n))
    ok = counts >= least - long
    members, counts = merged[first[ok]], counts[ok]
    done = 0
    while done < len(probed) and len(members):
        slab = probed[done : done + SLAB]
        if sum(map(len, slab)) <= HEAP:  # one binary search in all of them
            base = np.arange(len(slab)) * (int(max(x[-1] for x in probed)) + 1)
            keys = np.concatenate([x + b for x, b in zip(slab, base.tolist())])
            wanted = (base[:, None] + members).ravel()
            at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
            counts = counts + (keys[at] == wanted).reshape(len(slab), -1).sum(0)
        else:
            slab = slab[:1]
            at = np.minimum(np.searchsorted(slab[0], members), len(slab[0]) - 1)
            counts = counts + (slab[0][at] == members)
        done += len(slab)
        ok = counts >= least - (len(probed) - done)
        members, counts = members[ok], counts[ok]
    return members, counts


class Block:
    """The inverted lists of a pivot's shingles and of the differences from it, over the sets of a block."""

    def __init__(self, pivot: np.ndarray, sets: list[np.ndarray], num: int, den: int):
        self.pivot, self.num, self.den = pivot, num, den
        self.n = np.array([len(s) for s in sets], np.int64)
        every, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), self.n)
        at, hit = self._in_pivot(every)
        self.has = np.zeros((len(pivot), len(sets)), bool)
        self.has[at[hit], owner[hit]] = True
        self.lack = len(pivot) - self.has.sum(0)
        element, lacker = np.nonzero(~self.has)
        elements, owners = np.concatenate([pivot[element], every[~hit]]), np.concatenate([lacker, owner[~hit]])
        by = np.lexsort((owners, elements))  # what is lacked and what is added have no shingle in common
        self.elements, self.owners = elements[by], owners[by]

    def _in_pivot(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(self.pivot, x), len(self.pivot) - 1)
        return at, self.pivot[at] == x

    def of_pivot(self) -> np.ndarray:
        """Members that link with the pivot."""
        needed = self._needed(len(self.pivot))
        members, counts = divide_skip([np.flatnonzero(x) for x in self.has], max(1, int(needed.min())))
        return members[counts >= needed[members]]

    def _needed(self, size: int) -> np.ndarray:
        return -(-self.num * (self.n + size) // (self.num + self.den))

    def of(self, query: np.ndarray) -> np.ndarray:
        """Members that link with a set that the pivot doesn't link with; the set itself, if it is one, among them."""
        at, hit = self._in_pivot(query)
        lacks = np.ones(len(self.pivot), bool)
        lacks[at[hit]] = False
        own = np.concatenate([self.pivot[lacks], query[~hit]])
        needed = self._needed(len(query)) - len(self.pivot) + self.lack + int(lacks.sum())
        size_ok = (self.den * self.n >= self.num * len(query)) & (self.den * len(query) >= self.num * self.n)
        if not size_ok.any():
            return np.zeros(0, np.int64)
        least = max(1, int(needed[size_ok].min()))
        lo, hi = np.searchsorted(self.elements, own, "left"), np.searchsorted(self.elements, own, "right")
        members, counts = divide_skip([self.owners[a:b] for a, b in zip(lo.tolist(), hi.tolist())], least)
        return members[(counts >= needed[members]) & size_ok[members]]


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, np.ndarray, list, list]]:
    """((pivot, i, j), its set, (node, set) of the queries, those of the members) of rows in order, the pivot's row first.

    Further sets of the pivot's node are members."""
    key, rows = None, []

    def block():
        return key, rows[0][2], [r[1:] for r in rows if r[0] == 0], [r[1:] for r in rows[1:] if r[0] != 0]

    for batch in batches:
        for part in rows_of(batch, 256):
            for pivot, i, j, side, node, packed in zip(*(c.to_pylist() for c in part.columns)):
                if (pivot, i, j) != key:
                    if rows:
                        yield block()
                    key, rows = (pivot, i, j), []
                rows.append((side, node, np.frombuffer(packed, np.uint64)))
    if rows:
        yield block()


def _search(batches: Iterator[pa.RecordBatch], num: int, den: int, single: bool) -> Iterator[pa.RecordBatch]:
    """(a, b, pivot): links of the pivot of each block with its members, and, with single, of the others with all members; else
    those are given back with a null b.  Blocks with queries of their own have those searched instead of the pivot."""
    a, b, of = [], [], []

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (a, b, of)], names=["a", "b", "pivot"])

    for (pivot, _, _), head, queries, members in _blocks(batches):
        if not members:  # no node of the block fell into this chunk
            continue
        block, nodes = Block(head, [s for _, s in members], num, den), [n for n, _ in members]
        if not queries:
            linked = block.of_pivot().tolist()
            a += [pivot] * len(linked)
            b += [nodes[i] for i in linked]
            rest = sorted(set(range(len(nodes))).difference(linked))
            queries = [members[i] for i in rest] if single else []
            if not single:
                a += [nodes[i] for i in rest]
                b += [None] * len(rest)
        for node, query in queries:
            found = [nodes[i] for i in block.of(query).tolist() if nodes[i] != node]
            a += [node] * len(found)
            b += found
            if len(a) > 50_000:
                of += [pivot] * (len(a) - len(of))
                yield out()
                a, b, of = [], [], []
        of += [pivot] * (len(a) - len(of))
    if a:
        yield out()
    trim()


def _sets(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in rows_of(batch):
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([shingles(x, k).tobytes() for x in part.column(1).cast(pa.binary()).to_pylist()], pa.binary())], names=["node", "set"])


def jaccard_groups(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100, part_bytes: int = 256 << 10, block_bytes: int = 16 << 20) -> DataFrame:
    """doc_id, n_shingles, component_id of every row."""
    spark = docs.sparkSession
    rows = texts(docs)
    profile = written(rows.mapInArrow(lambda b: _profile(b, k), "doc_id long, n long, d1 long, d2 long, chunk int, cells binary"), "jaccard-profile")
    cells = profile.filter("chunk is not null").select("chunk", "cells").repartition(CELL_CHUNKS, "chunk").mapInArrow(_sum_cells, "chunk int, cells binary").collect()  # 4 MB in all
    counted = np.zeros(1 << CELLS_BITS, np.uint8)
    for r in cells:
        counted[r["chunk"] * (len(counted) // CELL_CHUNKS) :][: len(r["cells"])] = np.frombuffer(r["cells"], np.uint8)
    order = spark.sparkContext.broadcast(counted)
    profile = profile.filter("chunk is null").select("doc_id", "n", "d1", "d2")
    classes = written(profile.filter("n > 0").groupBy("d1", "d2").agg(F.min("doc_id").alias("node"), F.max("doc_id").alias("last")), "jaccard-classes")
    copies = written(profile.filter("n > 0").join(classes.filter("last > node"), ["d1", "d2"]).filter("doc_id > node").select("doc_id").distinct().join(classes.select(F.col("node").alias("doc_id")).distinct(), "doc_id", "left_anti"), "jaccard-copies")
    nodes = rows.join(sized(copies), "doc_id", "left_anti")  # the texts of one document of each class

    postings = written(nodes.mapInArrow(lambda b: _postings(b, order, k, num, den), "token long, node long, size int"), "jaccard-postings", "zstd")
    lists = postings.groupBy("token").agg(F.count("*").alias("in_list")).filter("in_list > 1").select("token")
    shared = written(postings.join(lists, "token"), "jaccard-shared")
    discard(postings)
    # a partner can be smaller, down to num/den of the size, and so share fewer
    least = 1 + F.floor(F.ceil(F.lit(num) * F.max("size") / F.lit(den)) / 16)
    linkable = written(shared.groupBy("node").agg(F.count("*").alias("n"), least.alias("least")).filter("n >= least").select("node"), "jaccard-linkable")
    # sizes that can link lie in the same or in neighbouring bands; each node stands in its band and the next
    band = F.floor(F.log("size") / F.lit(math.log(den / num) + 1e-9))
    banded = shared.join(sized(linkable), "node", "left_semi").select("token", "node", "size", F.explode(F.array(band, band + 1)).alias("band"))
    pivots = banded.groupBy("token", "band").agg(F.min("node").alias("pivot"), F.max("node").alias("last")).filter("last > pivot").select("token", "band", "pivot")
    pairs = written(banded.join(pivots, ["token", "band"]).filter("node <> pivot").select("pivot", "node", "size").distinct(), "jaccard-blocks")
    discard(shared)

    # the pivot belongs to its block; a block of more than part_bytes is cut into chunks
    n_bytes = F.sum(8 * F.col("size").cast("long"))
    count = lambda bytes_: F.ceil(n_bytes / bytes_).cast("int")
    sizes = written(pairs.groupBy("pivot").agg(count(part_bytes).alias("chunks"), F.least(count(part_bytes), F.greatest(F.lit(8), count(block_bytes))).alias("wide")), "jaccard-sizes")
    large = sizes.filter("chunks > 1")
    member = lambda placed, side: placed.select("pivot", "i", "j", F.lit(side).alias("side"), "node")
    chunk = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    placed = pairs.join(sized(large), "pivot", "left").withColumn("j", F.when(F.col("chunks") > 1, chunk("chunks")).otherwise(-1)).withColumn("i", F.lit(-1))
    heads = sizes.withColumn("j", F.explode(F.when(F.col("chunks") > 1, F.sequence(F.lit(0), F.col("chunks") - 1)).otherwise(F.array(F.lit(-1))))).withColumn("i", F.lit(-1)).withColumn("node", F.col("pivot"))
    first = written(member(placed, 1).unionByName(member(heads, -1)), "jaccard-members")
    wanted = written(first.select(F.col("node").alias("doc_id")).distinct(), "jaccard-wanted")
    sets = written(nodes.join(sized(wanted), "doc_id", "left_semi").mapInArrow(lambda b: _sets(b, k), "node long, set binary"), "jaccard-sets")

    def searched(members: DataFrame, single: bool) -> DataFrame:
        # few members go to the sets, so that these shuffle once, by block
        block = sets.join(sized(members, 500_000), "node").select("pivot", "i", "j", "side", "node", "set").repartition("pivot", "i", "j").sortWithinPartitions("pivot", "i", "j", "side", "node")
        return block.mapInArrow(lambda b: _search(b, num, den, single), "a long, b long, pivot long")

    edges = [written(searched(first.filter("j < 0"), True), "jaccard-edges")]
    if not large.isEmpty():
        edges.append(written(searched(first.filter("j >= 0"), False), "jaccard-edges"))
        # what the pivot of a large block doesn't link with is searched against all of the block, chunk by chunk on both sides: up to 8
        # chunks of each for parallel work, more only where they would exceed block_bytes
        nodes_of = pairs.join(sized(large), "pivot").unionByName(large.select("pivot", F.col("pivot").alias("node"), F.lit(0).alias("size"), "chunks", "wide"))
        rest = nodes_of.join(edges[1].filter("b is null").select("pivot", F.col("a").alias("node")).distinct(), ["pivot", "node"])
        rest = written(rest.select("pivot", "node", "size", "wide"), "jaccard-rest")
        some = written(rest.groupBy("pivot").agg(F.max("wide").alias("wide"), F.greatest(F.lit(1), F.least(count(part_bytes), F.greatest(F.lit(8), count(block_bytes)))).alias("asked")), "jaccard-asked")
        both = lambda df: df.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("wide") - 1)))
        asking = both(rest.join(sized(some.select("pivot", "asked")), "pivot").withColumn("i", chunk("asked")))
        asked = pairs.join(sized(some), "pivot").withColumn("j", chunk("wide")).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("asked") - 1)))
        heads = both(some.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("asked") - 1)))).withColumn("node", F.col("pivot"))
        second = written(member(asking, 0).unionByName(member(asked, 1)).unionByName(member(heads, -1)), "jaccard-members")
        edges.append(written(searched(second, False), "jaccard-edges"))
        discard(rest, some, second)
    links = edges[0]
    for more in edges[1:]:
        links = links.unionByName(more)
    group = components(links.filter("b is not null").select("a", "b"), "jaccard-links")
    discard(copies, linkable, pairs, sizes, first, wanted, sets, *edges)

    named = classes.join(group, "node", "left").select("d1", "d2", F.coalesce("component", "node").alias("component_id"))
    grouped = profile.filter("n > 0").join(named, ["d1", "d2"])
    none = profile.filter("n = 0").withColumn("component_id", F.col("doc_id"))  # no keys to join them by
    out = lambda df: df.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))
    return out(grouped).unionByName(out(none))
