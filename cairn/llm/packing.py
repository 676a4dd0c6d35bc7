"""Best-fit packing of tokenized documents into sequences of a fixed length, by exact-complement hashing.

Documents are tokenized once; longer ones are cut into pieces whose first may be shorter.  All that the plan needs from
the corpus is how many pieces there are of each length: at most ``capacity`` counts, whatever the input.  From these the
driver makes groups of equal sequences.  For each length, longest first, the gap to a full sequence is looked up in an index
of the single lengths, the sums of two and the sums of three that are still available, and the combination is consumed as
often as all its counts allow.  What finds no exact complement is packed best-fit, again in groups.  Combinations of small
pieces can strand large ones, so the plan is made with all of them, with those only that begin as best fit would, and by best
fit alone, and the one of fewest sequences is taken.  Pieces then find their place by their rank among the pieces of their length: counts by task and length, summed up over tasks, plus the
rank within the task.

Null texts are empty (one end id); very long texts are cut, never shortened; repeated rows are packed once each; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cairn.llm.shared import texts, trim, written
from cairn.llm.tokens import encoder, ragged

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, task int, nth long"


def ranks_within(values: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """The rank of each value among those equal to it, counted on from seen, which is brought up to date."""
    by = np.argsort(values, kind="stable")
    new = np.diff(values[by], prepend=-1) != 0
    first = np.flatnonzero(new)
    out = np.empty(len(values), np.int64)
    out[by] = np.arange(len(values)) - first[np.cumsum(new) - 1] + seen[values[by]]
    seen += np.bincount(values, minlength=len(seen))
    return out


def _tokenize(batches: Iterator[pa.RecordBatch], path: str, capacity: int, end_id: int) -> Iterator[pa.RecordBatch]:
    task, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
    for batch in batches:
        at = 0
        for ids, n in encoder(path).encode(batch.column(1)):
            ids = np.insert(ids, np.cumsum(n), end_id).astype("<u4")
            n = n + 1
            # pieces: full ones, but for the first
            pieces = -(-n // capacity)
            piece = ragged(np.zeros(len(n), np.int64), pieces)
            short = np.repeat(n - (pieces - 1) * capacity, pieces)
            length = np.where(piece == 0, short, capacity)
            start = np.where(piece == 0, 0, short + (piece - 1) * capacity)
            data, ends = memoryview(ids).cast("B"), (4 * np.cumsum(length)).tolist()
            crc = [zlib.crc32(data[a:b]) for a, b in zip([0, *ends[:-1]], ends)]
            docs = batch.column(0).take(pa.array(at + np.repeat(np.arange(len(n)), pieces)))
            at += len(n)
            columns = [docs, pa.array(piece, pa.int32()), pa.array(start), pa.array(length), pa.array(crc, pa.int64()), pa.array(np.full(len(piece), task, np.int32)), pa.array(ranks_within(length, seen))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "piece", "start", "length", "ids_crc32", "task", "nth"])
    trim()


def pieces(docs: DataFrame, path: str, capacity: int = 1024, end_id: int = 2) -> DataFrame:
    """One row per piece, with its task and its rank among the task's pieces of its length; written."""
    return written(texts(docs).mapInArrow(lambda b: _tokenize(b, path, capacity, end_id), PIECES), "packing-pieces")


class SumIndex:
    """The sums of one, two and three available lengths, each with its parts; counts only fall, so an entry whose parts
    are used up moves on to parts with a smaller first one, and never back."""

    def __init__(self, counts: dict[int, int], capacity: int):
        self.n = [0] * (capacity + 1)
        for length, n in counts.items():
            self.n[length] += n
        self.pair = list(range(-1, capacity))  # the larger part of a sum of two; from here on down
        self.triple = list(range(-2, capacity - 1))  # the largest part of a sum of three
        for total in range(capacity + 1):
            self.two(total)
            self.three(total)

    def two(self, total: int) -> tuple[int, int] | None:
        a, n = self.pair[total], self.n
        while 2 * a >= total and not (n[a] > (2 * a == total) and n[total - a]):
            a -= 1
        self.pair[total] = a
        return (a, total - a) if a > 0 and 2 * a >= total else None

    def three(self, total: int) -> tuple[int, int, int] | None:
        a = self.triple[total]
        while 3 * a >= total and a > 0:
            if self.n[a] and (rest := self.two(total - a)) and rest[0] <= a and all(self.n[x] >= k for x, k in Counter((a, *rest)).items()):
                self.triple[total] = a
                return (a, *rest)
            a -= 1
        self.triple[total] = a
        return None

    def complements(self, total: int) -> Iterator[tuple[int, ...]]:
        """One, two and three lengths that sum to total, as far as there are, the largest first."""
        if total > 0 and self.n[total]:
            yield (total,)
        for found in (self.two(total), self.three(total)):
            if found:
                yield found


def complements_first(counts: dict[int, int], capacity: int, largest_only: bool) -> list[tuple[tuple[int, ...], int]]:
    """Exact complements in bulk, the longest lengths first, then best fit.  With largest_only, each part but the last must be
    the largest that fits, as best fit would choose it: small ones that are spent early leave large gaps."""
    index, out = SumIndex(counts, capacity), []
    n = index.n

    def fits(found: tuple[int, ...], gap: int) -> bool:
        for x in found[:-1] if largest_only else ():
            if any(n[x + 1 : gap + 1]):
                return False
            gap -= x
        return True

    if n[capacity]:
        out.append(((capacity,), n[capacity]))
        n[capacity] = 0
    for parts in (1, 2, 3):
        for length in range(capacity - 1, 0, -1):
            gap = capacity - length
            while n[length]:
                found = next((f for f in index.complements(gap) if len(f) == parts and n[length] > f.count(length) and fits(f, gap)), None)
                if not found:
                    break
                own = Counter((length, *found))
                times = min(n[x] // k for x, k in own.items())
                for x, k in own.items():
                    n[x] -= k * times
                out.append(((length, *found), times))
    return out + best_fit({x: k for x, k in enumerate(n) if k}, capacity)


def plan(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Groups (lengths of one sequence, number of such sequences) that use every piece once: the fewest sequences of three plans."""
    plans = [complements_first(counts, capacity, True), complements_first(counts, capacity, False), best_fit({x: k for x, k in counts.items() if k}, capacity)]
    return min(plans, key=lambda groups: sum(n for _, n in groups))


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing over counts: each length fills the smallest gaps that hold it, group by group."""
    gaps: dict[int, list[list]] = defaultdict(list)
    for length in sorted(counts, reverse=True):
        todo = counts[length]
        while todo:
            gap = min((g for g in gaps if g >= length and gaps[g]), default=None)
            if gap is None:  # new sequences, each with as many as it holds
                each = capacity // length
                if todo // each:
                    gaps[capacity - each * length].append([(length,) * each, todo // each])
                if todo % each:
                    gaps[capacity - todo % each * length].append([(length,) * (todo % each), 1])
                break
            lengths, n = gaps[gap].pop()
            each = max(1, min(gap // length, todo // n))
            times = min(n, todo // each)
            if times < n:
                gaps[gap].append([lengths, n - times])
            gaps[gap - each * length].append([(*lengths, *(length,) * each), times])
            todo -= each * times
    return [(lengths, n) for group in gaps.values() for lengths, n in group]


def places(groups: list[tuple[tuple[int, ...], int]]) -> dict[str, np.ndarray]:
    """Where the pieces of each length go: from rank r0 on, to sequence s0 on, at an offset; sorted by length and r0."""
    rows, ranks, sequence = [], Counter(), 0
    for lengths, n in groups:
        offset = 0
        for x in lengths:
            rows.append((x, ranks[x], sequence, offset))
            ranks[x] += n
            offset += x
        sequence += n
    rows.sort()
    return dict(zip(("length", "r0", "s0", "offset"), np.array(rows, np.int64).reshape(-1, 4).T))


def pack(docs: DataFrame, path: str, capacity: int = 1024, end_id: int = 2) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece."""
    cuts = pieces(docs, path, capacity, end_id)
    by_task = cuts.groupBy("task", "length").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1))
    ranks = written(by_task.withColumn("before", F.coalesce(before, F.lit(0))), "packing-ranks")
    counts = {r["length"]: r["n"] for r in ranks.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # capacity rows at most
    table = places(plan(counts, capacity))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = table["length"] * (1 << 44) + table["r0"]
        for batch in batches:
            length, rank = (batch.column(i).to_numpy() for i in (3, 5))
            at = np.searchsorted(keys, length * (1 << 44) + rank, "right") - 1
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(table["s0"][at] + rank - table["r0"][at]), pa.array(table["offset"][at])], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    # one row of ranks per task and length: it grows with the tasks, so both sides are dealt out
    ranked = cuts.join(ranks.select("task", "length", "before").hint("merge"), ["task", "length"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("nth")).alias("rank"))
    return ranked.mapInArrow(assign, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
