"""Ordered scans of keyed tables: ranges, direction, limits, continuation, pages."""

from __future__ import annotations

from bisect import bisect_left
from dataclasses import dataclass, replace
from functools import reduce
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from cairn.operators.limits import ScanLimiter, StopReason, in_time
from cairn.operators.prefix import running
from cairn.operators.ranges import TupleRange
from cairn.plans.errors import CairnError
from cairn.plans.token import Continuation


@dataclass(frozen=True)
class Page:
    """Rows in order, why there are no more, and the token that resumes behind them."""

    rows: list[Row]
    reason: StopReason
    continuation: Continuation


@dataclass(frozen=True)
class Scan:
    """A scan is built up by its methods; ``df()`` is lazy, ``page()`` reads one page.

    ``size`` is what a row counts against a byte limit; without one, the bytes of its key and value columns as text."""

    source: DataFrame
    key: tuple[str, ...]
    span: TupleRange | None = None
    backward: bool = False
    most: int | None = None
    limiter: ScanLimiter | None = None
    token: Continuation | None = None
    where: tuple[Column, ...] = ()
    shape: tuple[Column, ...] = ()
    size: Column | None = None

    @staticmethod
    def over(source: DataFrame, *key: str) -> Scan:
        if not key:
            raise CairnError("cursor_incomplete_builder", "a scan needs key columns")
        return Scan(source, key)

    def range(self, span: TupleRange) -> Scan:
        return replace(self, span=span)

    def reverse(self, on: bool = True) -> Scan:
        return replace(self, backward=on)

    def limit(self, n: int | None) -> Scan:
        """At most n rows; 0 and less: no limit."""
        return replace(self, most=n if n and n > 0 else None)

    def limited_by(self, limiter: ScanLimiter) -> Scan:
        return replace(self, limiter=limiter)

    def continue_from(self, token: Continuation | bytes | None) -> Scan:
        return replace(self, token=Continuation.from_bytes(token) if isinstance(token, (bytes, bytearray)) else token)

    def filter(self, predicate: Column) -> Scan:
        """Rows for which the predicate holds; limits count the rows read, tokens stay those of the source."""
        return replace(self, where=(*self.where, predicate))

    def map(self, *columns: Column) -> Scan:
        return replace(self, shape=columns)

    def sized(self, size: Column) -> Scan:
        return replace(self, size=size)

    def _order(self) -> list[Column]:
        return [F.col(c).desc_nulls_last() if self.backward else F.col(c).asc_nulls_first() for c in self.key]

    def _bytes(self) -> Column:
        return self.size if self.size is not None else reduce(Column.__add__, (F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(0)) for c in self.source.columns))

    def read(self) -> DataFrame:
        """The rows of the range behind the token, unordered and unlimited."""
        if self.span is None:
            raise CairnError("cursor_incomplete_builder", "a scan needs a range")
        return self.source.filter(self.span.resumed(self.key, self.token, self.backward))

    def _shaped(self, df: DataFrame) -> DataFrame:
        for p in self.where:
            df = df.filter(p)
        return df.select(*self.shape) if self.shape else df

    def df(self) -> DataFrame:
        """What the scan returns until a limit stops it, in order.

        A row limit is a top-k; the byte limit keeps rows before which fewer bytes were read, so it goes over by one row."""
        rows = self.read()
        limiter = self.limiter
        if limiter and (limiter.time_is_up() or limiter.left_key_values() == 0 or limiter.left_bytes() == 0):
            return self._shaped(rows.filter(F.lit(False)))
        caps = [n for n in (self.most if not self.where else None, limiter.left_key_values() if limiter else None) if n is not None]
        ordered = False
        if caps:
            rows, ordered = rows.orderBy(*self._order()).limit(min(caps)), True
        if limiter and limiter.bytes is not None:
            n = self._rows_within(rows, limiter.left_bytes())
            if n is not None:
                rows, ordered = rows.orderBy(*self._order()).limit(n), True
            else:
                rows, ordered = running(rows, self._order(), self._bytes(), "_before").filter(F.col("_before") < limiter.left_bytes()).drop("_before"), False
        if not ordered:
            rows = rows.orderBy(*self._order())
        out = self._shaped(rows)
        return out.limit(self.most) if self.most and self.where else out

    def _rows_within(self, rows: DataFrame, budget: int, first: int = 1_024, most: int = 65_536) -> int | None:
        """How many rows a byte budget lets through, by the sizes of the first ones in order; None if it takes more than ``most`` of them."""
        want = first
        while want <= most:
            sizes = [r[0] or 0 for r in rows.orderBy(*self._order()).limit(want).select(self._bytes()).collect()]  # numbers only
            before = [0, *accumulate(sizes)]
            n = bisect_left(before, budget)  # rows before which fewer bytes were read
            if n < len(before) or len(sizes) < want:
                return min(n, len(sizes))
            want *= 8
        return None

    def page(self, rows_at_once: int = 10_000) -> Page:
        """One page: at most ``rows_at_once`` rows are read at a time and limits are charged as they are used.

        A token is a key, so the key columns must tell rows apart: two rows of equal keys are an error 202.

        Out-of-band limits are looked at first; an in-band limit is looked at before the end of the source."""
        limiter = self.limiter or ScanLimiter()
        token = self.token or Continuation.begin()
        got: list[Row] = []
        if token.is_end_marker():
            return Page([], StopReason.SOURCE_EXHAUSTED, token)
        while True:
            if reason := limiter.reached():
                return Page(got, reason, token)
            if self.most is not None and len(got) >= self.most:
                return Page(got, StopReason.RETURN_LIMIT_REACHED, token)
            want = min(x for x in (rows_at_once, limiter.left_key_values(), self.most - len(got) if self.most is not None and not self.where else None) if x is not None)
            part = replace(self, token=token).read().orderBy(*self._order()).limit(want + 1)  # and the key behind them
            keep = reduce(Column.__and__, self.where, F.lit(True))
            shaped = F.struct(*self.shape) if self.shape else F.struct(*(F.col(c) for c in self.source.columns))
            read = part.select(F.struct(*self.key).alias("_key"), self._bytes().alias("_bytes"), keep.alias("_keep"), shaped.alias("_row"))
            read = in_time(read.sparkSession, limiter, read.collect)  # one page
            if read is None:
                return Page(got, StopReason.TIME_LIMIT_REACHED, token)
            for a, b in zip(read, read[1:]):
                if a["_key"] == b["_key"]:
                    raise CairnError("cursor_incomplete_builder", f"several rows have the key {tuple(a['_key'])}")
            read = read[:want]
            for r in read:
                if reason := limiter.reached():
                    return Page(got, reason, token)
                if self.most is not None and len(got) >= self.most:
                    return Page(got, StopReason.RETURN_LIMIT_REACHED, token)
                limiter.charge(1, r["_bytes"] or 0)
                token = Continuation.at(*r["_key"])
                if r["_keep"]:
                    got.append(r["_row"])
            if len(read) < want:
                if reason := limiter.reached():
                    return Page(got, reason, token)
                if self.most is not None and len(got) >= self.most:
                    return Page(got, StopReason.RETURN_LIMIT_REACHED, token)
                return Page(got, StopReason.SOURCE_EXHAUSTED, Continuation.end())

    def pages(self):
        """All pages until the source is exhausted; a limiter that is used up ends them too."""
        scan = self
        while True:
            page = scan.page()
            yield page
            if page.reason is not StopReason.RETURN_LIMIT_REACHED:
                return
            scan = replace(scan, token=page.continuation)

    def into_dict(self) -> dict[tuple, Row]:
        """The whole result on the driver, by key in order; of equal keys the last stays."""
        columns = self.source.columns
        return {tuple(r[c] for c in self.key): r for r in replace(self, shape=()).df().select(*columns).collect()}


def collect(scan: Scan) -> tuple[list[Row], StopReason]:
    """All rows until the scan stops, and why it stopped."""
    page = scan.page()
    return page.rows, page.reason

