"""Ranges of typed keys, compiled to predicates that Parquet readers can use.

A key is a list of typed columns.  An endpoint is a tuple of at most as many values and compares only the columns it has:
an inclusive low endpoint keeps all keys from that prefix on, an exclusive one leaves out every key with the prefix; an
inclusive high endpoint keeps every key with the prefix, an exclusive one ends before it.  NULL sorts first.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from cairn.plans.token import Continuation

OPEN, INCLUSIVE, EXCLUSIVE = "open", "inclusive", "exclusive"


@dataclass(frozen=True)
class Endpoint:
    kind: str = OPEN
    key: tuple = ()

    def map(self, f: Callable[[tuple], tuple]) -> Endpoint:
        return self if self.kind == OPEN else Endpoint(self.kind, f(self.key))


START = STOP = Endpoint()


def inclusive(*key) -> Endpoint:
    return Endpoint(INCLUSIVE, tuple(key))


def exclusive(*key) -> Endpoint:
    return Endpoint(EXCLUSIVE, tuple(key))


def _equal(c: Column, v) -> Column:
    return c.isNull() if v is None else c == F.lit(v)


def _beyond(c: Column, v, up: bool) -> Column:
    """c after v, or before it; NULL is before every value."""
    if v is None:
        return c.isNotNull() if up else F.lit(False)
    return c > F.lit(v) if up else c.isNull() | (c < F.lit(v))


def compare(columns: Sequence[str | Column], key: tuple, up: bool, equal: bool) -> Column:
    """The key columns, cut to the endpoint's length, are after (up) or before key, or equal to it where equal is set.

    The first column's bound is stated once more by itself, for row-group statistics."""
    cols = [F.col(c) if isinstance(c, str) else c for c in columns][: len(key)]
    if len(key) > len(columns):
        raise ValueError("an endpoint can't have more values than the key has columns")
    if not key:
        return F.lit(equal)
    ors = []
    for i in range(len(key)):
        ors.append(reduce(Column.__and__, [*(_equal(c, v) for c, v in zip(cols[:i], key)), _beyond(cols[i], key[i], up)]))
    if equal:
        ors.append(reduce(Column.__and__, (_equal(c, v) for c, v in zip(cols, key))))
    out = reduce(Column.__or__, ors)
    if len(key) > 1:
        out = (_equal(cols[0], key[0]) | _beyond(cols[0], key[0], up) if key[0] is None or not up else cols[0] >= F.lit(key[0])) & out
    return out


@dataclass(frozen=True)
class TupleRange:
    low: Endpoint = START
    high: Endpoint = STOP

    @staticmethod
    def all() -> TupleRange:
        return TupleRange()

    @staticmethod
    def all_of(*prefix) -> TupleRange:
        return TupleRange(inclusive(*prefix), inclusive(*prefix))

    @staticmethod
    def between(low: tuple | None, high: tuple | None) -> TupleRange:
        """Low inclusive, high exclusive; None is open."""
        return TupleRange(START if low is None else inclusive(*low), STOP if high is None else exclusive(*high))

    def prepend(self, *prefix) -> TupleRange:
        """The same range below a prefix; open endpoints become the prefix, inclusive."""
        return TupleRange(*(inclusive(*prefix) if e.kind == OPEN else e.map(lambda k: (*prefix, *k)) for e in (self.low, self.high)))

    def predicate(self, columns: Sequence[str | Column]) -> Column:
        low, high = self.low, self.high
        if low.kind == high.kind == INCLUSIVE and low.key == high.key:  # a prefix: equalities alone
            return reduce(Column.__and__, (_equal(F.col(c) if isinstance(c, str) else c, v) for c, v in zip(columns, low.key)), F.lit(True))
        out = F.lit(True)
        if low.kind != OPEN:
            out = compare(columns, low.key, True, low.kind == INCLUSIVE)
        if high.kind != OPEN:
            below = compare(columns, high.key, False, high.kind == INCLUSIVE)
            out = below if low.kind == OPEN else out & below
        return out

    def resumed(self, columns: Sequence[str | Column], token: Continuation | None, reverse: bool = False) -> Column:
        """The predicate of what is left after the token's key: keys beyond it, or before it in a reverse scan."""
        if token is None or token.is_begin_marker():
            return self.predicate(columns)
        if token.is_end_marker():
            return F.lit(False)
        return self.predicate(columns) & compare(columns, token.key, not reverse, False)


@dataclass(frozen=True)
class KeyRange:
    """Byte keys from low, inclusive, to high, exclusive; None is open."""

    low: bytes | None = None
    high: bytes | None = None

    def predicate(self, column: str | Column) -> Column:
        c = F.col(column) if isinstance(column, str) else column
        out = F.lit(True)
        if self.low is not None:
            out = c >= F.lit(bytearray(self.low))
        if self.high is not None:
            out = out & (c < F.lit(bytearray(self.high)))
        return out


def next_prefix(key: bytes) -> bytes | None:
    """The first key after all keys that begin with key; None if there is none."""
    cut = key.rstrip(b"\xff")
    return cut[:-1] + bytes([cut[-1] + 1]) if cut else None
