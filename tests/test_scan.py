"""Ranges, limits, tokens and pages of the 5 x 5 key fixture."""

import itertools
import time

import pytest
from pyspark.sql import functions as F

from cairn.operators.limits import ScanLimiter, StopReason
from cairn.operators.prefix import ranked, running
from cairn.operators.ranges import KeyRange, TupleRange, exclusive, inclusive, next_prefix
from cairn.operators.scan import Scan, collect
from cairn.plans.errors import CairnError
from cairn.plans.token import Continuation

ALL = list(itertools.product(range(5), range(5)))


@pytest.fixture(scope="module")
def pairs(spark):
    return spark.createDataFrame([(i, j, f"{i}{j}") for i, j in ALL], "i int, j int, value string").cache()


@pytest.fixture
def scan(pairs):
    return Scan.over(pairs, "i", "j").range(TupleRange.all())


def keys(page):
    return [(r["i"], r["j"]) for r in page.rows]


def test_all_and_reverse(scan):
    assert keys(scan.page()) == ALL
    assert keys(scan.reverse().page()) == ALL[::-1]
    assert list(scan.into_dict()) == ALL


@pytest.mark.parametrize("low, high, keep", [
    (inclusive(1), inclusive(3), lambda k: 1 <= k[0] <= 3),
    (exclusive(1), exclusive(3), lambda k: 1 < k[0] < 3),
    (inclusive(1, 2), exclusive(3, 1), lambda k: (1, 2) <= k < (3, 1)),
    (exclusive(1, 2), inclusive(3, 1), lambda k: (1, 2) < k <= (3, 1)),
    (exclusive(1, 2), inclusive(3), lambda k: k > (1, 2) and k[0] <= 3),
    (inclusive(), inclusive(), lambda k: True),
])
def test_endpoints(scan, low, high, keep):
    want = [k for k in ALL if keep(k)]
    assert keys(scan.range(TupleRange(low, high)).page()) == want
    assert keys(scan.range(TupleRange(low, high)).reverse().page()) == want[::-1]


def test_prefix_between_prepend(scan):
    assert keys(scan.range(TupleRange.all_of(2)).page()) == [k for k in ALL if k[0] == 2]
    assert keys(scan.range(TupleRange.between((2,), None)).page()) == [k for k in ALL if k[0] >= 2]
    assert keys(scan.range(TupleRange.between((1,), (3,)).prepend(4)).page()) == [(4, 1), (4, 2)]
    assert keys(scan.range(TupleRange.all().prepend(4)).page()) == [k for k in ALL if k[0] == 4]


def test_null_comes_first(spark):
    rows = spark.createDataFrame([(None, 1), ("a", 2), ("b", 3)], "k string, n int")
    of = lambda r: sorted(x["n"] for x in rows.filter(r.predicate(["k"])).collect())
    assert of(TupleRange(high=exclusive("b"))) == [1, 2]
    assert of(TupleRange(low=exclusive(None))) == [2, 3]
    assert of(TupleRange(inclusive("a"), exclusive(None))) == []
    assert of(TupleRange.all_of(None)) == [1]


def test_range_reaches_the_scan(spark, tmp_path):
    spark.range(100).selectExpr("id as a", "id % 3 as b", "id as c").write.parquet(str(tmp_path / "t"))
    df = Scan.over(spark.read.parquet(str(tmp_path / "t")), "a", "b").range(TupleRange(inclusive(5, 1), exclusive(9, 1))).read().select("a", "b")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(a,5)" in plan and "ReadSchema: struct<a:bigint,b:bigint>" in plan


@pytest.mark.parametrize("n", [1, 2, 3, 7, 24, 25, 26])
@pytest.mark.parametrize("reverse", [False, True])
def test_pages_make_the_whole(scan, n, reverse):
    pages = list(scan.reverse(reverse).limit(n).pages())
    assert [k for p in pages for k in keys(p)] == (ALL[::-1] if reverse else ALL)
    assert pages[-1].reason is StopReason.SOURCE_EXHAUSTED and pages[-1].continuation.is_end_marker()
    assert all(p.reason is StopReason.RETURN_LIMIT_REACHED for p in pages[:-1])


def test_resume_at_end_and_begin(scan):
    end = scan.page().continuation
    assert scan.continue_from(end.to_bytes()).page().rows == []
    assert keys(scan.continue_from(Continuation.begin()).page()) == ALL


def test_key_value_limit(scan):
    none = scan.limited_by(ScanLimiter(key_values=0)).page()
    assert (none.rows, none.reason) == ([], StopReason.KEY_VALUE_LIMIT_REACHED) and none.continuation.is_begin_marker()
    two = scan.limited_by(ScanLimiter(key_values=2)).page()
    assert keys(two) == ALL[:2] and two.continuation == Continuation.at(0, 1)
    assert keys(scan.continue_from(two.continuation).page()) == ALL[2:]


def test_byte_limit_goes_over_by_one(scan):
    page = scan.limited_by(ScanLimiter(bytes=10)).page()  # each row has 4 bytes
    assert keys(page) == ALL[:3] and page.reason is StopReason.BYTE_LIMIT_REACHED
    assert scan.limited_by(ScanLimiter(bytes=10)).df().count() == 3
    assert scan.limited_by(ScanLimiter(bytes=0)).page().continuation.is_begin_marker()


def test_time_limit(scan):
    page = scan.limited_by(ScanLimiter(milliseconds=0)).page()
    assert (page.rows, page.reason) == ([], StopReason.TIME_LIMIT_REACHED)
    assert scan.limited_by(ScanLimiter(milliseconds=60_000)).page().reason is StopReason.SOURCE_EXHAUSTED


def test_priorities(scan):
    assert scan.limit(5).limited_by(ScanLimiter(key_values=5, bytes=20)).page().reason is StopReason.KEY_VALUE_LIMIT_REACHED
    assert scan.limit(5).limited_by(ScanLimiter(bytes=20)).page().reason is StopReason.BYTE_LIMIT_REACHED
    assert scan.limit(5).page().reason is StopReason.RETURN_LIMIT_REACHED
    assert scan.limit(25).page().reason is StopReason.RETURN_LIMIT_REACHED
    assert scan.limit(26).page().reason is StopReason.SOURCE_EXHAUSTED
    assert scan.limit(0).page().reason is StopReason.SOURCE_EXHAUSTED


def test_shared_limiter(scan):
    budget = ScanLimiter(key_values=4)
    assert len(scan.limit(3).limited_by(budget).page().rows) == 3
    second = scan.limit(3).limited_by(budget).page()
    assert len(second.rows) == 1 and second.reason is StopReason.KEY_VALUE_LIMIT_REACHED


def test_filter_map_collect(scan):
    page = scan.filter(F.col("j") == 1).map((F.col("i") * 10).alias("x")).page()
    assert [r["x"] for r in page.rows] == [0, 10, 20, 30, 40]
    got, reason = collect(scan.filter(F.lit(False)))
    assert got == [] and reason is StopReason.SOURCE_EXHAUSTED
    assert len(scan.filter(F.col("j") == 1).limit(2).page().rows) == 2
    assert scan.filter(F.col("j") == 1).limit(2).df().count() == 2


def test_incomplete_builder(pairs):
    with pytest.raises(CairnError, match="202"):
        Scan.over(pairs, "i").page()
    with pytest.raises(CairnError, match="202"):
        Scan.over(pairs)


def test_tokens():
    for t in (Continuation.begin(), Continuation.end(), Continuation.at(1, "x", None, 2.5, True, b"\x00\xff")):
        assert Continuation.from_bytes(t.to_bytes()) == t
    for bad in (b"", b"garbage!", b"e30=", Continuation.at(1).to_bytes()[:-3]):
        with pytest.raises(CairnError, match="200"):
            Continuation.from_bytes(bad)


def test_key_range_and_next_prefix(spark):
    rows = spark.createDataFrame([(bytearray(b"a"),), (bytearray(b"ab"),), (bytearray(b"b"),)], "k binary")
    assert rows.filter(KeyRange(b"a", next_prefix(b"a")).predicate("k")).count() == 2
    assert next_prefix(b"a\xff") == b"b" and next_prefix(b"\xff") is None


def test_running_sums(spark):
    df = spark.range(1000).selectExpr("(id * 37) % 1000 as k")
    got = {r["k"]: (r["before"], r["rn"]) for r in ranked(running(df, [F.col("k")], F.col("k"), "before"), [F.col("k")]).collect()}
    assert got == {k: (k * (k - 1) // 2, k + 1) for k in range(1000)}


def test_time_limit_stops_a_running_scan(spark):
    slow = spark.range(0, 100, 1, 1).withColumn("v", F.expr("java_method('java.lang.Thread', 'sleep', 100L + id - id)"))
    began = time.monotonic()
    page = Scan.over(slow, "id").range(TupleRange.all()).limited_by(ScanLimiter(milliseconds=1_500)).page()
    assert page.reason is StopReason.TIME_LIMIT_REACHED and page.rows == [] and page.continuation.is_begin_marker()
    assert time.monotonic() - began < 8
    assert len(Scan.over(spark.range(5).toDF("id"), "id").range(TupleRange.all()).limited_by(ScanLimiter(milliseconds=60_000)).page().rows) == 5


def test_rows_of_equal_keys_are_an_error(spark):
    df = spark.createDataFrame([(1, 1), (2, 1), (2, 2), (3, 1)], "k long, v long")
    with pytest.raises(CairnError, match="202"):
        Scan.over(df, "k").range(TupleRange.all()).page()
    with pytest.raises(CairnError, match="202"):
        Scan.over(df, "k").range(TupleRange.all()).page(rows_at_once=2)
    assert len(Scan.over(df, "k", "v").range(TupleRange.all()).page(rows_at_once=2).rows) == 4


@pytest.mark.parametrize("budget", [0, 1, 5, 6, 7_000, 10**9])
def test_byte_limit(spark, budget):
    sizes = [(i * 37) % 11 for i in range(3_000)]
    df = spark.createDataFrame(list(enumerate(sizes)), "k long, n long")
    scan = Scan.over(df, "k").range(TupleRange.all()).sized(F.col("n")).limited_by(ScanLimiter(bytes=budget))
    want = [k for k in range(3_000) if sum(sizes[:k]) < budget] if budget < 10**6 else list(range(3_000))
    assert [r["k"] for r in scan.df().collect()] == want
