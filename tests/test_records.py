"""Chunked records, versions, keys, schemas, descriptors, values, snapshots."""

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairn.functions import uuids, values
from cairn.operators import split as S
from cairn.operators.keys import Element, Index, Registry, primary_key
from cairn.operators.limits import ScanLimiter, StopReason
from cairn.operators.record_scan import RecordScan
from cairn.operators.versions import RecordContext, completed, version, with_commits, with_local_versions
from cairn.plans import descriptor as D
from cairn.plans import schema as P
from cairn.plans.errors import CairnError
from cairn.sources.store import SnapshotStore

N = 8


def stamp():
    return version(F.lit(None), F.lit(bytearray(10)), F.lit(0))


@pytest.fixture(scope="module")
def sizes(spark):
    rows = [(n, "x" * n) for n in (0, 1, N - 1, N, N + 1, 2 * N, 100 * N)]
    return spark.createDataFrame(rows, "pk long, body string")


@pytest.fixture(scope="module")
def chunks(sizes):
    return S.split(sizes, ["pk"], "body", stamp(), N).cache()


def test_split_round_trip(sizes, chunks):
    per = {r["pk"]: r["n"] for r in chunks.filter("split_idx >= 0").groupBy("pk").agg(F.count("*").alias("n")).collect()}
    assert per == {0: 1, 1: 1, N - 1: 1, N: 1, N + 1: 2, 2 * N: 2, 100 * N: 100}
    for reverse in (False, True):
        got = [(r["pk"], bytes(r["record"]).decode()) for r in S.records(chunks, ["pk"], reverse).collect()]
        assert got == sorted(((r["pk"], r["body"]) for r in sizes.collect()), reverse=reverse)


def kvs(rows):
    return sum(1 + max(1, -(-n // N)) for n in rows)


@pytest.mark.parametrize("at_once", [3, 10_000])
def test_record_pages(sizes, chunks, at_once):
    keys = sorted(r["pk"] for r in sizes.collect())
    for backward in (False, True):
        want = keys[::-1] if backward else keys
        scan = RecordScan.over(chunks, "pk").reverse(backward)
        whole = scan.page(at_once)
        assert [k for (k,) in whole.keys] == want and whole.reason is StopReason.SOURCE_EXHAUSTED and whole.continuation.is_end_marker()
        assert [(r["pk"], len(r["record"])) for r in whole.records.collect()] == [(k, k) for k in want]
        assert scan.continue_from(whole.continuation).page().keys == []
        got = []
        for page in scan.limit(2).pages(at_once):
            got += page.keys
            assert page.reason in (StopReason.RETURN_LIMIT_REACHED, StopReason.SOURCE_EXHAUSTED)
        assert [k for (k,) in got] == want
        # a budget that ends within the third record: it is dropped, and read again by the page that resumes
        page = scan.limited_by(ScanLimiter(key_values=kvs(want[:2]) + 1)).page(at_once)
        assert [k for (k,) in page.keys] == want[:2] and page.reason is StopReason.KEY_VALUE_LIMIT_REACHED
        assert [k for (k,) in scan.continue_from(page.continuation.to_bytes()).page(at_once).keys] == want[2:]
        # a budget for exactly two records: the record limit comes first, and nothing more is read
        budget = ScanLimiter(key_values=kvs(want[:2]))
        assert scan.limit(2).limited_by(budget).page(at_once).reason is StopReason.RETURN_LIMIT_REACHED and budget.used_key_values == kvs(want[:2])
        assert scan.limited_by(ScanLimiter(milliseconds=0)).page().reason is StopReason.TIME_LIMIT_REACHED


def test_records_look_ahead(chunks):
    budget = ScanLimiter()
    page = RecordScan.over(chunks, "pk").limited_by(budget).page(stop_after=2)
    assert page.keys == [(0,), (1,)] and page.reason is None and page.error is None and budget.used_key_values == 5  # two records and a header
    assert RecordScan.over(chunks, "pk").continue_from(page.continuation).page(stop_after=1).keys == [(N - 1,)]
    budget = ScanLimiter(bytes=1)
    assert RecordScan.over(chunks, "pk").limited_by(budget).page().reason is StopReason.BYTE_LIMIT_REACHED and budget.used_key_values == 1


def test_record_scan_builder(chunks):
    for wrong in (lambda s: s.limit(0), lambda s: s.continue_from(b"garbage"), lambda s: RecordScan.over(chunks)):
        with pytest.raises(CairnError, match="232"):
            wrong(RecordScan.over(chunks, "pk"))


@pytest.mark.parametrize("damage", ["split_idx = -1", "split_idx = 1", "split_idx = 0", "split_idx >= 0"])
def test_broken_record_ends_a_page(chunks, damage):
    """Whatever is missing of record 2 N, the scan stops before it in either direction with a 233, and the token is before it."""
    broken = chunks.filter(~((F.col("pk") == 2 * N) & F.expr(damage)))
    keys = [0, 1, N - 1, N, N + 1, 2 * N, 100 * N]
    for backward, want in ((False, keys[:5]), (True, keys[:5:-1])):
        page = RecordScan.over(broken, "pk").reverse(backward).page()
        assert [k for (k,) in page.keys] == want and page.reason is None and page.error.code == 233
        assert page.continuation.key == (want[-1], -1 if backward else -(-want[-1] // N) - 1)
        again = RecordScan.over(broken, "pk").reverse(backward).continue_from(page.continuation).page()
        assert again.keys == [] and again.error.code == 233
    last = chunks.filter("pk = 16 and split_idx < 1")
    assert RecordScan.over(last, "pk").page().error.code == 233 and RecordScan.over(last, "pk").reverse().page().error.code == 233


def test_save_validates_the_old_record(spark, chunks):
    broken = chunks.filter("not (pk = 9 and split_idx = -1)")
    changed = spark.createDataFrame([(9, "new")], "pk long, body string")
    with pytest.raises(CairnError, match="211"):
        S.save(broken, ["pk"], changed, "body", stamp(), N)
    assert S.load(S.save(chunks, ["pk"], changed, "body", stamp(), N), ["pk"], (9,))[1] == b"new"


def test_admission_is_an_error(spark):
    rows = spark.createDataFrame([(1, ("a", None)), (2, ("b", "set"))], "id long, who struct<name:string,note:string>")
    stored = T.StructType.fromDDL("id long, who struct<name:string>")
    assert [r[0] for r in rows.select(values.admitted(rows, stored)).collect()] == [True, False]
    assert values.admit(rows.filter("id = 1"), stored).count() == 1
    with pytest.raises(PySparkException, match="241"):
        values.admit(rows, stored).collect()
    one = lambda kind: D.Definitions.of([D.Message("cairn.R", (D.Field(1, "a", kind, D.OPTIONAL, "_a"),))])
    assert values.admit(rows.filter("id = 1"), stored, (one("string"), "cairn.R"), (one("string"), "cairn.R")).count() == 1
    with pytest.raises(CairnError, match="241"):
        values.admit(rows, stored, (one("string"), "cairn.R"), (one("bytes"), "cairn.R"))


def test_elements_are_tagged(spark):
    rows = spark.createDataFrame([(["a", None], {"k": (1,)}), (None, {})], "l array<string>, m map<string,struct<n:int>>")
    rows = rows.select("l", F.col("m").alias("m", metadata={"element": {"message": "Place"}}))
    got = [r.asDict(True) for r in rows.select(*(values.tagged(F.col(f.name), f).alias(f.name) for f in rows.schema.fields)).collect()]
    s = lambda v: {"type": "string", "value": v}
    assert got[0]["l"] == {"type": "repeated_string", "value": [s("a"), s(None)]}
    assert got[0]["m"] == {"type": "map_message_Place", "value": {"k": {"type": "message_Place", "value": {"n": {"type": "int32", "value": 1}}}}}
    assert got[1] == {"l": {"type": "repeated_string", "value": None}, "m": {"type": "map_message_Place", "value": {}}}
    tree = {(r["path"], r["type"], r["value"]) for r in values.value_tree(rows.limit(1), []).collect()}
    assert tree == {("l", "repeated_string", "[]"), ("l[0]", "string", "a"), ("l[1]", "string", None), ("m", "map_message_Place", "{}"), ("m{k}", "message_Place", "{}"), ("m{k}.n", "int32", "1")}


def test_scans_move_chunks_once(chunks):
    for df in (S.records(chunks, ["pk"]), S.records(chunks, ["pk"], reverse=True), RecordScan.over(chunks, "pk").page().records):
        plan = df._jdf.queryExecution().sparkPlan().toString() and df._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange ") == 1 and "rangepartitioning" in plan


def test_too_large(spark):
    big = spark.createDataFrame([(1, "x" * (100 * N + 1))], "pk long, body string")
    with pytest.raises(PySparkException, match="214"):
        S.split(big, ["pk"], "body", stamp(), N).collect()


def test_load_save_delete(spark, chunks):
    assert S.load(chunks, ["pk"], (N,))[1] == b"x" * N
    assert S.load(chunks, ["pk"], (999,)) is None
    with pytest.raises(CairnError, match="210"):
        S.load(chunks, ["pk"], (2 * N,), ScanLimiter(key_values=2))
    changed = spark.createDataFrame([(N, "yy"), (999, "new")], "pk long, body string")
    saved = S.save(chunks, ["pk"], changed, "body", stamp(), N)
    assert S.load(saved, ["pk"], (N,))[1] == b"yy" and S.load(saved, ["pk"], (999,))[1] == b"new"
    gone = S.delete(chunks, ["pk"], spark.createDataFrame([(N,), (12345,)], "pk long"))
    assert S.load(gone, ["pk"], (N,)) is None and gone.select("pk").distinct().count() == 6


@pytest.mark.parametrize("code, where", [
    (211, "not (pk = 16 and split_idx = -1)"),
    (212, "not (pk = 16 and split_idx = 1)"),
    (212, "not (pk = 16 and split_idx = 0)"),
    (None, "true"),
])
def test_corruption(spark, chunks, code, where):
    bad = chunks.filter(where)
    assert {r["pk"]: r["error_code"] for r in S.classify(bad, ["pk"]).collect()}[16] == code
    if code:
        with pytest.raises(CairnError, match=str(code)):
            S.load(bad, ["pk"], (16,))
        assert [r["pk"] for r in S.records(bad, ["pk"]).collect()] == [0, 1, 7, 8, 9]
        assert [r["pk"] for r in S.records(bad, ["pk"], reverse=True).collect()] == [800]
        with pytest.raises(CairnError, match="211"):
            S.delete_checked(bad, ["pk"], spark.createDataFrame([(16,)], "pk long"))


def test_gap_and_header(chunks):
    gap = chunks.withColumn("split_idx", F.when((F.col("pk") == 16) & (F.col("split_idx") == 1), 2).otherwise(F.col("split_idx")))
    head = chunks.withColumn("header_version", F.when(F.col("pk") == 16, 1).otherwise(F.col("header_version")))
    assert {r["pk"]: r["error_code"] for r in S.classify(gap, ["pk"]).collect()}[16] == 213
    assert {r["pk"]: r["error_code"] for r in S.classify(head, ["pk"]).collect()}[16] == 212


def test_partial_records_are_dropped(chunks):
    of = lambda **b: [r["pk"] for r in S.records_within(chunks, ["pk"], ScanLimiter(**b)).collect()]
    assert of(key_values=0) == [] and of(key_values=1) == [] and of(key_values=2) == [0]
    assert of(key_values=10) == [0, 1, 7, 8] and of(key_values=11) == [0, 1, 7, 8, 9]
    assert [r["pk"] for r in S.records_within(chunks, ["pk"], ScanLimiter(key_values=104), reverse=True).collect()] == [800, 16]
    assert of(milliseconds=0) == [] and of(bytes=0) == []
    with pytest.raises(CairnError, match="232"):
        S.records(chunks, ["pk"], limit=0)


def test_version_order(spark):
    rows = spark.createDataFrame([(1, None, "00" * 10, 5), (2, 1, "00" * 10, 0), (3, None, None, 0), (4, None, "00" * 10, 6), (5, 1, None, 0)], "n int, i long, g string, l int")
    v = version(F.col("i"), F.unhex("g"), F.col("l"))
    assert [r["n"] for r in rows.orderBy(v).collect()] == [1, 4, 3, 2, 5]
    done = rows.select("n", completed(v, F.lit(bytearray(b"\x01" * 10))).alias("v")).filter("v.complete").count()
    assert done == 5


def test_local_versions(spark):
    df = with_local_versions(spark.range(10).selectExpr("id", "id % 2 as c"), ["c"], ["id"])
    assert {r["id"]: r["local_version"] for r in df.collect()} == {i: i // 2 for i in range(10)}
    with pytest.raises(PySparkException, match="220"):
        with_local_versions(spark.range(65_536).selectExpr("id", "1 as c"), ["c"], ["id"]).agg(F.max("local_version")).collect()


def test_record_context():
    c = RecordContext()
    assert [c.claim_local_version() for _ in range(65_535)][-1] == 65_534
    with pytest.raises(CairnError, match="220"):
        c.claim_local_version()
    c.set_incarnation_version(3)
    with pytest.raises(CairnError, match="222"):
        c.set_incarnation_version(4)
    assert c.incarnation_version() == 3 and c.age_milliseconds() >= 0


def test_primary_key_rules(spark):
    df = spark.createDataFrame([(1, None)], "a int, b string")
    with pytest.raises(PySparkException, match="250"):
        primary_key(df, [Element("b", "string", F.col("b"))]).collect()
    with pytest.raises(CairnError, match="250"):
        primary_key(df, [])
    with pytest.raises(CairnError, match="250"):
        primary_key(df, [Element("a", "maybe_integer", F.col("a"))])


def test_index_rules(spark):
    df = spark.createDataFrame([(1, ["x", "y"]), (2, []), (3, None)], "pk int, tags array<string>")
    fan = Index("tags", (Element("tag", "string", F.col("item")), Element("at", "integer", F.col("ordinal"))), fan_out=F.col("tags"))
    assert [tuple(r) for r in fan.entries(df, ["pk"]).collect()] == [("x", 0, 1), ("y", 1, 1)]
    whole = Index("l", (Element("l", "list_of_string", F.col("tags")),))
    assert whole.entries(df.filter("pk < 3"), ["pk"]).count() == 2
    with pytest.raises(PySparkException, match="251"):
        whole.entries(df, ["pk"]).collect()
    local = F.struct(F.lit(None).alias("incarnation_version"), F.lit(65_536).alias("local_version"))
    with pytest.raises(PySparkException, match="251"):
        Index("v", (Element("v", "versionstamp", local),)).entries(df, ["pk"]).collect()
    with pytest.raises(CairnError, match="261"):
        Index("v", (Element("v", "versionstamp", local),), (Element("w", "versionstamp", local),))
    r = Registry()
    r.register("doc", lambda d: primary_key(d, [Element("pk", "integer", F.col("pk"))]), {"tags": lambda d: fan.entries(d, ["pk"])})
    assert r.keys("doc", df).count() == 3 and r.entries("doc", df)["tags"].count() == 2


def test_schemas():
    with pytest.raises(CairnError, match="260"):
        P.PrimaryKeySchema(())
    for index, pk in (((), ("string",)), (("string",), ()), (("versionstamp", "versionstamp"), ("string",)), (("what",), ("string",))):
        with pytest.raises(CairnError, match="261"):
            P.IndexSchemaKey(index, pk)
    with pytest.raises(CairnError, match="261"):
        P.IndexSchemaValue(())
    stamped = P.IndexSchemaKey(("versionstamp",), ("integer",))
    with pytest.raises(CairnError, match="261"):
        P.IndexSchema(stamped, P.IndexSchemaValue(("versionstamp",)))
    for x in (P.PrimaryKeySchema(("string", "uuid")), P.IndexSchema(stamped), P.IndexSchema(P.IndexSchemaKey(("maybe_bytes",), ("string",)), P.IndexSchemaValue(("list_of_double",)))):
        assert P.from_json(P.to_json(x)) == x
    for bad in ("{}", '{"v": 2}', '{"v": 1, "key": {"index": ["?"], "primary_key": ["string"]}}', "no"):
        with pytest.raises(CairnError, match="243"):
            P.from_json(bad)


def test_record_key_schema():
    good = T.StructType([T.StructField("a", T.StringType(), False), T.StructField("b", T.StructType([T.StructField("c", T.LongType(), False)]), False)])
    P.check_record_key(good)
    P.check_record_key_values(("x", (1,)), good)
    for bad in (T.StructType([]), T.StructType([T.StructField("a", T.StringType())]), T.StructType([T.StructField("a", T.ArrayType(T.LongType()), False)]), T.StructType([T.StructField("a", T.StructType([]), False)])):
        with pytest.raises(CairnError, match="230"):
            P.check_record_key(bad)
    for bad in (("x",), (1, (1,)), ("x", (True,)), ("x", 1)):
        with pytest.raises(CairnError, match="231"):
            P.check_record_key_values(bad, good)


def test_descriptors():
    defs = D.Definitions.of([D.Message("m.A", (D.Field(1, "a", "string", oneof="_a"),))])
    D.check_well_formed(defs, "m.A")
    with pytest.raises(CairnError, match="240"):
        D.check_well_formed(D.Definitions.of(defs.messages.values(), "proto2"), "m.A")
    grown = D.Definitions.of([D.Message("m.A", (*defs.messages["m.A"].fields, D.Field(2, "b", "int32", oneof="_b")))])
    assert D.is_evolvable(defs, "m.A", grown, "m.A") and not D.is_evolvable(grown, "m.A", defs, "m.A")


def test_values(spark):
    df = spark.createDataFrame([(1, float("nan"))], "pk int, x double")
    with pytest.raises(PySparkException, match="242"):
        values.value_tree(df, ["pk"]).collect()
    rows = spark.createDataFrame([(1, ["a"], {"k": bytearray(3)})], "pk int, tags array<string>, m map<string, binary>")
    assert {(r["path"], r["type"]) for r in values.value_tree(rows, ["pk"]).collect()} == {("pk", "int32"), ("tags", "repeated_string"), ("m", "map_bytes")}
    m = F.col("m").alias("m", metadata={"element": {"kind": "uuid"}})
    assert rows.select("pk", m).transform(lambda d: d.select(values.admitted(d, d.schema))).first()[0] is False
    with pytest.raises(CairnError, match="300"):
        uuids.check(b"short")


def test_snapshots(spark, tmp_path, sizes):
    store = SnapshotStore(spark, f"file://{tmp_path}/store")
    assert store.current() is None
    assert store.commit(sizes, ["pk"], files=2) == 1
    assert store.commit(lambda n: store.read().withColumn("n", F.lit(n)), ["pk"], files=2) == 2
    assert store.versions() == [1, 2] and store.read().first()["n"] == 2 and "n" not in store.read(1).columns
    assert store.global_version(2) == b"\0" * 9 + b"\2"
    with pytest.raises(FileNotFoundError):
        store.read(9)


def test_age_overflow(monkeypatch):
    context = RecordContext()
    assert context.age_milliseconds() >= 0
    context._began = -float(1 << 61)
    with pytest.raises(CairnError, match="221"):
        context.age_milliseconds()


def test_commits(spark):
    """Groups go to commits that a commit's numbers suffice for, in order, wherever the range partitions end; NULL is a group."""
    df = spark.range(131_071).selectExpr("130000 - id as k", "case when id < 2 then null else id >= 131069 end as g")
    rows = with_local_versions(with_commits(df, ["g"], ["k"]), ["g", "commit"], ["k"])
    got = {(r["g"], r["commit"]): r[2:] for r in rows.groupBy("g", "commit").agg(F.min("k"), F.max("k"), F.max("local_version"), F.count("*")).collect()}
    assert got == {
        (None, 0): (129_999, 130_000, 1, 2),
        (False, 0): (-1_068, 64_466, 65_534, 65_535),
        (False, 1): (64_467, 129_998, 65_531, 65_532),
        (True, 0): (-1_070, -1_069, 1, 2),
    }
    assert rows.filter("g = false and k + 1068 <> commit * 65535 + local_version").isEmpty()
