"""Each operator on the driver's tables, and the same in DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairn.functions import uuids, values
from cairn.operators import split as S
from cairn.operators.keys import Element, Index, changes, primary_key
from cairn.operators.limits import ScanLimiter
from cairn.operators.prefix import ranked
from cairn.operators.ranges import KeyRange, TupleRange, exclusive, inclusive
from cairn.operators.record_scan import RecordPage, RecordScan
from cairn.operators.scan import Page, Scan
from cairn.operators.versions import MOST_LOCAL, version, with_commits, with_local_versions
from cairn.plans import descriptor as D
from cairn.plans.token import Continuation

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
CHUNK = 4096
MOST = -(-S.MAX_BYTES // CHUNK)  # small chunks don't make the largest record smaller


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _orders(spark: SparkSession, sf_dir: str) -> Scan:
    return Scan.over(_t(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice"), "o_orderkey").range(TupleRange.all())


def _talk(spark: SparkSession, sf_dir: str, span: TupleRange) -> DataFrame:
    return Scan.over(_t(spark, sf_dir, "conversations").select("conv_id", "turn", "role"), "conv_id", "turn").range(span).read()


def _events(spark: SparkSession, sf_dir: str) -> Scan:
    return Scan.over(_t(spark, sf_dir, "events").select("event_id", "user_id", "event_type"), "event_id").range(TupleRange.all())


def _documents(spark: SparkSession, sf_dir: str) -> Scan:
    docs = _t(spark, sf_dir, "documents").select("doc_id", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("bytes"))
    return Scan.over(docs, "doc_id").range(TupleRange.all()).sized(F.col("bytes"))


def _paged(spark: SparkSession, page: Page, schema: str) -> DataFrame:
    """A page's rows, each with its place and the reason why the page ended."""
    rows = [(i + 1, page.reason.name, *r) for i, r in enumerate(page.rows)]
    return spark.createDataFrame(rows, f"rn long, reason string, {schema}")


# --- scans, ranges, continuation ---


@query("SELECT o_orderkey, o_custkey, o_totalprice, row_number() OVER (ORDER BY o_orderkey) AS rn FROM orders")
def scan_all(spark, sf_dir):
    return ranked(_orders(spark, sf_dir).read(), [F.col("o_orderkey")])


@query("SELECT o_orderkey, o_custkey, o_totalprice, row_number() OVER (ORDER BY o_orderkey DESC) AS rn FROM orders")
def reverse_scan(spark, sf_dir):
    return ranked(_orders(spark, sf_dir).reverse().read(), [F.col("o_orderkey").desc()])


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 100")
def limit_return(spark, sf_dir):
    return _orders(spark, sf_dir).limit(100).df()


@query("SELECT row_number() OVER (ORDER BY o_orderkey) AS rn, 'RETURN_LIMIT_REACHED' AS reason, o_orderkey, o_custkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 25")
def scan_page(spark, sf_dir):
    return _paged(spark, _orders(spark, sf_dir).limit(25).page(), "o_orderkey long, o_custkey long, o_totalprice double")


@query("SELECT conv_id, turn, role FROM conversations WHERE conv_id = 5")
def range_prefix(spark, sf_dir):
    return _talk(spark, sf_dir, TupleRange.all_of(5))


_LOW, _HIGH = "(conv_id > 3 OR (conv_id = 3 AND turn {0} 1))", "(conv_id < 40 OR (conv_id = 40 AND turn {0} 1))"


def _two(low: str, high: str) -> str:
    return f"SELECT conv_id, turn, role FROM conversations WHERE {_LOW.format(low)} AND {_HIGH.format(high)}"


@query(_two(">=", "<="))
def range_ii(spark, sf_dir):
    return _talk(spark, sf_dir, TupleRange(inclusive(3, 1), inclusive(40, 1)))


@query(_two(">=", "<"))
def range_ie(spark, sf_dir):
    return _talk(spark, sf_dir, TupleRange(inclusive(3, 1), exclusive(40, 1)))


@query(_two(">", "<="))
def range_ei(spark, sf_dir):
    return _talk(spark, sf_dir, TupleRange(exclusive(3, 1), inclusive(40, 1)))


@query(_two(">", "<"))
def range_ee(spark, sf_dir):
    return _talk(spark, sf_dir, TupleRange(exclusive(3, 1), exclusive(40, 1)))


@query("SELECT conv_id, turn, role FROM conversations WHERE conv_id > 3 AND conv_id <= 40")
def range_short_endpoints(spark, sf_dir):
    return _talk(spark, sf_dir, TupleRange(exclusive(3), inclusive(40)))


@query("SELECT conv_id, turn, role FROM conversations WHERE conv_id >= 10 AND conv_id < 20")
def range_between(spark, sf_dir):
    return _talk(spark, sf_dir, TupleRange.between((10,), (20,)))


@query("SELECT conv_id, turn, role FROM conversations WHERE conv_id = 7 AND turn >= 1 AND turn < 3")
def range_prepend(spark, sf_dir):
    return _talk(spark, sf_dir, TupleRange.between((1,), (3,)).prepend(7))


@query("SELECT c_custkey, c_name FROM customer WHERE encode(c_name) >= encode('Customer#00000005') AND encode(c_name) < encode('Customer#00000009')")
def key_range(spark, sf_dir):
    rows = _t(spark, sf_dir, "customer").select("c_custkey", "c_name", F.encode("c_name", "utf-8").alias("k"))
    return rows.filter(KeyRange(b"Customer#00000005", b"Customer#00000009").predicate("k")).select("c_custkey", "c_name")


_NULLED = "SELECT nullif(event_type, 'view') AS k, event_id FROM events"


@query(f"SELECT coalesce(k, '-') AS k, event_id FROM ({_NULLED}) WHERE k IS NULL OR k <= 'click'")
def range_null_first(spark, sf_dir):
    rows = _t(spark, sf_dir, "events").select(F.nullif("event_type", F.lit("view")).alias("k"), "event_id")
    return rows.filter(TupleRange(high=inclusive("click")).predicate(["k", "event_id"])).select(F.coalesce("k", F.lit("-")).alias("k"), "event_id")


@query(f"SELECT coalesce(k, '-') AS k, event_id FROM ({_NULLED}) WHERE false")
def range_null_high(spark, sf_dir):
    rows = _t(spark, sf_dir, "events").select(F.nullif("event_type", F.lit("view")).alias("k"), "event_id")
    return rows.filter(TupleRange(inclusive("click"), exclusive(None)).predicate(["k", "event_id"])).select(F.coalesce("k", F.lit("-")).alias("k"), "event_id")


@query("SELECT event_id, user_id, event_type FROM events WHERE event_id > 500 ORDER BY event_id LIMIT 50")
def resume_forward(spark, sf_dir):
    return _events(spark, sf_dir).continue_from(Continuation.at(500).to_bytes()).limit(50).df()


@query("SELECT event_id, user_id, event_type FROM events WHERE event_id < 500 ORDER BY event_id DESC LIMIT 50")
def resume_reverse(spark, sf_dir):
    return _events(spark, sf_dir).reverse().continue_from(Continuation.at(500)).limit(50).df()


@query("SELECT event_id, user_id, event_type FROM events ORDER BY event_id LIMIT 50")
def resume_begin(spark, sf_dir):
    return _events(spark, sf_dir).continue_from(Continuation.begin()).limit(50).df()


@query("SELECT event_id, user_id, event_type FROM events WHERE false")
def resume_end(spark, sf_dir):
    return _events(spark, sf_dir).continue_from(Continuation.end()).df()


_LINE = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")


@query("SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity > 45 AND l_returnflag = 'R'")
def cursor_filter(spark, sf_dir):
    scan = Scan.over(_t(spark, sf_dir, "lineitem").select(*_LINE, "l_quantity", "l_returnflag"), *_LINE).range(TupleRange.all())
    return scan.filter((F.col("l_quantity") > 45) & (F.col("l_returnflag") == "R")).df().drop("l_returnflag")


@query("SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_extendedprice * (1 - l_discount) AS revenue FROM lineitem")
def cursor_map(spark, sf_dir):
    scan = Scan.over(_t(spark, sf_dir, "lineitem").select(*_LINE, "l_extendedprice", "l_discount"), *_LINE).range(TupleRange.all())
    return scan.map(*(F.col(c) for c in _LINE), (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("revenue")).df()


# --- limits ---

_SIZED = "SELECT doc_id, octet_length(encode(coalesce(text, ''))) AS bytes FROM documents"
_BEFORE = f"SELECT doc_id, bytes, row_number() OVER (ORDER BY doc_id) AS n, coalesce(sum(bytes) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM ({_SIZED})"


@query(f"SELECT doc_id, bytes FROM ({_BEFORE}) WHERE n <= 37")
def limit_kv(spark, sf_dir):
    return _documents(spark, sf_dir).limited_by(ScanLimiter(key_values=37)).df()


@query(f"SELECT doc_id, bytes FROM ({_BEFORE}) WHERE before < 20000")
def limit_bytes(spark, sf_dir):
    return _documents(spark, sf_dir).limited_by(ScanLimiter(bytes=20_000)).df()


@query("SELECT doc_id, text FROM documents WHERE false")
def limit_time_zero(spark, sf_dir):
    return Scan.over(_t(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id").range(TupleRange.all()).limited_by(ScanLimiter(milliseconds=0)).df()


@query(f"SELECT n AS rn, 'KEY_VALUE_LIMIT_REACHED' AS reason, doc_id, bytes FROM ({_BEFORE}) WHERE n <= 5")
def limit_priority(spark, sf_dir):
    size = int(_documents(spark, sf_dir).limit(5).df().agg(F.sum("bytes")).first()[0])
    page = _documents(spark, sf_dir).limit(5).limited_by(ScanLimiter(key_values=5, bytes=size)).page()
    return _paged(spark, page, "doc_id long, bytes long")


@query(f"SELECT 1 AS scan, n AS rn, doc_id FROM ({_BEFORE}) WHERE n <= 3 UNION ALL SELECT 2, n, doc_id FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id DESC) AS n FROM documents) WHERE n <= 1")
def limit_shared(spark, sf_dir):
    budget = ScanLimiter(key_values=4)
    first = _documents(spark, sf_dir).limit(3).limited_by(budget).page()
    second = _documents(spark, sf_dir).reverse().limit(3).limited_by(budget).page()
    rows = [(s, i + 1, r["doc_id"]) for s, p in ((1, first), (2, second)) for i, r in enumerate(p.rows)]
    return spark.createDataFrame(rows, "scan int, rn long, doc_id long")


# --- records in chunks ---

_BODY = "SELECT doc_id, coalesce(text, '') AS text, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS bytes, greatest((octet_length(encode(coalesce(text, ''))) + 4095) // 4096, 1) AS n FROM documents"


def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = version(F.lit(None), F.unhex(F.lpad(F.hex("doc_id"), 20, "0")), F.lit(0))
    return S.split(_t(spark, sf_dir, "documents").select("doc_id", "text"), ["doc_id"], "text", v, CHUNK, S.MAX_BYTES)


def _whole(df: DataFrame) -> DataFrame:
    return df.select("doc_id", F.octet_length("record").cast("long").alias("bytes"), F.md5("record").alias("md5"))


_WHOLE = "SELECT doc_id, bytes, md5(text) AS md5"


@query(f"SELECT doc_id, i AS split_idx, octet_length(unhex(substr(h, CAST(1 + 8192 * i AS BIGINT), 8192))) AS bytes, md5(unhex(substr(h, CAST(1 + 8192 * i AS BIGINT), 8192))) AS md5 FROM (SELECT doc_id, h, unnest(range(0, n)) AS i FROM ({_BODY}))")
def record_split(spark, sf_dir):
    return _chunks(spark, sf_dir).filter("split_idx >= 0").select("doc_id", F.col("split_idx").cast("long").alias("split_idx"), F.octet_length("chunk").cast("long").alias("bytes"), F.md5("chunk").alias("md5"))


@query(f"SELECT doc_id, n AS data_splits, 0 AS header_version, lower(lpad(to_hex(doc_id), 20, '0')) AS global_version, 0 AS local_version, true AS complete FROM ({_BODY})")
def record_header(spark, sf_dir):
    rows = _chunks(spark, sf_dir).filter("split_idx = -1")
    return rows.select("doc_id", F.col("data_splits").cast("long").alias("data_splits"), "header_version", F.lower(F.hex("version.global_version")).alias("global_version"), "version.local_version", "version.complete")


@query(f"{_WHOLE} FROM ({_BODY}) WHERE doc_id = 5")
def record_load(spark, sf_dir):
    found = S.load(_chunks(spark, sf_dir), ["doc_id"], (5,), most_chunks=MOST)
    return _whole(spark.createDataFrame([(5, bytearray(found[1]))] if found else [], "doc_id long, record binary"))


@query(f"{_WHOLE} FROM ({_BODY})")
def record_scan_forward(spark, sf_dir):
    return _whole(S.records(_chunks(spark, sf_dir), ["doc_id"], most_chunks=MOST))


@query(f"{_WHOLE} FROM ({_BODY})")
def record_scan_reverse(spark, sf_dir):
    return _whole(S.records(_chunks(spark, sf_dir), ["doc_id"], reverse=True, most_chunks=MOST))


@query(f"{_WHOLE} FROM ({_BODY}) ORDER BY doc_id DESC LIMIT 20")
def record_limit(spark, sf_dir):
    return _whole(S.records(_chunks(spark, sf_dir), ["doc_id"], reverse=True, limit=20, most_chunks=MOST))


@query(f"{_WHOLE} FROM (SELECT *, sum(n + 1) OVER (ORDER BY doc_id) AS rows FROM ({_BODY})) WHERE rows <= 200")
def record_limit_kv(spark, sf_dir):
    return _whole(S.records_within(_chunks(spark, sf_dir), ["doc_id"], ScanLimiter(key_values=200)))


@query(f"{_WHOLE} FROM ({_BODY}) WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def record_delete(spark, sf_dir):
    return _whole(S.records(S.delete(_chunks(spark, sf_dir), ["doc_id"], _t(spark, sf_dir, "labels")), ["doc_id"], until_corrupt=False, most_chunks=MOST))


@query(f"SELECT b.doc_id, CASE WHEN l.doc_id IS NULL THEN b.bytes ELSE 3 * b.bytes END AS bytes, md5(CASE WHEN l.doc_id IS NULL THEN b.text ELSE b.text || b.text || b.text END) AS md5 FROM ({_BODY}) b LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l ON b.doc_id = l.doc_id")
def record_save_overwrite(spark, sf_dir):
    docs = _t(spark, sf_dir, "documents").join(_t(spark, sf_dir, "labels").select("doc_id").distinct(), "doc_id", "left_semi")
    changed = docs.select("doc_id", F.repeat(F.coalesce("text", F.lit("")), 3).alias("text"))
    v = version(F.lit(None), F.unhex(F.lpad(F.hex("doc_id"), 20, "0")), F.lit(1))
    return _whole(S.records(S.save(_chunks(spark, sf_dir), ["doc_id"], changed, "text", v, CHUNK, S.MAX_BYTES), ["doc_id"], until_corrupt=False, most_chunks=MOST))


def _damaged(spark: SparkSession, sf_dir: str, least: int) -> DataFrame:
    """From document least on: 0 of 7 lacks its last chunk, 1 its header, 2 has an unknown header, 3 a gap before its last chunk."""
    chunks = _chunks(spark, sf_dir)
    n = F.greatest(F.ceil(F.octet_length(F.coalesce("text", F.lit(""))) / CHUNK), F.lit(1)).cast("int")
    last = _t(spark, sf_dir, "documents").select("doc_id", (n - 1).alias("_last"))
    kind = F.when(F.col("doc_id") >= least, F.col("doc_id") % 7).otherwise(6)
    rows = chunks.join(last, "doc_id").withColumn("_kind", kind)
    rows = rows.filter(~((F.col("_kind") == 0) & (F.col("split_idx") == F.col("_last"))) & ~((F.col("_kind") == 1) & (F.col("split_idx") == -1)))
    rows = rows.withColumn("header_version", F.when((F.col("_kind") == 2) & (F.col("split_idx") == -1), 1).otherwise(F.col("header_version")))
    rows = rows.withColumn("split_idx", F.when((F.col("_kind") == 3) & (F.col("split_idx") == F.col("_last")), F.col("split_idx") + 1).otherwise(F.col("split_idx")))
    return rows.select(chunks.columns)


@query("SELECT doc_id, CASE doc_id % 7 WHEN 0 THEN 212 WHEN 1 THEN 211 WHEN 2 THEN 212 WHEN 3 THEN 213 ELSE 0 END AS error_code FROM documents")
def record_corruption(spark, sf_dir):
    return S.classify(_damaged(spark, sf_dir, 0), ["doc_id"], MOST).select("doc_id", F.coalesce("error_code", F.lit(0)).alias("error_code"))


_BAD = "SELECT doc_id FROM documents WHERE doc_id >= 60 AND doc_id % 7 < 4"


@query(f"SELECT 'forward' AS direction, doc_id, bytes, md5(text) AS md5 FROM ({_BODY}) WHERE doc_id < (SELECT min(doc_id) FROM ({_BAD})) UNION ALL SELECT 'reverse', doc_id, bytes, md5(text) FROM ({_BODY}) WHERE doc_id > (SELECT max(doc_id) FROM ({_BAD}))")
def record_scan_until_corrupt(spark, sf_dir):
    damaged = _damaged(spark, sf_dir, 60)
    both = [_whole(S.records(damaged, ["doc_id"], reverse=r, most_chunks=MOST)).select(F.lit(d).alias("direction"), "*") for d, r in (("forward", False), ("reverse", True))]
    return both[0].unionByName(both[1])


def _page_of_records(page: RecordPage) -> DataFrame:
    """rn, reason (or the error), doc_id, bytes, md5 of the records of a page, numbered in scan order."""
    reason = F.lit(page.reason.name if page.reason else f"{page.error.code} {page.error.name}")
    place = F.create_map(*[F.lit(x) for i, (k,) in enumerate(page.keys) for x in (k, i + 1)]) if page.keys else None
    rn = F.element_at(place, F.col("doc_id")).cast("long") if page.keys else F.lit(0).cast("long")
    return _whole(page.records).select(rn.alias("rn"), reason.alias("reason"), "doc_id", "bytes", "md5")


def _record_scan(spark: SparkSession, sf_dir: str) -> RecordScan:
    return RecordScan.over(_chunks(spark, sf_dir), "doc_id", most_chunks=MOST)


_NUMBERED = f"SELECT *, row_number() OVER (ORDER BY doc_id) AS up, row_number() OVER (ORDER BY doc_id DESC) AS down, sum(n + 1) OVER (ORDER BY doc_id) AS kv_up, sum(n + 1) OVER (ORDER BY doc_id DESC) AS kv_down FROM ({_BODY})"


@query(f"SELECT up AS rn, 'KEY_VALUE_LIMIT_REACHED' AS reason, doc_id, bytes, md5(text) AS md5 FROM ({_NUMBERED}) WHERE kv_up <= 100")
def record_page(spark, sf_dir):
    return _page_of_records(_record_scan(spark, sf_dir).limited_by(ScanLimiter(key_values=100)).page(rows_at_once=32))


@query(f"SELECT up - 7 AS rn, 'RETURN_LIMIT_REACHED' AS reason, doc_id, bytes, md5(text) AS md5 FROM ({_NUMBERED}) WHERE up BETWEEN 8 AND 27")
def record_resume_forward(spark, sf_dir):
    scan = _record_scan(spark, sf_dir)
    return _page_of_records(scan.limit(20).continue_from(scan.limit(7).page().continuation.to_bytes()).page())


@query(f"SELECT down - 5 AS rn, 'KEY_VALUE_LIMIT_REACHED' AS reason, doc_id, bytes, md5(text) AS md5 FROM ({_NUMBERED}) WHERE down > 5 AND kv_down - (SELECT max(kv_down) FROM ({_NUMBERED}) WHERE down = 5) <= 80")
def record_resume_reverse(spark, sf_dir):
    scan = _record_scan(spark, sf_dir).reverse()
    return _page_of_records(scan.limited_by(ScanLimiter(key_values=80)).continue_from(scan.limit(5).page().continuation.to_bytes()).page())


_FIRST_BAD, _LAST_BAD = (f"(SELECT {f}(doc_id) FROM ({_BAD}))" for f in ("min", "max"))


@query(f"SELECT row_number() OVER (ORDER BY doc_id) AS rn, '233 record_scan_corrupt' AS reason, doc_id, bytes, md5(text) AS md5 FROM ({_BODY}) WHERE doc_id < {_FIRST_BAD}")
def record_corruption_forward(spark, sf_dir):
    return _page_of_records(RecordScan.over(_damaged(spark, sf_dir, 60), "doc_id", most_chunks=MOST).page())


@query(f"SELECT row_number() OVER (ORDER BY doc_id DESC) AS rn, '233 record_scan_corrupt' AS reason, doc_id, bytes, md5(text) AS md5 FROM ({_BODY}) WHERE doc_id > {_LAST_BAD}")
def record_corruption_reverse(spark, sf_dir):
    return _page_of_records(RecordScan.over(_damaged(spark, sf_dir, 60), "doc_id", most_chunks=MOST).reverse().page())


# --- versions ---


@query("""SELECT event_id, row_number() OVER (ORDER BY CASE WHEN event_id % 3 = 0 THEN NULL ELSE event_id % 5 END NULLS FIRST,
 CASE WHEN event_id % 11 = 0 THEN 'ffffffffffffffffffff' ELSE lower(lpad(to_hex(user_id), 20, '0')) END, event_id, event_id % 11 <> 0) AS rn FROM events""")
def version_order(spark, sf_dir):
    incarnation = F.when(F.col("event_id") % 3 != 0, F.col("event_id") % 5)
    stamp = F.when(F.col("event_id") % 11 != 0, F.unhex(F.lpad(F.hex("user_id"), 20, "0")))
    rows = _t(spark, sf_dir, "events").select("event_id", version(incarnation, stamp, F.col("event_id")).alias("version"))
    return ranked(rows, [F.col("version").asc_nulls_first()]).select("event_id", "rn")


@query("SELECT event_id, CAST(row_number() OVER (PARTITION BY event_id // 1000 ORDER BY event_id) - 1 AS INTEGER) AS local_version FROM events")
def local_version(spark, sf_dir):
    """A commit has a thousand events at most, whatever the table's size: far fewer than its versions can tell apart."""
    rows = _t(spark, sf_dir, "events").select("event_id", F.floor(F.col("event_id") / 1000).alias("commit"))
    return with_local_versions(rows, ["commit"], ["event_id"]).select("event_id", "local_version")


# --- keys and indexes ---


@query("SELECT o_orderstatus AS status, o_orderkey AS orderkey FROM orders")
def pk_expr(spark, sf_dir):
    return primary_key(_t(spark, sf_dir, "orders"), [Element("status", "string", F.col("o_orderstatus")), Element("orderkey", "integer", F.col("o_orderkey"))])


@query("SELECT c_mktsegment AS segment, c_custkey FROM customer")
def index_scalar(spark, sf_dir):
    return Index("segment", (Element("segment", "string", F.col("c_mktsegment")),)).entries(_t(spark, sf_dir, "customer"), ["c_custkey"])


@query("SELECT nullif(event_type, 'view') AS kind, event_id FROM events")
def index_nullable(spark, sf_dir):
    return Index("kind", (Element("kind", "maybe_string", F.nullif(F.col("event_type"), F.lit("view"))),)).entries(_t(spark, sf_dir, "events"), ["event_id"])


@query("SELECT c_nationkey AS nation, c_custkey, c_name AS name, c_acctbal AS balance FROM customer")
def index_covering(spark, sf_dir):
    index = Index("nation", (Element("nation", "integer", F.col("c_nationkey")),), (Element("name", "string", F.col("c_name")), Element("balance", "double", F.col("c_acctbal"))))
    return index.entries(_t(spark, sf_dir, "customer"), ["c_custkey"])


@query("SELECT CASE WHEN event_id % 2 = 0 THEN 7 END AS v_incarnation, CAST(row_number() OVER (PARTITION BY CAST(ts AS DATE) ORDER BY event_id) - 1 AS INTEGER) AS v_local, event_id FROM events")
def index_versionstamp(spark, sf_dir):
    """A day of more events than one commit can number is several commits; the number returned counts on through the day's commits."""
    rows = with_commits(_t(spark, sf_dir, "events").select("event_id", F.to_date("ts").alias("day")), ["day"], ["event_id"])
    rows = with_local_versions(rows, ["day", "commit"], ["event_id"])
    stamp = F.struct(F.when(F.col("event_id") % 2 == 0, F.lit(7)).alias("incarnation_version"), F.col("local_version").alias("local_version"))
    entries = Index("v", (Element("v", "versionstamp", stamp),)).entries(rows, ["event_id", "commit"])
    return entries.select("v_incarnation", (F.col("commit") * (MOST_LOCAL + 1) + F.col("v_local")).alias("v_local"), "event_id")


@query("SELECT unnest(string_split(p_name, ' ')) AS word, p_partkey FROM part")
def index_fanout(spark, sf_dir):
    return Index("word", (Element("word", "string", F.col("item")),), fan_out=F.split("p_name", " ")).entries(_t(spark, sf_dir, "part"), ["p_partkey"])


@query("SELECT array_to_string(string_split(p_name, ' '), '|') AS words, p_partkey FROM part")
def index_list(spark, sf_dir):
    entries = Index("words", (Element("words", "list_of_string", F.split("p_name", " ")),)).entries(_t(spark, sf_dir, "part"), ["p_partkey"])
    return entries.select(F.array_join("words", "|").alias("words"), "p_partkey")


@query("SELECT c_custkey, c_name, c_mktsegment FROM customer WHERE c_mktsegment = 'BUILDING'")
def index_lookup_fetch(spark, sf_dir):
    customers = _t(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment")
    index = Index("segment", (Element("segment", "string", F.col("c_mktsegment")),))
    return index.fetch(index.entries(customers, ["c_custkey"]), customers, ["c_custkey"], TupleRange.all_of("BUILDING").predicate(["segment"]))


@query("""SELECT 'delete' AS change, c_mktsegment AS segment, c_custkey FROM customer WHERE c_custkey % 10 = 0 AND c_mktsegment <> 'MOVED'
 UNION ALL SELECT 'insert', 'MOVED', c_custkey FROM customer WHERE c_custkey % 10 = 0 AND c_mktsegment <> 'MOVED'""")
def index_maintenance(spark, sf_dir):
    customers = _t(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    moved = customers.withColumn("c_mktsegment", F.when(F.col("c_custkey") % 10 == 0, "MOVED").otherwise(F.col("c_mktsegment")))
    index = Index("segment", (Element("segment", "string", F.col("c_mktsegment")),))
    gone, new = changes(index.entries(customers, ["c_custkey"]), index.entries(moved, ["c_custkey"]))
    return gone.select(F.lit("delete").alias("change"), "*").unionByName(new.select(F.lit("insert").alias("change"), "*"))


# --- schemas and values ---


def _field(number: int, name: str, kind: str = "string", cardinality: str = D.OPTIONAL, **more) -> D.Field:
    return D.Field(number, name, kind, cardinality, more.pop("oneof", f"_{name}" if cardinality == D.OPTIONAL else None), **more)


def _message(*fields: D.Field, name: str = "cairn.Record", **more) -> D.Message:
    return D.Message(name, fields, **more)


WELL_FORMED: list[tuple[str, bool, list]] = [
    ("optional scalar", True, [_message(_field(1, "a"))]),
    ("repeated", True, [_message(_field(1, "a", "int64", D.REPEATED))]),
    ("map of string keys", True, [_message(_field(1, "a", "int32", D.MAP))]),
    ("recursive", True, [_message(_field(1, "a", "message:cairn.Record"))]),
    ("uuid", True, [_message(_field(1, "a", f"message:{D.UUID}"))]),
    ("unsigned", False, [_message(_field(1, "a", "uint32"))]),
    ("fixed unsigned in map", False, [_message(_field(1, "a", "fixed64", D.MAP))]),
    ("no presence", False, [_message(_field(1, "a", "string", D.PLAIN))]),
    ("integer map key", False, [_message(_field(1, "a", "string", D.MAP, map_key="int32"))]),
    ("reserved name", False, [_message(_field(1, f"{D.RESERVED_PREFIX}a"))]),
    ("map entry", False, [_message(_field(1, "a"), map_entry=True)]),
    ("well-known type", False, [_message(_field(1, "a", "bytes"), name=D.UUID)]),
    ("nested unsigned", False, [_message(_field(1, "a", "message:cairn.In")), _message(_field(1, "b", "uint64"), name="cairn.In")]),
]


@query("SELECT * FROM (VALUES " + ", ".join(f"('{n}', {str(ok).lower()})" for n, ok, _ in WELL_FORMED) + ") t(name, well_formed)")
def schema_wellformed(spark, sf_dir):
    rows = [(n, D.why_not_well_formed(D.Definitions.of(items), items[0].full_name) is None) for n, _, items in WELL_FORMED]
    return spark.createDataFrame(rows, "name string, well_formed boolean")


_E = D.Enumeration("cairn.Size", ((0, "NONE"), (1, "SMALL")))
_BASE = [_field(1, "a"), _field(2, "size", "enum:cairn.Size"), _field(3, "id", f"message:{D.UUID}"), _field(4, "list", "int32", D.REPEATED), _field(5, "self", "message:cairn.Record"), _field(6, "x", oneof="choice"), _field(7, "in", "message:cairn.In")]
_IN = _message(_field(1, "b"), name="cairn.In")


def _changed(drop: int | None = None, *new: D.Field, enum: D.Enumeration = _E, inner: D.Message = _IN) -> list:
    return [_message(*(f for f in _BASE if f.number != drop), *new), enum, inner]


EVOLUTIONS: list[tuple[str, bool, list]] = [
    ("same", True, _changed()),
    ("add optional field", True, _changed(None, _field(9, "new"))),
    ("add repeated field", True, _changed(None, _field(9, "new", "string", D.REPEATED))),
    ("look-alike for uuid", False, [*_changed(3, _field(3, "id", "message:cairn.UUID")), _message(_field(1, "value", "bytes"), name="cairn.UUID")]),
    ("field leaves oneof", False, _changed(6, _field(6, "x"))),
    ("drop field", False, _changed(1)),
    ("rename field", False, _changed(1, _field(1, "z", oneof="_a"))),
    ("string to bytes", False, _changed(1, _field(1, "a", "bytes"))),
    ("int32 to int64", False, _changed(4, _field(4, "list", "int64", D.REPEATED))),
    ("add enum value", True, _changed(enum=D.Enumeration("cairn.Size", (*_E.values, (2, "LARGE"))))),
    ("drop enum value", False, _changed(enum=D.Enumeration("cairn.Size", _E.values[:1]))),
    ("rename enum value", False, _changed(enum=D.Enumeration("cairn.Size", ((0, "NONE"), (1, "TINY"))))),
    ("self reference changes", False, [*_changed(5, _field(5, "self", "message:cairn.In"))]),
    ("rename nested field", False, _changed(inner=_message(_field(1, "c", oneof="_b"), name="cairn.In"))),
    ("rename nested type", False, [_message(*(f for f in _BASE if f.number != 7), _field(7, "in", "message:cairn.Inner")), _E, _message(_field(1, "b"), name="cairn.Inner")]),
    ("repeated to optional", False, _changed(4, _field(4, "list", "int32"))),
    ("optional to repeated", False, _changed(1, _field(1, "a", "string", D.REPEATED))),
]


@query("SELECT * FROM (VALUES " + ", ".join(f"('{n}', {str(ok).lower()})" for n, ok, _ in EVOLUTIONS) + ") t(name, evolvable)")
def schema_evolution(spark, sf_dir):
    old = D.Definitions.of([_message(*_BASE), _E, _IN])
    rows = [(n, D.is_evolvable(old, "cairn.Record", D.Definitions.of(items), items[0].full_name)) for n, _, items in EVOLUTIONS]
    return spark.createDataFrame(rows, "name string, evolvable boolean")


@query("SELECT c_custkey, c_custkey % 3 <> 0 AND c_custkey % 5 <> 0 AS admitted FROM customer")
def record_admission(spark, sf_dir):
    """The code knows two fields more than the stored schema, and some UUIDs have the wrong length."""
    size = F.when(F.col("c_custkey") % 5 == 0, 15).otherwise(16)
    rows = _t(spark, sf_dir, "customer").select("c_custkey", F.substring(F.unhex(F.md5("c_name")), F.lit(1), size).alias("id", metadata={"kind": "uuid"}), F.when(F.col("c_custkey") % 3 == 0, "set").alias("note"), F.array().cast("array<string>").alias("tags"))
    stored = T.StructType([T.StructField("c_custkey", T.LongType()), T.StructField("id", T.BinaryType(), metadata={"kind": "uuid"})])
    return rows.select("c_custkey", values.admitted(rows, stored).alias("admitted"))


_LEAVES = (("c_custkey", "int64", "c_custkey"), ("c_name", "string", "c_name"), ("c_nationkey", "int32", "c_nationkey"), ("c_mktsegment", "string", "nullif(c_mktsegment, 'BUILDING')"))


@query(" UNION ALL ".join(f"SELECT c_custkey, '{n}' AS path, '{t}' AS type, CAST({e} AS VARCHAR) AS value FROM customer" for n, t, e in _LEAVES) + " UNION ALL SELECT c_custkey, 'at', 'message_Place', '{}' FROM customer UNION ALL SELECT c_custkey, 'at.nation', 'int32', CAST(c_nationkey AS VARCHAR) FROM customer UNION ALL SELECT c_custkey, 'at.kind', 'enum_Kind', 'HOME:1' FROM customer")
def value_tree(spark, sf_dir):
    kind = F.struct(F.lit("HOME").alias("name"), F.lit(1).alias("number")).alias("kind", metadata={"enum": "Kind"})
    place = F.struct(F.col("c_nationkey").alias("nation"), kind).alias("at", metadata={"message": "Place"})
    rows = _t(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey", F.nullif(F.col("c_mktsegment"), F.lit("BUILDING")).alias("c_mktsegment"), place)
    return values.value_tree(rows, ["c_custkey"])


_NOTES = "SELECT c_custkey, [c_mktsegment, nullif(c_name, 'x')] AS notes FROM customer"


@query(f"""SELECT c_custkey, 'c_custkey' AS path, 'int64' AS type, CAST(c_custkey AS VARCHAR) AS value FROM customer
 UNION ALL SELECT c_custkey, 'notes', 'repeated_string', '[]' FROM ({_NOTES})
 UNION ALL SELECT c_custkey, 'notes[' || i || ']', 'string', notes[i + 1] FROM ({_NOTES}), (VALUES (0), (1)) t(i)
 UNION ALL SELECT c_custkey, 'at', 'map_message_Place', CASE WHEN c_custkey % 4 > 0 THEN '{{}}' END FROM customer
 UNION ALL SELECT c_custkey, 'at{{' || k || '}}', 'message_Place', '{{}}' FROM customer, (VALUES ('home'), ('work')) t(k) WHERE c_custkey % 4 > 0
 UNION ALL SELECT c_custkey, 'at{{' || k || '}}.nation', 'int32', CAST(c_nationkey + n AS VARCHAR) FROM customer, (VALUES ('home', 0), ('work', 1)) t(k, n) WHERE c_custkey % 4 > 0""")
def value_tree_nested(spark, sf_dir):
    """Every element of a list and every value of a map carries its own tag."""
    place = lambda n: F.struct((F.col("c_nationkey") + n).cast("int").alias("nation"))
    at = F.when(F.col("c_custkey") % 4 > 0, F.create_map(F.lit("home"), place(0), F.lit("work"), place(1))).alias("at", metadata={"element": {"message": "Place"}})
    rows = _t(spark, sf_dir, "customer").select("c_custkey", F.array("c_mktsegment", F.nullif("c_name", F.lit("x"))).alias("notes"), at)
    return values.value_tree(rows, ["c_custkey"])


@query("SELECT c_custkey, c_custkey % 3 <> 0 AND c_custkey % 5 <> 0 AS admitted FROM customer")
def record_admission_nested(spark, sf_dir):
    """The code knows a field more than the stored schema in a struct, and one in the structs of a list."""
    note = lambda n: F.when(F.col("c_custkey") % n == 0, "set").alias("note")
    rows = _t(spark, sf_dir, "customer").select("c_custkey", F.struct("c_name", note(3)).alias("who"), F.array(F.struct("c_nationkey"), F.struct("c_nationkey")).alias("plain"), F.array(F.struct("c_nationkey", note(5))).alias("places"))
    stored = T.StructType.fromDDL("c_custkey long, who struct<c_name:string>, plain array<struct<c_nationkey:int>>, places array<struct<c_nationkey:int>>")
    return rows.select("c_custkey", values.admitted(rows, stored).alias("admitted"))


def _uuid(text: Column) -> Column:
    return F.concat_ws("-", F.substring(text, 1, 8), F.substring(text, 9, 4), F.substring(text, 13, 4), F.substring(text, 17, 4), F.substring(text, 21, 12))


@query("SELECT c_custkey, md5(c_name) AS bytes, substr(md5(c_name), 1, 8) || '-' || substr(md5(c_name), 9, 4) || '-' || substr(md5(c_name), 13, 4) || '-' || substr(md5(c_name), 17, 4) || '-' || substr(md5(c_name), 21, 12) AS uuid FROM customer")
def uuid_roundtrip(spark, sf_dir):
    data = uuids.to_bytes(_uuid(F.md5("c_name")))
    return _t(spark, sf_dir, "customer").select("c_custkey", F.lower(F.hex(data)).alias("bytes"), uuids.to_text(data).alias("uuid"))
