"""Every query of the subpackage on the smallest tables: the columns, types and whole results that its contract names."""

import duckdb
import pytest

from cairn.llm import queries
from pyspark.sql import functions as F

pytest.importorskip("public_tokenizers")

CONTRACTS = {
    "op1_secret_scan": ("documents", "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string"),
    "op2_language_id": ("documents", "doc_id bigint, held_out boolean, lang_pred string, score double"),
    "op3_line_dedup": ("documents", "doc_id bigint, n_lines bigint, n_dropped bigint, kept_sha256 string"),
    "op4_warc_round_trip": ("pages", "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint"),
    "op6_best_fit_packing": (None, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint"),
    "op7_toxicity": ("documents", "doc_id bigint, held_out boolean, score double, predicted int"),
    "op8_nearest_neighbours": (None, "query_id bigint, rank int, vec_id bigint, score double"),
    "op9_token_id_files": ("documents", "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint"),
    "op10_ngram_jaccard_join": ("documents", "doc_id bigint, n_shingles bigint, component_id bigint"),
}
BOUNDS = {"op6_best_fit_packing": {"sf0.001": 193, "sf0.01": 964}}


@pytest.fixture(scope="module")
def results(spark, data):
    return {name: queries.queries()[name](spark, data).persist() for name in CONTRACTS}


@pytest.mark.parametrize("name", CONTRACTS)
def test_contract(spark, data, results, name):
    table, columns = CONTRACTS[name]
    got = results[name]
    assert [f"{n} {t}" for n, t in got.dtypes[: columns.count(",") + 1]] == columns.split(", ")
    if table:
        key = "page_id" if table == "pages" else "doc_id"
        want = spark.read.parquet(f"{data}/{table}.parquet").select(key)
        assert got.select(key).exceptAll(want).isEmpty() and want.exceptAll(got.select(key)).isEmpty()
    for c in ("held_out", "predicted", "score", "sequence_id", "ids_crc32", "component_id"):
        assert c not in got.columns or got.filter(F.col(c).isNull()).isEmpty()


def test_every_query_has_a_contract(spark, data):
    assert set(queries.queries()) == {*CONTRACTS, "op5_benchmark_decontamination"}
    assert queries.op5_benchmark_decontamination(spark, data).columns[:2] == ["doc_id", "item_id"]
    assert set(queries.oracle_sql()) <= set(CONTRACTS)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_sequences_are_few(spark, data, sf):
    """No more than best fit over single pieces needs on these tables; the tokens alone need 192 and 962."""
    got = queries.op6_best_fit_packing(spark, data.replace("sf0.001", sf))
    sums = got.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("end"), F.count_distinct("offset").alias("k"), F.count("*").alias("m"))
    assert sums.filter("n > 1024 or n <> end or k <> m").isEmpty()
    assert sums.count() <= BOUNDS["op6_best_fit_packing"][sf]


def test_held_out_accuracy(spark, data, results):
    """Languages of the documents that the fit doesn't see."""
    lang = spark.read.parquet(f"{data}/documents.parquet").filter("lang is not null").select("doc_id", "lang")
    held = results["op2_language_id"].filter("held_out and lang_pred <> 'und'").join(lang, "doc_id")
    assert held.count() > 20 and held.filter("lang = lang_pred").count() >= 0.95 * held.count()


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_same_as_sql(spark, data, name, sf):
    d, con = data.replace("sf0.001", sf), duckdb.connect()
    for t in ("documents", "pages"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{d}/{t}.parquet'")
    want = con.sql(queries.oracle_sql()[name])
    got = queries.queries()[name](spark, d).select(*want.columns)
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want.fetchall()))
