"""Every registered query against its DuckDB counterpart on the smallest tables."""

import duckdb
import pandas as pd
import pytest

from cairn.queries import QUERIES, SQL

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    return con


def rows(df: pd.DataFrame) -> list[str]:
    plain = lambda v: None if pd.isna(v) else int(v) if isinstance(v, float) and v == int(v) else v
    return sorted(repr([plain(v) for v in r]) for r in df[sorted(df.columns)].astype(object).values.tolist())


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, data, duck, name):
    want = duck.sql(SQL[name]).df()
    got = QUERIES[name](spark, data).toPandas()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


RECORDS = [f"record_{x}" for x in "split header load scan_forward scan_reverse limit limit_kv delete save_overwrite corruption scan_until_corrupt".split()]


@pytest.fixture(scope="module")
def long_texts(tmp_path_factory):
    """Records of more than 100 chunks of the queries, up to the reference's 10,000,000 bytes."""
    d = tmp_path_factory.mktemp("long")
    sizes = {0: 10, 1: 409_601, 2: 136_534, 4: 10_000_000, 5: 1_200_000, 6: 0, 60: 700_000, 61: 5, 63: 900_000, 67: 3_333_333, 68: 2}
    pd.DataFrame({"doc_id": list(sizes), "text": [("%d word " % i * (n // 6 + 1))[:n] for i, n in sizes.items()]}).to_parquet(d / "documents.parquet")
    pd.DataFrame({"doc_id": [2, 61, 67]}).to_parquet(d / "labels.parquet")
    return str(d)


@pytest.mark.parametrize("name", RECORDS)
def test_long_records(spark, long_texts, name):
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{long_texts}/{t}.parquet'")
    assert rows(QUERIES[name](spark, long_texts).toPandas()) == rows(con.sql(SQL[name]).df())


def test_entry(spark, data):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0


def test_busy_days(spark, tmp_path):
    """More events in a day than a commit has local versions."""
    n = 70_000
    day = ["2024-01-02"] * (n - 5) + ["2024-01-01"] * 3 + [None] * 2
    pd.DataFrame({"event_id": [n - i for i in range(n)], "ts": pd.to_datetime(day).astype("datetime64[us]")}).to_parquet(tmp_path / "events.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    want = con.sql(SQL["index_versionstamp"]).df()
    assert want["v_local"].max() == n - 6
    assert rows(QUERIES["index_versionstamp"](spark, str(tmp_path)).toPandas()) == rows(want)
