"""Every query against its SQL on the smallest tables."""

import math

import duckdb
import pandas as pd
import pytest

import __spark_entry__

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
OWN = {k: v for k, v in __spark_entry__.queries().items() if not k.startswith("op") and k != "pipeline"}
SQL = __spark_entry__.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


def rows(df):
    def text(x):
        return "~" if x is None or x is pd.NaT or x is pd.NA or (isinstance(x, float) and math.isnan(x)) else repr(x) if isinstance(x, float) else str(x)

    df = df[sorted(df.columns)].astype(object)
    return sorted(tuple(map(text, r)) for r in df.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(OWN))
def test_query(spark, duck, name):
    got = OWN[name](spark, FOLDER).toPandas()
    if name not in SQL:
        assert len(got)
        return
    want = duck.sql(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_streams_equal_the_batch_but_for_open_windows(spark):
    batch = {(r["window_start"], r["event_type"]): (r["n_events"], r["total"]) for r in OWN["batch_event_window"](spark, FOLDER).collect()}
    stream = {(r["window_start"], r["event_type"]): (r["n_events"], r["total"]) for r in OWN["stream_event_window"](spark, FOLDER).collect()}
    assert stream.items() <= batch.items()
    last = max(k[0] for k in stream)
    assert all((batch.keys() - stream.keys()) and k[0] > last for k in batch.keys() - stream.keys())
