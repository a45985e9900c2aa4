"""Every query with a DuckDB twin against it, over the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest

from tracewell.plans import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{DATA}/{t}.parquet"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    return con


def rows(pdf):
    columns = sorted(pdf.columns)
    return columns, sorted(tuple("" if pd.isna(v) else str(float(v)) if isinstance(v, (int, float)) else str(v) for v in r) for r in pdf[columns].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, DATA).toPandas()
    if name not in ORACLES:
        assert len(got)
        return
    assert rows(got) == rows(duck.execute(ORACLES[name]).df())
