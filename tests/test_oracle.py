"""Every query that has SQL against DuckDB on the smallest tables."""

import duckdb
import numpy as np
import pandas as pd
import pytest

from lodestrata.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def cell(v):
    if v is None or v is pd.NaT or (isinstance(v, (float, np.floating)) and np.isnan(v)):
        return "null"
    if isinstance(v, (float, np.floating)):
        return f"{v:.6g}"
    if isinstance(v, (list, np.ndarray)):
        return "[" + ",".join(map(cell, v)) + "]"
    return str(v)


def rows(df):
    df = df[sorted(df.columns)]
    return list(df.columns), sorted(tuple(map(cell, r)) for r in df.itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query(spark, duck, name):
    assert rows(catalog.QUERIES[name](spark, SF).toPandas()) == rows(duck.sql(catalog.ORACLE_SQL[name]).df())


def test_streams_agree_with_batches(spark):
    a, b = (rows(catalog.QUERIES[n](spark, SF).toPandas()) for n in ("repeat_deferral", "repeat_deferral_batch"))
    assert a == b


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 50
    assert set(e.oracle_sql()) <= set(e.queries())
