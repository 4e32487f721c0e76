"""Every registered query against its DuckDB SQL on the smallest tables, and the contract of the entry module."""

import math
import os

import duckdb
import pandas as pd
import pytest

from corvane import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no fixture tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if v is None or pd.isna(v):
        return "~"
    if isinstance(v, (int, float)) and not isinstance(v, bool):
        return f"{float(v):.8g}"
    return str(v).removesuffix(" 00:00:00")


def rows_of(frame):
    columns = sorted(frame.columns)
    return columns, sorted(tuple(plain(v) for v in r) for r in frame[columns].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_against_sql(spark, duck, name):
    got = rows_of(catalog.QUERIES[name](spark, SF).toPandas())
    assert got == rows_of(duck.sql(catalog.ORACLES[name]).df())
    spark.catalog.clearCache()


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_runs(spark, name):
    assert catalog.QUERIES[name](spark, SF).count() > 0
    spark.catalog.clearCache()


def test_entry(spark):
    import __spark_entry__

    assert {"current", "future", "entity"} == set(__spark_entry__.entry(spark).columns)
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert all(math.isfinite(r["current"]) for r in __spark_entry__.entry(spark).collect())
