"""Every query with SQL against DuckDB on the smallest tables."""

import datetime
import math
import os

import duckdb
import pytest

from millrace.queries import catalog

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return str(v) if isinstance(v, (datetime.date, datetime.datetime)) else v


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.execute(catalog.ORACLES[name])
    columns = [d[0] for d in want.description]
    df = catalog.QUERIES[name](spark, SF)
    assert sorted(df.columns) == sorted(columns)
    order = sorted(columns)
    rows = [tuple(plain(r[c]) for c in order) for r in df.collect()]
    expected = [tuple(plain(r[columns.index(c)]) for c in order) for r in want.fetchall()]
    key = lambda r: tuple((x is not None, str(x)) for x in r)
    assert sorted(rows, key=key) == sorted(expected, key=key)
    assert rows
