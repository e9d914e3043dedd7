"""Every registered query against its SQL on the smallest tables."""

import datetime
import decimal

import duckdb
import pytest

from formlens.plans import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for t in TABLES.split():
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def plain(v):
    if isinstance(v, float):
        return round(v, 9) + 0.0
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return tuple(map(plain, v)) if isinstance(v, list) else v


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES) and len(QUERIES) >= 100


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_equals_sql(spark, duck, name):
    df, want = QUERIES[name](spark, SF), duck.sql(ORACLES[name])
    order = sorted(df.columns)
    assert order == sorted(want.columns)
    got = sorted(repr(tuple(plain(r[c]) for c in order)) for r in df.collect())
    assert got == sorted(repr(tuple(plain(r[want.columns.index(c)]) for c in order)) for r in want.fetchall())
