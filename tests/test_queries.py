"""Every registered query against its SQL in DuckDB, and rows from those without."""

import datetime
import math

import duckdb
import pytest

from ponding.plans import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SLOW = {"flood_safe_route"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return v if v is None or isinstance(v, (int, str, bool, datetime.datetime)) else str(v)


def table(rows, names):
    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted(names), sorted(([plain(r[k]) for k in order] for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(QUERIES.keys() - SLOW))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    got = table(df.collect(), df.columns)
    if name in ORACLE_SQL:
        want = duck.sql(ORACLE_SQL[name])
        assert got == table(want.fetchall(), want.columns)
    else:
        assert got[1]


def test_entry():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(QUERIES) <= set(entry.queries())
