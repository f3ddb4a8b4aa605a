"""Every registered query of the engine against its oracle SQL, on the smallest tables."""

import datetime
import math

import duckdb
import pytest

from lakeweft.catalog import DRIVER_TABLES
from lakeweft.plans import registry

FOLDER = "/root/testdata/sf0.001"
QUERIES, ORACLES = registry.queries(), registry.oracle_sql()
KINDS = {"int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "date": "DATE", "timestamp_ntz": "TIMESTAMP"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in DRIVER_TABLES:
        con.execute(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 4) + 0.0
    if isinstance(v, (datetime.date, datetime.datetime)):
        return str(v)
    return v


def rows(table, order):
    return sorted((tuple(plain(r[i]) for i in order) for r in table), key=repr)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_oracle(spark, duck, name):
    got = QUERIES[name](spark, FOLDER)
    want = duck.execute(ORACLES[name])
    names = [d[0] for d in want.description]
    kinds = {d[0]: str(d[1]) for d in want.description}
    assert sorted(got.columns) == sorted(names)
    for c, kind in got.dtypes:
        if kind in KINDS:
            assert KINDS[kind] == kinds[c], c
    order = sorted(names)
    assert rows(got.collect(), [got.columns.index(c) for c in order]) == rows(want.fetchall(), [names.index(c) for c in order])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_without_oracle_runs(spark, name):
    assert QUERIES[name](spark, FOLDER).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
