"""Unique keys of writable tables, and the hash function of the registry."""

import pytest
from pyspark.sql import functions as F

from lakeweft.engine import Engine
from lakeweft.operators.dml import ConcurrentChange, ConstraintError, WritableTable

SCHEMA = "id bigint, code string, n int"


def rows(t):
    return sorted((tuple(r) for r in t.read().collect()), key=str)


def test_ignore_keeps_rows_of_null_keys(spark, tmp_path):
    t = WritableTable(spark, f"file://{tmp_path}/t", SCHEMA, primary_key=["id"], unique=[["code"]])
    t.insert(spark.createDataFrame([(1, None, 0), (2, None, 0), (3, None, 0), (4, "a", 0)], SCHEMA), ignore=True)
    assert len(rows(t)) == 4
    t.insert(spark.createDataFrame([(5, None, 1), (6, "a", 1), (4, "z", 1), (7, "b", 1), (8, "b", 2)], SCHEMA), ignore=True)
    assert rows(t) == sorted([(1, None, 0), (2, None, 0), (3, None, 0), (4, "a", 0), (5, None, 1), (7, "b", 1)], key=str)


def test_upsert_on_any_key(spark, tmp_path):
    t = WritableTable(spark, f"file://{tmp_path}/t", SCHEMA, primary_key=["id"], unique=[["code"]])
    t.insert(spark.createDataFrame([(1, "a", 0), (2, "b", 0), (3, None, 0)], SCHEMA))
    n = t.insert(spark.createDataFrame([(1, "x", 5), (9, "b", 6), (10, None, 7), (11, "c", 8)], SCHEMA), on_duplicate={"n": F.col("new.n")})
    assert n == 2
    assert rows(t) == sorted([(1, "a", 5), (2, "b", 6), (3, None, 0), (10, None, 7), (11, "c", 8)], key=str)


def test_a_refusal_changes_no_child(spark, tmp_path):
    parent = WritableTable(spark, f"file://{tmp_path}/p", "id bigint", primary_key=["id"])
    first, second = (WritableTable(spark, f"file://{tmp_path}/{c}", "p bigint") for c in "ab")
    first.refer("p", parent, "id", "cascade")
    second.refer("p", parent, "id", "restrict")
    for t, kind in ((parent, "id bigint"), (first, "p bigint"), (second, "p bigint")):
        t.insert(spark.createDataFrame([(1,)], kind))
    with pytest.raises(ConstraintError):
        parent.delete(F.col("id") == 1)
    assert rows(first) == rows(second) == rows(parent) == [(1,)]


def test_two_writers(spark, tmp_path):
    a = WritableTable(spark, f"file://{tmp_path}/t", "id bigint")
    b = WritableTable(spark, f"file://{tmp_path}/t", "id bigint")
    a._read()
    b._read()
    part = a._write(spark.createDataFrame([(1,)], "id bigint"))
    a._publish([part])
    with pytest.raises(ConcurrentChange):
        b._publish([])
    assert rows(b) == [(1,)]


def test_fnv_hash(spark):
    def fnv(text):
        h = 0xCBF29CE484222325
        for b in text.encode():
            h = (h ^ b) * 0x100000001B3 % (1 << 64)
        return f"{h:016x}"

    for text in ("", "a", "foobar", "straße"):
        assert Engine(spark, None).sql(f"SELECT FNV_HASH('{text}') AS h").first()["h"] == fnv(text)
