"""Registered queries of the engine, each with its oracle SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lakeweft.plans import features, relational
from lakeweft.plans.kit import Query, ready

_PARTS = (relational, features)


def queries() -> dict[str, Query]:
    out: dict = {}
    for part in _PARTS:
        out |= part.queries()
    return {name: ready(query) for name, query in out.items()}


def oracle_sql() -> dict[str, str]:
    out: dict = {}
    for part in _PARTS:
        out |= part.oracle_sql()
    return out


def flagship(spark: SparkSession, folder: str) -> DataFrame:
    return relational.queries()["q5_wide_join"](spark, folder)
