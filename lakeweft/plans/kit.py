"""Small helpers for registering queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lakeweft.catalog import DRIVER_TABLES
from lakeweft.engine import Compat, Engine
from lakeweft.plans.dialect import tokens
from lakeweft.session import import_path

Query = Callable[[SparkSession, str], DataFrame]


def engine_for(spark: SparkSession, folder: str, names: set[str], dialect: str = "mysql", compat: Compat | None = None) -> Engine:
    """An engine that knows just the named tables; no other footer is read."""
    e = Engine(spark, None, dialect, compat)
    e.catalog.add_parquet(folder, [n for n in DRIVER_TABLES if n in names])
    return e


def text(sql: str, dialect: str = "mysql", args=None, compat: Compat | None = None) -> Query:
    """A query given as dialect text."""
    names = {t.text.lower().strip("`") for t in tokens(sql, dialect) if t.kind in ("name", "qid")}
    return lambda spark, folder: engine_for(spark, folder, names, dialect, compat).sql(sql, args)


def ready(query: Query) -> Query:
    """The query, after its session's Python workers were told where this package is."""

    def run(spark: SparkSession, folder: str) -> DataFrame:
        import_path(spark)
        return query(spark, folder)

    return run


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")
