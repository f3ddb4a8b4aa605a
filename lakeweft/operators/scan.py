"""Scan operators: filter, map, reduce, ordered and limited scans, and statistics.

All of them only build a logical plan; pruning, pushdown, partial aggregation and top-k
heaps are Catalyst's.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Expr = str | Column


def _column(x: Expr) -> Column:
    return F.expr(x) if isinstance(x, str) else x


def scan(table: DataFrame, condition: Expr | None = None, columns: Sequence[Expr] | None = None, reduce: Sequence[Column] | None = None, outer: bool = False) -> DataFrame:
    """Filter, map, and optionally reduce a table.  ``outer`` gives one row of NULLs if nothing is found."""
    out = table if condition is None else table.filter(_column(condition))
    if columns is not None:
        out = out.select(*map(_column, columns))
    if reduce is not None:
        return out.agg(*reduce)
    if outer:
        one = table.sparkSession.range(1).select(F.lit(1).alias("__one"))
        out = one.join(out.withColumn("__one", F.lit(1)), "__one", "left").drop("__one")
    return out


def scan_batch(batch: DataFrame, table: DataFrame, on: Expr, how: str = "inner") -> DataFrame:
    """The scan repeated for each row of an outer batch: a join, whose strategy Catalyst picks."""
    return batch.join(table, _column(on), how)


def scan_exists(table: DataFrame, condition: Expr | None = None) -> bool:
    return not scan(table, condition).limit(1).isEmpty()


def table_empty(table: DataFrame) -> bool:
    return table.isEmpty()


def scan_order(table: DataFrame, order: Sequence[Column], limit: int | None = None, offset: int = 0, condition: Expr | None = None, per: Sequence[str] | None = None, columns: Sequence[Expr] | None = None) -> DataFrame:
    """Ordered scan with offset and limit, of the whole or of each partition ``per``.

    With ``per`` the rank filter lets Catalyst cut each partition early (window group limit).
    """
    out = table if condition is None else table.filter(_column(condition))
    if per:
        rank = F.row_number().over(Window.partitionBy(*per).orderBy(*order))
        out = out.withColumn("__rank", rank)
        if limit is not None:
            out = out.filter(F.col("__rank") <= offset + limit)
        out = out.filter(F.col("__rank") > offset).drop("__rank")
    else:
        out = out.orderBy(*order)
        if offset:
            out = out.offset(offset)
        if limit is not None:
            out = out.limit(limit)
    return out if columns is None else out.select(*map(_column, columns))


def scan_order_multi(tables: Sequence[DataFrame], order: Sequence[Column], limit: int | None = None, offset: int = 0) -> DataFrame:
    """One ordered scan over several tables of the same columns.

    Each is cut to its own first ``offset + limit`` rows before they meet.
    """
    cut = [t.orderBy(*order).limit(offset + limit) if limit is not None else t for t in tables]
    out = cut[0]
    for t in cut[1:]:
        out = out.unionByName(t)
    return scan_order(out, order, limit, offset)


def scan_order_batch_accept(table: DataFrame, accepted: DataFrame, key: Sequence[str], order: Sequence[Column], limit: int, offset: int = 0) -> DataFrame:
    """The first rows in order among those whose key a record set holds."""
    return scan_order(table.join(accepted.select(*key).distinct(), list(key), "left_semi"), order, limit, offset)


def scan_estimate(table: DataFrame) -> int:
    """Rows the optimizer expects; from statistics only, no scan."""
    stats = table._jdf.queryExecution().optimizedPlan().stats()
    if stats.rowCount().isDefined():
        return int(str(stats.rowCount().get()))
    width = max(1, sum(f.dataType.defaultSize() if hasattr(f.dataType, "defaultSize") else 8 for f in table.schema))
    return int(str(stats.sizeInBytes())) // width


def scan_selectivity_estimate(table: DataFrame, condition: Expr, fraction: float = 0.01, seed: int = 7) -> float | None:
    """Share of a sample's rows that match; None if the sample is empty.  Sampling is what this operator is for."""
    row = table.sample(fraction=fraction, seed=seed).agg(F.count("*").alias("n"), F.count_if(_column(condition)).alias("k")).first()
    return row["k"] / row["n"] if row["n"] else None


def planner_statistics(table: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(column_name, n_rows, n_nulls, n_distinct, min_value, max_value), in one pass over the table."""
    names = list(columns or table.columns)
    parts = [F.count("*").alias("n")]
    for i, c in enumerate(names):
        q = F.col(f"`{c}`")
        parts += [F.count_if(q.isNull()).alias(f"u{i}"), F.approx_count_distinct(q).alias(f"d{i}"), F.min(q).cast("string").alias(f"a{i}"), F.max(q).cast("string").alias(f"z{i}")]
    one = table.agg(*parts)
    rows = [F.struct(F.lit(c).alias("column_name"), F.col("n").alias("n_rows"), F.col(f"u{i}").alias("n_nulls"), F.col(f"d{i}").alias("n_distinct"), F.col(f"a{i}").alias("min_value"), F.col(f"z{i}").alias("max_value")) for i, c in enumerate(names)]
    return one.select(F.inline(F.array(*rows)))


def zero_source(spark, *columns: Expr) -> DataFrame:
    """A SELECT without a source: one row."""
    return spark.range(1).select(*map(_column, columns))
