"""Ordered computed columns and window helpers."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType, _parse_datatype_string


def whole_partition(measure: Column, per: Sequence[str]) -> Column:
    """An aggregate over the whole partition, whatever the order."""
    return measure.over(Window.partitionBy(*per))


def running(measure: Column, per: Sequence[str], order: Sequence[Column]) -> Column:
    return measure.over(Window.partitionBy(*per).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))


def top_n(table: DataFrame, per: Sequence[str], order: Sequence[Column], n: int, name: str = "rn") -> DataFrame:
    """The first ``n`` rows of each partition; the rank filter is pushed below the shuffle (window group limit)."""
    return table.withColumn(name, F.row_number().over(Window.partitionBy(*per).orderBy(*order))).filter(F.col(name) <= n)


def first_last(value: str, per: Sequence[str], order: Sequence[Column]) -> tuple[Column, Column]:
    w = Window.partitionBy(*per).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return F.first(value).over(w), F.last(value).over(w)


def ordered_fold(table: DataFrame, per: Sequence[str], order: Sequence[str], name: str, kind: str, start: Callable[[], object], step: Callable[[object, dict], tuple[object, object]]) -> DataFrame:
    """An ordered computed column: ``step(state, row) -> (state, value)`` down each partition.

    For folds that no window function expresses.  Rows are shuffled by ``per`` and sorted
    by Spark; a task then streams over them in batches with one state, so a partition
    never has to fit in memory.
    """
    schema = StructType([*table.schema.fields, StructField(name, _parse_datatype_string(kind), True)])
    fields = table.columns

    def run(batches):
        at, state = None, None
        for pdf in batches:
            values = []
            for row in pdf.to_dict("records"):
                key = tuple(row[c] for c in per)
                if at != key:
                    at, state = key, start()
                state, value = step(state, row)
                values.append(value)
            yield pdf[fields].assign(**{name: pd.Series(values, index=pdf.index, dtype="object")})

    dealt = table.repartition(*per) if per else table.coalesce(1)
    return dealt.sortWithinPartitions(*per, *order).mapInPandas(run, schema)
