"""Vector functions on ``array<float|double>`` columns, all in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; NULL if either has no length."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm)


def l2(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: F.pow(x.cast("double") - y.cast("double"), F.lit(2.0))), F.lit(0.0), lambda s, v: s + v))


def euclidean_compat(a: Column, b: Column) -> Column:
    """The root of the dot product, which the dialect calls EUCLIDEAN."""
    return F.sqrt(dot(a, b))


def nearest(table: DataFrame, vector: str, query: list[float], k: int, id_column: str, mode: str = "cosine") -> DataFrame:
    """The ``k`` rows nearest to one vector: one scan and a top-k heap per task."""
    q = F.array(*(F.lit(float(x)) for x in query))
    measure = {"cosine": cosine, "dot": dot, "l2": l2}[mode](F.col(vector), q)
    order = F.asc("score") if mode == "l2" else F.desc("score")
    return table.select(id_column, measure.alias("score")).orderBy(order, id_column).limit(k)
