"""Aggregation beyond ``groupBy().agg()``: ordered folds, cached groups, custom aggregates."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def group_concat(value: Column, separator: str = ",", order: Sequence[Column] | None = None, distinct: bool = False) -> Column:
    """Values of a group as one string, in a set order (their own by default)."""
    text = value.cast("string")
    if order is None:
        items = F.array_sort(F.collect_set(text) if distinct else F.collect_list(text))
    else:
        pairs = F.array_sort(F.collect_list(F.struct(*(c.alias(f"k{i}") for i, c in enumerate(order)), text.alias("v"))))
        items = F.transform(pairs, lambda p: p["v"])
        items = F.array_distinct(items) if distinct else items
    return F.when(F.size(items) > 0, F.array_join(items, separator))


def reduce_aggregate(value: Column, neutral: Column, step: Callable[[Column, Column], Column], order: Column | None = None) -> Column:
    """A custom aggregate given as (reduce, neutral); with ``order`` the fold sees the values in that order."""
    if order is None:
        return F.aggregate(F.collect_list(value), neutral, step)
    pairs = F.array_sort(F.collect_list(F.struct(order.alias("k"), value.alias("v"))))
    return F.aggregate(pairs, neutral, lambda s, p: step(s, p["v"]))


def decimal_rounded(value: Column, scale: int) -> Column:
    """SUM or AVG rounded to the largest scale of its inputs."""
    return F.round(value, scale)


def salted_aggregate(table: DataFrame, keys: Sequence[str], partial: dict[str, Column], final: dict[str, Column], salts: int) -> DataFrame:
    """Two-step aggregate for measures without map-side combining: first by key and salt, then by key."""
    first = table.withColumn("__salt", F.pmod(F.xxhash64(*table.columns), F.lit(salts))).groupBy(*keys, "__salt").agg(*(c.alias(n) for n, c in partial.items()))
    return first.groupBy(*keys).agg(*(c.alias(n) for n, c in final.items()))


class GroupCache:
    """Grouped relations kept for reuse, keyed by their optimized plan."""

    def __init__(self):
        self._kept: dict[int, tuple[DataFrame, DataFrame]] = {}

    def get(self, frame: DataFrame) -> DataFrame:
        key = frame.semanticHash()
        found = self._kept.get(key)
        if found is not None and found[0].sameSemantics(frame):
            return found[1]
        kept = frame.persist()
        self._kept[key] = (frame, kept)
        return kept

    def invalidate(self) -> None:
        for _, kept in self._kept.values():
            kept.unpersist()
        self._kept.clear()
