"""Record sets: lazy sets of one table's rows, with set algebra.

A set is a predicate, so union, intersection and complement are OR, AND and NOT in one scan;
a set projected through a join carries its keys and becomes a semi-join.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class RecordSet:
    """Rows of ``table`` for which ``member`` is true (NULL is not)."""

    def __init__(self, table: DataFrame, member: Column | str | None = None):
        self.table = table
        member = F.expr(member) if isinstance(member, str) else member
        self.member = F.lit(True) if member is None else F.coalesce(member, F.lit(False))

    def _same(self, other: RecordSet) -> None:
        if not self.table.sameSemantics(other.table):
            raise ValueError("record sets of different tables")

    def __or__(self, other: RecordSet) -> RecordSet:
        self._same(other)
        return RecordSet(self.table, self.member | other.member)

    def __and__(self, other: RecordSet) -> RecordSet:
        self._same(other)
        return RecordSet(self.table, self.member & other.member)

    def __sub__(self, other: RecordSet) -> RecordSet:
        self._same(other)
        return RecordSet(self.table, self.member & ~other.member)

    def __invert__(self) -> RecordSet:
        return RecordSet(self.table, ~self.member)

    def rows(self) -> DataFrame:
        return self.table.filter(self.member)

    def count(self) -> int:
        return self.rows().count()

    def scan(self, condition: Column | str) -> RecordSet:
        return self & RecordSet(self.table, condition)

    def project_join(self, keys: Sequence[str], target: DataFrame, target_keys: Sequence[str]) -> DataFrame:
        """Rows of ``target`` whose key occurs in this set; NULL keys match nothing."""
        source = self.rows().select(*(F.col(k).alias(f"__k{i}") for i, k in enumerate(keys))).distinct()
        on = [target[t] == source[f"__k{i}"] for i, t in enumerate(target_keys)]
        return target.join(source, on, "left_semi")

    def key_index(self, keys: Sequence[str]) -> DataFrame:
        """The set's distinct keys, kept for reuse."""
        return self.rows().select(*keys).distinct().persist()
