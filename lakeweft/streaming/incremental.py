"""Incrementally kept groups: a cached GROUP BY that inserts, updates and deletes maintain.

State is one row per key with COUNT(*), and COUNT and SUM per measure, which changes can
take back.  MIN and MAX can't be taken back, so keys touched by deletions are recomputed
from the base table.  ``merge`` is meant for ``foreachBatch``: each batch writes a new
version named after its id, and a batch that comes again is passed over.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHANGE = "change"


class IncrementalGroups:
    """Groups by ``keys`` of ``measures``; ``base`` gives the table as it is now, for MIN and MAX after deletions."""

    def __init__(self, spark: SparkSession, folder: str, keys: Sequence[str], measures: Sequence[str], base: Callable[[], DataFrame] | None = None):
        self.spark, self.folder, self.keys, self.measures, self.base = spark, folder.rstrip("/"), list(keys), list(measures), base
        self.version: int | None = None
        self.seen: set[int] = set()

    def _partial(self, rows: DataFrame) -> DataFrame:
        sign = F.col(CHANGE).cast("long") if CHANGE in rows.columns else F.lit(1)
        out = [F.sum(sign).alias("n_rows")]
        for m in self.measures:
            known = F.when(F.col(m).isNotNull(), sign).otherwise(0)
            added = F.when(sign > 0, F.col(m))
            out += [F.sum(known).alias(f"n_{m}"), F.sum(F.coalesce(F.col(m).cast("double"), F.lit(0.0)) * sign).alias(f"sum_{m}"), F.min(added).alias(f"min_{m}"), F.max(added).alias(f"max_{m}"), F.max(F.when(sign < 0, F.lit(1)).otherwise(0)).alias(f"gone_{m}")]
        return rows.groupBy(*self.keys).agg(*out)

    def state(self) -> DataFrame | None:
        return None if self.version is None else self.spark.read.parquet(f"{self.folder}/v{self.version}")

    def merge(self, rows: DataFrame, batch_id: int) -> None:
        """Take in one batch; a ``change`` column of -1 marks rows that go."""
        if batch_id in self.seen:
            return
        new = self._partial(rows)
        old = self.state()
        both = new if old is None else new.unionByName(old.withColumns({f"gone_{m}": F.lit(0) for m in self.measures}))
        parts = [F.sum("n_rows").alias("n_rows")]
        for m in self.measures:
            parts += [F.sum(f"n_{m}").alias(f"n_{m}"), F.sum(f"sum_{m}").alias(f"sum_{m}"), F.min(f"min_{m}").alias(f"min_{m}"), F.max(f"max_{m}").alias(f"max_{m}"), F.max(f"gone_{m}").alias(f"gone_{m}")]
        merged = both.groupBy(*self.keys).agg(*parts).filter("n_rows > 0")  # keys without rows go
        if self.base is not None and self.measures:
            touched = merged.filter(" or ".join(f"gone_{m} = 1" for m in self.measures)).select(*self.keys)
            fresh = self.base().join(touched, self.keys, "left_semi").groupBy(*self.keys).agg(*(f(m).alias(f"{n}2_{m}") for m in self.measures for n, f in (("min", F.min), ("max", F.max))))
            merged = merged.join(fresh, self.keys, "left").withColumns({f"{n}_{m}": F.when(F.col(f"gone_{m}") == 1, F.col(f"{n}2_{m}")).otherwise(F.col(f"{n}_{m}")) for m in self.measures for n in ("min", "max")})
        keep = [*self.keys, "n_rows", *(f"{n}_{m}" for m in self.measures for n in ("n", "sum", "min", "max"))]
        nxt = 0 if self.version is None else self.version + 1
        merged.select(*keep).write.mode("overwrite").parquet(f"{self.folder}/v{nxt}")
        self.version = nxt
        self.seen.add(batch_id)

    def groups(self) -> DataFrame:
        """keys, n_rows, and for each measure n, sum, avg, min, max; NULL where a group has no value."""
        out = self.state()
        more = []
        for m in self.measures:
            n, s = F.col(f"n_{m}"), F.col(f"sum_{m}")
            more += [n, F.when(n > 0, s).alias(f"sum_{m}"), F.when(n > 0, s / n).alias(f"avg_{m}"), F.col(f"min_{m}"), F.col(f"max_{m}")]
        return out.select(*self.keys, "n_rows", *more)

    def follow(self, stream: DataFrame, checkpoint: str):
        """A streaming query that keeps the groups up to date with ``stream``; it ends when all there is has been read."""
        return stream.writeStream.foreachBatch(lambda rows, i: self.merge(rows, i)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
