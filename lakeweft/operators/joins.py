"""Joins that Spark has no one operator for: range, disjunctive, as-of, single, and IN as a value."""

from __future__ import annotations

import functools
import operator
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Tasks for each core where a join makes many pairs of few rows.
SPREAD = 4


def semi_join(left: DataFrame, right: DataFrame, on: Column | Sequence[str]) -> DataFrame:
    return left.join(right, on, "left_semi")


def anti_join(left: DataFrame, right: DataFrame, on: Column | Sequence[str]) -> DataFrame:
    return left.join(right, on, "left_anti")


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[tuple[str, str]], how: str = "inner") -> DataFrame:
    """Equality join in which NULL matches NULL."""
    return left.join(right, [left[a].eqNullSafe(right[b]) for a, b in keys], how)


def range_join(points: DataFrame, ranges: DataFrame, value: str, low: str, high: str, width: float | None = None) -> DataFrame:
    """``low <= value <= high`` as an equality join on bins, then the exact check.

    Each range is listed under the bins it touches.  ``width`` defaults to the mean range
    length, found in one aggregate, so a range of ordinary length touches about two bins; much longer ones are
    listed at doubling widths instead of under thousands of bins.
    """
    if width is None:
        mean = ranges.agg(F.avg(F.col(high).cast("double") - F.col(low).cast("double"))).first()[0]
        width = max(float(mean or 0), 1e-9)
    span = F.greatest(F.col(high).cast("double") - F.col(low).cast("double"), F.lit(width))
    level = F.greatest(F.ceil(F.log2(span / width)), F.lit(0)).cast("int")
    size = F.lit(width) * F.pow(F.lit(2.0), F.col("__level"))
    cell = lambda x: F.floor(F.col(x).cast("double") / size).cast("long")
    listed = ranges.filter(F.col(low) <= F.col(high)).withColumn("__level", level)
    listed = listed.withColumn("__bin", F.explode(F.sequence(cell(low), cell(high))))
    levels = listed.select("__level").distinct().agg(F.sort_array(F.collect_set("__level")).alias("__levels"))  # one row, at most 1100 levels of doubling
    placed = points.crossJoin(F.broadcast(levels)).withColumn("__level", F.explode("__levels")).drop("__levels").withColumn("__bin", cell(value))
    return placed.join(listed, ["__level", "__bin"]).filter(F.col(value).between(F.col(low), F.col(high))).drop("__level", "__bin")


def disjunctive_join(left: DataFrame, right: DataFrame, alternatives: Sequence[Sequence[tuple[str, str]]]) -> DataFrame:
    """Join on the OR of equality alternatives, each pair of rows once: a union of equality joins instead of a nested loop.

    An alternative passes over the pairs that an earlier one holds, so nothing has to be
    deduplicated: pairs can be many more than rows.  For the same reason the rows of ``left`` are dealt over all cores first.
    """
    left = left.repartition(SPREAD * left.sparkSession.sparkContext.defaultParallelism)
    made, earlier = None, F.lit(False)
    for keys in alternatives:
        holds = functools.reduce(operator.and_, [left[a] == right[b] for a, b in keys])
        part = left.join(right, holds & ~earlier)
        made = part if made is None else made.unionByName(part)
        earlier = earlier | F.coalesce(holds, F.lit(False))
    return made


def asof_join(left: DataFrame, right: DataFrame, left_time: str, right_time: str, by: Sequence[str]) -> DataFrame:
    """For each left row the latest right row of the same ``by`` at or before it.

    One sort by key and time over the union and a last-value window; no pairs are made.
    """
    extra = [c for c in right.columns if c not in by]
    a = left.withColumns({"__t": F.col(left_time), "__side": F.lit(1), "__right": F.lit(None).cast(right.select(F.struct(*extra)).schema[0].dataType)})
    b = right.select(*by, *(F.lit(None).cast(left.schema[c].dataType).alias(c) for c in left.columns if c not in by), F.col(right_time).alias("__t"), F.lit(0).alias("__side"), F.struct(*extra).alias("__right"))
    w = Window.partitionBy(*by).orderBy("__t", "__side").rowsBetween(Window.unboundedPreceding, 0)
    both = a.unionByName(b).withColumn("__found", F.last("__right", ignorenulls=True).over(w))
    return both.filter("__side = 1").select(*left.columns, *(F.col("__found")[c].alias(f"right_{c}" if c in left.columns else c) for c in extra))


def single_join(left: DataFrame, right: DataFrame, keys: Sequence[tuple[str, str]], value: str, name: str, first_by: Sequence[Column] | None = None) -> DataFrame:
    """The scalar subquery: one value of ``right`` per left row, NULL for none.

    More than one match is an error, unless ``first_by`` says which comes first (LIMIT 1).
    """
    by = [b for _, b in keys]
    if first_by is None:
        n = F.count("*")
        one = right.groupBy(*by).agg(F.when(n > 1, F.raise_error(F.lit("the scalar subquery has more than one row"))).otherwise(F.any_value(value)).alias(name))
    else:
        ranked = right.withColumn("__r", F.row_number().over(Window.partitionBy(*by).orderBy(*first_by))).filter("__r = 1")
        one = ranked.select(*by, F.col(value).alias(name))
    one = one.select(*(F.col(b).alias(f"__k{i}") for i, b in enumerate(by)), name)
    return left.join(one, [left[a] == one[f"__k{i}"] for i, (a, _) in enumerate(keys)], "left").drop(*(f"__k{i}" for i in range(len(keys))))


def in_value(left: DataFrame, probe: Column, right: DataFrame, element: str, name: str, negated: bool = False) -> DataFrame:
    """``probe IN (SELECT element ...)`` as a three-valued column.

    True on a match; NULL without one if the probe is NULL or the other side holds a NULL;
    false otherwise, and false for an empty other side even for a NULL probe.
    """
    facts = right.agg((F.count("*") > 0).alias("__any"), (F.count_if(F.col(element).isNull()) > 0).alias("__null"))  # one row
    keys = right.select(F.col(element).alias("__e")).filter("__e is not null").distinct().withColumn("__hit", F.lit(True))
    joined = left.withColumn("__p", probe).join(keys, F.col("__p") == F.col("__e"), "left").crossJoin(F.broadcast(facts))
    value = F.when(F.col("__hit"), True).when(~F.col("__any"), False).when(F.col("__p").isNull() | F.col("__null"), F.lit(None).cast("boolean")).otherwise(False)
    return joined.withColumn(name, ~value if negated else value).drop("__p", "__e", "__hit", "__any", "__null")


def salted_join(big: DataFrame, small: DataFrame, key: str, salts: int, how: str = "inner") -> DataFrame:
    """Equality join with a hot key of ``big`` spread over ``salts`` tasks; ``small`` is repeated as often."""
    left = big.withColumn("__salt", F.pmod(F.xxhash64(*big.columns), F.lit(salts)))
    right = small.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)).cast("array<bigint>")))
    return left.join(right, [key, "__salt"], how).drop("__salt")
