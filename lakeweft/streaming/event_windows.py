"""Event-time windows over streams or tables: tumbling, sliding and session, with a watermark."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def windowed(rows: DataFrame, time: str, size: str, slide: str | None = None, keys: Sequence[str] = (), measures: Sequence[Column] = (), late: str | None = None) -> DataFrame:
    """Aggregates per window and keys.  On a stream ``late`` bounds how late an event may come."""
    timed = rows.withColumn(time, F.col(time).cast("timestamp"))
    if late is not None and rows.isStreaming:
        timed = timed.withWatermark(time, late)
    w = F.window(time, size, slide) if slide else F.window(time, size)
    out = timed.groupBy(w.alias("w"), *keys).agg(*(measures or [F.count("*").alias("n")]))
    return out.select(F.col("w.start").cast("timestamp_ntz").alias("window_start"), F.col("w.end").cast("timestamp_ntz").alias("window_end"), *(c for c in out.columns if c != "w"))


def sessions(rows: DataFrame, time: str, gap: str, keys: Sequence[str], measures: Sequence[Column] = (), late: str | None = None) -> DataFrame:
    """Session windows: events of a key no further apart than ``gap``."""
    timed = rows.withColumn(time, F.col(time).cast("timestamp"))
    if late is not None and rows.isStreaming:
        timed = timed.withWatermark(time, late)
    out = timed.groupBy(F.session_window(time, gap).alias("w"), *keys).agg(*(measures or [F.count("*").alias("n")]))
    return out.select(F.col("w.start").cast("timestamp_ntz").alias("session_start"), F.col("w.end").cast("timestamp_ntz").alias("session_end"), *(c for c in out.columns if c != "w"))


def gaps_and_islands(rows: DataFrame, time: str, gap_seconds: int, keys: Sequence[str]) -> DataFrame:
    """A batch session number per key by window functions."""
    w = Window.partitionBy(*keys).orderBy(time)
    seconds = F.unix_timestamp(F.col(time).cast("timestamp"))
    new = F.when(seconds - F.lag(seconds).over(w) <= gap_seconds, 0).otherwise(1)
    return rows.withColumn("__new", new).withColumn("session", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__new")


def watch(spark: SparkSession, folder: str, fmt: str = "text", schema: str | None = None) -> DataFrame:
    """Files of a folder as a stream, new ones as they come."""
    reader = spark.readStream.format(fmt)
    return (reader.schema(schema) if schema else reader).load(folder)


def drain(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """What a stream yields until all there is has been read, as an in-memory table."""
    q = stream.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.table(name)
