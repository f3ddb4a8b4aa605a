"""Sessions: one factory for local work, and an engine session with the dialects' settings."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import SparkSession

#: Settings of an engine session.  Non-ANSI arithmetic gives NULL for x/0 and for casts of
#: odd text, as both dialects want; the driver's own session stays as it is.
ENGINE_CONF = {
    "spark.sql.ansi.enabled": "false",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.cbo.enabled": "true",
    "spark.sql.cbo.joinReorder.enabled": "true",
}


def import_path(spark: SparkSession) -> None:
    """Let Python workers find this package where the driver found it, whatever their working folder is."""
    root = str(Path(__file__).resolve().parents[1])
    known = spark.sparkContext.environment.get("PYTHONPATH", "")
    if root not in known.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(filter(None, [root, known]))


def local_session(cores: int | str = "*", partitions: int = 8, **conf: str) -> SparkSession:
    builder = SparkSession.builder.master(f"local[{cores}]").appName("lakeweft").config("spark.sql.shuffle.partitions", str(partitions))
    for k, v in ({"spark.ui.enabled": "false", "spark.sql.session.timeZone": "UTC"} | conf).items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def engine_session(spark: SparkSession) -> SparkSession:
    """A session with its own settings and views over the same context and cache."""
    own = spark.newSession()
    for k in ("spark.sql.shuffle.partitions",):
        own.conf.set(k, spark.conf.get(k))
    for k, v in ENGINE_CONF.items():
        own.conf.set(k, v)
    return own
