"""The Spark session the engine expects."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(app: str = "noetica", **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution; `conf` adds settings, dots written as double underscores.

    Checkpoints of cut lineage are deleted once no DataFrame in use is made from them.
    """
    builder = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").config("spark.sql.adaptive.skewJoin.enabled", "true")
    builder = builder.config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()
