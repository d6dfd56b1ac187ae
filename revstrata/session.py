"""A session with the settings that the library expects; any session in UTC will do."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(name: str = "revstrata", **conf: str) -> SparkSession:
    """AQE, skew joins and UTC; keyword arguments are further settings, with `__` for a dot."""
    b = SparkSession.builder.appName(name)
    own = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    } | {k.replace("__", "."): v for k, v in conf.items()}
    for k, v in own.items():
        b = b.config(k, v)
    return b.getOrCreate()
