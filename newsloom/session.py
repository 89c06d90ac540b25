"""Session settings."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(app: str = "newsloom", **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution; conf keys have `__` for dots."""
    builder = SparkSession.builder.appName(app)
    for key, value in {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true"}.items():
        builder = builder.config(key, value)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()
