"""Spark sessions with settings that suit this library."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(app: str = "evidentia", **conf: str) -> SparkSession:
    """Adaptive execution on, UTC; anything else is left to the cluster. conf keys may use __ for dots."""
    builder = SparkSession.builder.appName(app).config("spark.sql.adaptive.enabled", "true").config("spark.sql.session.timeZone", "UTC")
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()
