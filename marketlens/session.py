"""Session settings that the library relies on."""

from __future__ import annotations

from pyspark.sql import SparkSession


def build_session(name: str = "marketlens", **settings: str) -> SparkSession:
    """A session with adaptive execution on; cluster settings stay with the cluster."""
    builder = (
        SparkSession.builder.appName(name)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
    )
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
