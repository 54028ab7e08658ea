"""A session with the settings this library expects."""

from __future__ import annotations

from pyspark.sql import SparkSession


def get_session(app: str = "quern", master: str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """A UTC session with adaptive execution; on a cluster the submitted settings win."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.showConsoleProgress", "false")
    )
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return builder.getOrCreate()
