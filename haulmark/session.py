"""Session settings the package relies on."""

from __future__ import annotations

from pyspark.sql import SparkSession


def build_session(app_name: str = "haulmark", master: str | None = None, **conf: str) -> SparkSession:
    """A session with UTC wall-clock times and adaptive execution on.

    Cluster sizing (executors, shuffle partitions, checkpoint folder) is left to the
    submit command; ``conf`` entries use ``__`` for dots and win over the defaults.
    """
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
    )
    if master:
        builder = builder.master(master)
    for name, value in conf.items():
        builder = builder.config(name.replace("__", "."), value)
    return builder.getOrCreate()


def pin_utc(spark: SparkSession) -> None:
    """Make calendar arithmetic on a borrowed session use UTC."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
