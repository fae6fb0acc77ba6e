"""SparkSession settings that every entry point of the package shares."""

from __future__ import annotations

from pyspark.sql import SparkSession


def build_session(app: str = "quern", master: str | None = None, **conf: str) -> SparkSession:
    """Return a session with adaptive execution, Arrow transfer and UTC time; ``conf`` wins over the defaults."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
    } | conf
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
