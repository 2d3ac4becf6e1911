"""Session settings the engine is tuned for."""

from __future__ import annotations

from pyspark.sql import SparkSession


def build_session(app: str = "rankspark", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution and Arrow; ``conf`` keys use ``__`` for dots."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    settings |= {k.replace("__", "."): v for k, v in conf.items()}
    for k, v in settings.items():
        b = b.config(k, v)
    return b.getOrCreate()
