"""Session factory with the settings the operators assume."""

from __future__ import annotations

from pyspark.sql import SparkSession


def build_session(app: str = "corpusloom", master: str | None = None, **settings: str) -> SparkSession:
    """UTC, ANSI and adaptive execution on; anything else is the cluster's choice (or ``settings``)."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC", "spark.sql.ansi.enabled": "true", "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true", "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    return builder.config(map=defaults | settings).getOrCreate()
