"""Session factory: UTC, ANSI-safe defaults, adaptive execution."""

from __future__ import annotations

from pyspark.sql import SparkSession


def get_session(app: str = "aerolith", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings every plan here relies on; `conf` overrides them."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.sources.partitionOverwriteMode": "dynamic",
        # the JVM never compiles methods beyond this; the index's formulas would run interpreted
        "spark.sql.codegen.hugeMethodLimit": "8000",
    } | conf
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
