"""Session settings that the queries rely on."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(app: str = "iqlake", **conf: str) -> SparkSession:
    """A session in UTC with ANSI arithmetic and adaptive plans; other settings come from ``conf`` or the cluster."""
    builder = SparkSession.builder.appName(app)
    fixed = {"spark.sql.session.timeZone": "UTC", "spark.sql.ansi.enabled": "true", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true"}
    return builder.config(map={**fixed, **conf}).getOrCreate()
