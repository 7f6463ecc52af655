"""Spark session with the settings every entry point of this package expects."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def get_session(master: str | None = None, app: str = "pixkin", **conf: str) -> SparkSession:
    """A session with AQE on, UTC and Arrow; ``conf`` overrides. On a cluster submit with your own settings and use
    ``SparkSession.builder.getOrCreate()`` instead: nothing here is required for correct results."""
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    } | conf
    builder = SparkSession.builder.appName(app).config(map=settings)
    if master or "SPARK_MASTER" in os.environ:
        builder = builder.master(master or os.environ["SPARK_MASTER"])
    return builder.getOrCreate()
