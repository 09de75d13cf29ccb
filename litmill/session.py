"""The Spark session that command-line runs and benchmarks use; on a cluster, submit's own settings hold."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def session(master: str | None = None, **conf: str) -> SparkSession:
    """UTC, adaptive execution; small shuffles only where the session is local."""
    b = SparkSession.builder.appName("litmill").config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    if master or "SPARK_MASTER" not in os.environ:
        b = b.master(master or "local[*]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false")
    for k, v in conf.items():
        b = b.config(k, v)
    return b.getOrCreate()
