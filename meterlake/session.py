"""The session that reports and tests use."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(app: str = "meterlake", cores: int | None = None, memory: str = "8g", **conf: str) -> SparkSession:
    """A UTC session with adaptive execution. Without ``cores`` the master comes from the environment, as on a cluster."""
    builder = SparkSession.builder.appName(app)
    if cores:
        builder = builder.master(f"local[{cores}]").config("spark.sql.shuffle.partitions", str(cores)).config("spark.driver.memory", memory)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.ui.showConsoleProgress": "false",
        "spark.ui.enabled": "false",
        "spark.sql.python.filterPushdown.enabled": "true",
    } | conf
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
