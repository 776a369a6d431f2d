"""Session settings that the engine counts on."""

from __future__ import annotations

from pyspark.sql import SparkSession


def build(app: str = "tempora", master: str | None = None, **conf: str) -> SparkSession:
    """A session with UTC timestamps, AQE, Arrow and last-wins map keys; keyword arguments are further settings with _ for dots."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    base = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    }
    for k, v in {**base, **{k.replace("_", "."): v for k, v in conf.items()}}.items():
        b = b.config(k, v)
    return b.getOrCreate()
