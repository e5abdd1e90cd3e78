"""A session with the settings the engine expects; a cluster's own settings win."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(name: str = "scriptorium", **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(name)
    base = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.execution.arrow.maxRecordsPerBatch": "2048",
        "spark.ui.showConsoleProgress": "false",
    }
    for k, v in (base | {k.replace("__", "."): v for k, v in conf.items()}).items():
        builder = builder.config(k, v)
    return builder.getOrCreate()
