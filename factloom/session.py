"""A session with the settings that the engine's results depend on."""

from __future__ import annotations

from pyspark.sql import SparkSession

CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.speculation": "false",  # a second attempt would call a paid completer again
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(app: str = "factloom", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    return builder.config(map=CONF | conf).getOrCreate()
