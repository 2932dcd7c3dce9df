"""Session settings the library is designed for."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # a stack capture per Column call costs more than building the whole plan
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def build_session(
    app: str = "studyspark", master: str | None = None, shared: str | None = None, **extra: str
) -> SparkSession:
    """Session with the settings above; `extra` keys use `__` for dots.

    `shared` is a folder that all machines see, for tables between passes (spark.checkpoint.dir).
    """
    builder = SparkSession.builder.appName(app)
    if shared:
        builder = builder.config("spark.checkpoint.dir", shared)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **{k.replace("__", "."): v for k, v in extra.items()}}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
