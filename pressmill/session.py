"""A session with what the engine relies on."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: The zone that timestamps without one are in; it has no daylight saving time.
NEWS_ZONE = "+05:30"


def session(name: str = "pressmill", zone: str = NEWS_ZONE, **conf: str) -> SparkSession:
    builder = (
        SparkSession.builder.appName(name)
        .config("spark.sql.session.timeZone", zone)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.sources.partitionOverwriteMode", "dynamic")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()
