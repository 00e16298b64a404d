"""Session settings that the engine is written for."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(app: str = "lakeloom", master: str | None = None, **more: str) -> SparkSession:
    """A UTC session with adaptive execution; more are further settings, with _ for the dots of their names."""
    conf = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true"}
    builder = SparkSession.builder.appName(app).config(map=conf | {k.replace("_", "."): v for k, v in more.items()})
    return (builder.master(master) if master else builder).getOrCreate()
