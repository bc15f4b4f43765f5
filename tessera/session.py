"""Sessions with the settings that the engine expects."""

from __future__ import annotations

from pyspark.sql import SparkSession


def build_session(name: str = "tessera", master: str | None = None, partitions: int | None = None, **settings: str) -> SparkSession:
    """A session with adaptive execution on and UTC; cluster settings given otherwise are left alone."""
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    if partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(partitions))
    builder = builder.config("spark.sql.adaptive.enabled", "true").config("spark.sql.session.timeZone", "UTC")
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
