"""Session settings the reports expect."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    # Days, hours and minutes are taken in UTC.
    "spark.sql.session.timeZone": "UTC",
    # Bad casts and missing array elements raise instead of turning into NULL.
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Many small initial partitions, merged at run time from measured sizes.
    "spark.sql.adaptive.coalescePartitions.initialPartitionNum": "8000",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
    # Joins whose measured sides are small enough per task skip the sort.
    "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold": "64m",
    # Tables bucketed by user serve joins on user and day as they are.
    "spark.sql.requireAllClusterKeysForCoPartition": "false",
    "spark.ui.enabled": "false",
}


def build_session(
    app_name: str = "dayzero", master: str | None = None, **settings: str
) -> SparkSession:
    """A session with ``SETTINGS``; ``settings`` overrides them by full name
    (``**{"spark.sql.shuffle.partitions": "8"}``)."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **settings}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
