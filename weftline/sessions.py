"""Sessions of a job's own: the same context and settings, but for a few, so that no other query of the caller's session is touched."""

from __future__ import annotations

from pyspark.sql import SparkSession


def derived(spark: SparkSession, settings: dict[str, str]) -> SparkSession:
    """A session with the settings of ``spark`` and these."""
    own = spark.newSession()
    for key, value in spark.conf.getAll.items():
        if own.conf.isModifiable(key):
            own.conf.set(key, value)
    for key, value in settings.items():
        own.conf.set(key, value)
    return own
