"""Spark sessions for the jobs."""

from __future__ import annotations

from pyspark.sql import SparkSession

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def prepare(spark: SparkSession) -> SparkSession:
    """One time zone for all dates and windows; and joins by an order and its line take rows where they are if both sides are dealt by order."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    return spark


def prepare_streams(spark: SparkSession) -> SparkSession:
    """Keyed state lives in RocksDB, which the state processors need."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    return prepare(spark)
