"""Topics of JSON records, from Kafka or from folders of text files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.times import from_millis, from_seconds
from millrace.schemas import CHANGE, CONFIG_CHANGE, LOG


def kafka_options(servers: str, topic: str, group: str, start: str = "latest") -> dict[str, str]:
    return {"kafka.bootstrap.servers": servers, "subscribe": topic, "kafka.group.id": group, "startingOffsets": start, "failOnDataLoss": "false"}


def read_topic(spark: SparkSession, servers: str, topic: str, group: str, start: str = "latest") -> DataFrame:
    """A stream of `value` and its `offset`; a null stays null."""
    return spark.readStream.format("kafka").options(**kafka_options(servers, topic, group, start)).load().selectExpr("cast(value as string) as value", "offset")


def read_topic_files(spark: SparkSession, path: str, files_per_batch: int = 1) -> DataFrame:
    """The same from text files, oldest first, without offsets: for tests and for replays."""
    return spark.readStream.format("text").option("maxFilesPerTrigger", files_per_batch).load(path)


def _parsed(raw: DataFrame, schema: str) -> DataFrame:
    """The record's fields, and all columns beside `value` (a topic's offset, say)."""
    return raw.select(F.from_json("value", schema).alias("_r"), *[c for c in raw.columns if c != "value"]).select("_r.*", *[c for c in raw.columns if c != "value"])


def parse_changes(raw: DataFrame) -> DataFrame:
    """database, table, type, ts, data, old."""
    return _parsed(raw, CHANGE)


def with_row_time(df: DataFrame, delay: str = "0 seconds") -> DataFrame:
    """Event time from `ts` in seconds."""
    return df.withColumn("row_time", from_seconds(F.col("ts"))).withWatermark("row_time", delay)


def parse_log(raw: DataFrame) -> DataFrame:
    return _parsed(raw, LOG)


def parse_page_log(raw: DataFrame, delay: str = "0 seconds") -> DataFrame:
    """common, page, ts and row_time, in whole seconds."""
    return parse_log(raw).select("common", "page", "ts", F.date_trunc("second", from_millis(F.col("ts"))).alias("row_time")).withWatermark("row_time", delay)


def parse_rows(raw: DataFrame, schema: str) -> DataFrame:
    """A fact topic read back as a table."""
    return _parsed(raw, schema)


def parse_config_changes(raw: DataFrame) -> DataFrame:
    """op, before, after of the configuration table's change stream."""
    return _parsed(raw, CONFIG_CHANGE)
