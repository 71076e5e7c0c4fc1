"""The routing configuration and the dictionary."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.schemas import CONFIG_COLUMNS

KEYS = {"dim": ["source_table"], "dwd": ["source_table", "source_type"]}


def read_jdbc(spark: SparkSession, url: str, table: str, **options: str) -> DataFrame:
    return spark.read.format("jdbc").options(url=url, dbtable=table, **options).load()


def config_snapshot(config: DataFrame, sink_type: str) -> DataFrame:
    return config.filter(F.col("sink_type") == sink_type).select(*CONFIG_COLUMNS)


def config_fold(snapshot: DataFrame, changes: DataFrame, sink_type: str) -> DataFrame:
    """The configuration after all changes (op, before, after, seq): `d` takes the key of `before` out, anything else puts `after`. The
    latest change of a key counts; the snapshot comes before all."""
    keys = KEYS[sink_type]
    row = F.when(F.col("op") == "d", F.col("before")).otherwise(F.col("after"))
    new = changes.select(row.alias("row"), (F.col("op") != "d").alias("live"), "seq").filter(F.col("row.sink_type") == sink_type)
    start = config_snapshot(snapshot, sink_type).select(F.struct(*CONFIG_COLUMNS).alias("row"), F.lit(True).alias("live"), F.lit(-1).cast("long").alias("seq"))
    every = start.unionByName(new.select("row", "live", F.col("seq").cast("long")))
    last = every.groupBy(*[F.col(f"row.{k}").alias(k) for k in keys]).agg(F.max_by(F.struct("row", "live"), "seq").alias("m"))
    return last.filter("m.live").select("m.row.*")
