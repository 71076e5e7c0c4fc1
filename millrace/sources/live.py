"""The routing configuration while jobs run: a versioned table that a stream of changes edits.

A micro-batch of changes is routed by the version that is newest when it first begins. The choice is logged by the batch's number, so a
batch that comes again is routed alike, whatever has changed since. The latest change of a key counts, in the order of the topic; `d` ends a
route, anything else sets it. A new route's table is created by the first batch that begins after it, as tables are by
DimensionTables.upsert_batch(); one whose route has ended stays.
"""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators import etl
from millrace.schemas import CONFIG_COLUMNS
from millrace.sinks import DimensionTables, route_topics
from millrace.sources.config import KEYS, config_snapshot
from millrace.tables import Pins, VersionedTable, change_order


class LiveConfig:
    """Of one kind of sinks, dim or dwd; rows of others are left out."""

    def __init__(self, spark: SparkSession, path: str, sink_type: str):
        self.spark, self.sink_type = spark, sink_type
        self.table, self.pins = VersionedTable(spark, f"{path.rstrip('/')}/routes"), Pins(spark, f"{path.rstrip('/')}/pins")
        self.table.create(list(CONFIG_COLUMNS), KEYS[sink_type])

    def _put(self, rows: DataFrame, source: str, batch: int) -> None:
        self.table.upsert(rows.withColumns({k: F.coalesce(k, F.lit("")) for k in KEYS[self.sink_type][1:]}), source, batch)

    def start(self, snapshot: DataFrame) -> None:
        """The configuration before all changes. Put once; a restarted job's counts for nothing."""
        rows = config_snapshot(snapshot, self.sink_type)
        self._put(rows.withColumns({self.table.GONE: F.lit(False), self.table.SEQ: change_order([F.lit(None).cast("string")])}), "start", 0)

    def edit(self, batch: DataFrame, number: int) -> None:
        """For foreachBatch of changes (op, before, after, and the topic's offset, if there)."""
        gone = F.coalesce(F.col("op") == "d", F.lit(False))
        row = F.when(gone, F.col("before")).otherwise(F.col("after"))
        place = F.col("offset") if "offset" in batch.columns else F.monotonically_increasing_id()
        rows = batch.select(row.alias("row"), gone.alias(self.table.GONE), change_order([F.lit(0), place], number).alias(self.table.SEQ))
        self._put(rows.filter(F.col("row.sink_type") == self.sink_type).select("row.*", self.table.GONE, self.table.SEQ), "changes", number)

    def now(self) -> DataFrame:
        return self.table.read()

    def of(self, reader: str, batch: int) -> DataFrame:
        """The configuration that routes a micro-batch of a job."""
        return self.table.read(self.pins.take(reader, batch, {"routes": self.table.version()})["routes"])

    def vacuum(self, keep: timedelta = timedelta(days=1)) -> None:
        self.table.vacuum(self.pins.held("routes"), keep)


def route_dimensions(config: LiveConfig, tables: DimensionTables, job: str = "dimensions", apply_deletes: bool = False):
    """For foreachBatch of cleaned changes: into the tables that the configuration names."""

    def route(batch: DataFrame, number: int) -> None:
        routes = config.of(job, number)
        tables.upsert_batch(etl.route_dim(batch, routes), number, routes, apply_deletes, job)

    return route


def route_facts(config: LiveConfig, path: str, job: str = "facts"):
    """For foreachBatch of cleaned changes: topics as folders of text. A batch that comes again replaces itself."""

    def route(batch: DataFrame, number: int) -> None:
        route_topics(etl.route_fact(batch, config.of(job, number))).write.mode("overwrite").partitionBy("topic").text(f"{path}/batch={number}")

    return route
