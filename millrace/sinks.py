"""Sinks: topics, dimension tables and summary tables."""

from __future__ import annotations

from collections.abc import Callable
from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.ledger import append_once
from millrace.operators.summaries import with_ts
from millrace.shared import Folder
from millrace.tables import Pins, VersionedTable, change_order


def to_topic(df: DataFrame) -> DataFrame:
    """One JSON text for each row."""
    return df.select(F.to_json(F.struct("*")).alias("value"))


def to_keyed_topic(df: DataFrame, keys: list[str]) -> DataFrame:
    """key and value in JSON: the last value of a key counts, a null value deletes it."""
    return df.select(F.to_json(F.struct(*keys)).alias("key"), F.to_json(F.struct("*")).alias("value"))


def route_topics(routed: DataFrame) -> DataFrame:
    """Of routed facts: the topic by sink_table, and the payload without it."""
    return routed.select(F.concat(F.lit("topic_"), F.col("sink_table")).alias("topic"), F.to_json(F.struct(*[c for c in routed.columns if c != "sink_table"])).alias("value"))


def kafka_sink_options(servers: str, topic: str | None = None) -> dict[str, str]:
    return {"kafka.bootstrap.servers": servers} | ({"topic": topic} if topic else {})


def latest_per_key(df: DataFrame, keys: list[str], order: list[str], value: str = "value") -> DataFrame:
    """What a reader of a keyed topic sees in the end: the last row of each key, unless its value is null. An aggregation, so repeats
    are dropped before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    last = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("last"))
    return last.filter(F.col(f"last.{value}").isNotNull()).select(*keys, "last.*")


def to_files(df: DataFrame, path: str, checkpoint: str):
    """A writer of a stream of `value` (and `topic`, whose folders they go to) as text, the file form of a topic: read_topic_files() reads it."""
    out = df.writeStream.format("text").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return out.partitionBy("topic") if "topic" in df.columns else out


def to_kafka(df: DataFrame, servers: str, checkpoint: str, topic: str | None = None):
    """The same for Kafka; without a topic each row names its own."""
    return df.writeStream.format("kafka").options(**kafka_sink_options(servers, topic)).option("checkpointLocation", checkpoint).outputMode("append")


def dim_upsert(current: DataFrame, rows: DataFrame, pk: str, order: list[str], apply_deletes: bool = False) -> DataFrame:
    """A dimension table after rows (type, data map, order) are put into it: the latest of each key. A delete puts its row as well,
    unless apply_deletes. Rows without a key are left out. What is no number in `order` is the least."""
    columns = [c for c in current.columns]
    seq = F.struct(*[F.col(c).try_cast("long").alias(c) for c in order])
    new = rows.select(*[F.col("data")[c].alias(c) for c in columns], F.col("type").alias("_type"), seq.alias("_seq")).filter(F.col(pk).isNotNull())
    every = current.select(*columns, F.lit(None).cast("string").alias("_type"), F.lit(None).cast(new.schema["_seq"].dataType).alias("_seq")).unionByName(new)
    rank = F.struct(F.col("_seq").isNotNull(), "_seq")  # what is in the table comes before all
    last = every.groupBy(pk).agg(F.max_by(F.struct(*[c for c in columns if c != pk], "_type"), rank).alias("r"))
    if apply_deletes:
        last = last.filter(~F.coalesce(F.col("r._type") == "delete", F.lit(False)))
    return last.select(*[F.col(pk) if c == pk else F.col(f"r.{c}") for c in columns])


class DimensionTables:
    """Dimension tables by name, under a path: versioned tables, so that streams read them while others upsert them."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.pins = Pins(spark, f"{self.path}/pins")

    def _table(self, table: str) -> VersionedTable:
        return VersionedTable(self.spark, f"{self.path}/tables/{table}")

    def names(self) -> list[str]:
        return sorted(Folder(self.spark, f"{self.path}/tables").names())

    def create(self, table: str, columns: str, pk: str | None = None) -> None:
        """All columns text, from a comma list; nothing happens if the table is there. The key, `id` by default, must be a column."""
        self._table(table).create([c.strip() for c in columns.split(",")], [pk or "id"])

    def read(self, table: str, version: int | None = None) -> DataFrame:
        return self._table(table).read(version)

    def upsert(self, table: str, rows: DataFrame, pk: str = "id", order: tuple[str, ...] = ("ts", "offset"), apply_deletes: bool = False, source: str | None = None, batch: int | None = None) -> int:
        """Puts rows (type, data, order) into the table; the latest of each key counts, by the first column of `order`, then batch, then
        the others, whatever batch it comes in. Returns the table's version with them."""
        t = self._table(table)
        gone = F.coalesce(F.col("type") == "delete", F.lit(False)) & F.lit(apply_deletes)
        return t.upsert(rows.select(*[F.col("data")[c].alias(c) for c in t.columns()], gone.alias(t.GONE), change_order([F.col(c) for c in order], batch).alias(t.SEQ)), source, batch)

    def upsert_batch(self, batch: DataFrame, number: int, config: DataFrame, apply_deletes: bool = False, source: str = "changes") -> None:
        """For foreachBatch of routed changes: one small job for each table of the configuration. A batch that comes again changes nothing.
        Changes of one second count in the order of batches, then in the topic's, or in that of the rows where there are no offsets (files)."""
        batch = batch if "offset" in batch.columns else batch.withColumn("offset", F.monotonically_increasing_id())
        batch = batch.persist()
        for c in config.select("sink_table", "sink_columns", "sink_pk").distinct().collect():  # the configuration, not data
            self.create(c["sink_table"], c["sink_columns"], c["sink_pk"])
            self.upsert(c["sink_table"], batch.filter(F.col("sink_table") == c["sink_table"]), c["sink_pk"] or "id", apply_deletes=apply_deletes, source=source, batch=number)
        batch.unpersist()

    def pinned(self, reader: str, batch: int, tables: list[str] | None = None) -> dict[str, DataFrame]:
        """The tables as a micro-batch sees them: all at the newest versions of the moment at which it first began, and the same if it comes
        again. reader: the stream's name."""
        newest = {n: v for n in tables or self.names() if (v := self._table(n).version()) is not None}
        return {n: self.read(n, v) for n, v in self.pins.take(reader, batch, newest).items()}

    def with_tables(self, reader: str, write: Callable[[DataFrame, int, dict[str, DataFrame]], None], tables: list[str] | None = None) -> Callable[[DataFrame, int], None]:
        """For foreachBatch: write(batch, number, tables by name) with pinned tables. A join of a stream with read() itself would see the
        files of the query's start for ever."""
        return lambda batch, number: write(batch, number, self.pinned(reader, number, tables))

    def vacuum(self, keep: timedelta = timedelta(days=1)) -> None:
        """Deletes what no reader can read any more."""
        for n in self.names():
            self._table(n).vacuum(self.pins.held(n), keep)


def write_summary(df: DataFrame, batch: int, columns: list[str], path: str) -> None:
    """For foreachBatch of summaries: the sink's columns in its order, with the time of writing. A batch that comes again replaces itself."""
    with_ts(df).select(*columns).write.mode("overwrite").parquet(f"{path}/batch={batch}")


def write_summary_jdbc(df: DataFrame, batch: int, columns: list[str], options: dict[str, str], source: str = "summary") -> bool:
    """The same into a table of a database; a batch that comes again, or that was cut off half way, is there once. source: the stream's name."""
    return append_once(with_ts(df).select(*columns), source, batch, options)


def jdbc_summary_options(url: str, table: str, batch_size: int = 10_000) -> dict[str, str]:
    return {"url": url, "dbtable": table, "batchsize": str(batch_size), "isolationLevel": "NONE"}
