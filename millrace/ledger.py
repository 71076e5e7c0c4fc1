"""Sinks that hold each batch of a source once, however often it is written and wherever a writer dies.

A folder topic: a batch's rows are files that nobody sees until an entry of the commit log names them, with their numbers of rows; an entry
is written whole or not at all, and holds the last batch of each source. Offsets follow from the log and the rows' places in their files.
A database table: tasks write a batch to a table of its own; one transaction moves its rows and notes the batch's number.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.shared import CommitLog

BATCHES = "millrace_batches"


class FolderTopic:
    """Records `value` (and `key`, null without one) with offsets from 0, without gaps, in the order of commits."""

    SCHEMA = "key string, value string"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.log = CommitLog(spark, f"{self.path}/log")
        self.log.put(0, {"first": 0, "rows": 0, "files": [], "sources": {}})

    def append(self, rows: DataFrame, source: str, batch: int) -> None:
        done = lambda e: e["sources"].get(source, -1) >= batch
        if done(self.log.get(max(self.log.numbers()))):
            return
        name = uuid.uuid4().hex
        key = F.col("key") if "key" in rows.columns else F.lit(None).cast("string")
        rows.select(key.alias("key"), "value").write.parquet(f"{self.path}/data/{name}")
        counts = self.spark.read.schema(self.SCHEMA).parquet(f"{self.path}/data/{name}").groupBy(F.col("_metadata.file_name").alias("f")).count().collect()  # a row a file
        files = sorted((f"{name}/{r['f']}", r["count"]) for r in counts)
        while True:
            newest = max(self.log.numbers())
            last = self.log.get(newest)
            if done(last):
                return
            entry = {"first": last["first"] + last["rows"], "rows": sum(n for _, n in files), "files": files, "sources": last["sources"] | {source: batch}}
            if self.log.put(newest + 1, entry):
                return

    def end(self) -> int:
        """The offset of the next record."""
        last = self.log.get(max(self.log.numbers()))
        return last["first"] + last["rows"]

    def _of(self, entries: list[dict]) -> DataFrame:
        """key, value, offset of the entries' records."""
        places, paths = [], []
        for e in entries:
            at = e["first"]
            for f, n in e["files"]:
                places.append((f.rpartition("/")[2], at))
                paths.append(f"{self.path}/data/{f}")
                at += n
        if not paths:
            return self.spark.createDataFrame([], f"{self.SCHEMA}, offset bigint")
        rows = self.spark.read.schema(self.SCHEMA).parquet(*paths).select("key", "value", F.col("_metadata.file_name").alias("_file"), F.col("_metadata.row_index").alias("_row"))
        start = self.spark.createDataFrame(places, "_file string, _at bigint")
        return rows.join(F.broadcast(start), "_file").select("key", "value", (F.col("_at") + F.col("_row")).alias("offset"))

    def read(self, start: int = 0, end: int | None = None) -> DataFrame:
        """Records with offsets from start to before end, as the topic stands."""
        entries = []
        for n in reversed(self.log.numbers()):
            e = self.log.get(n)
            if e["first"] + e["rows"] <= start:
                break
            entries += [e] if end is None or e["first"] < end else []
        rows = self._of(entries).filter(F.col("offset") >= start)
        return rows if end is None else rows.filter(F.col("offset") < end)

    def follow(self, write: Callable[[DataFrame, int], None], commits: int = 1):
        """A writer of a stream over the topic, to be given a checkpoint and started: write(records, number) for each micro-batch of so many
        commits. It follows the log, so what isn't committed is never seen."""

        def each(batch: DataFrame, number: int) -> None:
            write(self._of([json.loads(r["value"]) for r in batch.collect()]), number)  # entries, not records

        return self.spark.readStream.format("text").option("wholetext", "true").option("maxFilesPerTrigger", commits).load(f"{self.path}/log").writeStream.foreachBatch(each)


class _Database:
    """A connection from the driver, for the few statements that end a batch."""

    def __init__(self, spark: SparkSession, options: dict[str, str]):
        jvm, gateway = spark._jvm, spark.sparkContext._gateway
        properties = jvm.java.util.Properties()
        for k, v in options.items():
            properties.setProperty(k, v)
        if "driver" in options:  # through Spark's class loader, which knows added jars
            loader = jvm.java.lang.Thread.currentThread().getContextClassLoader()
            made = loader.loadClass(options["driver"]).getDeclaredConstructor(gateway.new_array(jvm.java.lang.Class, 0)).newInstance(gateway.new_array(jvm.java.lang.Object, 0))
        else:
            made = jvm.java.sql.DriverManager.getDriver(options["url"])
        self.connection: Any = made.connect(options["url"], properties)
        self.quote = jvm.org.apache.spark.sql.jdbc.JdbcDialects.get(options["url"]).quoteIdentifier

    def __enter__(self) -> _Database:
        self.connection.setAutoCommit(False)
        return self

    def __exit__(self, kind, error, trace) -> None:
        if kind is None:
            self.connection.commit()
        else:
            self.connection.rollback()
        self.connection.close()

    def run(self, sql: str, *values: Any) -> int:
        statement = self.connection.prepareStatement(sql)
        for i, v in enumerate(values, 1):
            statement.setObject(i, v)
        out = statement.executeUpdate()
        statement.close()
        return out

    def has(self, table: str) -> bool:
        names = self.connection.getMetaData()
        return any(names.getTables(None, None, n, None).next() for n in {table, table.upper(), table.lower()})

    def has_batch(self, source: str, batch: int) -> bool:
        statement = self.connection.prepareStatement(f"select batch from {BATCHES} where source = ? and batch = ?")
        statement.setString(1, source)
        statement.setLong(2, batch)
        found = statement.executeQuery().next()
        statement.close()
        return found


def append_once(df: DataFrame, source: str, batch: int, options: dict[str, str]) -> bool:
    """Appends a batch to the table options["dbtable"]; False, and nothing else, if this batch of the source is in it. The table is made if
    there is none. Only numbers of batches and statements pass the driver."""
    spark, table = df.sparkSession, options["dbtable"]
    with _Database(spark, options) as db:
        if not db.has(BATCHES):
            db.run(f"create table {BATCHES} (source varchar(200) not null, batch bigint not null, primary key (source, batch))")
        if db.has_batch(source, batch):
            return False
        there = db.has(table)
    if not there:
        df.limit(0).write.format("jdbc").options(**options).mode("append").save()
    stage = f"{table}_stage_{''.join(c if c.isalnum() else '_' for c in source)}"
    df.write.format("jdbc").options(**(options | {"dbtable": stage})).mode("overwrite").save()
    with _Database(spark, options) as db:
        columns = ", ".join(db.quote(c) for c in df.columns)
        if done := not db.has_batch(source, batch):
            db.run(f"insert into {BATCHES} (source, batch) values (?, ?)", source, batch)  # its key stops a second writer
            db.run(f"insert into {table} ({columns}) select {columns} from {stage}")
        db.run(f"drop table {stage}")
    return done
