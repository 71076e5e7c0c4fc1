"""The app log's job, on streams and as batches: dirty records apart, new visitors' marks repaired, and five topics of what is left."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions.times import from_millis
from millrace.operators import etl
from millrace.sources.topics import parse_log


def dirty_topic(raw: DataFrame) -> DataFrame:
    """topic and value of the records that are no JSON objects, for to_files() or to_kafka()."""
    return etl.split_dirty(raw.select("value"))[1].select(F.lit("topic_dirty").alias("topic"), "value")


def repaired_log(raw: DataFrame, repair: Callable[[DataFrame], DataFrame], delay: str = "0 seconds") -> DataFrame:
    """The log's records with repaired marks. repair: the stream's or the batch's repair_is_new(), over mid, is_new, time and event_id
    (here the record's text, which tells records of one time apart)."""
    good = etl.split_dirty(raw.select("value"))[0]
    r = F.from_json("value", "common struct<mid:string,is_new:string>, ts bigint").alias("r")
    rows = good.select(r, "value").select(F.col("r.common.mid").alias("mid"), F.col("r.common.is_new").alias("is_new"), from_millis(F.col("r.ts")).alias("time"), F.col("value").alias("event_id"))
    rows = repair(rows.withWatermark("time", delay) if raw.isStreaming else rows)
    if not raw.isStreaming:  # text is small for what its parsing costs: partitions joined by size alone would leave cores idle
        rows = rows.repartition(4 * rows.sparkSession.sparkContext.defaultParallelism)
    log = parse_log(rows.withColumnRenamed("event_id", "value"))
    common = F.when(F.col("common").isNotNull(), F.col("common").withField("is_new", F.col("is_new")))
    return log.withColumn("common", common).drop("mid", "is_new", "time")


def log_topics(log: DataFrame) -> DataFrame:
    """topic and value of errors, starts, pages, displays and actions: etl's branches, with each record read once for all five."""
    none, text_map = F.lit(None), "map<string,string>"
    branch = lambda name, display=none, action=none: F.struct(F.lit(name).alias("name"), display.cast(text_map).alias("display"), action.cast(text_map).alias("action"))
    empty = F.array().cast(f"array<struct<name:string,display:{text_map},action:{text_map}>>")
    when = lambda condition, branches: F.coalesce(F.when(condition, branches), empty)
    is_page = F.col("start").isNull()
    shown, acted = F.transform("displays", lambda d: branch("display", display=d)), F.transform("actions", lambda a: branch("action", action=a))
    branches = F.concat(when(F.col("err").isNotNull(), F.array(branch("error"))), F.when(is_page, F.array(branch("page"))).otherwise(F.array(branch("start"))), when(is_page, shown), when(is_page, acted))
    rows = log.withColumn("_b", F.explode(branches))
    record = lambda *without: F.to_json(F.struct(*[c for c in log.columns if c not in without]))
    name = F.col("_b.name")
    value = F.when(name == "error", record()).when(name == "start", record("err")).when(name == "page", record("start", "displays", "actions", "err"))
    value = value.when(name == "display", F.to_json(F.struct("common", "page", "ts", "_b.display"))).otherwise(F.to_json(F.struct("common", "page", "_b.action")))
    return rows.select(F.concat(F.lit("topic_"), name).alias("topic"), value.alias("value"))


def write_log_topics(batch: DataFrame, number: int, path: str) -> None:
    """For foreachBatch of repaired_log(): the state is passed once for all five topics. A batch that comes again replaces itself."""
    batch.persist()
    log_topics(batch).write.mode("overwrite").partitionBy("topic").text(f"{path}/batch={number}")
    batch.unpersist()
