"""Cleaning, splitting and routing of records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions.values import changed_to, is_empty, is_json, is_json_object, keep_keys
from millrace.sources.topics import parse_changes


def non_empty(raw: DataFrame, made_here: bool = False) -> DataFrame:
    """Without tombstones and empty records. made_here: for values that the same plan writes as JSON. Spark moves a filter below what makes
    them, so each would be made twice, for the filter and to be read."""
    if not made_here:
        return raw.filter(~is_empty(F.col("value")))
    kept = F.explode(F.when(~is_empty(F.col("value")), F.array("value"))).alias("value")
    return raw.select(*[kept if c == "value" else c for c in raw.columns])


def dim_etl(raw: DataFrame) -> DataFrame:
    """Changes for dimensions: JSON only, without the marks around a bootstrap. A record without a type passes."""
    marks = F.coalesce(F.col("type").isin("bootstrap-start", "bootstrap-complete"), F.lit(False))
    return parse_changes(non_empty(raw).filter(is_json(F.col("value")))).filter(~marks)


def fact_etl(raw: DataFrame) -> DataFrame:
    """Changes for facts: JSON only, nothing of a bootstrap, and no record without a type."""
    return parse_changes(non_empty(raw).filter(is_json(F.col("value")))).filter(~F.col("type").startswith("bootstrap-"))


def split_dirty(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """JSON objects, and all other records as they were."""
    full = non_empty(raw)
    return full.filter(is_json_object(F.col("value"))), full.filter(~is_json_object(F.col("value")))


def mark_dirty(raw: DataFrame, mark: str = "dirty") -> DataFrame:
    """split_dirty() for those who need both at once: all records that aren't empty, read once, with a mark."""
    return non_empty(raw).withColumn(mark, ~is_json_object(F.col("value")))


def _small(config: DataFrame) -> DataFrame:
    """A configuration has a row for each table, not for each change. Its size is unknown to Spark, which else would sort all changes by
    their few tables' names, each table's in one task."""
    return F.broadcast(config)


def route_dim(changes: DataFrame, config: DataFrame) -> DataFrame:
    """sink_table, type, data with the configured columns, of changes in configured tables; and ts and offset, if there, which tell
    their order."""
    c = config.select(F.col("source_table").alias("table"), "sink_table", "sink_columns")
    extra = [x for x in ("ts", "offset") if x in changes.columns]
    return changes.join(_small(c), "table").select("sink_table", "type", keep_keys(F.col("data"), F.col("sink_columns")).alias("data"), *extra)


def route_fact(changes: DataFrame, config: DataFrame) -> DataFrame:
    """sink_table, data with the configured columns, ts, of changes of configured tables and types."""
    c = config.select(F.col("source_table").alias("table"), F.col("source_type").alias("type"), "sink_table", "sink_columns")
    return changes.join(_small(c), ["table", "type"]).select("sink_table", keep_keys(F.col("data"), F.col("sink_columns")).alias("data"), "ts")


def error_branch(log: DataFrame) -> DataFrame:
    return log.filter(F.col("err").isNotNull())


def start_branch(log: DataFrame) -> DataFrame:
    return log.filter(F.col("start").isNotNull()).drop("err")


def page_branch(log: DataFrame) -> DataFrame:
    return log.filter(F.col("start").isNull()).drop("start", "displays", "actions", "err")


def display_branch(log: DataFrame) -> DataFrame:
    return log.filter(F.col("start").isNull()).select("common", "page", "ts", F.explode("displays").alias("display"))


def action_branch(log: DataFrame) -> DataFrame:
    return log.filter(F.col("start").isNull()).select("common", "page", F.explode("actions").alias("action"))


def rows_of(changes: DataFrame, table: str, *types: str) -> DataFrame:
    of = changes.filter(F.col("table") == table)
    return of.filter(F.col("type").isin(*types)) if types else of


def status_changed(changes: DataFrame, table: str, column: str, value: str) -> DataFrame:
    return rows_of(changes, table).filter(changed_to(column, value))


def home_and_product(pages: DataFrame) -> DataFrame:
    return pages.filter(F.col("page_id").isin("home", "good_detail"))


def logins(pages: DataFrame) -> DataFrame:
    return pages.filter(~is_empty(F.col("uid")) & (is_empty(F.col("last_page_id")) | (F.col("last_page_id") == "login")))


def searches(pages: DataFrame) -> DataFrame:
    return pages.filter((F.col("last_page_id") == "search") & (F.col("item_type") == "keyword"))
