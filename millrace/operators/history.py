"""What batch runs remember of keys: each key's first day, last day, and the date on which its visitor was new.

A run over one day's rows needs a row for each key that it meets, not the key's rows of all days. State is a table (key, first_date,
last_date, base_date) of one row a key; a run gives its result and the table after it. Runs follow each other day by day; rows that come
late are taken in by revise(), which says what of the state and of earlier results they change.

Rows without a time are in no day; those without a key have a state row as any other key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.operators import keyed

STATE = "key string, first_date string, last_date string, base_date string"


def no_history(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], STATE)


def _with_state(days: DataFrame, key: str, state: DataFrame) -> DataFrame:
    side = state.withColumnRenamed("key", "_key")
    return days.join(side, F.col(key).cast("string").eqNullSafe(side["_key"]), "left").drop("_key")


def _bases(rows: DataFrame, key: str, time: str, tie: str, flag: str | None) -> DataFrame:
    """key, new_base, by the key's first row among these (see keyed.repair_is_new()), first_date and last_date."""
    first = rows.filter(F.col(time).isNotNull()).groupBy(F.col(key).cast("string").alias("_of")).agg(F.min(F.struct(time, tie, *([flag] if flag else []))).alias("r"), F.max(time).alias("_last"))
    day = F.to_date(f"r.{time}")
    is_new = F.coalesce(F.col(f"r.{flag}") == "1", F.lit(False)) if flag else F.lit(True)
    text = lambda c: F.date_format(c, "yyyy-MM-dd")
    return first.select("_of", text(F.when(is_new, day).otherwise(F.date_sub(day, 1))).alias("new_base"), text(f"r.{time}").alias("first_date"), text("_last").alias("last_date"))


def first_and_returning(rows: DataFrame, state: DataFrame, key: str, time: str, tie: str, days: int = 8) -> DataFrame:
    """keyed.first_of_day() of these rows, with is_first and is_back as if all rows before had been read as well."""
    out = _with_state(keyed.first_of_day(rows, key, time, tie), key, state)
    order = Window.partitionBy(key).orderBy("date")
    before = F.coalesce(F.lag("date").over(order), F.col("last_date"))
    out = out.withColumn("_before", before)
    return out.withColumns({"is_first": F.col("_before").isNull().cast("int"), "is_back": F.coalesce((F.datediff("date", "_before") >= days).cast("int"), F.lit(0))}).drop("_before", "first_date", "last_date", "base_date")


def repair_is_new(rows: DataFrame, state: DataFrame, key: str = "mid", flag: str = "is_new", time: str = "time", tie: str = "event_id") -> DataFrame:
    """keyed.repair_is_new() of these rows: the day on which a visitor is new is the state's, or for a visitor that it lacks, these rows'."""
    own = _bases(rows, key, time, tie, flag)
    out = _with_state(rows, key, state)
    out = out.join(own.select("_of", "new_base"), F.col(key).cast("string").eqNullSafe(F.col("_of")), "left")
    late = (F.col(flag) == "1") & (F.date_format(time, "yyyy-MM-dd") != F.coalesce("base_date", "new_base"))
    return out.withColumn(flag, F.when(late, F.lit("0")).otherwise(F.col(flag))).select(*rows.columns)


def after(rows: DataFrame, state: DataFrame, key: str, time: str, tie: str, flag: str | None = None) -> DataFrame:
    """The state once these rows are read: an aggregation of the old one and of one row for each key of these. Earlier rows that come
    late move first_date back, and base_date with it, as if they had come in time."""
    new = _bases(rows, key, time, tie, flag).select(F.col("_of").alias("key"), "first_date", "last_date", F.col("new_base").alias("base_date"), F.lit(1).alias("_order"))
    every = state.withColumn("_order", F.lit(0)).unionByName(new)
    return every.groupBy("key").agg(F.min("first_date").alias("first_date"), F.max("last_date").alias("last_date"), F.min_by("base_date", F.struct("first_date", "_order")).alias("base_date"))


def revise(days: DataFrame, late: DataFrame, key: str, time: str, tie: str, days_away: int = 8) -> DataFrame:
    """first_and_returning() results of all days (key, date, time, tie, is_first, is_back) after rows that came late: only keys that the late
    rows have are counted again, from their days, not from their rows; other keys' results pass as they are."""
    touched = late.filter(F.col(time).isNotNull()).select(F.col(key).alias("_touched")).distinct()
    same = days[key].eqNullSafe(touched["_touched"])
    kept = days.join(touched, same, "left_anti")
    again = days.join(touched, same, "left_semi").select(key, "date", time, tie).unionByName(keyed.first_of_day(late, key, time, tie).select(key, "date", time, tie))
    once = again.groupBy(key, "date").agg(F.min(F.struct(time, tie)).alias("r")).select(key, "date", f"r.{time}", f"r.{tie}")
    before = F.lag("date").over(Window.partitionBy(key).orderBy("date"))
    counted = once.withColumn("_before", before).withColumns({"is_first": F.col("_before").isNull().cast("int"), "is_back": F.coalesce((F.datediff("date", "_before") >= days_away).cast("int"), F.lit(0))}).drop("_before")
    return kept.select(*counted.columns).unionByName(counted)
