"""What the stream jobs keep by key, as batch operations over event time.

Where only the first row of a key and day matters, an aggregation finds it, so that repeats are dropped before the shuffle and a
key with very many rows, or a null key, isn't sorted in one task.

Rows without a time begin no day, make no visitor new or old and keep their mark, and replace and are replaced by nothing: they belong to
no window and are left out. Rows without an id replace nothing either, but count.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.times import date_text


def first_of_day(df: DataFrame, key: str, time: str, tie: str, carry: tuple[str, ...] = ()) -> DataFrame:
    """The first row of each key and day: key, date, time, tie and the columns to carry."""
    first = F.min(F.struct(time, tie, *carry)).alias("r")
    return df.filter(F.col(time).isNotNull()).groupBy(key, date_text(F.col(time)).alias("date")).agg(first).select(key, "date", "r.*")


def first_ever(df: DataFrame, key: str, time: str, tie: str) -> DataFrame:
    """first_of_day() with `is_first`: 1 on the key's very first day."""
    days = first_of_day(df, key, time, tie)
    least = F.min("date").over(Window.partitionBy(key))
    return days.withColumn("is_first", (F.col("date") == least).cast("int"))


def returning(df: DataFrame, key: str, time: str, tie: str, days: int = 8) -> DataFrame:
    """first_of_day() with `is_back`: 1 if the key's day before lies so many days back at least."""
    out = first_of_day(df, key, time, tie)
    last = F.lag("date").over(Window.partitionBy(key).orderBy("date"))
    return out.withColumn("is_back", F.coalesce((F.datediff("date", last) >= days).cast("int"), F.lit(0)))


def repair_is_new(log: DataFrame, key: str = "mid", flag: str = "is_new", time: str = "time", tie: str = "event_id") -> DataFrame:
    """A visitor is new on one date only: that of the key's first row if it says so, else the day before. Later rows that say new on
    another date get '0'; rows that say '0' stay."""
    first = log.filter(F.col(time).isNotNull()).groupBy(F.col(key).alias("_key")).agg(F.min(F.struct(time, tie, flag)).alias("r"))
    day = F.to_date(f"r.{time}")
    base = first.select("_key", F.when(F.coalesce(F.col(f"r.{flag}") == "1", F.lit(False)), day).otherwise(F.date_sub(day, 1)).alias("_base"))
    late = (F.col(flag) == "1") & (F.to_date(time) != F.col("_base"))
    return log.join(base, log[key].eqNullSafe(base["_key"]), "left").withColumn(flag, F.when(late, F.lit("0")).otherwise(F.col(flag))).drop("_key", "_base")


def replace_by_cancel(df: DataFrame, key: str, order: list[str], measures: list[str], time: str = "time", within: tuple[str, ...] = ()) -> DataFrame:
    """For sums over rows that replace earlier ones of their key: each row, and where another follows, its negative beside it (with
    its own time), so that only the last one counts. Null measures count 0. within: columns in which all rows of a key are equal (a line's
    order); rows that are dealt by them already aren't shuffled."""
    rows = df.filter(F.col(time).isNotNull()) if time in df.columns else df
    rows = rows.withColumns({m: F.coalesce(F.col(m), F.lit(0).cast(df.schema[m].dataType)) for m in measures})
    apart = F.when(F.col(key).isNull(), F.monotonically_increasing_id())  # rows without an id don't gather in one task
    replaced = F.lead(F.lit(1)).over(Window.partitionBy(*within, key, "_apart").orderBy(*order)).isNotNull()
    signs = F.when(F.col("_replaced"), F.array(F.lit(1), F.lit(-1))).otherwise(F.array(F.lit(1)))
    rows = rows.withColumn("_apart", apart).withColumn("_replaced", replaced).withColumn("sign", F.explode(signs)).drop("_replaced", "_apart")
    return rows.withColumns({m: F.when(F.col("sign") < 0, -F.col(m)).otherwise(F.col(m)).cast(df.schema[m].dataType) for m in measures})
