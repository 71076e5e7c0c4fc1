"""Dimensions as they were: validity intervals from changes, and lookups as of an event's time.

Changes and events of a key are sorted together and each event takes the last change before it, in one pass over both: no row for each
day, and no comparison of all events of a key with all its versions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def intervals(changes: DataFrame, key: str, time: str, columns: list[str], tie: list[str] | None = None) -> DataFrame:
    """key, columns, valid_from, valid_to (not included; null: still valid). Of changes at one time the last by `tie` counts; changes that
    change no column make no interval of their own; changes without a key or time are left out."""
    one = changes.filter(F.col(key).isNotNull() & F.col(time).isNotNull()).groupBy(key, time).agg(F.max(F.struct(*[F.col(c) for c in (tie or [])], F.struct(*columns).alias("_row"))).alias("r")).select(key, time, "r._row")
    order = Window.partitionBy(key).orderBy(time)
    moved = one.withColumn("_was", F.lag("_row").over(order)).filter(F.col("_was").isNull() | ~F.col("_row").eqNullSafe(F.col("_was")))
    return moved.withColumn("valid_to", F.lead(time).over(order)).select(key, "_row.*", F.col(time).alias("valid_from"), "valid_to")


def as_of(events: DataFrame, versions: DataFrame, key: str, time: str, columns: list[str], version_key: str | None = None, version_time: str = "valid_from", salts: int = 1) -> DataFrame:
    """Events with the columns of the key's last version at or before their time, or nulls. Events without a key or time get nulls.
    salts: a key with very many events is dealt to so many tasks, each with a copy of its versions, which are few."""
    own = [F.col(c).alias(f"_e_{c}") for c in events.columns]
    left = events.select(F.col(key).alias("_key"), F.col(time).alias("_time"), F.lit(1).alias("_kind"), F.struct(*own).alias("_event"), F.pmod(F.xxhash64(*[F.col(c) for c in (time, key)]), F.lit(salts)).cast("int").alias("_salt"))
    found = F.struct(*[F.col(c).alias(c) for c in columns]).alias("_found")
    right = versions.filter(F.col(version_time).isNotNull()).select(F.col(version_key or key).alias("_key"), F.col(version_time).alias("_time"), F.lit(0).alias("_kind"), found, F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("_salt"))
    both = left.unionByName(right, allowMissingColumns=True)
    order = Window.partitionBy("_key", "_salt").orderBy("_time", "_kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = both.withColumn("_found", F.when(F.col("_key").isNotNull() & F.col("_time").isNotNull(), F.last("_found", ignorenulls=True).over(order))).filter("_kind = 1")
    return seen.select(*[F.col("_event")[f"_e_{c}"].alias(c) for c in events.columns], *[F.col("_found")[c].alias(c) for c in columns])
