"""Distinct counts that can be merged: from short windows to hours and days, without the ids.

A window holds a theta sketch of its ids (built-in functions): all hashes while there are fewer than 2^LG of them, so that the count is exact,
and beyond that a uniform sample of hashes, whose relative standard error is 1 / sqrt(2^LG - 1), 1.6 % at 12. Where that is not enough,
exact_counts() counts the ids of such windows, and only of those, again. Merged sketches are those of all
ids together, ids that several windows share being counted once. Tasks merge before they shuffle, and a sketch's size is bounded, so neither a
window with very many ids nor a key with most rows gathers in a task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions.times import window_columns
from millrace.operators.summaries import WIDTH

LG = 12


def sketch_ids(df: DataFrame, of: str, keys: tuple[str, ...] = (), time: str = "time", width: str = WIDTH, lg: int = LG) -> DataFrame:
    """window, keys, sketch (binary): for a summary table, or on a stream with a watermark. Null ids and rows without a time aren't counted."""
    return df.groupBy(F.window(time, width).alias("window"), *keys).agg(F.theta_sketch_agg(of, lg).alias("sketch"))


def merge_sketches(sketches: DataFrame, keys: tuple[str, ...] = (), width: str = "1 day", lg: int = LG) -> DataFrame:
    """Sketches of longer windows, of those that begin in them, by fewer keys or the same."""
    return sketches.groupBy(F.window(F.col("window.start"), width).alias("window"), *keys).agg(F.theta_union_agg("sketch", lg).alias("sketch"))


def distinct_counts(sketches: DataFrame, name: str = "distinct_count") -> DataFrame:
    """stt, edt, the other columns, and the count."""
    rest = [c for c in sketches.columns if c not in ("window", "sketch")]
    return sketches.select(*window_columns(F.col("window")), *rest, F.theta_sketch_estimate("sketch").cast("bigint").alias(name))


def exact_counts(sketches: DataFrame, df: DataFrame, of: str, keys: tuple[str, ...] = (), time: str = "time", width: str = "1 day", lg: int = LG, name: str = "distinct_count") -> DataFrame:
    """distinct_counts() without error: windows whose sketches may be samples (2^lg ids or more) are counted from the rows that the sketches
    were made of. Their ids are made distinct before they are counted, so that no window gathers in a task."""
    full = F.theta_sketch_estimate("sketch") >= 1 << lg
    large = sketches.filter(full).select(F.col("window.start").alias("_start"), *[F.col(k).alias(f"_{k}") for k in keys])
    rows = df.filter(F.col(of).isNotNull()).select(F.window(time, width).alias("window"), *keys, of)
    same = rows["window.start"].eqNullSafe(large["_start"])
    for k in keys:
        same = same & rows[k].eqNullSafe(large[f"_{k}"])
    ids = rows.join(large, same, "left_semi").distinct()
    counted = ids.groupBy("window", *keys).agg(F.count("*").alias(name)).select(*window_columns(F.col("window")), *keys, name)
    return distinct_counts(sketches.filter(~full), name).select(*counted.columns).unionByName(counted)
