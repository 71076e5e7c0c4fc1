"""Event times, dates and windows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DATE, DATE_TIME = "yyyy-MM-dd", "yyyy-MM-dd HH:mm:ss"


def from_seconds(ts: Column) -> Column:
    return F.timestamp_seconds(ts.try_cast("bigint"))


def from_millis(ts: Column) -> Column:
    return F.timestamp_millis(ts.try_cast("bigint"))


def date_text(time: Column) -> Column:
    return F.date_format(time, DATE)


def date_time_text(time: Column) -> Column:
    return F.date_format(time, DATE_TIME)


def to_millis(text: Column, full: bool = False) -> Column:
    """Epoch milliseconds of a date, or of a date and time; null if it is neither."""
    return F.unix_millis(F.try_to_timestamp(text, F.lit(DATE_TIME if full else DATE)))


def window_columns(window: Column) -> list[Column]:
    return [date_time_text(window["start"]).alias("stt"), date_time_text(window["end"]).alias("edt")]
