"""Maps and JSON."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def keep_keys(data: Column, names: Column) -> Column:
    """Entries of a map whose keys stand in a comma list; names aren't trimmed."""
    return F.map_filter(data, lambda k, _: F.array_contains(F.split(names, ","), k))


def is_empty(x: Column) -> Column:
    return F.coalesce(x, F.lit("")) == ""


def is_json(text: Column) -> Column:
    return F.try_parse_json(text).isNotNull()


def is_json_object(text: Column) -> Column:
    """JSON that begins with a brace: cheaper than asking for its schema."""
    return F.coalesce(text.rlike(r"^[ \t\n\r]*\{") & is_json(text), F.lit(False))


def changed_to(column: str, value: str) -> Column:
    """Of database changes: an update that gave the column this value."""
    return (F.col("type") == "update") & F.col("old")[column].isNotNull() & (F.col("data")[column] == value)
