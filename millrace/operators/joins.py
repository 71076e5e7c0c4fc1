"""Joins of the facts and summaries. Which side is broadcast, if any, is left to Spark, which knows the sizes, but for the dictionary of codes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def decode(df: DataFrame, code: str, dictionary: DataFrame, name: str) -> DataFrame:
    """Adds the dictionary's name of a code; rows without one go. The dictionary has a row for each code: it is broadcast, as rows would
    gather by their few codes."""
    dic = dictionary.select(F.col("dic_code").alias(code), F.col("dic_name").alias(name))
    return df.join(F.broadcast(dic), code)


def interval_join(left: DataFrame, right: DataFrame, key: str, time: str, before: str, after: str, right_time: str = "right_time") -> DataFrame:
    """Rows of equal key where the right time lies in [left time - before, left time + after], both ends included."""
    right = right.withColumnsRenamed({key: "_key", time: right_time})
    low, high = (F.col(time) - F.expr(f"interval {before}"), F.col(time) + F.expr(f"interval {after}"))
    return left.join(right, (left[key] == right["_key"]) & (right[right_time] >= low) & (right[right_time] <= high)).drop("_key")


def enrich(df: DataFrame, dim: DataFrame, key: str, columns: dict[str, str], dim_key: str = "id", default: dict[str, str] | None = None) -> DataFrame:
    """Adds columns {new: dimension's} by key; rows without a match stay, with nulls or defaults."""
    side = dim.select(F.col(dim_key).alias("_id"), *[F.col(c).alias(n) for n, c in columns.items()])
    out = df.join(side, df[key] == side["_id"], "left").drop("_id")
    return out.fillna(default) if default else out


def flat_sku(sku: DataFrame, spu: DataFrame, trademark: DataFrame, category3: DataFrame, category2: DataFrame, category1: DataFrame) -> DataFrame:
    """One row for each sku with the names of all dimensions above it: small tables are joined once, before any fact."""
    out = enrich(sku, spu, "spu_id", {"spu_name": "spu_name"})
    out = enrich(out, trademark, "tm_id", {"trademark_name": "tm_name"})
    out = enrich(out, category3, "category3_id", {"category3_name": "name", "category2_id": "category2_id"})
    out = enrich(out, category2, "category2_id", {"category2_name": "name", "category1_id": "category1_id"})
    return enrich(out, category1, "category1_id", {"category1_name": "name"})


def lookup(df: DataFrame, dim: DataFrame, on: dict[str, str], columns: dict[str, str], order: list[str]) -> DataFrame:
    """Adds columns of the first dimension row (by order) that equals in all of on {df's: dimension's}, else nulls."""
    keys = list(on.values())
    one = dim.groupBy(*keys).agg(F.min(F.struct(*order, *[F.col(c).alias(f"_{n}") for n, c in columns.items()])).alias("r"))
    side = one.select(*[F.col(d).alias(f"_k{i}") for i, d in enumerate(keys)], *[F.col(f"r._{n}").alias(n) for n in columns])
    same: Column = F.lit(True)
    for i, c in enumerate(on):
        same = same & (df[c] == side[f"_k{i}"])
    return df.join(side, same, "left").drop(*[f"_k{i}" for i in range(len(keys))])
