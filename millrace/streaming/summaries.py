"""The summaries on streams: inputs need a watermark on `time`, of any delay. Rows without a time are in no window.
salts: see keyed.first_of_day()."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.times import window_columns
from millrace.functions.values import is_empty
from millrace.operators import etl
from millrace.operators.joins import enrich
from millrace.operators.summaries import SKU_MEASURES, WIDTH, by_window, keywords, province_sums, registrations, sku_sums
from millrace.streaming import keyed

__all__ = ["cart_users", "home_detail_visitors", "keywords", "login_users", "page_views", "province_orders", "refunds", "registrations", "sku_orders", "users"]


def cart_users(carts: DataFrame, salts: int = 1) -> DataFrame:
    return by_window(keyed.first_of_day(carts, "user_id", "time", "id", keep=keyed.DAY, salts=salts), F.count("*").alias("cart_add_uu_ct"))


def users(rows: DataFrame, tie: str, unique: str, new: str) -> DataFrame:
    """Of orders or payments: users of the day, and those that never came before."""
    return by_window(keyed.first_of_day(rows, "user_id", "time", tie), F.count("*").alias(unique), F.sum("is_first").alias(new))


REPEATS = keyed.REPEATS


def by_final_window(rows: DataFrame, *measures: Column, keep: pd.Timedelta, keys: tuple[str, ...]) -> DataFrame:
    """by_window() over what replace_by_cancel() gives with this `keep`. Windows are those of FINAL, which lies `keep` after the row's
    time, and are named by the row's time: a window is given out once, when the watermark is `keep` past its end and nothing in it can
    be taken back. Tasks sum before the shuffle, so a key with very many rows doesn't gather in one."""
    width = pd.Timedelta(WIDTH)
    shift = keep % width
    out = rows.groupBy(F.window(keyed.FINAL, WIDTH, WIDTH, f"{shift // pd.Timedelta(microseconds=1)} microseconds").alias("w"), *keys).agg(*measures)
    back = F.expr(f"interval {keep // pd.Timedelta(microseconds=1)} microseconds")
    w = F.struct((F.col("w.start") - back).alias("start"), (F.col("w.end") - back).alias("end"))
    return out.select(*window_columns(w), *[c for c in out.columns if c != "w"])


def province_orders(lines: DataFrame, order: list[str], provinces: DataFrame | None = None, keep: pd.Timedelta = REPEATS) -> DataFrame:
    out = by_final_window(keyed.replace_by_cancel(lines, "id", order, ["order_amount"], keep=keep), *province_sums(), keep=keep, keys=("province_id",))
    return out if provinces is None else enrich(out, provinces, "province_id", {"province_name": "name"}, default={"province_name": ""})


def sku_orders(lines: DataFrame, order: list[str], skus: DataFrame | None = None, keep: pd.Timedelta = REPEATS) -> DataFrame:
    """skus: flat_sku()."""
    out = by_final_window(keyed.replace_by_cancel(lines, "id", order, SKU_MEASURES, keep=keep), *sku_sums(), keep=keep, keys=("sku_id",))
    return out if skus is None else enrich(out, skus, "sku_id", {c: c for c in skus.columns if c != "id"})


def refunds(rows: DataFrame, skus: DataFrame) -> DataFrame:
    """Orders with refunds by trademark, category and user; the set of a window's orders is state."""
    rows = enrich(rows, skus, "sku_id", {"tm_id": "tm_id", "category3_id": "category3_id"})
    return by_window(rows, F.size(F.collect_set("order_id")).cast("long").alias("refund_count"), keys=("tm_id", "category3_id", "user_id"))


def home_detail_visitors(pages: DataFrame, salts: int = 1) -> DataFrame:
    seen = etl.home_and_product(pages).withColumn("visit", F.concat_ws("\x01", "page_id", "mid"))
    first = keyed.first_of_day(seen, "visit", "time", "event_id", keep=keyed.DAY, salts=salts)
    count = lambda page: F.sum((F.col("page_id") == page).cast("long"))
    return by_window(first, count("home").alias("home_uv_ct"), count("good_detail").alias("good_detail_uv_ct"))


def page_views(pages: DataFrame, salts: int = 1) -> DataFrame:
    """Both inputs of the sum come from one stream: its rows, and those that begin a visitor's day."""
    keys = ("vc", "ch", "ar", "is_new")
    zero, one = F.lit(0).cast("long"), F.lit(1).cast("long")
    first = keyed.first_of_day(pages, "mid", "time", "event_id", keep=keyed.DAY, salts=salts).select("time", *keys, one.alias("uv_ct"), zero.alias("sv_ct"), zero.alias("pv_ct"), zero.alias("dur_sum"))
    every = pages.select("time", *keys, zero.alias("uv_ct"), is_empty(F.col("last_page_id")).cast("long").alias("sv_ct"), one.alias("pv_ct"), F.coalesce("during_time", zero).alias("dur_sum"))
    return by_window(every.unionByName(first), *[F.sum(c).alias(c) for c in ("uv_ct", "sv_ct", "pv_ct", "dur_sum")], keys=keys)


def login_users(pages: DataFrame, days: int = 8) -> DataFrame:
    seen = keyed.first_of_day(etl.logins(pages), "uid", "time", "event_id", days)
    return by_window(seen, F.sum("is_back").alias("back_ct"), F.count("*").alias("uu_ct"))
