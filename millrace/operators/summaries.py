"""Summaries over tumbling windows of event time. Each works on batches; those without keyed operators also on streams, given a
watermark on `time`. `ts`, the time of writing, is added by with_ts()."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.text import explode_words
from millrace.functions.times import window_columns
from millrace.functions.values import is_empty
from millrace.operators import keyed
from millrace.operators.etl import home_and_product, logins
from millrace.operators.joins import enrich

WIDTH = "10 seconds"
AMOUNT = "decimal(38,4)"
SKU_MEASURES = ["original_amount", "activity_amount", "coupon_amount", "order_amount"]


def by_window(df: DataFrame, *measures: Column, keys: tuple[str, ...] = (), time: str = "time", width: str = WIDTH) -> DataFrame:
    """stt, edt, keys and measures; tasks sum before the shuffle, so a window without keys needs no single task."""
    out = df.groupBy(F.window(time, width).alias("w"), *keys).agg(*measures)
    return out.select(*window_columns(F.col("w")), *[c for c in out.columns if c != "w"])


def with_ts(df: DataFrame) -> DataFrame:
    return df.withColumn("ts", F.unix_millis(F.current_timestamp()))


def cart_users(carts: DataFrame) -> DataFrame:
    return by_window(keyed.first_of_day(carts, "user_id", "time", "id"), F.count("*").alias("cart_add_uu_ct"))


def order_users(details: DataFrame) -> DataFrame:
    days = keyed.first_ever(details, "user_id", "time", "id")
    return by_window(days, F.count("*").alias("order_unique_user_count"), F.sum("is_first").alias("order_new_user_count"))


def paying_users(payments: DataFrame) -> DataFrame:
    days = keyed.first_ever(payments, "user_id", "time", "order_detail_id")
    return by_window(days, F.count("*").alias("payment_suc_unique_user_count"), F.sum("is_first").alias("payment_suc_new_user_count"))


def _amounts(columns: list[str]) -> list[Column]:
    return [F.sum(F.col(c).cast(AMOUNT)).cast(AMOUNT).alias(c) for c in columns]


def province_sums() -> list[Column]:
    """Distinct orders and amounts, for streams, whose state holds a window's set of orders."""
    return [F.size(F.collect_set("order_id")).cast("long").alias("order_count"), *_amounts(["order_amount"])]


def sku_sums() -> list[Column]:
    return _amounts(SKU_MEASURES)


def province_orders(details: DataFrame, provinces: DataFrame, order: list[str], within: tuple[str, ...] = ()) -> DataFrame:
    rows = keyed.replace_by_cancel(details, "id", order, ["order_amount"], within=within)
    each = rows.groupBy(F.window("time", WIDTH).alias("w"), "province_id", "order_id").agg(F.sum(F.col("order_amount").cast(AMOUNT)).alias("a"))
    out = each.groupBy("w", "province_id").agg(F.count("*").alias("order_count"), F.sum("a").cast(AMOUNT).alias("order_amount"))
    out = out.select(*window_columns(F.col("w")), "province_id", "order_count", "order_amount")
    return enrich(out, provinces, "province_id", {"province_name": "name"}, default={"province_name": ""})


def sku_orders(details: DataFrame, skus: DataFrame, order: list[str], within: tuple[str, ...] = ()) -> DataFrame:
    """skus: flat_sku(). Dimensions come after the sums."""
    out = by_window(keyed.replace_by_cancel(details, "id", order, SKU_MEASURES, within=within), *sku_sums(), keys=("sku_id",))
    names = [c for c in skus.columns if c != "id"]
    return enrich(out, skus, "sku_id", {c: c for c in names})


def refunds(rows: DataFrame, skus: DataFrame) -> DataFrame:
    """Orders with refunds by trademark, category and user."""
    keys = ("tm_id", "category3_id", "user_id")
    rows = enrich(rows, skus, "sku_id", {"tm_id": "tm_id", "category3_id": "category3_id"})
    out = rows.groupBy(F.window("time", WIDTH).alias("w"), *keys).agg(F.count_distinct("order_id").alias("refund_count"))
    out = out.select(*window_columns(F.col("w")), *keys, "refund_count")
    return out


def refund_names(out: DataFrame, trademark: DataFrame, category3: DataFrame, category2: DataFrame, category1: DataFrame) -> DataFrame:
    out = enrich(out, trademark, "tm_id", {"trademark_name": "tm_name"})
    out = enrich(out, category3, "category3_id", {"category3_name": "name", "category2_id": "category2_id"})
    out = enrich(out, category2, "category2_id", {"category2_name": "name", "category1_id": "category1_id"})
    return enrich(out, category1, "category1_id", {"category1_name": "name"})


def home_detail_visitors(pages: DataFrame) -> DataFrame:
    seen = home_and_product(pages).withColumn("visit", F.struct("mid", "page_id"))
    first = keyed.first_of_day(seen, "visit", "time", "event_id")
    count = lambda page: F.sum((F.col("visit.page_id") == page).cast("long"))
    return by_window(first, count("home").alias("home_uv_ct"), count("good_detail").alias("good_detail_uv_ct"))


def keywords(searched: DataFrame, text: str = "item") -> DataFrame:
    return by_window(explode_words(searched, text), F.count("*").alias("keyword_count"), keys=("keyword",))


def page_views(pages: DataFrame) -> DataFrame:
    """Visitors (once a day), sessions, views and time by version, channel, area and new visitors. Visitors are counted from the first
    rows of each day, apart from the sums over all rows, so no visitor's rows are sorted."""
    keys = ("vc", "ch", "ar", "is_new")
    zero = F.lit(0).cast("long")
    first = keyed.first_of_day(pages, "mid", "time", "event_id", keys).select("time", *keys, F.lit(1).cast("long").alias("uv_ct"), zero.alias("sv_ct"), zero.alias("pv_ct"), zero.alias("dur_sum"))
    every = pages.select("time", *keys, zero.alias("uv_ct"), is_empty(F.col("last_page_id")).cast("long").alias("sv_ct"), F.lit(1).cast("long").alias("pv_ct"), F.coalesce("during_time", zero).alias("dur_sum"))
    return by_window(every.unionByName(first), *[F.sum(c).alias(c) for c in ("uv_ct", "sv_ct", "pv_ct", "dur_sum")], keys=keys)


def login_users(pages: DataFrame, days: int = 8) -> DataFrame:
    seen = keyed.returning(logins(pages), "uid", "time", "event_id", days)
    return by_window(seen, F.sum("is_back").alias("back_ct"), F.count("*").alias("uu_ct"))


def registrations(rows: DataFrame) -> DataFrame:
    return by_window(rows, F.count("*").alias("register_ct"))
