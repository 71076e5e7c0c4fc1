"""Fact tables, from database changes (table, type, ts, data, old).

On streams changes need a column row_time with a watermark (with_row_time()), and joins a time to keep: rows meet if their times are no
further apart, so that state ends. Batches join whatever the times are, unless told to keep as well. row_time stays in the result.

Changes may carry the id of the order that a row belongs to in a column order_id, beside data. What is dealt by it then meets as it is: lines, orders,
promotions and payments take one shuffle each. Without it, promotions are joined by their line alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.times import DATE, from_seconds
from millrace.operators.etl import rows_of, status_changed
from millrace.operators.joins import decode, interval_join

MONEY = "decimal(16,2)"
SPLITS = ("sku_num", "split_original_amount", "split_activity_amount", "split_coupon_amount", "split_total_amount")


#: How long streams keep rows for their joins; cancellations come up to a quarter of an hour after the order.
KEEP, KEEP_CANCELLED = "10 seconds", "910 seconds"


def _time(rows: DataFrame) -> list[str]:
    return ["row_time"] if "row_time" in rows.columns else []


def _order(rows: DataFrame) -> list[str]:
    return ["order_id"] if "order_id" in rows.columns else []


def _take(rows: DataFrame, *names: str, **renamed: str) -> DataFrame:
    """Columns of `data`, ts, and order_id and row_time, if there."""
    columns = {n: n for n in names} | renamed
    return rows.select(*[F.col("data")[n].alias(c) for c, n in columns.items() if c not in _order(rows)], *_order(rows), "ts", *_time(rows))


def _join(left: DataFrame, right: DataFrame, on: list[str], keep: str | None, how: str = "inner") -> DataFrame:
    """On equal columns; the left side's ts and row_time stay."""
    right = right.drop("ts")
    if keep is None:
        return left.join(right.drop("row_time"), on, how)
    right = right.withColumnsRenamed({c: f"_{c}" for c in [*on, "row_time"]})
    near = right["_row_time"].between(left["row_time"] - F.expr(f"interval {keep}"), left["row_time"] + F.expr(f"interval {keep}"))
    for c in on:
        near = near & (left[c] == right[f"_{c}"])
    return left.join(right, near, how).drop(*[f"_{c}" for c in [*on, "row_time"]])


def _day(text: Column) -> Column:
    return F.date_format(F.try_to_timestamp(text), DATE)


def comment(changes: DataFrame, dictionary: DataFrame) -> DataFrame:
    rows = _take(rows_of(changes, "comment_info", "insert"), "id", "user_id", "sku_id", "appraise", "comment_txt")
    return decode(rows, "appraise", dictionary, "appraise_name").select("id", "user_id", "sku_id", "appraise", "appraise_name", "comment_txt", "ts")


def cart_add(changes: DataFrame) -> DataFrame:
    """What was put into carts: an insert's number, or by how much an update raised it."""
    new, old = F.col("data")["sku_num"].try_cast("int"), F.col("old")["sku_num"].try_cast("int")
    rows = rows_of(changes, "cart_info").filter((F.col("type") == "insert") | ((F.col("type") == "update") & old.isNotNull() & (new > old)))
    number = F.when(F.col("type") == "insert", F.col("data")["sku_num"]).otherwise((new - old).cast("string"))
    return rows.select(*[F.col("data")[c].alias(c) for c in ("id", "user_id", "sku_id")], number.alias("sku_num"), "ts")


def _details(changes: DataFrame) -> DataFrame:
    d = rows_of(changes, "order_detail", "insert")
    original = (F.col("sku_num").try_cast(MONEY) * F.col("order_price").try_cast(MONEY)).cast("string")
    return _take(d, "id", "order_id", "sku_id", "sku_name", "create_time", "order_price", *SPLITS[2:], "sku_num").withColumn("split_original_amount", original)


def _with_promotions(details: DataFrame, changes: DataFrame, keep: str | None) -> DataFrame:
    activity = _take(rows_of(changes, "order_detail_activity", "insert"), "activity_id", "activity_rule_id", id="order_detail_id")
    coupon = _take(rows_of(changes, "order_detail_coupon", "insert"), "coupon_id", id="order_detail_id")
    on = [*_order(changes), "id"]
    return _join(_join(details, activity, on, keep, "left"), coupon, on, keep, "left")


_ORDER = ["id", "order_id", "user_id", "sku_id", "sku_name", "province_id", "activity_id", "activity_rule_id", "coupon_id", "date_id"]


def order_detail(changes: DataFrame, keep: str | None = None) -> DataFrame:
    """Lines of new orders, with their activity and coupon, if any."""
    orders = _take(rows_of(changes, "order_info", "insert"), "user_id", "province_id", order_id="id")
    out = _with_promotions(_join(_details(changes), orders, ["order_id"], keep), changes, keep)
    return out.withColumn("date_id", _day(F.col("create_time"))).select(*_ORDER, "create_time", *SPLITS, "ts", *_time(out))


def cancel_detail(changes: DataFrame, status: str = "1003", keep: str | None = None) -> DataFrame:
    """Lines of orders that were cancelled, at the time of that change."""
    orders = _take(status_changed(changes, "order_info", "order_status", status), "user_id", "province_id", "operate_time", order_id="id")
    out = _with_promotions(_join(orders, _details(changes), ["order_id"], keep), changes, keep)
    return out.withColumn("date_id", _day(F.col("operate_time"))).select(*_ORDER, F.col("operate_time").alias("cancel_time"), *SPLITS, "ts", *_time(out))


def refund(changes: DataFrame, dictionary: DataFrame, status: str = "1005", keep: str | None = None) -> DataFrame:
    """Requests for refunds of orders in that status, with the names of type and reason."""
    rows = _take(rows_of(changes, "order_refund_info", "insert"), "id", "user_id", "order_id", "sku_id", "refund_type", "refund_num", "refund_amount", "refund_reason_type", "refund_reason_txt", "create_time")
    orders = _take(status_changed(changes, "order_info", "order_status", status), "province_id", order_id="id")
    out = decode(decode(_join(rows, orders, ["order_id"], keep), "refund_type", dictionary, "refund_type_name"), "refund_reason_type", dictionary, "refund_reason_type_name")
    return out.select(
        "id", "user_id", "order_id", "sku_id", "province_id", _day(F.col("create_time")).alias("date_id"), "create_time", F.col("refund_type").alias("refund_type_code"), "refund_type_name",
        F.col("refund_reason_type").alias("refund_reason_type_code"), "refund_reason_type_name", "refund_reason_txt", "refund_num", "refund_amount", "ts", F.current_timestamp().alias("row_op_ts"), *_time(out),
    )


def refund_paid(changes: DataFrame, dictionary: DataFrame, status: str = "1006", keep: str | None = None) -> DataFrame:
    """Refunds that were paid, of orders in that status. Any change of the payment or of the request counts."""
    rows = _take(rows_of(changes, "refund_payment"), "id", "order_id", "sku_id", "payment_type", "callback_time", "total_amount")
    orders = _take(status_changed(changes, "order_info", "order_status", status), "user_id", "province_id", order_id="id")
    requests = _take(rows_of(changes, "order_refund_info"), "order_id", "sku_id", "refund_num")
    out = decode(_join(_join(rows, orders, ["order_id"], keep), requests, ["order_id", "sku_id"], keep), "payment_type", dictionary, "payment_type_name")
    return out.select(
        "id", "user_id", "order_id", "sku_id", "province_id", F.col("payment_type").alias("payment_type_code"), "payment_type_name", _day(F.col("callback_time")).alias("date_id"), "callback_time",
        "refund_num", F.col("total_amount").alias("refund_amount"), "ts", F.current_timestamp().alias("row_op_ts"), *_time(out),
    )


def payment(changes: DataFrame, details: DataFrame, dictionary: DataFrame, before: str = "15 minutes", after: str = "5 seconds") -> DataFrame:
    """Payments with the lines of their orders placed from `before` to `after` the payment. On streams details need row_time as well."""
    timed = lambda df, ts: df if "row_time" in df.columns else df.withColumn("row_time", from_seconds(F.col(ts)))
    rows = _take(rows_of(changes, "payment_info"), "user_id", "order_id", "payment_type", "callback_time")
    paid = timed(decode(rows, "payment_type", dictionary, "payment_type_name"), "ts")
    lines = timed(details.drop("user_id", "date_id", "create_time").withColumnsRenamed({"id": "order_detail_id", "ts": "order_ts"}), "order_ts")
    out = interval_join(paid, lines, "order_id", "row_time", before, after)
    nothing = [F.lit(None).cast("string").alias(c) for c in ("source_id", "source_type_code", "source_type_name")]
    return out.select(
        "order_detail_id", "order_id", "user_id", "sku_id", "sku_name", "province_id", "activity_id", "activity_rule_id", "coupon_id", F.col("payment_type").alias("payment_type_code"), "payment_type_name",
        "callback_time", *nothing, "sku_num", "split_original_amount", "split_activity_amount", "split_coupon_amount", F.col("split_total_amount").alias("split_payment_amount"), "ts", *_time(changes),
    )
