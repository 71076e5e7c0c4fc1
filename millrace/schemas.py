"""Schemas of the topics."""

from __future__ import annotations

#: A database change: `ts` in epoch seconds, `old` the former values of what changed.
CHANGE = "database string, `table` string, type string, ts string, data map<string,string>, old map<string,string>"

COMMON = "struct<mid:string,uid:string,vc:string,ch:string,ar:string,is_new:string>"
PAGE = "struct<page_id:string,last_page_id:string,item:string,item_type:string,during_time:bigint>"
#: An app log record: `ts` in epoch milliseconds.
LOG = f"common {COMMON}, page {PAGE}, displays array<map<string,string>>, actions array<map<string,string>>, start map<string,string>, err map<string,string>, ts bigint"

CONFIG_COLUMNS = ("source_table", "source_type", "sink_table", "sink_type", "sink_columns", "sink_pk", "sink_extend")
CONFIG = ", ".join(f"{c} string" for c in CONFIG_COLUMNS)
CONFIG_CHANGE = "op string, before struct<{0}>, after struct<{0}>".format(", ".join(f"{c}:string" for c in CONFIG_COLUMNS))

_SPLITS = "sku_num string, split_original_amount string, split_activity_amount string, split_coupon_amount string, split_total_amount string"
ORDER_DETAIL = f"id string, order_id string, user_id string, sku_id string, sku_name string, province_id string, activity_id string, activity_rule_id string, coupon_id string, date_id string, create_time string, {_SPLITS}, ts string"
