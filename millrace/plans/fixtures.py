"""The warehouse's inputs as views of the test tables: change events, the app log, dimensions and the configuration.

VIEWS says the same in DuckDB's SQL, for the queries' oracles.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.times import date_time_text
from millrace.session import prepare
from millrace.sources.files import read_table, spread

ARRIVAL = ["l_shipdate", "l_partkey", "l_suppkey", "l_extendedprice"]
MONEY = "decimal(16,2)"
#: Dictionary codes; one reason that occurs, 1307, is left out.
CODES = ["1101", "1102", "1103", "1201", "1202", "1203", "1204", "1301", "1302", "1303", "1304", "1305", "1306", "1501", "1502"]
#: Fixed values: (source_table, source_type, sink_table, sink_type, sink_columns, sink_pk). The blank keeps one name from matching.
ROUTES = [
    ("sku_info", "", "dim_sku_info", "dim", "id,sku_name,tm_id", "id"),
    ("spu_info", "", "dim_spu_info", "dim", "id, spu_name", "id"),
    ("user_info", "insert", "dwd_user_register", "dwd", "id,create_time", ""),
    ("favor_info", "insert", "dwd_interaction_favor_add", "dwd", "id,user_id,sku_id", ""),
    ("coupon_use", "update", "dwd_tool_coupon_pay", "dwd", "id,user_id", ""),
]


def _string(c: str | Column) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("string")


def _clock(seconds: Column) -> Column:
    return date_time_text(F.timestamp_seconds(seconds))


class Inputs:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = prepare(spark), sf_dir

    def table(self, name: str) -> DataFrame:
        return read_table(self.spark, self.dir, name)

    @cached_property
    def dictionary(self) -> DataFrame:
        return self.spark.createDataFrame([(c, f"name {c}") for c in CODES], "dic_code string, dic_name string")

    @cached_property
    def routes(self) -> DataFrame:
        return self.spark.createDataFrame([(*r, None) for r in ROUTES], "source_table string, source_type string, sink_table string, sink_type string, sink_columns string, sink_pk string, sink_extend string")

    @cached_property
    def orders(self) -> DataFrame:
        o, c = self.table("orders"), self.table("customer").select("c_custkey", "c_nationkey")
        ts = F.unix_timestamp(F.col("o_orderdate").cast("timestamp")) + (F.col("o_orderkey") * 37) % 86400
        return o.join(c, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "o_custkey", "o_orderstatus", "c_nationkey", ts.alias("ts"))

    @cached_property
    def items(self) -> DataFrame:
        """lineitem with its parts, and its orders' ids as the changes have them: what is dealt by that id stays so in all that comes of the
        changes. Parts are met before, as lines are narrowest there."""
        part = self.table("part").select("p_partkey", "p_name", "p_retailprice")
        return self.table("lineitem").withColumn("order_id", _string("l_orderkey")).filter(F.col("order_id").isNotNull()).join(part, F.col("l_partkey") == F.col("p_partkey"))

    @cached_property
    def last_items(self) -> DataFrame:
        """items with the latest row of each line only. Few lines have several rows, so they go to their orders (of a few lines each)
        before any is dropped; the joins by order need no other shuffle of them."""
        rest, key = ["l_quantity", "l_discount", "l_tax", "l_returnflag", "p_name", "p_retailprice"], ["order_id", "l_linenumber"]
        last = self.items.repartition("order_id").groupBy(*key).agg(F.max(F.struct(*ARRIVAL, *rest)).alias("r"))
        return last.select(*key, "r.*")

    @cached_property
    def order_lines(self) -> DataFrame:
        """Lines in order of arrival, ids repeated."""
        return self._lines(self.items)

    @cached_property
    def last_lines(self) -> DataFrame:
        """The latest line of each id."""
        return self._lines(self.last_items)

    def _lines(self, items: DataFrame) -> DataFrame:
        """Lines and orders meet by order, not by a copy of one side: both grow with the data, and their files tell too little of their size."""
        orders = self.orders.withColumn("_order", _string("o_orderkey"))
        lines = items.join(orders.hint("merge"), F.col("order_id") == F.col("_order"))
        money = lambda c: F.col(c).cast(MONEY)
        return lines.select(
            F.concat_ws("-", "order_id", "l_linenumber").alias("id"), "order_id", _string("l_partkey").alias("sku_id"), F.col("p_name").alias("sku_name"),
            _string("o_custkey").alias("user_id"), _string("c_nationkey").alias("province_id"), money("l_quantity").alias("sku_num"), money("p_retailprice").alias("order_price"),
            (money("l_quantity") * money("p_retailprice")).cast("decimal(20,4)").alias("original_amount"), (money("l_extendedprice") * money("l_discount")).cast("decimal(20,4)").alias("activity_amount"),
            (money("l_extendedprice") * money("l_tax")).cast("decimal(20,4)").alias("coupon_amount"), money("l_extendedprice").alias("order_amount"),
            "l_discount", "l_tax", "l_quantity", "l_returnflag", "l_linenumber", *ARRIVAL, "ts", F.timestamp_seconds("ts").alias("time"),
        )

    def _changes(self, df: DataFrame, table: str, kind: Column, ts: Column, data: dict[str, Column], old: dict[str, Column] | None = None, order: dict[str, Column] | None = None) -> DataFrame:
        """order: {"order_id": the id of the row's order}, of the shop's tables."""
        entries = lambda d: F.create_map(*[x for k, v in d.items() for x in (F.lit(k), v.cast("string"))])
        past = entries(old) if old else F.lit(None).cast("map<string,string>")
        beside = [v.cast("string").alias(k) for k, v in (order or {}).items()]
        return df.select(F.lit("shop").alias("database"), F.lit(table).alias("table"), kind.alias("type"), ts.cast("string").alias("ts"), entries(data).alias("data"), past.alias("old"), *beside)

    @cached_property
    def order_changes(self) -> DataFrame:
        """Inserts of all orders, and what became of them: F cancelled, P refund asked for and a day later paid."""
        insert = F.lit("insert")
        key, user, province = F.col("o_orderkey"), F.col("o_custkey"), F.col("c_nationkey")
        base, of = {"id": key, "user_id": user, "province_id": province}, {"order_id": key}
        out = self._changes(self.orders, "order_info", insert, F.col("ts"), base | {"order_status": F.lit("1001"), "create_time": _clock(F.col("ts"))}, order=of)
        for status, before, after, delay in (("F", "1001", "1003", 600), ("P", "1001", "1005", 1800), ("P", "1005", "1006", 86400)):
            at = F.col("ts") + delay
            rows = self.orders.filter(F.col("o_orderstatus") == status)
            out = out.union(self._changes(rows, "order_info", F.lit("update"), at, base | {"order_status": F.lit(after), "operate_time": _clock(at)}, {"order_status": F.lit(before)}, of))
        return out

    @cached_property
    def refund_lines(self) -> DataFrame:
        return self.last_lines.filter(F.col("l_returnflag") == "R")

    @cached_property
    def changes(self) -> DataFrame:
        """All of topic_db, parsed; the order of a row stands beside its data, null if it has none."""
        c, insert = F.col, F.lit("insert")
        x, of = self.last_lines, {"order_id": c("order_id")}
        out = self.order_changes.union(self._changes(x, "order_detail", insert, c("ts"), {
            "id": c("id"), "order_id": c("order_id"), "sku_id": c("sku_id"), "sku_name": c("sku_name"), "create_time": _clock(c("ts")), "sku_num": c("sku_num"), "order_price": c("order_price"),
            "split_total_amount": c("order_amount"), "split_activity_amount": c("activity_amount"), "split_coupon_amount": c("coupon_amount"),
        }, order=of))
        activity, coupon = F.round(c("l_discount") * 100).cast("int"), F.round(c("l_tax") * 100).cast("int")
        items, shipped, line = self.last_items, F.unix_timestamp(c("l_shipdate").cast("timestamp")), F.concat_ws("-", "order_id", "l_linenumber")
        out = out.union(self._changes(items.filter("l_discount >= 0.05"), "order_detail_activity", insert, shipped, {"order_detail_id": line, "activity_id": activity, "activity_rule_id": F.concat(F.lit("r"), activity)}, order=of))
        out = out.union(self._changes(items.filter("l_tax >= 0.04"), "order_detail_coupon", insert, shipped, {"order_detail_id": line, "coupon_id": coupon}, order=of))
        r, part = self.refund_lines, c("l_partkey")
        asked, paid = c("ts") + 3600, c("ts") + 90000
        out = out.union(self._changes(r, "order_refund_info", insert, asked, {
            "id": F.concat(F.lit("r"), c("id")), "user_id": c("user_id"), "order_id": c("order_id"), "sku_id": c("sku_id"), "refund_type": 1501 + part % 2, "refund_num": c("l_quantity").cast("long"),
            "refund_amount": c("order_amount"), "refund_reason_type": 1301 + part % 7, "refund_reason_txt": F.concat(F.lit("reason "), part % 5), "create_time": _clock(asked),
        }, order=of))
        out = out.union(self._changes(r, "refund_payment", F.lit("update"), paid, {
            "id": F.concat(F.lit("p"), c("id")), "order_id": c("order_id"), "sku_id": c("sku_id"), "payment_type": 1101 + part % 4, "callback_time": _clock(paid), "total_amount": c("order_amount"),
        }, order=of))
        key, at = c("o_orderkey"), c("ts") + (c("o_orderkey") * 7) % 1200 - 10
        out = out.union(self._changes(self.orders.filter("o_orderstatus in ('F', 'O')"), "payment_info", F.lit("update"), at, {
            "user_id": c("o_custkey"), "order_id": key, "payment_type": 1101 + key % 3, "callback_time": _clock(at),
        }, order={"order_id": key}))
        carts, old, none = self.carts, {"sku_num": c("old_sku_num")}, {"order_id": F.lit(None)}
        data = {n: c(n) for n in ("id", "user_id", "sku_id", "sku_num")}
        out = out.union(self._changes(carts, "cart_info", c("type"), c("ts"), data, old, none))
        return out.union(self._changes(self.comments, "comment_info", insert, c("id"), {n: c(n) for n in ("id", "user_id", "sku_id", "appraise", "comment_txt")}, order=none))

    @cached_property
    def carts(self) -> DataFrame:
        e, k = F.col("event_id"), F.col("k")
        rows = self.events.filter("event_type = 'click'")
        old = F.when((e % 3 == 0) | (e % 5 == 0), F.lit(None)).otherwise((e * 7) % 50)
        return rows.select(
            _string("event_id").alias("id"), _string("user_id").alias("user_id"), _string(k % 20).alias("sku_id"), F.when(e % 3 == 0, "insert").otherwise("update").alias("type"), (k % 50).alias("sku_num"), old.alias("old_sku_num"), F.unix_timestamp("time").alias("ts")
        )

    @cached_property
    def comments(self) -> DataFrame:
        rows = self.table("labels").join(self.table("documents").select("doc_id", "text", "n_chars"), "doc_id")
        return rows.select(
            _string("doc_id").alias("id"), _string(F.col("n_chars") % 97).alias("user_id"), _string(F.col("n_chars") % 20).alias("sku_id"), _string(1201 + F.col("quality") * 2 + F.col("toxic")).alias("appraise"), F.col("text").alias("comment_txt")
        )

    @cached_property
    def events(self) -> DataFrame:
        k = F.get_json_object("props", "$.k").cast("bigint")
        return spread(self.table("events")).select("event_id", "user_id", "event_type", "value", "props", k.alias("k"), F.col("ts").cast("timestamp").alias("time"))

    @cached_property
    def page_log(self) -> DataFrame:
        k, user, kind = F.col("k"), F.col("user_id"), F.col("event_type")
        page = F.when(kind == "view", "home").when(kind == "click", "good_detail").when(kind == "purchase", "payment").when(kind == "signup", "register").otherwise("mine")
        last = F.when(k % 6 == 1, "login").when(k % 6 == 2, "search").when(k % 6 == 3, "").when(k % 6 > 3, "home")
        return self.events.select(
            F.concat(F.lit("mid_"), user).alias("mid"), F.when(k % 4 == 0, "").otherwise(_string(user)).alias("uid"), F.when(k % 3 == 0, "v2.1").when(k % 3 == 1, "v2.0").alias("vc"), F.concat(F.lit("ch"), k % 5).alias("ch"), F.concat(F.lit("ar"), user % 7).alias("ar"),
            F.when(k % 10 < 7, "0").otherwise("1").alias("is_new"), page.alias("page_id"), last.alias("last_page_id"), F.round(F.col("value") * 1000).cast("bigint").alias("during_time"), F.unix_millis("time").alias("ts"), "event_id", "k",
        ).withColumn("time", F.timestamp_millis("ts"))

    @cached_property
    def topic_log(self) -> DataFrame:
        """The app log as text, with lines that are no records."""
        e, k = F.col("event_id"), F.col("k")
        text = lambda **v: F.create_map(*[x for n, c in v.items() for x in (F.lit(n), c.cast("string"))])
        shown = lambda n: text(item=k % 20, order=F.lit(n))
        record = F.struct(
            F.struct("mid", "uid", "vc", "ch", "ar", "is_new").alias("common"), F.struct("page_id", "last_page_id", "during_time").alias("page"),
            F.when(e % 3 == 1, F.array(shown(1))).when(e % 3 == 2, F.array(shown(1), shown(2))).alias("displays"), F.when(e % 5 == 0, F.array(text(action_id=F.lit("favor"), ts=F.col("ts")))).alias("actions"),
            F.when(e % 7 == 0, text(entry=F.lit("icon"))).alias("start"), F.when(e % 11 == 0, text(msg=k)).alias("err"), "ts",
        )
        good = self.page_log.select(F.to_json(record).alias("value"))
        odd = e % 100
        bad = F.when(odd == 1, "nope").when(odd == 2, "123").when(odd == 3, "").when(odd == 5, "[1]")
        return good.union(self.page_log.filter(odd.between(1, 5)).select(bad.alias("value")))

    @cached_property
    def topic_db(self) -> DataFrame:
        """Change events of parts and suppliers as text, with bootstrap marks, records without a type, and lines that are no records."""
        mark = lambda n: F.when(n % 9 == 0, "bootstrap-start").when(n % 9 == 1, "bootstrap-insert").when(n % 9 == 2, "bootstrap-complete").when(n % 9 == 3, F.lit(None)).when(n % 9 == 4, "update").otherwise("insert")
        p, s = F.col("p_partkey"), F.col("s_suppkey")
        parts = self._changes(self.table("part"), "sku_info", mark(p), 1_700_000_000 + p, {"id": p, "sku_name": F.col("p_name"), "tm_id": F.col("p_brand"), "price": F.col("p_size")}, {"price": p % 7})
        suppliers = self._changes(self.table("supplier"), "spu_info", mark(s), 1_700_000_000 + s, {"id": s, "spu_name": F.col("s_name")}, {"spu_name": s})
        bad = F.when(p % 50 == 1, "nope").when(p % 50 == 2, "").when(p % 50 == 4, "{")
        lines = self.table("part").filter((p % 50).isin(1, 2, 3, 4)).select(bad.alias("value"))
        return parts.union(suppliers).select(F.to_json(F.struct("*")).alias("value")).union(lines)

    @cached_property
    def fact_changes(self) -> DataFrame:
        """Changes that the configuration routes to facts: registrations, favours, coupons; others, that it doesn't."""
        c = F.col
        table = F.when(c("event_type") == "signup", "user_info").when(c("event_type") == "view", "favor_info").when(c("event_type") == "click", "coupon_use").otherwise("other")
        rows = self.events.withColumn("of", table)
        data = {"id": c("event_id"), "user_id": c("user_id"), "sku_id": c("k"), "create_time": F.unix_timestamp("time"), "of": c("of")}
        kind = F.when(c("event_id") % 4 == 0, "update").otherwise("insert")
        return self._changes(rows, "", kind, F.unix_timestamp("time"), data).withColumn("table", c("data")["of"])

    # dimensions
    @cached_property
    def trademark(self) -> DataFrame:
        return self.table("part").select(F.col("p_brand").alias("id"), F.concat(F.lit("tm "), "p_brand").alias("tm_name")).distinct()

    @cached_property
    def category3(self) -> DataFrame:
        return self.table("nation").select(_string("n_nationkey").alias("id"), F.col("n_name").alias("name"), _string("n_regionkey").alias("category2_id"))

    @cached_property
    def category2(self) -> DataFrame:
        return self.table("region").select(_string("r_regionkey").alias("id"), F.col("r_name").alias("name"), _string(F.col("r_regionkey") % 2).alias("category1_id"))

    @cached_property
    def category1(self) -> DataFrame:
        return self.table("region").filter("r_regionkey < 1").select(_string("r_regionkey").alias("id"), F.concat(F.lit("top "), "r_name").alias("name"))

    @cached_property
    def spu(self) -> DataFrame:
        return self.table("supplier").select(_string("s_suppkey").alias("id"), F.col("s_name").alias("spu_name"))

    @cached_property
    def sku(self) -> DataFrame:
        p = F.col("p_partkey")
        return self.table("part").select(_string(p).alias("id"), F.col("p_name").alias("sku_name"), _string(p % 10).alias("spu_id"), F.col("p_brand").alias("tm_id"), _string(p % 25).alias("category3_id"))

    @cached_property
    def province(self) -> DataFrame:
        """One nation has no row."""
        return self.table("nation").filter("n_nationkey <> 7").select(_string("n_nationkey").alias("id"), F.col("n_name").alias("name"))

    @cached_property
    def search_log(self) -> DataFrame:
        """Page records of the log as text: a user's turn is a search; other turns come from another page, or are of another type."""
        ts = F.lit(1704067200000) + F.col("conv_id") * 3000 + F.col("turn") * 500
        user, odd = F.col("role") == "user", F.col("turn") % 2 == 0
        page = F.struct(
            F.lit("good_list").alias("page_id"), F.when(user | odd, "search").otherwise("home").alias("last_page_id"), F.trim("text").alias("item"), F.when(user | ~odd, "keyword").otherwise("sku_id").alias("item_type"), F.lit(1).cast("long").alias("during_time"),
        )
        return self.table("conversations").select(F.to_json(F.struct(page.alias("page"), ts.alias("ts"))).alias("value"))


#: DuckDB views; a query's oracle starts with those it needs.
VIEWS: dict[str, str] = {
    "dic": "select code as dic_code, 'name ' || code as dic_name from (select unnest([" + ", ".join(f"'{c}'" for c in CODES) + "]) as code)",
    "o_fx": "select o_orderkey, o_custkey, o_orderstatus, c_nationkey, cast(epoch(o_orderdate) as bigint) + (o_orderkey * 37) % 86400 as ts from orders join customer on o_custkey = c_custkey",
    "lines": """select concat(l_orderkey, '-', l_linenumber) as id, cast(l_orderkey as varchar) as order_id, cast(l_partkey as varchar) as sku_id, p_name as sku_name, cast(o_custkey as varchar) as user_id, cast(c_nationkey as varchar) as province_id,
        cast(l_quantity as decimal(16,2)) as sku_num, cast(p_retailprice as decimal(16,2)) as order_price, cast(cast(l_quantity as decimal(16,2)) * cast(p_retailprice as decimal(16,2)) as decimal(20,4)) as original_amount,
        cast(cast(l_extendedprice as decimal(16,2)) * cast(l_discount as decimal(16,2)) as decimal(20,4)) as activity_amount, cast(cast(l_extendedprice as decimal(16,2)) * cast(l_tax as decimal(16,2)) as decimal(20,4)) as coupon_amount,
        cast(l_extendedprice as decimal(16,2)) as order_amount, l_discount, l_tax, l_quantity, l_returnflag, l_orderkey, l_linenumber, l_shipdate, l_partkey, l_suppkey, l_extendedprice, ts
        from lineitem join o_fx on l_orderkey = o_orderkey join part on l_partkey = p_partkey""",
    "last_lines": "select * from lines qualify row_number() over (partition by id order by l_shipdate desc, l_partkey desc, l_suppkey desc, l_extendedprice desc) = 1",
    "activity": "select id, cast(cast(round(l_discount * 100) as int) as varchar) as activity_id, 'r' || cast(cast(round(l_discount * 100) as int) as varchar) as activity_rule_id from last_lines where l_discount >= 0.05",
    "coupon": "select id, cast(cast(round(l_tax * 100) as int) as varchar) as coupon_id from last_lines where l_tax >= 0.04",
    "refund_lines": "select * from last_lines where l_returnflag = 'R'",
    "details": """select d.id, d.order_id, d.user_id, d.sku_id, d.sku_name, d.province_id, activity_id, activity_rule_id, coupon_id, strftime(epoch_ms(ts * 1000), '%Y-%m-%d') as date_id, strftime(epoch_ms(ts * 1000), '%Y-%m-%d %H:%M:%S') as create_time,
        cast(sku_num as varchar) as sku_num, cast(original_amount as varchar) as split_original_amount, cast(activity_amount as varchar) as split_activity_amount, cast(coupon_amount as varchar) as split_coupon_amount, cast(order_amount as varchar) as split_total_amount, cast(ts as varchar) as ts
        from last_lines d left join activity using (id) left join coupon using (id)""",
    "refunds": """select 'r' || r.id as id, r.user_id, r.order_id, r.sku_id, r.province_id, strftime(epoch_ms((r.ts + 3600) * 1000), '%Y-%m-%d') as date_id, strftime(epoch_ms((r.ts + 3600) * 1000), '%Y-%m-%d %H:%M:%S') as create_time,
        cast(1501 + l_partkey % 2 as varchar) as refund_type_code, a.dic_name as refund_type_name, cast(1301 + l_partkey % 7 as varchar) as refund_reason_type_code, b.dic_name as refund_reason_type_name, 'reason ' || (l_partkey % 5) as refund_reason_txt,
        cast(cast(l_quantity as bigint) as varchar) as refund_num, cast(order_amount as varchar) as refund_amount, cast(r.ts + 3600 as varchar) as ts
        from refund_lines r join o_fx on l_orderkey = o_orderkey and o_orderstatus = 'P' join dic a on a.dic_code = cast(1501 + l_partkey % 2 as varchar) join dic b on b.dic_code = cast(1301 + l_partkey % 7 as varchar)""",
    "pays": "select cast(o_orderkey as varchar) as order_id, cast(o_custkey as varchar) as user_id, cast(1101 + o_orderkey % 3 as varchar) as payment_type, ts + (o_orderkey * 7) % 1200 - 10 as ts from o_fx where o_orderstatus in ('F', 'O')",
    "payments": """select d.id as order_detail_id, p.order_id, p.user_id, d.sku_id, d.sku_name, d.province_id, d.activity_id, d.activity_rule_id, d.coupon_id, p.payment_type as payment_type_code, dic_name as payment_type_name, strftime(epoch_ms(p.ts * 1000), '%Y-%m-%d %H:%M:%S') as callback_time,
        cast(null as varchar) as source_id, cast(null as varchar) as source_type_code, cast(null as varchar) as source_type_name, d.sku_num, d.split_original_amount, d.split_activity_amount, d.split_coupon_amount, d.split_total_amount as split_payment_amount, cast(p.ts as varchar) as ts
        from pays p join dic on payment_type = dic_code join details d on d.order_id = p.order_id and cast(d.ts as bigint) between p.ts - 900 and p.ts + 5""",
    "ev": "select *, cast(json_extract_string(props, '$.k') as bigint) as k, epoch_us(ts) // 1000 as ms, epoch_us(ts) // 1000000 as sec from events",
    "cart": "select cast(event_id as varchar) as id, cast(user_id as varchar) as user_id, cast(k % 20 as varchar) as sku_id, case when event_id % 3 = 0 then 'insert' else 'update' end as type, k % 50 as sku_num, case when event_id % 3 = 0 or event_id % 5 = 0 then null else (event_id * 7) % 50 end as old_sku_num, sec as ts from ev where event_type = 'click'",
    "cart_adds": "select id, user_id, sku_id, cast(case when type = 'insert' then sku_num else sku_num - old_sku_num end as varchar) as sku_num, cast(ts as varchar) as ts from cart where type = 'insert' or old_sku_num is not null and sku_num > old_sku_num",
    "pages_log": """select concat('mid_', user_id) as mid, case when k % 4 = 0 then '' else cast(user_id as varchar) end as uid, case k % 3 when 0 then 'v2.1' when 1 then 'v2.0' end as vc, concat('ch', k % 5) as ch, concat('ar', user_id % 7) as ar, case when k % 10 < 7 then '0' else '1' end as is_new,
        case event_type when 'view' then 'home' when 'click' then 'good_detail' when 'purchase' then 'payment' when 'signup' then 'register' else 'mine' end as page_id, case k % 6 when 0 then null when 1 then 'login' when 2 then 'search' when 3 then '' else 'home' end as last_page_id,
        cast(round(value * 1000) as bigint) as during_time, ms as ts, event_id, k from ev""",
    "visitor": "select mid, case when arg_min(is_new, (ts, event_id)) = '1' then cast(epoch_ms(min(ts)) as date) else cast(epoch_ms(min(ts)) as date) - 1 end as base from pages_log group by mid",
    "repaired": "select p.* exclude (is_new), case when is_new = '1' and cast(epoch_ms(ts) as date) <> base then '0' else is_new end as is_new from pages_log p join visitor using (mid)",
    "marked": "select p.*, v.is_new as fixed from pages_log p join repaired v using (event_id)",
    "sku": "select cast(p_partkey as varchar) as id, p_name as sku_name, cast(p_partkey % 10 as varchar) as spu_id, p_brand as tm_id, cast(p_partkey % 25 as varchar) as category3_id from part",
    "tm": "select distinct p_brand as id, 'tm ' || p_brand as tm_name from part",
    "c3": "select cast(n_nationkey as varchar) as id, n_name as name, cast(n_regionkey as varchar) as category2_id from nation",
    "c2": "select cast(r_regionkey as varchar) as id, r_name as name, cast(r_regionkey % 2 as varchar) as category1_id from region",
    "c1": "select cast(r_regionkey as varchar) as id, 'top ' || r_name as name from region where r_regionkey < 1",
    "flat": """select sku.id, sku.sku_name, sku.spu_id, sku.tm_id, sku.category3_id, s_name as spu_name, tm_name as trademark_name, c3.name as category3_name, c3.category2_id, c2.name as category2_name, c2.category1_id, c1.name as category1_name
        from sku left join supplier on cast(s_suppkey as varchar) = spu_id left join tm on tm.id = tm_id left join c3 on c3.id = category3_id left join c2 on c2.id = c3.category2_id left join c1 on c1.id = c2.category1_id""",
    "signed": """select *, 1 as s from lines union all select * exclude (last), -1 as s from (select *, lead(1) over (partition by id order by l_shipdate, l_partkey, l_suppkey, l_extendedprice) as last from lines) where last is not null""",
}
