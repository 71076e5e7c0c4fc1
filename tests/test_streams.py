"""Streams give what batches give, for all windows that the watermark has closed."""

import datetime as dt
import json
from decimal import Decimal

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from millrace import sinks
from millrace.operators import etl, facts, joins, keyed, summaries
from millrace.plans.fixtures import ARRIVAL, Inputs
from millrace.schemas import CONFIG, ORDER_DETAIL
from millrace.sinks import to_files, to_topic
from millrace.sources.topics import parse_changes, parse_page_log, parse_rows, read_topic_files, with_row_time
from millrace.streaming import keyed as stream_keyed
from millrace.streaming import log
from millrace.streaming import summaries as streams

SF = "/root/testdata/sf0.001"


def replay(spark, df, path, delay="0 seconds", by=()):
    """df as a stream of files in time order (ties by `by`), and a row of the far future to close the last window."""
    n = df.withColumn("_n", F.ntile(3).over(Window.orderBy("time", *by))).persist()
    for i in (1, 2, 3):
        n.filter(f"_n = {i}").drop("_n").coalesce(1).write.mode("append").parquet(path)
    last = n.orderBy(F.col("time").desc()).limit(1).withColumn("time", F.col("time") + F.expr("interval 15000 days")).drop("_n")
    last = last.withColumn("id", F.lit("none")) if "id" in df.columns else last  # so that it replaces nothing
    last.coalesce(1).write.mode("append").parquet(path)
    n.unpersist()
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path).withWatermark("time", delay)


def run(df, tmp_path):
    q = df.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.read.schema(df.schema).parquet(f"{tmp_path}/out")


def same(stream, batch):
    pick = lambda df: sorted(repr(tuple(r)) for r in df.filter("stt < '2026'").select(*sorted(batch.columns)).collect())
    got, want = pick(stream), pick(batch)
    assert got == want and len(want) > 20


@pytest.fixture(scope="module")
def pages(spark):
    return Inputs(spark, SF).page_log.drop("k")


def test_logins(spark, pages, tmp_path):
    same(run(streams.login_users(replay(spark, pages, f"{tmp_path}/in"), 3), tmp_path), summaries.login_users(pages, 3))


def test_page_views_with_repair(spark, pages, tmp_path):
    got = run(stream_keyed.repair_is_new(replay(spark, pages, f"{tmp_path}/in")), tmp_path)
    pick = lambda df: sorted((r.event_id, r.is_new) for r in df.filter("time < '2026-01-01'").collect())
    assert pick(got) == pick(keyed.repair_is_new(pages))


def test_home_and_product_pages(spark, pages, tmp_path):
    same(run(streams.home_detail_visitors(replay(spark, pages, f"{tmp_path}/in")), tmp_path), summaries.home_detail_visitors(pages))


def test_page_views(spark, pages, tmp_path):
    same(run(streams.page_views(replay(spark, pages, f"{tmp_path}/in")), tmp_path), summaries.page_views(pages))


def test_keywords_need_no_state_of_their_own(spark, tmp_path):
    log = parse_page_log(Inputs(spark, SF).search_log)
    searches = etl.searches(log.select(F.col("page.last_page_id").alias("last_page_id"), F.col("page.item_type").alias("item_type"), F.col("page.item").alias("item"), F.col("row_time").alias("time")))
    same(run(streams.keywords(replay(spark, searches, f"{tmp_path}/in")), tmp_path), summaries.keywords(searches))


def timed(spark, path, schema, files, delay="0 seconds"):
    """(stream, batch) of rows whose last column is a time, in seconds of one hour; a file is a micro-batch."""
    files = [[(*r[:-1], None if r[-1] is None else dt.datetime(2024, 1, 1) + dt.timedelta(seconds=r[-1])) for r in f] for f in files]
    df = spark.createDataFrame([r for f in files for r in f], schema)
    for i, rows in enumerate(files):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{path}/{i:03d}")
        for p in sorted(__import__("pathlib").Path(path, f"{i:03d}").glob("*.parquet")):
            __import__("os").utime(p, (1_700_000_000 + i, 1_700_000_000 + i))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(path)
    return stream.withWatermark("time", delay), df


LINE = "id string, n int, sku_id string, original_amount decimal(20,4), activity_amount decimal(20,4), coupon_amount decimal(20,4), order_amount decimal(16,2), order_id string, province_id string, time timestamp"


def line(i, n, amount, at, sku="s1"):
    x = None if amount is None else Decimal(amount)
    return (i, n, sku, x, x, None, x, f"o{i}", "p1", at)


@pytest.fixture
def one_partition(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


def summed(spark, tmp_path, files, kind, delay="0 seconds", keep=streams.REPEATS):
    """Windows of the stream by sku or province, and of a batch."""
    of, measures, key, columns = {"sku": (streams.sku_orders, summaries.sku_sums, "sku_id", summaries.SKU_MEASURES), "province": (streams.province_orders, summaries.province_sums, "province_id", ["order_amount"])}[kind]
    stream, df = timed(spark, f"{tmp_path}/in", LINE, [*files, [line("end", 1, 0, 3000)], [line("end2", 1, 0, 3100)]], delay)
    got = run(of(stream, ["n"], keep=keep), tmp_path)
    want = summaries.by_window(keyed.replace_by_cancel(df, "id", ["n"], columns), *measures(), keys=(key,))
    pick = lambda d: sorted(repr(tuple(r)) for r in d.filter("stt < '2024-01-01 00:40:00'").collect())
    return pick(got), pick(want)


REPEATED = {
    "the watermark has passed the line": [[line("a", 1, 5, 20)], [line("b", 1, 1, 22)], [line("a", 2, 7, 23)]],
    "every second": [[line("a", i, i, 20 + i), line("b", 1, 2, 20 + i)] for i in range(1, 7)],
    "across windows": [[line("a", 1, 5, 18)], [line("b", 1, 1, 19)], [line("a", 2, 7, 21, "s2")], [line("c", 1, 1, 25)], [line("a", 3, 8, 30)], [line("d", 1, 1, 33)], [line("a", 4, 9, 40)]],
    "long after, but within keep of the last": [[line("a", 1, 5, 0)], [line("x", 1, 1, 9)], [line("a", 2, 6, 9.5)], [line("x", 2, 1, 17)], [line("a", 3, 7, 19)]],
    "in one micro-batch that the watermark has passed": [[line("a", 1, 5, 20)], [line("b", 1, 1, 29.5), line("a", 2, 6, 29.5)], [line("a", 3, 1, 30)]],
    "nulls": [[line("a", 1, None, 20), line(None, 1, 5, 20), line(None, 1, 5, 21), line("t", 1, 3, None)], [line("b", 1, 1, 22), line(None, 2, 7, 23)], [line("a", 2, 7, 23), line("t", 2, 3, None), line("b", 2, None, 24)]],
}


def one_after_the_other(cases, apart=100):
    """All cases as one stream, each with lines of its own, some time after the one before."""
    moved = lambda r, k: (None if r[0] is None else f"{k}{r[0]}", *r[1:-1], None if r[-1] is None else r[-1] + k * apart)
    return [[moved(r, k) for r in f] for k, files in enumerate(cases) for f in files]


@pytest.mark.parametrize(("kind", "delay"), [("sku", "0 seconds"), ("province", "4 seconds")])
def test_repeated_lines_never_stop_a_stream(spark, tmp_path, one_partition, kind, delay):
    got, want = summed(spark, tmp_path, one_after_the_other(REPEATED.values()), kind, delay)
    assert got == want and len(want) >= 10


def test_other_times_to_keep(spark, tmp_path, one_partition):
    """Windows stay those of the rows' own times."""
    import pandas as pd

    files = [[line("a", 1, 5, 18)], [line("b", 1, 1, 19)], [line("a", 2, 7, 21, "s2")], [line("c", 1, 1, 24)], [line("a", 3, 8, 24.25)]]
    got, want = summed(spark, tmp_path, files, "sku", keep=pd.Timedelta(seconds=3.5))
    assert got == want and len(want) == 3


def test_a_late_earlier_row_takes_no_time_from_the_last(spark, tmp_path, one_partition):
    """Delay 20 s, keep 10 s: n=1 comes late, the clock goes on past its end, and n=3 still replaces n=2."""
    files = [[line("a", 2, 6, 40)], [line("a", 1, 5, 25)], [line("x", 1, 1, 56)], [line("x", 2, 1, 56)], [line("a", 3, 7, 41)]]
    got, want = summed(spark, tmp_path, files, "sku", "20 seconds")
    assert got == want and want


def test_a_repeat_after_its_time_replaces_nothing(spark, tmp_path, one_partition):
    got, _ = summed(spark, tmp_path, [[line("a", 1, 5, 5)], [line("b", 1, 1, 16)], [line("a", 2, 7, 17)]], "sku")
    assert len(got) == 2 and "'5.0000'" in got[0] and "'8.0000'" in got[1]


def signed(df, *columns):
    return sorted(repr(tuple(r)) for r in df.filter("time < '2026-01-01'").select("id", "sign", *columns).collect())


@pytest.mark.parametrize("ties", ["in order", "reversed", "shuffled"])
def test_replaced_lines_are_those_of_a_batch(spark, tmp_path, ties):
    """All rows of a line have one time, so files cut through them: in order of arrival, or not."""
    lines = Inputs(spark, SF).order_lines.select("id", "order_amount", "activity_amount", *ARRIVAL, "time").filter("id like '1%'")
    by = {"in order": ["id", *ARRIVAL], "reversed": [F.col(c).desc() for c in ("id", *ARRIVAL)], "shuffled": [F.xxhash64("id", *ARRIVAL)]}[ties]
    stream = replay(spark, lines, f"{tmp_path}/in", by=by)
    got = run(stream_keyed.replace_by_cancel(stream, "id", ARRIVAL, ["order_amount"], keep=streams.REPEATS), tmp_path)
    pick = [*ARRIVAL, "order_amount", "activity_amount"]
    got, want = signed(got, *pick), signed(keyed.replace_by_cancel(lines, "id", ARRIVAL, ["order_amount"]), *pick)
    assert got == want and len(want) > 2000


def put(df, path, *files):
    for rows in files:
        df.sparkSession.createDataFrame(rows, df.schema).coalesce(1).write.mode("append").parquet(path)


def test_replaced_rows_of_odd_values(spark, tmp_path):
    """Nulls in measures and other columns, rows that come too early or too late, numbers of all kinds."""
    at = lambda s: dt.datetime(2024, 1, 1, 0, 0, s)
    schema = "id string, n int, amount decimal(16,2), many long, share double, note string, time timestamp"
    rows = [
        [("a", 1, Decimal("5.00"), 1, 0.5, None, at(1)), ("b", 2, Decimal("7.00"), 2, 1.5, "b2", at(1)), (None, 1, Decimal("1.00"), 1, 1.0, "x", at(1))],
        [("a", 2, None, None, None, "a2", at(2)), ("b", 1, Decimal("3.00"), 1, None, None, at(2)), (None, None, Decimal("2.00"), 2, 2.0, None, at(2))],
        [("a", 3, Decimal("9.00"), 9, 9.5, None, at(3)), ("c", None, None, None, None, None, at(3))],
    ]
    df = spark.createDataFrame([r for f in rows for r in f], schema)
    put(df, f"{tmp_path}/in", *rows)
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in").withWatermark("time", "1 minute")
    got = run(stream_keyed.replace_by_cancel(stream, "id", ["n"], ["amount", "many", "share"]), tmp_path)
    pick = ["n", "amount", "many", "share", "note", "time"]
    assert signed(got, *pick) == signed(keyed.replace_by_cancel(df, "id", ["n"], ["amount", "many", "share"]), *pick)


def test_state_of_replaced_lines_ends(spark, tmp_path):
    """A repeat that comes later than `keep` replaces nothing."""
    at = lambda s: dt.datetime(2024, 1, 1, 0, 0, s)
    df = spark.createDataFrame([("a", 1, Decimal("5.00"), at(0))], "id string, n int, amount decimal(16,2), time timestamp")
    put(df, f"{tmp_path}/in", [("a", 1, Decimal("5.00"), at(0)), ("b", 1, Decimal("5.00"), at(0))], [("a", 2, Decimal("6.00"), at(5)), ("z", 1, Decimal("0.00"), at(40))], [("z", 2, Decimal("0.00"), at(41))], [("b", 2, Decimal("6.00"), at(50))])
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in").withWatermark("time", "0 seconds")
    got = run(stream_keyed.replace_by_cancel(stream, "id", ["n"], ["amount"], keep=streams.REPEATS), tmp_path)
    assert sorted((r.id, r.n, r.sign) for r in got.filter("id <> 'z'").collect()) == [("a", 1, -1), ("a", 1, 1), ("a", 2, 1), ("b", 1, 1), ("b", 2, 1)]


@pytest.fixture(scope="module")
def lines(spark):
    return Inputs(spark, SF).order_lines.select("id", "order_id", "sku_id", "user_id", "province_id", *summaries.SKU_MEASURES, *ARRIVAL, "time").persist()


def test_sku_orders(spark, lines, tmp_path):
    t = Inputs(spark, SF)
    skus = joins.flat_sku(t.sku, t.spu, t.trademark, t.category3, t.category2, t.category1)
    same(run(streams.sku_orders(replay(spark, lines, f"{tmp_path}/in", by=[F.xxhash64("id", *ARRIVAL)]), ARRIVAL, skus), tmp_path), summaries.sku_orders(lines, skus, ARRIVAL))


def test_province_orders(spark, lines, tmp_path):
    t = Inputs(spark, SF)
    same(run(streams.province_orders(replay(spark, lines, f"{tmp_path}/in", by=["id", *ARRIVAL]), ARRIVAL, t.province), tmp_path), summaries.province_orders(lines, t.province, ARRIVAL))


def test_cart_users(spark, tmp_path):
    carts = Inputs(spark, SF).carts.select("id", "user_id", F.timestamp_seconds("ts").alias("time"))
    same(run(streams.cart_users(replay(spark, carts, f"{tmp_path}/in", by=["id"])), tmp_path), summaries.cart_users(carts))


def test_order_and_paying_users(spark, lines, tmp_path):
    got = run(streams.users(replay(spark, lines, f"{tmp_path}/in", by=["id"]), "id", "order_unique_user_count", "order_new_user_count"), tmp_path)
    same(got, summaries.order_users(lines))
    paid = lines.withColumnRenamed("id", "order_detail_id")
    assert sorted(map(tuple, summaries.paying_users(paid).collect())) == sorted(map(tuple, summaries.order_users(lines).collect()))


def test_refunds(spark, lines, tmp_path):
    rows, skus = lines.select("order_id", "user_id", "sku_id", "time"), Inputs(spark, SF).sku
    same(run(streams.refunds(replay(spark, rows, f"{tmp_path}/in"), skus), tmp_path), summaries.refunds(rows, skus))


def test_registrations(spark, pages, tmp_path):
    rows = pages.filter("page_id = 'register'").select("event_id", "time")
    same(run(streams.registrations(replay(spark, rows, f"{tmp_path}/in")), tmp_path), summaries.registrations(rows))


def test_late_rows_are_dropped(spark, tmp_path):
    at = lambda s: dt.datetime(2024, 1, 1, 0, 0, s)
    df = spark.createDataFrame([("1", at(1))], "id string, time timestamp")
    put(df, f"{tmp_path}/in", [("1", at(1))], [("2", at(25))], [("3", at(26))], [("4", at(2)), ("5", at(27))], [("6", at(59))], [("7", at(59))])
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in").withWatermark("time", "0 seconds")
    got = {r.stt[-2:]: r.register_ct for r in run(streams.registrations(stream), tmp_path).collect()}
    assert got == {"00": 1, "20": 3}  # "4" comes after its window has closed


def lines_of(spark, path, *files):
    """Text files, one a micro-batch, in this order."""
    import os
    import pathlib

    pathlib.Path(path).mkdir(parents=True, exist_ok=True)
    for i, rows in enumerate(files):
        at = pathlib.Path(path, f"{i:03d}.txt")
        at.write_text("".join(r + "\n" for r in rows))
        os.utime(at, (1_700_000_000 + i, 1_700_000_000 + i))
    return read_topic_files(spark, path)


def change(table, kind, ts, old=None, **data):
    return json.dumps({"database": "shop", "table": table, "type": kind, "ts": str(ts), "data": data} | ({"old": old} if old else {}))


def order_events(o, ts, gap=2):
    """An order of two lines; the first has an activity, and a coupon if its number is even."""
    out = [(ts, change("order_info", "insert", ts, id=o, user_id=f"u{o}", province_id="1"))]
    for n in (1, 2):
        line = f"{o}-{n}"
        at = ts + n % 2 * gap
        out.append((at, change("order_detail", "insert", at, id=line, order_id=o, sku_id=f"s{n}", sku_name="x", create_time="2024-01-01 00:00:00", sku_num="2", order_price="3.50", split_total_amount="7.00")))
        if n == 1:
            out.append((at + 1, change("order_detail_activity", "insert", at + 1, order_detail_id=line, activity_id="a", activity_rule_id="r")))
            out += [(at + 3, change("order_detail_coupon", "insert", at + 3, order_detail_id=line, coupon_id="c"))] if int(o) % 2 == 0 else []
    return out


def in_files(events, n=4):
    events = [e for _, e in sorted(events)]
    size = -(-len(events) // n)
    return [events[i : i + size] for i in range(0, len(events), size)]


def closing(table="other", at=2_000_000_000):
    return [[change(t, "insert", at + i, id="end", order_id="end", order_detail_id="end") for t in ("order_info", "order_detail", "order_detail_activity", "order_detail_coupon")] for i in (0, 1)]


def facts_of(stream, batch, tmp_path, drop=("row_time", "row_op_ts")):
    pick = lambda df: sorted(repr(tuple(r)) for r in df.filter("order_id <> 'end'").drop(*drop).collect())
    got, want = pick(run(stream, tmp_path)), pick(batch)
    assert got == want and want
    return got


def test_order_details(spark, tmp_path):
    """As a batch, for events that lie close; an activity that comes later than is kept for is left out, an order drops its lines."""
    T = 1_704_067_200
    events = [e for o in range(1, 21) for e in order_events(str(o), T + 60 * o)]
    late = [(T + 60 + 300, change("order_detail_activity", "insert", T + 360, order_detail_id="1-2", activity_id="late", activity_rule_id="r")), *order_events("77", T + 5000, gap=60)]
    files = [*in_files(events + late), *closing()]
    raw = with_row_time(parse_changes(lines_of(spark, f"{tmp_path}/in", *files)))
    near = spark.createDataFrame([(e,) for _, e in events] + [(e,) for _, e in late[1:] if '"77-1"' not in e], "value string")
    got = facts_of(facts.order_detail(raw, keep=facts.KEEP), facts.order_detail(parse_changes(near)), tmp_path)
    assert len(got) == 41


def test_cancelled_details_refunds_and_payments(spark, tmp_path):
    T = 1_704_067_200
    dictionary = spark.createDataFrame([("1", "one"), ("2", "two")], "dic_code string, dic_name string")
    events = [e for o in range(1, 13) for e in order_events(str(o), T + 60 * o)]
    for o in range(1, 13):
        at = T + 60 * o
        events.append((at + 600, change("order_info", "update", at + 600, {"order_status": "1001"}, id=str(o), user_id="u", province_id="1", order_status="1003", operate_time="2024-01-02 03:04:05")))
        events.append((at + 30, change("payment_info", "update", at + 30, user_id="u", order_id=str(o), payment_type=str(o % 3), callback_time="x")))
        for status, table, kind in (("1005", "order_refund_info", "insert"), ("1006", "refund_payment", "update")):
            when = at + (700 if status == "1005" else 704)
            events.append((when, change("order_info", "update", when, {"order_status": "1"}, id=str(o), user_id="u", province_id="1", order_status=status)))
            events.append((when + 2, change(table, kind, when + 2, id=f"r{o}", order_id=str(o), user_id="u", sku_id="s1", refund_type="1", refund_reason_type=str(1 + o % 3), refund_num="1", payment_type="2", callback_time="2024-01-02 03:04:05", create_time="2024-01-02 03:04:05", total_amount="7.00")))
    batch = parse_changes(spark.createDataFrame([(e,) for _, e in events], "value string"))
    end = [[change(t, "update", 2_000_000_000 + i, {"order_status": "0"}, id="end", order_id="end", order_status=s) for t, s in (("order_info", "1003"), ("order_info", "1005"), ("order_info", "1006"))] + f for i, f in enumerate(closing())]
    raw = with_row_time(parse_changes(lines_of(spark, f"{tmp_path}/in", *in_files(events), *end)))
    facts_of(facts.cancel_detail(raw, keep=facts.KEEP_CANCELLED), facts.cancel_detail(batch), tmp_path / "cancel")
    facts_of(facts.refund(raw, dictionary, keep=facts.KEEP), facts.refund(batch, dictionary), tmp_path / "refund")
    facts_of(facts.refund_paid(raw, dictionary, keep=facts.KEEP), facts.refund_paid(batch, dictionary), tmp_path / "paid")
    # payments meet the order details that were written to their topic, as text
    details = facts.order_detail(batch)
    topic = [r.value for r in to_topic(details.orderBy("ts")).collect()]
    stream = with_row_time(parse_rows(etl.non_empty(lines_of(spark, f"{tmp_path}/topic", topic[:9], ["", *topic[9:]])), ORDER_DETAIL).drop("offset"))
    facts_of(facts.payment(raw, stream, dictionary), facts.payment(batch, details, dictionary), tmp_path / "payment")


def test_log_job(spark, tmp_path):
    """Dirty records and the five topics, from text to text."""
    rows = [r.value for r in Inputs(spark, SF).topic_log.filter("value is not null").orderBy(F.coalesce(F.get_json_object(F.when(F.col("value").startswith("{"), F.col("value")), "$.ts"), F.lit("0")).cast("long")).limit(400).collect()]
    raw = lines_of(spark, f"{tmp_path}/in", rows[:150], rows[150:300], rows[300:])
    read = lambda path: {(r.topic, r.value) for r in spark.read.text(path).select("topic", "value").collect()}
    to_files(log.dirty_topic(raw), f"{tmp_path}/dirty", f"{tmp_path}/cp1").trigger(availableNow=True).start().awaitTermination()
    q = log.repaired_log(raw, stream_keyed.repair_is_new).writeStream.foreachBatch(lambda b, i: log.write_log_topics(b, i, f"{tmp_path}/out")).option("checkpointLocation", f"{tmp_path}/cp2").trigger(availableNow=True).start()
    q.awaitTermination()
    batch = spark.createDataFrame([(r,) for r in rows], "value string")
    want = {(r.topic, r.value) for r in log.log_topics(log.repaired_log(batch, keyed.repair_is_new)).collect()}
    assert read(f"{tmp_path}/out") == want and len({t for t, _ in want}) == 5
    assert read(f"{tmp_path}/dirty") == {("topic_dirty", r) for r in rows if r in ("nope", "123", "[1]")}


def test_dimension_job(spark, tmp_path):
    """Topic text to routed dimension tables, over several micro-batches."""
    config = spark.createDataFrame([("sku_info", "", "dim_sku", "dim", "id,name", "id", None), ("spu_info", "", "dim_spu", "dim", "code,name", "code", None)], CONFIG)
    files = [
        [change("sku_info", "bootstrap-start", 1), change("sku_info", "insert", 1, id="1", name="a", more="x"), change("sku_info", "update", 1, id="1", name="b"), change("spu_info", "insert", 1, code="c", name="s")],
        ["nope", "", change("sku_info", "update", 2, id="1", name="c"), change("sku_info", "insert", 2, id="2", name="z"), change("other", "insert", 2, id="9")], [change("sku_info", "delete", 3, id="2", name="z")],
    ]
    for deletes, want in ((False, {("1", "c"), ("2", "z")}), (True, {("1", "c")})):
        tables = sinks.DimensionTables(spark, f"{tmp_path}/dims{deletes}")
        routed = etl.route_dim(etl.dim_etl(lines_of(spark, f"{tmp_path}/in{deletes}", *files)), config)
        routed.writeStream.foreachBatch(lambda b, i, t=tables, d=deletes: t.upsert_batch(b, i, config, d)).option("checkpointLocation", f"{tmp_path}/cp{deletes}").trigger(availableNow=True).start().awaitTermination()
        assert {tuple(r) for r in tables.read("dim_sku").collect()} == want and [tuple(r) for r in tables.read("dim_spu").collect()] == [("c", "s")]


def test_summary_sink_and_routed_topics(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1)], "stt string, n int")
    for batch in (0, 1, 1):
        sinks.write_summary(rows, batch, ["stt", "n", "ts"], f"{tmp_path}/summary")
    got = spark.read.parquet(f"{tmp_path}/summary").collect()
    assert [(r.stt, r.n, r.batch) for r in sorted(got, key=lambda r: r.batch)] == [("a", 1, 0), ("a", 1, 1)] and all(r.ts > 1_700_000_000_000 for r in got)
    config = spark.createDataFrame([("user_info", "insert", "dwd_user_register", "dwd", "id,create_time", "", None)], CONFIG)
    raw = lines_of(spark, f"{tmp_path}/in", [change("user_info", "insert", 1, id="1", create_time="5", phone="x"), change("user_info", "update", 1, id="2")], [change("user_info", "bootstrap-insert", 1, id="3")])
    routed = sinks.route_topics(etl.route_fact(etl.fact_etl(raw), config))
    to_files(routed, f"{tmp_path}/out", f"{tmp_path}/cp").trigger(availableNow=True).start().awaitTermination()
    assert [(r.topic, json.loads(r.value)) for r in spark.read.text(f"{tmp_path}/out").collect()] == [("topic_dwd_user_register", {"data": {"id": "1", "create_time": "5"}, "ts": "1"})]


def test_topic_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.txt").write_text('{"table":"t","type":"insert","ts":"1","data":{"id":"1"}}\nnope\n')
    got = run(parse_changes(read_topic_files(spark, f"{tmp_path}/in")), tmp_path).collect()
    assert sorted(str(r.table) for r in got) == ["None", "t"]


def test_a_key_with_most_rows_is_shared_out(spark, tmp_path, one_partition):
    """One visitor has nine of ten rows; shares of it leave a few rows, and windows are those of a batch."""
    day = 86400
    rows = [[(i * 1000 + n, f"u{n}" if n % 10 == 9 else "robot", i * day // 2 + n) for n in range(200)] for i in range(3)]
    files = [*rows, [(10**6, "end", 30 * day)], [(10**6 + 1, "end", 31 * day)]]
    stream, df = timed(spark, f"{tmp_path}/in", "id long, user_id string, time timestamp", files)
    got, want = (sorted(map(tuple, d.filter("stt < '2024-01-20'").collect())) for d in (run(streams.cart_users(stream, salts=4), tmp_path / "a"), summaries.cart_users(df)))
    assert got == want and len(want) == 40
    left = run(stream_keyed.first_of_shares(stream, "user_id", "time", "id", 4), tmp_path / "b")
    assert left.filter("user_id = 'robot'").count() == 8 and df.filter("user_id = 'robot'").count() == 540
