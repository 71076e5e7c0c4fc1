"""Hand-written rows for the edges of each operator."""

import re
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from millrace import sinks
from millrace.functions.text import explode_words
from millrace.operators import etl, facts, joins, keyed, summaries
from millrace.plans import queries
from millrace.sources import config, topics
from millrace.streaming.log import log_topics

DAY = 86400


def raw(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "value string")


def visits(spark, *rows):
    """(mid, is_new, day, tie)"""
    return spark.createDataFrame(list(rows), "mid string, is_new string, day double, event_id long").withColumn("time", F.timestamp_seconds((F.col("day") * DAY).cast("long")))


def flags(df):
    return [r.is_new for r in df.orderBy("event_id").collect()]


@pytest.mark.parametrize(("rows", "want"), [
    ([("1", 1.0), ("1", 1.5)], ["1", "1"]),
    ([("1", 1.0), ("1", 2.0)], ["1", "0"]),
    ([("0", 1.0), ("1", 1.5)], ["0", "0"]),
    ([("0", 1.0), ("0", 3.0)], ["0", "0"]),
    ([("1", 1.0), ("0", 2.0), ("1", 1.2)], ["1", "0", "1"]),
])
def test_new_visitors(spark, rows, want):
    for mid in ("m", None):
        assert flags(keyed.repair_is_new(visits(spark, *[(mid, n, d, i) for i, (n, d) in enumerate(rows)]))) == want


def test_first_of_day_ever_and_returning(spark):
    df = visits(spark, *[("u", "0", d, i) for i, d in enumerate([1.0, 1.5, 2.0, 9.0, 17.0, 47.0])])
    ever = keyed.first_ever(df, "mid", "time", "event_id").orderBy("date").collect()
    assert [(r.event_id, r.is_first) for r in ever] == [(0, 1), (2, 0), (3, 0), (4, 0), (5, 0)]
    assert [r.is_back for r in keyed.returning(df, "mid", "time", "event_id").orderBy("date").collect()] == [0, 0, 0, 1, 1]


def test_replace_by_cancel_nets_to_the_last_row(spark):
    rows = [("a", 1, Decimal("5.00")), ("b", 1, Decimal("1.00")), ("b", 2, None), ("c", 1, Decimal("1.00")), ("c", 2, Decimal("2.00")), ("c", 3, Decimal("4.00"))]
    df = keyed.replace_by_cancel(spark.createDataFrame(rows, "id string, n int, amount decimal(16,2)"), "id", ["n"], ["amount"])
    assert {r.id: (r.s, r.n) for r in df.groupBy("id").agg(F.sum("amount").alias("s"), F.count("*").alias("n")).collect()} == {"a": (Decimal(5), 1), "b": (Decimal(0), 3), "c": (Decimal(4), 5)}


@pytest.mark.parametrize(("gap", "found"), [(-6, False), (-5, True), (0, True), (900, True), (901, False)])
def test_interval_join_ends(spark, gap, found):
    row = lambda s: spark.createDataFrame([("o", s)], "order_id string, s long").select("order_id", F.timestamp_seconds("s").alias("t"))
    assert joins.interval_join(row(10_000 + gap), row(10_000), "order_id", "t", "15 minutes", "5 seconds").count() == found


def test_cart_add_rules(spark):
    rows = [("insert", "2", None), ("update", "5", {"sku_num": "2"}), ("update", "2", {"sku_num": "5"}), ("update", "3", {"sku_num": "3"}), ("update", "4", {"user_id": "x"}), ("update", "4", None)]
    df = spark.createDataFrame([("cart_info", t, "1", {"id": str(i), "sku_num": n}, o) for i, (t, n, o) in enumerate(rows)], "table string, type string, ts string, data map<string,string>, old map<string,string>")
    assert {r.id: r.sku_num for r in facts.cart_add(df).collect()} == {"0": "2", "1": "3"}


def test_etl_on_types_and_bad_lines(spark):
    line = lambda t: '{"table":"t","type":%s,"data":{"id":"1"}}' % (f'"{t}"' if t else "null")  # noqa: E731, UP031
    df = raw(spark, *map(line, ["insert", "bootstrap-start", "bootstrap-insert", "bootstrap-complete", None]), "nope", "", None)
    assert sorted(str(r.type) for r in etl.dim_etl(df).collect()) == ["None", "bootstrap-insert", "insert"]
    assert [r.type for r in etl.fact_etl(df).collect()] == ["insert"]


def test_dirty_split(spark):
    good, dirty = etl.split_dirty(raw(spark, "nope", "123", "", None, "[1]", '{"ts":1}'))
    assert [r.value for r in good.collect()] == ['{"ts":1}'] and sorted(r.value for r in dirty.collect()) == ["123", "[1]", "nope"]


def test_log_branches(spark):
    log = topics.parse_log(raw(
        spark, '{"common":{"mid":"a"},"page":{"page_id":"p"},"err":{"msg":"e"},"ts":1}', '{"common":{"mid":"b"},"start":{"entry":"i"},"err":{"msg":"e"},"ts":2}',
        '{"common":{"mid":"c"},"page":{"page_id":"p"},"displays":[{"item":"1"},{"item":"2"}],"actions":[{"action_id":"x"},{"action_id":"y"},{"action_id":"z"}],"ts":3}', '{"common":{"mid":"d"},"page":{"page_id":"p"},"displays":[],"ts":4}',
    ))
    mids = lambda df: sorted(r.mid for r in df.select("common.mid").collect())
    assert mids(etl.error_branch(log)) == ["a", "b"] and mids(etl.start_branch(log)) == ["b"] and mids(etl.page_branch(log)) == ["a", "c", "d"]
    assert mids(etl.display_branch(log)) == ["c", "c"] and mids(etl.action_branch(log)) == ["c", "c", "c"]


def config_row(table, kind, sink, columns="id,name"):
    return (table, "insert", sink, kind, columns, "id", None)


def test_config_fold_and_routes(spark):
    schema = "source_table string, source_type string, sink_table string, sink_type string, sink_columns string, sink_pk string, sink_extend string"
    start = spark.createDataFrame([config_row("a", "dim", "old"), config_row("b", "dim", "b"), config_row("x", "dwd", "x")], schema)
    struct = "struct<" + schema.replace(" string", ":string").replace(", ", ",") + ">"
    changes = spark.createDataFrame([("u", None, config_row("a", "dim", "new"), 1), ("d", config_row("b", "dim", "b"), None, 2), ("d", config_row("q", "dim", "q"), None, 3), ("c", None, config_row("c", "dim", "c", "id, name"), 4), ("c", None, config_row("z", "dwd", "z"), 5)], f"op string, before {struct}, after {struct}, seq int")
    folded = config.config_fold(start, changes, "dim")
    assert {(r.source_table, r.sink_table) for r in folded.collect()} == {("a", "new"), ("c", "c")}
    rows = spark.createDataFrame([("a", "insert", "1", {"id": "1", "name": "n", "more": "m"}, None), ("c", "update", "1", {"id": "2", "name": "n"}, None), ("no", "insert", "1", {"id": "3"}, None)], "table string, type string, ts string, data map<string,string>, old map<string,string>")
    assert {(r.sink_table, tuple(sorted(r.data.items()))) for r in etl.route_dim(rows, folded).collect()} == {("new", (("id", "1"), ("name", "n"))), ("c", (("id", "2"),))}
    assert [r.sink_table for r in etl.route_fact(rows, folded).collect()] == ["new"]


def test_latest_per_key_and_tombstones(spark):
    df = spark.createDataFrame([("a", "1", 1), ("a", None, 2), ("b", None, 1), ("b", "2", 2), ("c", "1", 1), ("c", "3", 3)], "id string, value string, n int")
    assert {(r.id, r.value) for r in sinks.latest_per_key(df, ["id"], ["n"]).collect()} == {("b", "2"), ("c", "3")}


def test_dimension_tables(spark, tmp_path):
    tables = sinks.DimensionTables(spark, str(tmp_path))
    tables.create("d", "id,name")
    tables.create("d", "id,other")
    assert tables.read("d").columns == ["id", "name"] and tables.read("d").count() == 0
    row = lambda i, n, kind, seq: (kind, {"id": i, "name": n, "more": "x"}, seq)
    put = lambda *r: spark.createDataFrame(list(r), "type string, data map<string,string>, seq int")
    some = lambda **how: tables.upsert("d", put(row("2", "c", "delete", 4)), order=("seq",), **how)
    tables.upsert("d", put(row("1", "a", "insert", 1), row("1", "b", "update", 2), row("2", "c", "insert", 3), row(None, "c", "insert", 3)), order=("seq",))
    some()
    assert {tuple(r) for r in tables.read("d").collect()} == {("1", "b"), ("2", "c")}
    for _ in range(2):
        some(apply_deletes=True)
        assert {tuple(r) for r in tables.read("d").collect()} == {("1", "b")}
    tables.upsert("d", put(row("2", "older", "insert", 1), row("3", "d", "insert", 1)), order=("seq",))
    assert {tuple(r) for r in tables.read("d").collect()} == {("1", "b"), ("3", "d")}  # older changes that come later don't win
    tables.upsert("d", put(row("2", "again", "insert", 5)), order=("seq",))
    assert {tuple(r) for r in tables.read("d").collect()} == {("1", "b"), ("2", "again"), ("3", "d")}
    with pytest.raises(ValueError, match="no column"):
        tables.create("e", "name")


def test_database_source_and_sink(spark):
    """Over the database that comes with Spark."""
    options = {"url": "jdbc:derby:memory:shop;create=true", "driver": "org.apache.derby.jdbc.EmbeddedDriver"}
    spark.createDataFrame([("1101", "card"), ("1102", "cash")], "dic_code string, dic_name string").write.format("jdbc").options(dbtable="base_dic", **options).save()
    dictionary = config.read_jdbc(spark, options["url"], "base_dic", driver=options["driver"])
    rows = spark.createDataFrame([("1101", 1), ("9", 2)], "payment_type string, n int")
    assert [tuple(r) for r in joins.decode(rows, "payment_type", dictionary, "name").collect()] == [("1101", 1, "card")]
    summary = spark.createDataFrame([("a", 5, "inner")], "stt string, n int, not_for_the_sink string")
    for batch in (0, 1, 1, 0):
        sinks.write_summary_jdbc(summary, batch, ["stt", "n", "ts"], sinks.jdbc_summary_options(options["url"], "summary") | {"driver": options["driver"]})
    got = config.read_jdbc(spark, options["url"], "summary", driver=options["driver"]).collect()
    assert [(r.STT if hasattr(r, "STT") else r.stt, r.n) for r in got] == [("a", 5)] * 2 and all(r.ts > 1_700_000_000_000 for r in got)


def test_topic_forms(spark):
    df = spark.createDataFrame([("1", "n", "t")], "id string, name string, sink_table string")
    assert sinks.to_keyed_topic(df, ["id"]).first().key == '{"id":"1"}'
    assert tuple(sinks.route_topics(df).first()) == ("topic_t", '{"id":"1","name":"n"}')
    assert topics.kafka_options("s", "t", "g")["subscribe"] == "t" and "topic" not in sinks.kafka_sink_options("s") and sinks.jdbc_summary_options("u", "t")["dbtable"] == "t"


def test_words(spark):
    df = spark.createDataFrame([("Tea tea, 2",), ("...",), (None,)], "text string")
    assert sorted(r.keyword for r in explode_words(df, "text").collect()) == ["2", "tea", "tea"]


def test_enrichment_keeps_rows(spark):
    df = spark.createDataFrame([("1",), ("9",), (None,)], "k string")
    dim = spark.createDataFrame([("1", "one")], "id string, name string")
    assert {(r.k, r.n) for r in joins.enrich(df, dim, "k", {"n": "name"}, default={"n": ""}).collect()} == {("1", "one"), ("9", ""), (None, "")}


def test_visitors_are_counted_once_a_day(spark):
    pages = visits(spark, ("a", "1", 1.0, 1), ("a", "1", 1.1, 2), ("b", "0", 1.0, 3), ("a", "0", 2.0, 4)).withColumns({"vc": F.lit("v"), "ch": F.lit("c"), "ar": F.lit("r"), "last_page_id": F.lit(""), "during_time": F.lit(5).cast("long")})
    out = summaries.page_views(pages).agg(F.sum("uv_ct"), F.sum("pv_ct"), F.sum("sv_ct"), F.sum("dur_sum")).first()
    assert tuple(out) == (3, 4, 4, 20)


@pytest.mark.parametrize("parts", [1, 7])
def test_order_of_partitions_is_no_matter(spark, parts):
    df = visits(spark, *[(f"m{i % 5}", str(i % 2), 1 + (i * 7 % 40) / 10, i) for i in range(60)]).repartition(parts)
    assert sorted(map(tuple, keyed.first_of_day(df, "mid", "time", "event_id").select("mid", "date", "event_id").collect())) == sorted(map(tuple, keyed.first_of_day(df.coalesce(1), "mid", "time", "event_id").select("mid", "date", "event_id").collect()))


def test_marked_records_are_those_of_the_split(spark):
    rows = raw(spark, "nope", "123", "", None, "[1]", '{"ts":1}')
    good, dirty = etl.split_dirty(rows)
    got = [(r.value, r.dirty) for r in etl.mark_dirty(rows).collect()]
    assert sorted(got) == sorted([(r.value, False) for r in good.collect()] + [(r.value, True) for r in dirty.collect()])


def test_few_codes_and_routes_are_sent_to_the_rows(spark):
    """F11 to F13: rows don't gather by the few values that a configuration or dictionary has."""
    changes = spark.range(10).selectExpr("concat('t', id % 1) as `table`", "concat('insert', id % 1) as type", "map('id', string(id)) as data", "string(id) as ts", "concat('a', id % 1) as code")
    routes = spark.createDataFrame([("t0", "insert0", "s", "id")], "source_table string, source_type string, sink_table string, sink_columns string")
    dictionary = spark.createDataFrame([("a0", "A")], "dic_code string, dic_name string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as if sizes were unknown
    plans = [df._jdf.queryExecution().executedPlan().toString() for df in (etl.route_fact(changes, routes), etl.route_dim(changes, routes), joins.decode(changes, "code", dictionary, "name"))]
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    for plan in plans:
        assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    assert etl.route_fact(changes, routes).count() == 10


def test_log_is_read_once_for_all_topics(spark):
    """five branches, one pass."""
    record = '{"common":{"mid":"m","is_new":"1"},"page":{"page_id":"p"},"displays":[{"item":"1"},{"item":"2"}],"actions":[{"ts":"5"}],"err":{"msg":"e"},"ts":1}'
    out = log_topics(topics.parse_log(raw(spark, record, '{"start":{"entry":"icon"},"displays":[{"item":"1"}],"ts":2}')))
    assert "Union" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(r.topic[6:] for r in out.collect()) == ["action", "display", "display", "error", "page", "start"]


def exchanges(df, by):
    """How many shuffles have rows of a given key, those that are used again counted once, and all others."""
    spark_plan = df._jdf.queryExecution().executedPlan().toString()
    keys = re.findall(r"Exchange hashpartitioning\((.*), \d+\)", spark_plan)
    mine = [k for k in keys if re.fullmatch(rf"(?:{by})#\d+L?", k)]
    return len(mine), sorted(re.sub(r"#\d+L?", "", k) for k in set(keys) - set(mine))


@pytest.mark.parametrize("name", ["fact_topic", "fact_order_detail", "fact_cancel_detail", "fact_payment", "fact_refund"])
def test_lines_are_dealt_by_order_only(spark, name):
    some, others = exchanges(queries.QUERIES[name](spark, "/root/testdata/sf0.001"), "order_id|_order|_key")
    assert some and others == []


def test_replaced_lines_stay_with_their_orders(spark):
    _, others = exchanges(queries.QUERIES["dedup_cancel_sku"](spark, "/root/testdata/sf0.001"), "order_id|_order")
    assert others == []


def test_promotions_of_changes_with_an_order(spark):
    schema = "`table` string, type string, ts string, data map<string,string>, old map<string,string>"
    row = lambda table, **data: (table, "insert", "5", data, None)
    changes = [row("order_info", id=o, user_id="u" + o, province_id="p") for o in "12"]
    changes += [row("order_detail", id=f"{o}-{n}", order_id=o, sku_id="s", sku_num="1", order_price="2") for o in "12" for n in "ab"] + [row("order_detail", id=None, order_id="1")]
    changes += [row("order_detail_activity", order_detail_id=i, activity_id=a) for i, a in (("1-a", "x"), ("1-a", "y"), ("2-b", "z"), (None, "n"))] + [row("order_detail_coupon", order_detail_id=i, coupon_id="c") for i in ("1-a", "1-b")]
    plain = spark.createDataFrame(changes, schema)
    detail = F.col("data")["order_detail_id"]
    order = F.when(F.col("table") == "order_info", F.col("data")["id"]).when(F.col("table") == "order_detail", F.col("data")["order_id"]).otherwise(F.substring_index(detail, "-", 1))
    got = [sorted(map(repr, facts.order_detail(c).collect())) for c in (plain, plain.withColumn("order_id", order))]
    assert got[0] == got[1] and len(got[0]) == 6


def test_a_topic_read_back_is_written_once(spark):
    df = queries.QUERIES["fact_topic"](spark, "/root/testdata/sf0.001")
    assert df._jdf.queryExecution().optimizedPlan().toString().count("StructsToJsonEvaluator") == 1


def test_non_empty_of_values_made_here(spark):
    df = raw(spark, "{}", "", None, " ").select("value", F.lit(7).alias("offset"))
    assert etl.non_empty(df, made_here=True).collect() == etl.non_empty(df).collect() and etl.non_empty(df).count() == 2
