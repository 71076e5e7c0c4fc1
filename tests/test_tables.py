"""Tables that are read while they are upserted, and routes that change while jobs run."""

import json
import random
import shutil
from datetime import timedelta

import pytest
from pyspark.sql import functions as F
from test_streams import change, lines_of

from millrace import sinks, tables
from millrace.operators import etl, joins
from millrace.schemas import CONFIG, CONFIG_CHANGE
from millrace.shared import CommitLog
from millrace.sources import live
from millrace.sources.topics import parse_config_changes

CHANGES = "type string, data map<string,string>, ts string, offset long"


def put(spark, *rows):
    return spark.createDataFrame([(k, {"id": i, "name": n}, ts, o) for k, i, n, ts, o in rows], CHANGES)


@pytest.mark.parametrize("fan_in", [2, 8])
def test_batches_in_any_order_give_one_table(spark, tmp_path, fan_in, monkeypatch):
    monkeypatch.setattr(tables, "FAN_IN", fan_in)
    rng = random.Random(fan_in)
    rows = [(rng.choice(["insert", "update", "delete", None]), str(rng.randrange(12)), f"n{i}", str(rng.randrange(30)), i) for i in range(60)]
    batches = [rows[i : i + 10] for i in range(0, 60, 10)]
    want = {}
    for kind, i, n, ts, o in sorted(rows, key=lambda r: (int(r[3]), r[4])):
        want[i] = None if kind == "delete" else n
    rng.shuffle(batches)
    t = sinks.DimensionTables(spark, str(tmp_path))
    t.create("d", "id,name")
    for b in batches:
        t.upsert("d", put(spark, *b), order=("ts", "offset"), apply_deletes=True)
    assert {r.id: r.name for r in t.read("d").collect()} == {i: n for i, n in want.items() if n is not None}
    if fan_in == 2:
        assert len(t._table("d")._entry(None)["segments"]) == 1


def test_versions_stay_as_they_were(spark, tmp_path, monkeypatch):
    t = sinks.DimensionTables(spark, str(tmp_path))
    t.create("d", "id, name")
    v = [t.upsert("d", put(spark, ("insert", "1", f"v{n}", "5", n)), batch=n, source="s") for n in range(3)]
    names = lambda version=None: [r.name for r in t.read("d", version).collect()]
    assert [names(x) for x in v] == [["v0"], ["v1"], ["v2"]] and names() == ["v2"]
    assert t.upsert("d", put(spark, ("insert", "1", "again", "9", 9)), batch=2, source="s") == v[2] and names() == ["v2"]  # a batch that comes again
    t.upsert("d", put(spark, ("update", "1", "older", "4", 9), ("insert", None, "x", "9", 1), ("insert", "2", "no time", "abc", 1)), batch=3, source="s")
    assert sorted(names()) == ["no time", "v2"]
    held = t.pinned("reader", 7, ["d"])["d"]
    t.upsert("d", put(spark, ("update", "1", "new", "6", 1)))
    assert t.pinned("reader", 7, ["d"])["d"].collect() == held.collect()  # the same batch sees the same version
    t.vacuum(timedelta(0))
    assert {r.name for r in held.collect()} == {"no time", "v2"} and "new" in names()
    with pytest.raises(Exception, match="(?s)does not exist"):
        t.read("d", v[0])
    held, table = t.pinned("reader", 8, ["d"])["d"], t._table("d")
    monkeypatch.setattr(tables, "FAN_IN", 2)
    table.compact()
    t.vacuum(timedelta(0))
    assert len(table.data.names()) > 1 and held.collect() and len(table._entry(None)["segments"]) == 1  # the pinned version's files stay
    t.pinned("reader", 9, ["d"])
    t.pinned("reader", 10, ["d"])
    t.vacuum(timedelta(0))
    assert len(table.data.names()) == 1 and "new" in names()
    with pytest.raises(ValueError, match="no column"):
        t.create("e", "name")
    with pytest.raises(ValueError, match="no table"):
        t.read("nothing")


def test_what_a_batch_writes_follows_the_batch(spark, tmp_path):
    t = sinks.DimensionTables(spark, str(tmp_path))
    t.create("d", "id,name")
    name = F.sha2(F.col("id").cast("string"), 256)
    rows = spark.range(200_000).select(F.lit("insert").alias("type"), F.create_map(F.lit("id"), F.col("id").cast("string"), F.lit("name"), name).alias("data"), F.lit("1").alias("ts"), F.col("id").alias("offset"))
    t.upsert("d", rows)
    whole = t._table("d")._entry(None)["segments"][0]["bytes"]
    for i in range(3):
        t.upsert("d", rows.filter(F.col("offset") % 2000 == i).withColumn("ts", F.lit("2")))
    sizes = sorted(s["bytes"] for s in t._table("d")._entry(None)["segments"])
    assert len(sizes) == 4 and sizes[-1] == whole and sizes[-2] < whole / 50 and t.read("d").count() == 200_000


def test_commits_are_whole_and_once(spark, tmp_path):
    log = CommitLog(spark, f"{tmp_path}/log")
    assert log.numbers() == [] and log.put(3, {"a": 1}) and not log.put(3, {"a": 2}) and log.once(3, {"a": 3}) == {"a": 1} and log.once(4, "ü") == "ü" and log.get(4) == "ü"
    assert log.numbers() == [3, 4]


def test_a_stream_joins_a_table_that_is_upserted(spark, tmp_path):
    """Ten upserts while the stream runs: each micro-batch sees the newest version, and no file goes under its hands."""
    t = sinks.DimensionTables(spark, f"{tmp_path}/dims")
    t.create("d", "id,name")
    seen = []

    def write(batch, number, dims):
        got = joins.enrich(batch, dims["d"], "value", {"name": "name"})
        t.upsert("d", put(spark, ("update", "a", f"v{number + 1}", "1", 0)), source="other job", batch=number)  # between the batch's begin and its reading
        t.vacuum(timedelta(0))
        seen.append((number, [r.name for r in got.collect()]))

    stream = lines_of(spark, f"{tmp_path}/in", *[["a", "b"]] * 10)
    t.upsert("d", put(spark, ("insert", "a", "v0", "1", 0)))
    stream.writeStream.foreachBatch(t.with_tables("job", write)).option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start().awaitTermination()
    assert [(n, set(names)) for n, names in seen] == [(i, {f"v{i}", None}) for i in range(10)]


def route(table, sink, kind="dim", columns="id,name", source="insert"):
    return {"source_table": table, "source_type": source, "sink_table": sink, "sink_type": kind, "sink_columns": columns, "sink_pk": "id", "sink_extend": None}


def edits(spark, *rows):
    return parse_config_changes(spark.createDataFrame([(json.dumps(dict(zip(("op", "before", "after"), r, strict=True))),) for r in rows], "value string").coalesce(1))


def test_routes_change_between_batches(spark, tmp_path):
    """A route that is new, one that goes elsewhere, one that ends; and a batch that comes again is routed as at first."""
    dim, dwd = (live.LiveConfig(spark, f"{tmp_path}/{k}", k) for k in ("dim", "dwd"))
    start = spark.createDataFrame([tuple(r.values()) for r in (route("a", "dim_a"), route("b", "dim_b"), route("f", "fact_f", "dwd"), route("f", "fact_u", "dwd", source="update"))], CONFIG)
    for c in (dim, dwd):
        c.start(start)
    dims = sinks.DimensionTables(spark, f"{tmp_path}/dims")
    to_dims, to_facts = live.route_dimensions(dim, dims), live.route_facts(dwd, f"{tmp_path}/facts")

    def batch(n):
        lines = [change(t, k, n, id=str(n), name=f"{t}{n}") for t in ("a", "b", "c", "f") for k in ("insert", "update")]
        return etl.fact_etl(spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1))

    changes = [
        [],
        [("c", None, route("c", "dim_c")), ("d", route("b", "dim_b"), None), ("u", None, route("f", "fact_new", "dwd", "id"))],
        [("u", None, route("a", "dim_a2")), ("d", route("f", "fact_u", "dwd", source="update"), None), ("c", None, route("x", "x")), ("d", route("x", "x"), None)],
    ]
    for n, rows in enumerate(changes):
        for c in (dim, dwd):
            c.edit(edits(spark, *rows) if rows else spark.createDataFrame([], CONFIG_CHANGE), n)
        to_dims(batch(n), n)
        to_facts(batch(n), n)
    ids = lambda t: sorted(r.id for r in dims.read(t).collect())
    topics = lambda: sorted((r.batch, r.topic[6:], json.loads(r.value)["data"].get("name")) for r in spark.read.text(f"{tmp_path}/facts").collect())
    want = [(0, "fact_f", "f0"), (0, "fact_u", "f0"), (1, "fact_new", None), (1, "fact_u", "f1"), (2, "fact_new", None)]
    for _ in range(2):
        assert {t: ids(t) for t in dims.names()} == {"dim_a": ["0", "1"], "dim_a2": ["2"], "dim_b": ["0"], "dim_c": ["1", "2"]} and topics() == want
        for c in (dim, dwd):  # changes and records of earlier batches come again
            c.edit(edits(spark, ("d", route("a", "dim_a"), None)), 1)
            c.vacuum(timedelta(0))
        to_dims(batch(1), 1)
        to_facts(batch(1), 1)
    assert sorted(r.source_table for r in dim.now().collect()) == ["a", "c"]


def test_a_running_job_follows_its_configuration(spark, tmp_path):
    """The same as streams, from text: routes in one folder, records in another."""
    config, dims = live.LiveConfig(spark, f"{tmp_path}/config", "dim"), sinks.DimensionTables(spark, f"{tmp_path}/dims")
    topic = [json.dumps({"op": "c", "before": None, "after": route("a", "dim_a")}), json.dumps({"op": "d", "before": route("a", "dim_a"), "after": None})]
    for n in range(3):
        if n < 2:
            lines_of(spark, f"{tmp_path}/routes{n}", [topic[n]])
        lines_of(spark, f"{tmp_path}/in{n}", [change("a", "insert", n, id=str(n), name="x")])

    def run(stream, write, name):
        stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{tmp_path}/{name}").trigger(availableNow=True).start().awaitTermination()

    for n in range(3):  # files arrive one after the other
        shutil.copytree(f"{tmp_path}/in{n}", f"{tmp_path}/records/in{n}")
        if n < 2:
            shutil.copytree(f"{tmp_path}/routes{n}", f"{tmp_path}/table/{n}")
        run(parse_config_changes(spark.readStream.option("recursiveFileLookup", "true").text(f"{tmp_path}/table")), config.edit, "cp1")
        run(etl.dim_etl(spark.readStream.option("recursiveFileLookup", "true").text(f"{tmp_path}/records")), live.route_dimensions(config, dims), "cp2")
    assert sorted(r.id for r in dims.read("dim_a").collect()) == ["0"]
