"""Runs that follow each other with a state of one row a key, and dimensions as they were."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from millrace.operators import history, keyed, sketches, versions

SCHEMA = "event_id long, mid string, is_new string, time timestamp"


def rows_of(seed=1, n=300, days=40):
    rng = random.Random(seed)
    at = lambda: dt.datetime(2024, 1, 1) + dt.timedelta(seconds=rng.randrange(days * 86400))
    return [(i, rng.choice(["a", "b", "c", "d", "e", None]), rng.choice("01"), at() if rng.random() > 0.05 else None) for i in range(n)]


def test_days_one_by_one_are_all_at_once(spark, tmp_path):
    rows = [r for r in rows_of(n=60, days=30) if r[3]]
    df, state, days, marks = spark.createDataFrame(rows, SCHEMA).persist(), history.no_history(spark), [], []
    for i in range(0, 30, 6):
        low = dt.datetime(2024, 1, 1) + dt.timedelta(days=i)
        part = spark.createDataFrame([r for r in rows if low <= r[3] < low + dt.timedelta(days=6)], SCHEMA)
        days += map(tuple, history.first_and_returning(part, state, "mid", "time", "event_id", 3).select("mid", "date", "event_id", "is_first", "is_back").collect())
        marks += [(r.event_id, r.is_new) for r in history.repair_is_new(part, state).collect()]
        history.after(part, state, "mid", "time", "event_id", "is_new").write.parquet(f"{tmp_path}/{i}")
        state = spark.read.schema(history.STATE).parquet(f"{tmp_path}/{i}")
    ever = keyed.first_ever(df, "mid", "time", "event_id").select("mid", "date", "event_id", "is_first")
    back = keyed.returning(df, "mid", "time", "event_id", 3).select("mid", "date", "is_back")
    want = [(*r[:4], b) for r in map(tuple, ever.collect()) for m, d, b in map(tuple, back.collect()) if (m, d) == (r[0], r[1])]
    assert sorted(days, key=str) == sorted(want, key=str)
    assert sorted(marks) == sorted((r.event_id, r.is_new) for r in keyed.repair_is_new(df).collect())
    assert state.count() == len({r[1] for r in rows})


def test_a_late_day_is_corrected(spark):
    rows = rows_of(2, 80)
    late = [r for r in rows if r[0] % 7 == 0]
    results = lambda data: history.first_and_returning(spark.createDataFrame(data, SCHEMA), history.no_history(spark), "mid", "time", "event_id", 3)
    got = history.revise(results([r for r in rows if r[0] % 7]), spark.createDataFrame(late, SCHEMA), "mid", "time", "event_id", 3)
    pick = lambda df: sorted(map(str, df.select("mid", "date", "event_id", "is_first", "is_back").collect()))
    assert pick(got) == pick(results(rows))
    state = history.after(spark.createDataFrame(late, SCHEMA), history.after(spark.createDataFrame([r for r in rows if r[0] % 7], SCHEMA), history.no_history(spark), "mid", "time", "event_id"), "mid", "time", "event_id")
    assert sorted(map(str, state.collect())) == sorted(map(str, history.after(spark.createDataFrame(rows, SCHEMA), history.no_history(spark), "mid", "time", "event_id").collect()))


@pytest.mark.parametrize("salts", [1, 4])
def test_as_of(spark, salts):
    rng = random.Random(salts)
    changes = [(rng.choice(["a", "b", None]), rng.choice([*range(40), None]), i, rng.choice(["x", "y", "z", None])) for i in range(40)]
    events = [(i, rng.choice(["a", "b", "c", None]), rng.choice([*range(45), None])) for i in range(80)]
    made = versions.intervals(spark.createDataFrame(changes, "id string, at int, n int, name string"), "id", "at", ["name"], ["n"])
    got = {r.e: r.name for r in versions.as_of(spark.createDataFrame(events, "e int, k string, at int"), made, "k", "at", ["name"], "id", salts=salts).collect()}

    def at(k, t):
        own = sorted((c[1], c[2], c[3]) for c in changes if k is not None and c[0] == k and c[1] is not None and t is not None and c[1] <= t) if k else []
        return own[-1][2] if own else None

    assert got == {e: at(k, t) for e, k, t in events}
    rows = made.collect()
    for k in "ab":
        own = sorted((r.valid_from, r.valid_to, r.name) for r in rows if r.id == k)
        assert own and own[-1][1] is None and all(x[1] == y[0] and x[2] != y[2] for x, y in zip(own, own[1:], strict=False))
    assert versions.as_of(spark.createDataFrame(events, "e int, k string, at int"), made.limit(0), "k", "at", ["name"], "id").filter(F.col("name").isNotNull()).count() == 0


def test_merged_sketches(spark):
    """Exact while small, and within five standard errors beyond; ids that windows share count once; nulls don't."""
    n = 60_000
    rows = spark.range(2 * n).select(F.concat(F.lit("u"), F.col("id") % n).alias("mid"), F.timestamp_seconds(F.lit(1704067200) + F.col("id") % 50_000).alias("time"), F.when(F.col("id") < 3000, "few").otherwise("many").alias("page"))
    more = spark.createDataFrame([(None, dt.datetime(2024, 1, 1), "few"), ("x", None, "few")], "mid string, time timestamp, page string")
    short = sketches.sketch_ids(rows.unionByName(more), "mid", ("page",))
    got = {r.page: r.distinct_count for r in sketches.distinct_counts(sketches.merge_sketches(sketches.merge_sketches(short, ("page",), "1 hour"), ("page",))).collect()}
    assert got["few"] == 3000 and abs(got["many"] - n) < 5 * n / (2**sketches.LG - 1) ** 0.5
    assert sum(r.distinct_count for r in sketches.distinct_counts(sketches.merge_sketches(short)).collect()) == pytest.approx(n, rel=0.08)


def test_exact_counts_of_windows_that_sketches_only_estimate(spark):
    rows = spark.range(6000).select(F.concat(F.lit("m"), F.col("id") % 3000).alias("mid"), F.when(F.col("id") % 10 == 0, "few").when(F.col("id") % 10 > 1, "many").alias("page"), F.timestamp_seconds(F.col("id") * 7).alias("time"))
    rows = rows.unionByName(rows.limit(20).withColumn("mid", F.lit(None).cast("string")))
    merged = sketches.merge_sketches(sketches.sketch_ids(rows, "mid", ("page",), lg=8), ("page",), lg=8)
    got = {r.page: r.distinct_count for r in sketches.exact_counts(merged, rows, "mid", ("page",), lg=8).collect()}
    assert got == {"few": 300, "many": 2400, None: 300}
