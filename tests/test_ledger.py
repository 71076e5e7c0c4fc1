"""Sinks that hold each batch once, words of unspaced text, and rows without a time."""

import datetime as dt
import json
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from test_streams import lines_of, timed
from test_streams import run as run_stream

from millrace import ledger, sinks
from millrace.functions.segment import UNKNOWN, Lexicon, Trie, dictionary_segmenter, word_costs
from millrace.functions.text import explode_words
from millrace.operators import facts, keyed
from millrace.plans.fixtures import Inputs
from millrace.sources.config import read_jdbc
from millrace.streaming import keyed as stream_keyed
from millrace.streaming import log

DERBY = {"url": "jdbc:derby:memory:ledger;create=true", "driver": "org.apache.derby.jdbc.EmbeddedDriver"}


def test_a_batch_is_in_the_database_once(spark, monkeypatch):
    options, rows = DERBY | {"dbtable": "sums"}, lambda n: spark.createDataFrame([(f"b{n}", i) for i in range(5)], "stt string, n int").repartition(3)
    read = lambda: sorted((r.stt, r.n) for r in read_jdbc(spark, DERBY["url"], "sums", driver=DERBY["driver"]).collect())
    assert ledger.append_once(rows(0), "job", 0, options) and not ledger.append_once(rows(0), "job", 0, options)
    run, died = ledger._Database.run, []

    def dies(self, sql, *values):
        if sql.startswith("insert into sums") and not died:
            died.append(sql)
            raise RuntimeError("lost")
        return run(self, sql, *values)

    monkeypatch.setattr(ledger._Database, "run", dies)
    with pytest.raises(RuntimeError):
        ledger.append_once(rows(1), "job", 1, options)
    assert read() == [("b0", i) for i in range(5)]
    assert ledger.append_once(rows(1), "job", 1, options) and ledger.append_once(rows(1), "another job", 1, options)
    assert read() == sorted([("b0", i) for i in range(5)] + [("b1", i) for i in range(5)] * 2)


def test_a_folder_topic(spark, tmp_path, monkeypatch):
    topic = ledger.FolderTopic(spark, str(tmp_path))
    rows = lambda n: spark.createDataFrame([(f"{n}-{i}",) for i in range(7)], "value string").repartition(2)
    assert topic.read().count() == 0 and topic.end() == 0
    topic.append(rows(0), "a", 0)
    put = topic.log.put
    monkeypatch.setattr(topic.log, "put", lambda *_: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError):
        topic.append(rows(1), "a", 1)  # files without an entry
    monkeypatch.setattr(topic.log, "put", put)
    for source, batch in (("a", 1), ("a", 0), ("a", 1), ("b", 0)):
        topic.append(rows(batch), source, batch)
    got = sorted((r.offset, r.value) for r in topic.read().collect())
    assert [o for o, _ in got] == list(range(21)) and sorted(v for _, v in got) == sorted(f"{n}-{i}" for n in (0, 1, 0) for i in range(7))
    assert {v[0] for _, v in got[:7]} == {"0"} and {v[0] for _, v in got[7:14]} == {"1"}
    assert sorted((r.offset, r.value) for r in topic.read(5, 16).collect()) == got[5:16] and topic.read(21).count() == 0 and topic.end() == 21
    seen = {}

    def follow():
        topic.follow(lambda df, n: seen.update({n: sorted((r.offset, r.value) for r in df.collect())})).option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start().awaitTermination()

    follow()
    topic.append(rows(2), "b", 1)
    follow()
    assert [x for n in sorted(seen) for x in seen[n]] == [*got, *((r.offset, r.value) for r in topic.read(21).orderBy("offset").collect())]


def best_cut(run, costs):
    """By trying all ways: (cost, words, lengths)."""
    ways = [((0, 0, ()), ())] if not run else []
    for end in range(1, len(run) + 1):
        if run[:end] in costs or end == 1:
            own = min(costs.get(run[:end], UNKNOWN), UNKNOWN)
            (cost, n, sizes), words = best_cut(run[end:], costs)
            ways.append(((cost + own, n + 1, (-end, *sizes)), ((run[:end], run[:end] in costs), *words)))
    return min(ways)


def test_cuts_are_the_best(spark):
    rng = random.Random(7)
    for _ in range(60):
        costs = {"".join(rng.choice("ab日") for _ in range(rng.randint(1, 4))): rng.choice([1000, 2000, 2000, 3500]) for _ in range(rng.randint(0, 12))}
        run = "".join(rng.choice("ab日x") for _ in range(rng.randint(0, 10)))
        want = []
        for w, known in best_cut(run, costs)[1]:
            if want and not known and not want[-1][1]:
                want[-1] = (want[-1][0] + w, False)
            else:
                want.append((w, known))
        assert Trie(costs.items()).cut(run) == [w for w, _ in want], (run, costs)


def test_words_of_unspaced_text(spark):
    words = spark.createDataFrame([("中国", 10), ("人民", 10), ("中", 1), ("国人", 2), ("小米", 5), ("手机", 5), ("手机", 5), ("", 3), (None, 3), ("x", 0)], "word string, weight long")
    cut = dictionary_segmenter(words)
    df = spark.createDataFrame([(1, "中国人民, 小米手机Pro 13"), (2, None), (3, ""), (4, "龙龙小米")], "id int, text string")
    got = {}
    for r in explode_words(df, "text", segmenter=cut).collect():
        got.setdefault(r.id, []).append(r.keyword)
    assert got == {1: ["中国", "人民", "小米", "手机", "pro", "13"], 4: ["龙龙", "小米"]}
    assert {r.word for r in word_costs(words).collect()} == {"中国", "人民", "中", "国人", "小米", "手机"}
    with pytest.raises(ValueError, match="letters"):
        dictionary_segmenter(words, limit=3)
    assert [r.keyword for r in explode_words(df.filter("id = 4"), "text", segmenter=dictionary_segmenter(words.limit(0))).collect()] == ["龙龙小米"]


def test_a_worker_holds_the_letters_of_a_dictionary_not_its_prefixes():
    rng = random.Random(11)
    glued = lambda parts, k: "".join(rng.choice(parts) for _ in range(rng.randint(1, k)))
    parts = ["the", "wh", "a", "nd", "é", "ß", "学", "生", "entre", "\U0001f600"]
    costs = {glued(parts, 6): rng.randint(0, 9000) for _ in range(5000)}
    lexicon, whole = Lexicon(pa.array(list(costs)), np.array(list(costs.values()))), Trie(costs.items())
    assert lexicon.nbytes <= sum(max(len(w.encode()), 8) + 4 for w in costs)
    runs = [glued([*parts, "q"], 9) for _ in range(2000)]
    part = lexicon.trie(runs)
    assert [part.cut(r) for r in runs] == [whole.cut(r) for r in runs]
    few = lexicon.trie(runs[:20])
    assert len(few.nodes) < len(whole.nodes) / 10 and [few.cut(r) for r in runs[:20]] == [whole.cut(r) for r in runs[:20]]


def test_marks_of_records_without_a_time(spark, tmp_path):
    schema = "event_id long, mid string, is_new string, time timestamp"
    day = 86400
    files = [[(1, "a", "1", None), (2, "b", "1", 10)], [(3, "a", "1", 20), (4, "b", "1", None), (5, None, "1", 30)], [(6, "a", "1", day + 20), (7, "b", "1", day + 30), (8, "c", "1", None)]]
    stream, df = timed(spark, f"{tmp_path}/in", schema, files)
    pick = lambda d: sorted((r.event_id, r.is_new) for r in d.collect())
    want = [(1, "1"), (2, "1"), (3, "1"), (4, "1"), (5, "1"), (6, "0"), (7, "0"), (8, "1")]
    assert pick(keyed.repair_is_new(df)) == want and pick(run_stream(stream_keyed.repair_is_new(stream), tmp_path)) == want
    assert sorted((r.mid or "", r.date) for r in keyed.first_of_day(df, "mid", "time", "event_id").collect()) == [("", "2024-01-01"), ("a", "2024-01-01"), ("a", "2024-01-02"), ("b", "2024-01-01"), ("b", "2024-01-02")]


def test_first_days_without_times(spark, tmp_path):
    files = [[(1, "a", None), (2, "a", 10), (3, "b", None)], [(4, "a", 20), (5, "b", 30)], [(6, "a", None)]]
    stream, df = timed(spark, f"{tmp_path}/in", "id long, user_id string, time timestamp", files)
    got = run_stream(stream_keyed.first_of_day(stream, "user_id", "time", "id", keep=stream_keyed.DAY), tmp_path)
    assert sorted(r.id for r in got.collect()) == [2, 5] == sorted(r.id for r in keyed.first_of_day(df, "user_id", "time", "id").collect())


def test_the_log_job_takes_any_time(spark, tmp_path):
    record = lambda mid, ts, **more: json.dumps({"common": {"mid": mid, "is_new": "1"}, "page": {"page_id": "p"}} | ({"ts": ts} if ts is not None else {}) | more)
    rows = [record("a", None), record("a", 1704067200000), record("a", "soon"), '{"ts":null}', record("a", 1704267200000), record("b", None, err={"m": "x"})]
    got = run_stream(log.repaired_log(lines_of(spark, f"{tmp_path}/in", rows[:3], rows[3:]), stream_keyed.repair_is_new), tmp_path)
    topics = lambda df: sorted((r.topic, r.value) for r in log.log_topics(df).collect())
    want = topics(log.repaired_log(spark.createDataFrame([(r,) for r in rows], "value string"), keyed.repair_is_new))
    assert topics(got) == want and len(want) == 7


def test_times_of_changes_that_are_no_numbers(spark):
    current = spark.createDataFrame([("1", "a")], "id string, name string")
    rows = spark.createDataFrame([("update", {"id": "1", "name": "b"}, "abc"), ("update", {"id": "1", "name": "c"}, "5"), ("update", {"id": "2", "name": "d"}, None)], "type string, data map<string,string>, ts string")
    assert {tuple(r) for r in sinks.dim_upsert(current, rows, "id", ["ts"]).collect()} == {("1", "c"), ("2", "d")}


def test_refunds_know_when_they_were_made(spark):
    t = Inputs(spark, "/root/testdata/sf0.001")
    before = dt.datetime.now(dt.timezone.utc)
    low, high = facts.refund(t.changes, t.dictionary).agg(F.unix_millis(F.min("row_op_ts")), F.unix_millis(F.max("row_op_ts"))).first()
    assert before.timestamp() * 1000 - 1 <= low <= high <= dt.datetime.now(dt.timezone.utc).timestamp() * 1000
