"""The training-data operators against brute force, and on odd tables."""

import hashlib
import random
import re
import zlib
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from millrace.llm import bwt, common, components, hamming, langid, merkle, minhash, mixing, packing, pseudo_lm, sharding, suffixes, textbytes, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def make_texts(n=60, seed=1):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice(["th", "en", "ra", "ü", "lo", "sk", "é", "on"]) for _ in range(rng.randint(1, 4)))
    shared = " ".join(word() for _ in range(50))
    out = []
    for i in range(n):
        words = [word() for _ in range(rng.choice([1, 2, 5, 40, 120]))]
        if i % 5 == 0:
            words[len(words) // 2 : 0] = [shared]
        text = " ".join(words) + rng.choice(["", ".", "\nMore. ", "\n\nNext\x00part, Z"])
        if i % 7 == 3 and out:  # near copy
            words = out[rng.randrange(len(out))].split(" ")
            words[rng.randrange(len(words))] = word()
            text = " ".join(words)
        out.append(out[rng.randrange(len(out))] if i % 11 == 5 else text)
    return [*out, "", "a b", "A B", " \t\n", "x" * 3000, "日本語 のテキスト 😀", "rows " * 700]


@pytest.fixture(scope="module")
def texts():
    return dict(enumerate(make_texts()))


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, ["en", "fr", None][i % 3], [None, "s1", "s2", "s3", "S"][i % 5], len(t)) for i, t in texts.items()]
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def odd(spark):
    """Null and repeated ids, null and empty texts, equal rows, and columns whose names the operators use."""
    rows = [(1, "one two three four five six", "en", "a", 1), (1, "one two three four five six", "en", "a", 1), (None, "one two three four five six", None, None, None), (None, None, "fr", "a", 0), (2, None, None, None, 0), (3, "", "en", "b", 0), (4, "  \n", "en", "b", 3), (4, "other text", "fr", "b", 3), (-5, "é" * 400, "en", "", 400)]
    df = spark.createDataFrame(rows, SCHEMA)
    for c in ("size", "bucket", "score", "label", "range", "cell", "virtual_slot", "draw", "_doc", "u", "v", "sig", "piece", "shard", "start", "_of", "_id", "repeats"):
        df = df.withColumn(c, F.lit("x"))
    return df


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i in range(60)] + [(1, 1, None), (None, 1, 1), (2, 1, 1)], "doc_id long, quality int, toxic int")


RUNS = {
    "merkle": lambda d, labels: merkle.fingerprint_edits(d), "langid": lambda d, labels: langid.identify(d), "suffixes": lambda d, labels: suffixes.remove_repeats(d), "toxicity": lambda d, labels: toxicity.score_documents(d, labels),
    "minhash": lambda d, labels: minhash.near_duplicates(d), "pseudo_lm": lambda d, labels: pseudo_lm.score(d), "sharding": lambda d, labels: sharding.shard_documents(d), "mixing": lambda d, labels: mixing.mix(d),
}


@pytest.mark.parametrize("name", RUNS)
def test_odd_rows_each_give_one(odd, labels, name):
    rows = RUNS[name](odd, labels).collect()
    assert sorted(str(r.doc_id) for r in rows) == sorted(map(str, [1, 1, None, None, 2, 3, 4, 4, -5]))


@pytest.mark.parametrize("name", [*RUNS, "packing"])
def test_empty_table(spark, labels, name):
    empty = spark.createDataFrame([], SCHEMA)
    assert (packing.pack_documents(empty) if name == "packing" else RUNS[name](empty, labels)).count() == 0


def test_fingerprints(docs, texts):
    got = {r.doc_id: r for r in merkle.fingerprint_edits(docs).collect()}
    ids = sorted(texts, reverse=True)
    for i, d in enumerate(ids):
        text, after = texts[d], texts[ids[(i + 1) % len(ids)]]
        edited = text[: len(text) - len(text) // 3] + after[: len(text) // 3]
        assert got[d].n_chars == len(text) and got[d].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert (got[d].fingerprint == got[d].edited_fingerprint) == (text == edited)
        assert 0 <= got[d].near_next <= 1 and (got[d].near_edited == 1 or text != edited)
    assert len({r.fingerprint for r in got.values()}) == len(set(texts.values()))


def test_fingerprints_over_many_ranges(docs, texts, monkeypatch):
    want = sorted(map(tuple, merkle.fingerprint_edits(docs).collect()))
    monkeypatch.setattr(merkle, "RANGE_BYTES", 500)
    assert sorted(map(tuple, merkle.fingerprint_edits(docs).collect())) == want


def test_changed_paragraphs(spark):
    df = spark.createDataFrame([("a\nb\n\nc\nd", "a\nnew\nb\n\nc\nd"), ("a\nb\n\nc\nd", "c\nd\n\na\nB"), ("a", "a"), ("", "x")], "l string, r string")
    l, r = (merkle.sections(merkle.tree(F.col(c))) for c in "lr")
    nodes = lambda *texts: [merkle.sections(merkle.tree(F.lit(t)))[0][0] for t in texts]
    got = df.select(merkle.changed_paragraphs(l, r).alias("c"), F.array(nodes("new")[0]).alias("x"), F.array(nodes("B")[0]).alias("y"), F.array(nodes("x")[0]).alias("z")).collect()
    assert [x.c for x in got] == [got[0].x, got[0].y, [], got[0].z]
    same = lambda a, b: df.select(*[merkle.root(merkle.section_nodes(merkle.sections(merkle.tree(F.lit(t))))) for t in (a, b)]).first()
    assert len(set(same("a\n\n\nb", "a\n\nb"))) == 2 and len(set(same("", "\n"))) == 2 and len(set(same("é a", "é a"))) == 1


@pytest.mark.parametrize("text", ["", "ab", "x" * 1000, "word " * 80, "短い 日本語のテキスト、長い長い。" * 20, "$$$ &&& ###\t" * 50])
def test_leaves_are_short_and_keep_all_bytes(spark, text):
    pieces = re.findall(merkle.LEAVES, text.encode().hex().upper())
    assert "".join(pieces) == text.encode().hex().upper() and all(len(x) <= 2 * merkle.LEAF for x in pieces)
    got = spark.createDataFrame([(text,)], "t string").select(merkle.tree(F.col("t")).alias("t")).first().t
    assert got == [[[hashlib.sha256(b"l" + x.encode()).hexdigest() for x in pieces or [""]]]]


def test_an_insertion_moves_few_leaves(spark):
    rng = random.Random(9)
    for alphabet in ("abcdefghijklmnop qrst", "自動車電話番号新聞天気予報学校図書館"):
        text = "".join(rng.choice(alphabet) for _ in range(3000))
        df = spark.createDataFrame([(text, text[:1000] + "!?" + text[1000:])], "a string, b string")
        assert df.select(merkle.likeness(merkle.leaves(merkle.tree(F.col("a"))), merkle.leaves(merkle.tree(F.col("b"))))).first()[0] > 0.9


@pytest.mark.parametrize("ids", [[0, 1, 2, 3, 4, 5, 1 << 50], [-(1 << 63), -(1 << 63) + 5, 0, (1 << 63) - 5, (1 << 63) - 1], [None] * 30 + [4, 9], [7] * 40])
def test_any_ids_fall_into_ranges(spark, ids, monkeypatch):
    monkeypatch.setattr(merkle, "RANGE_BYTES", 400)
    rows = [(d, f"text {i} " * 9) for i, d in enumerate(ids)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    tie = {r.text: r.h for r in df.select("text", F.xxhash64("text").alias("h")).collect()}
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, tie[r[1]]), reverse=True)
    want = {t: order[(i + 1) % len(order)][1] for i, (_, t) in enumerate(order)}
    out = merkle.with_next(df)
    assert {r.text: r.next_text for r in out.collect()} == want
    if len(ids) > 10:
        assert len(merkle._borders(df.withColumn("key", F.coalesce("doc_id", F.lit(-1))).withColumn("tie", F.xxhash64("text")))) >= 5


@pytest.mark.parametrize("chunk", [1, 2, 5, 16, 1 << 21])
def test_transform_classes(chunk, monkeypatch):
    monkeypatch.setattr(bwt, "CHUNK", chunk)
    rng = random.Random(1)
    for trial in range(120):
        length = rng.randint(1, 5)
        pieces = [bytes(rng.choice(b"ab\x00\xf0" if trial % 2 else b"ab") for _ in range(rng.randint(length, 14))) for _ in range(rng.randint(1, 8))]
        bounds, n = np.concatenate(([0], np.cumsum([len(p) for p in pieces]))), np.array([len(p) - length + 1 for p in pieces])
        label = bwt.window_classes(np.frombuffer(b"".join(pieces), np.uint8), bounds, n, length)
        windows = [p[i : i + length] for p in pieces for i in range(len(p) - length + 1)]
        assert len(set(zip(label, windows, strict=True))) == len(set(label)) == len(set(windows))


def repeats_by_hand(rows, length):
    first = {}
    for d, t in sorted(rows):
        for p in range(len(t) - length + 1):
            first.setdefault(t[p : p + length], (d, p))
    out = []
    for d, t in rows:
        gone = bytearray(len(t))
        for p in range(len(t) - length + 1):
            if first[t[p : p + length]] != (d, p):
                gone[p : p + length] = b"\1" * length
        kept = bytes(b for b, g in zip(t, gone, strict=True) if not g)
        out.append((d, len(t), len(t) - len(kept), sum(g and not gone[i - 1] if i else g for i, g in enumerate(gone)), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def test_suffix_repeats(docs, texts, monkeypatch):
    want = repeats_by_hand([(d, t.encode()) for d, t in texts.items()], 100)
    assert sum(r[2] for r in want) > 5000
    assert sorted(map(tuple, suffixes.remove_repeats(docs).collect())) == want
    kept = {r.doc_id: r.text for r in suffixes.without_repeats(docs).collect()}
    assert set(kept) == set(texts) and all(len(kept[d].encode()) >= n - gone for d, n, gone, *_ in want)


def test_rows_of_one_id_have_their_own_repeats(spark):
    rng = random.Random(4)
    some = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    passage, head = some(300), some(250)
    rows = [(None, some(700) + passage), (None, some(1500)), (None, some(120)), (1, passage + some(50)), (2, some(90) + passage + some(90)), (2, some(2000)), (2, some(400) + passage), (2, some(110))]
    rows += [(i, head + some(200)) for i in (3, 3, None, None)] + [(3, head[100:] + some(20)), (3, some(40) + passage[:180] + some(40)), (2, rows[4][1]), (None, rows[0][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    data, first = [(suffixes.NO_ID if d is None else d, t.encode()) for d, t in rows], {}
    for d, t in data:
        for p in range(len(t) - 99):
            first[t[p : p + 100]] = min(first.get(t[p : p + 100], (d, p)), (d, p))
    want = []
    for d, t in data:
        gone = bytearray(len(t))
        for p in range(len(t) - 99):
            if first[t[p : p + 100]] != (d, p):
                gone[p : p + 100] = b"\1" * 100
        kept = bytes(b for b, g in zip(t, gone, strict=True) if not g)
        want.append((len(t), len(t) - len(kept), hashlib.sha256(kept).hexdigest()))
    got = suffixes.remove_repeats(df).collect()
    assert sorted((r.n_bytes, r.n_removed, r.kept_sha256) for r in got) == sorted(want)
    assert sorted(hashlib.sha256(r.text.encode()).hexdigest() for r in suffixes.without_repeats(df).collect()) == sorted(w[2] for w in want)


def test_a_long_text_in_segments(monkeypatch):
    rng = random.Random(2)
    text = np.frombuffer(bytes(rng.choice(b"abcdefgh ") for _ in range(3000)) * 2, np.uint8)
    whole = suffixes.spans(text, np.array([0, len(text)]), 100)
    windows = sum(whole[2])
    assert windows == len(text) - 99 and (whole[3] < 69 + whole[2]).all() and (whole[2] <= 69).all()
    monkeypatch.setattr(suffixes, "SEGMENT", 1000)  # each window in one segment, and spans that a border cuts still cover all
    batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array([5]), pa.array([text.tobytes().decode()])], ["doc_id", "key", "text"])
    rows = pa.Table.from_batches(suffixes._task_spans(iter([batch]), 100, np.zeros(0, np.int64))).to_pylist()
    starts = sorted(p for r in rows for p in range(r["place"] >> 16, (r["place"] >> 16) + (r["place"] >> 8 & 255)))
    assert starts == list(range(len(text) - 99))


def test_a_text_over_a_megabyte(spark):
    """Longer than a block, with a passage that repeats in it and one from a short text."""
    rng = random.Random(12)
    some = lambda n: "".join(rng.choices("abcdefghé ", k=n))
    passage, short = some(400), some(150)
    rows = [(1, short), (2, some(700_000) + "1" + passage + "2" + some(500_000) + short + some(1000) + "3" + passage + "4" + some(10)), (3, some(2000))]
    got = {r.doc_id: r for r in suffixes.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = rows[1][1].replace(short, "", 1)
    want = want[: want.rindex(passage)] + want[want.rindex(passage) + len(passage) :]
    assert (got[1].n_removed, got[3].n_removed, got[2].n_spans) == (0, 0, 2)
    assert got[2].kept_sha256 == hashlib.sha256(want.encode()).hexdigest()


def test_frequent_anchors(spark, monkeypatch):
    """Spans of anchors that stand in most texts meet by their own hash; the rows are the same."""
    rng = random.Random(6)
    some = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    line, head = some(60), some(130)
    texts = [some(rng.randint(50, 200)) + line + some(rng.randint(0, 200)) for _ in range(40)] + [head + line + some(50) for _ in range(10)]
    rows = list(enumerate(texts + texts[:3]))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    want = repeats_by_hand([(d, t.encode()) for d, t in rows], 100)
    of, key = suffixes._keys()
    keyed = docs.select(of.alias("doc_id"), key.alias("key"), "text")
    assert len(suffixes._frequent(keyed, 100)) == 0 and sorted(map(tuple, suffixes.remove_repeats(docs).collect())) == want
    monkeypatch.setattr(suffixes, "SHARE", 1)
    monkeypatch.setattr(suffixes, "MANY", 5)
    assert 0 < len(suffixes._frequent(keyed, 100)) < 100
    assert sorted(map(tuple, suffixes.remove_repeats(docs).collect())) == want


@pytest.mark.parametrize(("size", "held"), [(1, 100), (3, 100), (1000, 100), (2, 1)])
def test_spans_pass_by_in_any_batches(size, held):
    rng = random.Random(size)
    rows = {(a, s, rng.randint(0, 4), rng.randint(0, 2), rng.randint(0, 3) << 16 | 7 << 8 | (a if a != 3 else a | suffixes.HEAVY)) for a in range(6) for s in range(a if a < 3 else 1) for _ in range(6)}
    rows |= {(a, 9, 1, a, 5 << 16 | 7 << 8 | suffixes.KNOWN) for a in (-8, 40)}
    rows = sorted([*rows, *list(rows)[::2]], key=lambda r: (*r[:3], r[4], r[3]))
    table = pa.table([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], suffixes._SPAN)
    got = [(r["doc_id"], r["key"], r["start"], r["n"], r["lead"]) for r in pa.Table.from_batches(suffixes._meet(iter(table.to_batches(size)), held)).to_pylist()]
    repeat, wanted, alone = set(), set(), set()
    for a, s, d, k, p in rows:
        begin = min((x[2], x[4] >> 16) for x in rows if x[:2] == (a, s))
        if p & 255 == suffixes.KNOWN or (d, p >> 16) != begin:
            repeat.add((d, k, p >> 16, 7, None))
        else:
            of_many = p & suffixes.HEAVY or len({x[1] for x in rows if x[0] == a}) > 1
            (wanted if of_many else alone).add((d, k, p >> 16, 7, p & 127))
    assert set(got) >= repeat | wanted and set(got) <= repeat | wanted | (alone if held == 1 else set())
    assert len(got) <= len(set(rows))


@pytest.mark.parametrize("strings", [1, 4, 10_000])
def test_halves_pass_by_in_any_batches(strings):
    rng = random.Random(strings)
    pieces = [bytes(rng.choice(b"ab") for _ in range(rng.randint(6, 9))) for _ in range(60)]
    rows = sorted((rng.randint(0, 4), d // 2, 0, 100 * (d % 2), len(p) - 5, p) for d, p in enumerate(pieces))
    kinds = [pa.int64()] * 4 + [pa.int16(), pa.binary()]
    table = pa.table([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["half", "doc_id", "key", "start", "n", "piece"])
    got = set()
    for r in pa.Table.from_batches(suffixes._transform(iter(table.to_batches(3)), 6, strings)).to_pylist():
        got |= {(r["doc_id"], r["start"] + i) for i in range(r["n"])}
    def late(of_group):  # with groups in one transform, repeats of other groups' windows may be found as well
        first, out = {}, set()
        for h, d, _, s, n, p in sorted(rows, key=lambda r: (r[1], r[3])):
            out |= {(d, s + i) for i in range(n) if first.setdefault((h * of_group, p[i : i + 6]), (d, s + i)) != (d, s + i)}
        return out

    assert late(True) <= got <= late(False)


def sets_by_hand(texts, k):
    out = {}
    for d, t in texts.items():
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        out[d] = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} or ({tuple(w)} if w else set())
    return out


@pytest.mark.parametrize(("k", "num"), [(3, 85), (5, 80)])
def test_near_duplicates(docs, texts, k, num):
    sets, parent = sets_by_hand(texts, k), {d: d for d in texts}

    def root(x):
        return x if parent[x] == x else root(parent[x])

    for a in texts:
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= num * len(sets[a] | sets[b]) and root(a) != root(b):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    got = {r.doc_id: r for r in minhash.near_duplicates(docs, k, num).collect()}
    assert {d: (r.n_shingles, r.component_id, r.kept) for d, r in got.items()} == {d: (len(sets[d]), root(d), root(d) == d) for d in texts}
    assert sum(not r.kept for r in got.values()) > 5


def test_buckets_in_several_squares(docs, monkeypatch):
    want = sorted(map(tuple, minhash.near_duplicates(docs, 3, 50).collect()))
    monkeypatch.setattr(minhash, "SQUARE", 2)
    assert sorted(map(tuple, minhash.near_duplicates(docs, 3, 50).collect())) == want


def test_components(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, 101), (102, 101), (7, 7), (None, 1), (200, 100)]
    got = {r.node: r.component for r in components.connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(31)}, **dict.fromkeys((100, 101, 102, 200), 100)}


def test_forward_backward():
    import itertools

    rng, field = np.random.default_rng(0), langid.Field(["a", "b", "c"])
    field.move = rng.normal(size=(3, 3))
    old, langid.SEGMENT = langid.SEGMENT, 3
    try:
        bounds, e = np.array([0, 5, 5, 9, 10]), rng.uniform(0.1, 1, (10, 3))
        got, step = field.marginals(e, bounds), np.exp(field.move)
    finally:
        langid.SEGMENT = old
    for a, b in zip(bounds, bounds[1:], strict=False):
        total = np.zeros((b - a, 3))
        for path in itertools.product(range(3), repeat=b - a):
            p = np.prod([e[a + t, s] for t, s in enumerate(path)]) * (step[:, path[0]].sum() if path else 1) * np.prod([step[x, y] for x, y in zip(path, path[1:], strict=False)])
            for t, s in enumerate(path):
                total[t, s] += p
        assert np.allclose(total / total.sum(1, keepdims=True), got[a:b])


def test_languages_on_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = langid.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held_out]
    assert sum(r.lang_pred == r.lang for r in held) >= 0.98 * len(held)


def late_ids(spark, n, last):
    """Ids below n, those with the `last` largest hashes apart."""
    ids = [r.id for r in spark.range(n).orderBy(F.xxhash64("id"), "id").collect()]
    return ids[:-last], ids[-last:]


def test_rare_languages_are_learned(spark):
    usual, rare = late_ids(spark, 400, 3)
    df = spark.createDataFrame([(i, f"the cat and the dog {i}", "en") for i in usual] + [(i, "zuk zok zak zyk", "zz") for i in rare], "doc_id long, text string, lang string")
    assert langid.SAMPLE >= 1500
    field = langid.fit_languages(df, F.lit(True), sample=40)
    assert field.languages == ["en", "zz"]


def test_rare_labels_are_learned(spark, monkeypatch):
    common, rare = late_ids(spark, 400, 10)
    df = spark.createDataFrame([(i, f"word{i % 7} and more") for i in common] + [(i, "bad thing") for i in rare], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 0) for i in common] + [(i, 1) for i in rare], "doc_id long, toxic int")
    seen = {}
    fit = toxicity.Machine.fit
    monkeypatch.setattr(toxicity.Machine, "fit", lambda self, docs, label, **more: seen.update(label=label, **more) or fit(self, docs, label, **more))
    model = toxicity.fit_toxicity(df, labels, F.lit(True), sample=40)
    assert toxicity.SAMPLE >= 12_000 and len(seen["label"]) == 40 and seen["label"].sum() == 10
    assert np.isclose(seen["weight"][0] * 30 / 390, seen["weight"][1] * 10 / 10)
    assert {r.score > 0.3 for r in toxicity.with_score(df, model).filter(F.col("_doc.text") == "bad thing").collect()} == {True}


def test_code_switched_text(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    field = langid.fit_languages(docs, F.lit(True))
    en, fr = (docs.filter(f"lang = '{x}' and n_chars between 600 and 3000").first().text for x in ("en", "fr"))
    mixed = en[:400] + " " + fr[:400]
    runs = langid.language_runs(spark.createDataFrame([(1, mixed)], "doc_id long, text string"), field).first().runs
    size = lambda lang: sum(r.end - r.start for r in runs if r.lang == lang)
    assert size("en") > 300 and size("fr") > 300 and len(runs) < 20


def test_toxicity_on_held_out_documents(spark):
    d = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{d}/labels.parquet")
    got = toxicity.op4_toxicity_fm(spark, d).join(labels, "doc_id").filter("held_out").collect()
    hit = [r for r in got if r.predicted]
    assert sum(r.toxic for r in hit) >= 0.9 * len(hit) and len(hit) >= 0.7 * sum(r.toxic for r in got)
    assert all(r.predicted == (r.score >= 0.3) for r in got)


def test_pairs_of_terms_count():
    """Toxic only if two terms meet: weights alone can't tell."""
    rng = np.random.default_rng(0)
    rows = [(int(a), int(b), rng.integers(100, 140, 3)) for a, b in rng.integers(0, 2, (3000, 2))]
    docs = [np.unique(np.concatenate(([1] if a else [2], [3] if b else [4], more))).astype(np.int32) for a, b, more in rows]
    label = np.array([a == b for a, b, _ in rows], np.float32)
    model = toxicity.Machine().fit(docs, label, factor_rate=0.05)
    score = model.score(np.concatenate(([0], np.cumsum([len(x) for x in docs]))), np.concatenate(docs))
    assert ((score > 0.5) == label).mean() > 0.8


def test_pseudo_likelihood_gradient():
    net = pseudo_lm.Network(np.arange(1, 50, dtype=np.uint64))
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    rng = np.random.default_rng(1)
    around, target = rng.integers(0, pseudo_lm.VOCABULARY + 1, (40, 4)), rng.integers(0, pseudo_lm.VOCABULARY, 40)
    grad = net.gradients(around, target)
    for k, at in (("w", (3, 5)), ("wc", (2, 7)), ("b", (4,)), ("embed", (int(around[0, 0]), 1)), ("bw", (int(target[0]) // 32, 3))):
        loss = []
        for step in (1e-5, -2e-5):
            net.p[k][at] += step
            loss.append(-net.log_probabilities(around, target).mean())
        net.p[k][at] += 1e-5
        assert abs((loss[0] - loss[1]) / 2e-5 - grad[k][at]) < 1e-4


def test_pseudo_likelihood_is_a_distribution_and_learns(spark):
    docs = spark.createDataFrame([(i, "a b c d " * 200 + ("zz" * (i % 3))) for i in range(600)], "doc_id long, text string").repartition(2)
    net = pseudo_lm.fit_network(docs.select("text"))
    every = np.arange(pseudo_lm.VOCABULARY)
    assert np.isclose(np.exp(net.log_probabilities(np.full((len(every), 4), 3), every)).sum(), 1, atol=1e-4)
    got = pseudo_lm.score(docs).collect()
    assert all(r.n_words in (800, 801) and r.mean_log_likelihood > -3 for r in got)  # far above a guess among 2048


def test_rounds_cover_every_word(spark, monkeypatch):
    """However the rows are partitioned, the rounds take each word once, and the scores are the same."""
    texts = [f"a b c d e f g h i j {i % 7} {'word ' * (i % 5)}" for i in range(300)] + ["", "one", "x " * 40_000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    monkeypatch.setattr(pseudo_lm, "SHARD", 40_000)
    seen, train = spark.sparkContext.accumulator(0), pseudo_lm._train

    def counted(batches, model):
        for b in train(batches, model):
            seen.add(b.column("n")[0].as_py())
            yield b

    monkeypatch.setattr(pseudo_lm, "_train", counted)
    got = [{r.doc_id: r.log_likelihood for r in pseudo_lm.score(d).collect()} for d in (df.repartition(2), df.repartition(7, "doc_id"))]
    assert seen.value == 2 * sum(len(t.split()) for t in texts)
    assert all(np.isclose(got[0][d], got[1][d], rtol=1e-3) for d in got[0])


def test_each_rare_word_is_predicted_itself(spark, monkeypatch):
    monkeypatch.setattr(pseudo_lm, "ROUNDS", 0)
    texts = [" ".join(f"w{i}" for i in range(2500)) + " " + " ".join(f"w{i}" for i in range(400, 2500)), "w3 w3 w7 w7 w7", "w2400 once w1 w1", "", "never"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    net, count, entry = pseudo_lm.fit_network(df), {}, {}
    hashes = {}
    for _, _, h, _ in pseudo_lm.word_hashes(pa.RecordBatch.from_pydict({"text": texts})):
        hashes = dict(zip(" ".join(texts).split(), h, strict=True))
    for w in " ".join(texts).split():
        count[w] = count.get(w, 0) + 1
    of = lambda w: int(net.ids(np.array([hashes[w]], np.uint64))[0])
    for w, n in count.items():
        entry[of(w)] = entry.get(of(w), 0) + n
    got = {r.doc_id: r.log_likelihood for r in pseudo_lm.score(df).collect()}
    rare = 0
    for d, t in enumerate(texts):
        ids = np.array([of(w) for w in t.split()], np.int32)
        want = net.log_probabilities(net.contexts(ids, np.array([0, len(ids)]), np.arange(len(ids))), ids).sum() if len(ids) else 0
        own = [np.log(count[w] / entry[of(w)]) for w in t.split()]
        rare += sum(x < 0 for x in own)
        assert np.isclose(got[d], want + sum(own), rtol=1e-4)
    assert rare > 300


@pytest.mark.parametrize("dims", [64, 40])
def test_multi_index_search(spark, dims, monkeypatch):
    rng = np.random.default_rng(dims)
    v = rng.normal(size=(300, dims)).astype(np.float32)
    v[100:180] = v[20]
    v[180:220] = v[20] + rng.normal(0, 0.3, (40, dims))
    rows = [(i, [float(x) for x in r]) for i, r in enumerate(v)] + [(400, None), (None, [1.0] * dims), (420, [1.0]), (440, [1.0] * (dims + 30)), (460, [])]
    rows += rows[:50]  # repeated rows are one row
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    for c in ("id", "v", "q0", "s0", "seg", "value", "part", "near", "rank", "ids", "far"):
        df = df.withColumn(c, F.lit("x"))
    bits = v >= 0
    want = set()
    for q in range(0, 300, 20):
        near = sorted((int((bits[q] != bits[i]).sum()), i) for i in range(300) if i != q)[:10]
        want |= {(q, n + 1, i, d) for n, (d, i) in enumerate(near)}
    assert {tuple(r) for r in hamming.top_k(df).collect()} == want
    monkeypatch.setattr(hamming, "BUCKET", 3)
    assert {tuple(r) for r in hamming.top_k(df).collect()} == want


def test_search_of_few_and_none(spark):
    kind = "vec_id long, embedding array<float>"
    assert hamming.top_k(spark.createDataFrame([], kind)).count() == 0
    assert [tuple(r) for r in hamming.top_k(spark.createDataFrame([(0, [1.0, -1.0]), (7, [1.0, 1.0])], kind)).collect()] == [(0, 1, 7, 1)]


def test_shards(docs, texts):
    got = sharding.shard_documents(docs).collect()
    assert {r.doc_id: (r.size, r.text_crc32) for r in got} == {d: (len(t.encode()) + 1, zlib.crc32(t.encode())) for d, t in texts.items()}
    for s in range(8):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    load = np.random.default_rng(0).integers(0, 1000, 4096)
    one = sharding.first_map(load, 8)
    total = np.bincount(one, load, 8)
    assert total.max() - total.min() <= 1000
    grown = sharding.edit_map(one, load, 9)
    assert np.bincount(grown, load, 9).max() <= 1.02 * load.sum() / 9 and (one != grown).mean() < 0.2


def test_slot_map_versions(spark, tmp_path):
    one = np.zeros(4096, int)
    sharding.save_map(spark, str(tmp_path), 1, one)
    sharding.save_map(spark, str(tmp_path), 2, one + 1)
    assert {r.shard for r in sharding.load_map(spark, str(tmp_path)).collect()} == {1}
    assert {r.shard for r in sharding.load_map(spark, str(tmp_path), 1).collect()} == {0}


def targets_by_hand(total):
    names = sorted((n for n in total if n is not None), key=lambda n: n) + ([None] if None in total else [])
    weight, full = {n: (5, 2, 1)[i % 3] for i, n in enumerate(names)}, set()
    while True:  # clamp what is above its cap, share the rest again
        left = 1.5 * sum(total.values()) - sum(2 * total[s] for s in full)
        rest = [s for s in names if s not in full]
        target = {s: 2.0 * total[s] if s in full else left * weight[s] / sum(weight[x] for x in rest) for s in names}
        over = {s for s in rest if target[s] > 2 * total[s]}
        if not over:
            return target
        full |= over


def test_mix_by_hand(docs, texts):
    got = {r.doc_id: r for r in mixing.mix(docs).collect()}
    source = {d: [None, "s1", "s2", "s3", "S"][d % 5] for d in texts}
    size = {d: len(WORD.findall(t)) for d, t in texts.items()}
    total = {s: sum(size[d] for d in texts if source[d] == s) for s in source.values()}
    target = targets_by_hand(total)
    for s in total:
        rows = [got[d] for d in texts if source[d] == s]
        assert all(abs(r.target - target[s]) < 1e-6 and r.source_size == total[s] for r in rows)
        assert abs(sum(r.taken for r in rows) - target[s]) <= 0.5
    assert all(got[d].size == size[d] and 0 <= got[d].taken <= 2 * size[d] for d in texts)
    assert {r.doc_id: r.taken for r in mixing.mix(docs.repartition(3)).collect()} == {d: r.taken for d, r in got.items()}


def test_packing_against_the_tokenizer(docs, odd, texts):
    import public_tokenizers
    from tokenizers import Tokenizer

    coder = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = packing.pack_documents(docs).collect()
    for d, t in texts.items():
        ids = np.array([*coder.encode(t, add_special_tokens=False).ids, 2], "<u4")
        own = sorted((r for r in got if r.doc_id == d), key=lambda r: r.piece)
        assert [r.piece for r in own] == list(range(-(-len(ids) // 1024))) and [r.start for r in own] == [0, *np.cumsum([r.length for r in own])[:-1]]
        assert sum(r.length for r in own) == len(ids) and all(r.length == 1024 for r in own[1:])
        assert all(zlib.crc32(ids[r.start : r.start + r.length]) == r.ids_crc32 for r in own)
    assert_packed(got)
    rows = packing.pack_documents(odd).collect()
    assert len(rows) == 9
    assert_packed(rows)


def assert_packed(rows):
    of = {}
    for r in rows:
        of.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in of.values():
        own.sort()
        assert [o for o, _ in own] == [0, *np.cumsum([n for _, n in own])[:-1]] and sum(n for _, n in own) <= 1024


@pytest.mark.parametrize("text", ["a  b", " a", "a  b 　 c", "don't  <|endoftext|> stop", "x \n\n y\t z ", "été à 12 34!? ok", "", " ", "  "])
def test_chunks_are_like_whole_texts(text):
    import public_tokenizers
    from tokenizers import Tokenizer

    coder, chunks = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), packing.Chunks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    texts = [text, text + " more " + text, text]
    data = [t.encode() for t in texts]
    ids, bounds = chunks.encode(np.frombuffer(b"".join(data), np.uint8), np.concatenate(([0], np.cumsum([len(x) for x in data]))))
    assert [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:], strict=False)] == [coder.encode(t, add_special_tokens=False).ids for t in texts]


def test_islands_are_no_worse_than_best_fit():
    rng = np.random.default_rng(3)
    sizes = np.sort(rng.integers(200, 700, 400))
    island = packing.Island(sizes, 1)
    first = island.packed(0)
    best = island.evolve()[0]
    assert np.bincount(best, sizes).max() <= 1024 and len(best) == 400 and best.max() <= first.max() and island.fitness(best) >= island.fitness(first)


def test_pipeline_stages(spark, odd, tmp_path):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near-duplicates", "repeated passages", "mixing", "packing"]
    toxic, clean = ({r.doc_id for r in spark.read.parquet(f"{sf}/labels.parquet").filter(f"toxic = {x}").collect()} for x in (1, 0))
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = stage(spark, docs, sf)
        if name != "packing":
            assert docs.columns == before.columns
        docs.write.parquet(f"{tmp_path}/{name.replace(' ', '-')}")
        docs = spark.read.parquet(f"{tmp_path}/{name.replace(' ', '-')}")
        if name == "toxicity":
            left = {r.doc_id for r in docs.collect()}
            assert len(left & toxic) <= 0.1 * len(toxic) and len(left & clean) >= 0.95 * len(clean)
        if name == "near-duplicates":
            want = {r.doc_id for r in minhash.near_duplicates(before).filter("kept").collect()}
            assert {r.doc_id for r in docs.collect()} == want
        if name == "repeated passages":
            assert suffixes.repeats(docs).count() < suffixes.repeats(before).count() and docs.count() == before.count()
    assert_packed(docs.collect())
    docs = odd
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf)
        assert docs.columns == odd.columns


def thue_morse(n=2048):
    """A word and its complement, which collide in every polynomial hash modulo 2^64."""
    word = "a"
    while len(word) < n:
        word += word.translate({97: 98, 98: 97})
    return word, word.translate({97: 98, 98: 97})


def test_range_hashes_are_residues(monkeypatch):
    rng, prime = np.random.default_rng(0), int(textbytes.PRIME)
    for run in (textbytes._RUN, 7):
        monkeypatch.setattr(textbytes, "_RUN", run)
        buf = rng.integers(0, 256, 2000).astype(np.uint8)
        start = rng.integers(0, 1900, 100)
        end = start + rng.integers(0, 100, 100)
        residues = [[sum((int(x) + 1) * pow(base, i, prime) for i, x in enumerate(buf[a:b])) % prime for base in textbytes.BASES] for a, b in zip(start, end, strict=True)]
        want = textbytes.mix(np.array([x | y << 31 for x, y in residues], np.uint64))
        assert (textbytes.range_hash(textbytes.prefix(buf), start, end) == want).all()


def test_words_that_collide_modulo_a_power_of_two(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    one, two = thue_morse()
    df = spark.createDataFrame([(0, one), (1, two), (2, f"x {one} y z"), (3, f"x {two} y z")], "doc_id long, text string").coalesce(1)
    assert {r.doc_id for r in minhash.near_duplicates(df, 3, 85).filter("kept").collect()} == {0, 1, 2, 3}
    assert len({r.word for r in pseudo_lm.word_counts(df).collect()}) == 5
    want = repeats_by_hand([(r.doc_id, r.text.encode()) for r in df.collect()], 100)
    assert sorted(map(tuple, suffixes.remove_repeats(df).collect())) == want
    coder = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for r in packing.token_pieces(df, capacity=1 << 20).collect():
        ids = np.array([*coder.encode([one, two, f"x {one} y z", f"x {two} y z"][r.doc_id], add_special_tokens=False).ids, 2], "<u4")
        assert (r.length, r.ids_crc32) == (len(ids), zlib.crc32(ids))


def test_chunks_of_one_hash_are_told_apart(monkeypatch):
    """Even if all hashes were one."""
    import public_tokenizers
    from tokenizers import Tokenizer

    monkeypatch.setattr(packing, "range_hash", lambda sums, start, end: np.zeros(len(start), np.uint64))
    coder, chunks = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), packing.Chunks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    for text in ("one two three four two", "other words than those before other"):
        data = text.encode()
        ids, _ = chunks.encode(np.frombuffer(data, np.uint8), np.array([0, len(data)]))
        assert ids.tolist() == coder.encode(text, add_special_tokens=False).ids


def test_scores_by_hand(texts):
    """Bias, weights and all pairs of a text's terms, one by one."""
    rng, model = np.random.default_rng(1), toxicity.Machine()
    model.bias, model.w, model.v = np.float32(-0.3), rng.normal(0, 0.2, toxicity.BUCKETS).astype(np.float32), rng.normal(0, 0.1, (toxicity.BUCKETS, toxicity.RANK)).astype(np.float32)

    def bucket(term, times=1):
        one = np.frombuffer(term, np.uint8)
        return (int(textbytes.range_hash(textbytes.prefix(one), np.array([0]), np.array([len(one)]))[0]) * times % (1 << 64)) >> (64 - 18)

    batch = pa.RecordBatch.from_pydict({"text": list(texts.values())})
    got = np.concatenate([model.score(bounds, x) for _, bounds, x in toxicity.term_buckets(batch)])
    for text, score in zip(texts.values(), got, strict=True):
        terms = re.findall(rb"[A-Za-z0-9\x80-\xff]+", text.encode().lower())
        of = {bucket(t) for t in terms} | {bucket(t[:n], 2 * n + 1) for t in terms for n in toxicity.STEMS if len(t) > n}
        z = model.bias + sum(float(model.w[x]) for x in of) + sum(float(model.v[x] @ model.v[y]) for x in of for y in of if x < y)
        assert np.isclose(score, 1 / (1 + np.exp(-z)), rtol=1e-3, atol=1e-5)


def test_labels_of_other_types(spark):
    docs = spark.createDataFrame([(i, f"good {i % 5} bad" if i % 2 else "fine day") for i in range(60)], "doc_id long, text string")
    for kind in ("long", "boolean", "double", "string"):
        labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").cast(kind if kind != "string" else "int").cast(kind).alias("toxic"))
        assert {r.predicted for r in toxicity.score_documents(docs, labels).filter("doc_id % 2 = 1").collect()} == {1}


def test_samples_are_bounded_whatever_ids_repeat(spark):
    """An id that many rows share doesn't bring them all to the driver."""
    docs = spark.createDataFrame([(7, f"many words of one kind {i}", "en") for i in range(500)] + [(i, "peu de mots", "fr") for i in range(100, 120)], "doc_id long, text string, lang string")
    assert langid.fit_languages(docs, F.lit(True), sample=30).languages == ["en", "fr"]
    labels = spark.createDataFrame([(7, 1)] + [(i, 0) for i in range(100, 120)], "doc_id long, label int")
    chosen, _, _ = common.sample_by_class(labels, "label", 30)
    assert common.first_rows(docs.select("doc_id", "text"), chosen, ["doc_id"]).count() == 21


def test_samples_are_bounded_in_bytes(spark):
    docs = spark.createDataFrame([(i, "x" * (1000 if i % 4 == 0 else 10)) for i in range(40)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, label int")
    chosen, _, taken = common.sample_by_class(labels, "label", 30)
    same, as_taken = common.within_bytes(docs, chosen, taken, ["doc_id"], 1 << 20)
    assert same is chosen and as_taken == {0: 15, 1: 15}
    some, of_class = common.within_bytes(docs, chosen, taken, ["doc_id"], 4400)  # 2200 a class: two long ones
    rows = some.collect()
    assert sum(r.doc_id % 4 == 0 for r in rows) == 2 and of_class == {0: sum(r.label == 0 for r in rows), 1: 15}


def cut_by_hand(rows):
    """Texts without what lies in a string of 100 bytes that also starts earlier; characters covered in part stay."""
    first, out = {}, {}
    data = sorted((d, t.encode()) for d, t in rows)
    for d, t in data:
        for p in range(len(t) - 99):
            first.setdefault(t[p : p + 100], (d, p))
    for d, t in data:
        gone = bytearray(len(t))
        for p in range(len(t) - 99):
            if first[t[p : p + 100]] != (d, p):
                gone[p : p + 100] = b"\1" * 100
        kept, at = [], 0
        for c in t.decode():
            n = len(c.encode())
            kept += [c] if not all(gone[at : at + n]) else []
            at += n
        out[d] = "".join(kept)
    return out


def test_pipeline_by_hand(spark):
    """run() against brute force in all stages after the learned one."""
    import public_tokenizers
    from tokenizers import Tokenizer

    sf = "/root/testdata/sf0.001"
    rows = {r.doc_id: r for r in corpus_pipeline.drop_toxic(spark, spark.read.parquet(f"{sf}/documents.parquet"), sf).collect()}
    sets, group = sets_by_hand({d: r.text for d, r in rows.items()}, 5), {d: d for d in rows}

    def root(x):
        return x if group[x] == x else root(group[x])

    for a in rows:
        for b in rows:
            both = len(sets[a] & sets[b]) if a < b else 0
            if both and 100 * both >= 80 * len(sets[a] | sets[b]) and root(a) != root(b):
                x, y = sorted((root(a), root(b)))
                group[y] = x
    texts = cut_by_hand([(d, r.text or "") for d, r in rows.items() if root(d) == d])
    size, source = {d: len(WORD.findall(t)) for d, t in texts.items()}, {d: rows[d].source for d in texts}
    total = {s: sum(size[d] for d in texts if source[d] == s) for s in source.values()}
    target, want, coder = targets_by_hand(total), [], Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for s in total:
        whole = int(target[s] // total[s]) if total[s] else 0
        room = int(np.floor(target[s] + 0.5)) - whole * total[s]
        for d in sorted((d for d in texts if source[d] == s), key=lambda d: (hashlib.md5(f"7:{d}".encode()).hexdigest(), d)):
            part = max(0, min(size[d], room))
            room -= size[d]
            ids = np.array([*coder.encode(texts[d], add_special_tokens=False).ids, 2], "<u4")
            cuts = [0, *range(len(ids) % 1024 or 1024, len(ids) + 1, 1024)]
            for _ in range(whole + int(part > 0 and 2 * part >= size[d])):
                want += [(d, i, a, b - a, zlib.crc32(ids[a:b])) for i, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]
    got = corpus_pipeline.run(spark, sf).collect()
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == sorted(want) and len(want) > 200
    assert_packed(got)


def test_pipeline_over_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
