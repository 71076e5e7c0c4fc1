"""Whitening, ranked search and SimHash groups, against brute force and on odd tables."""

import random
import re

import duckdb
import numpy as np
import pandas as pd
import pytest
import xxhash
from pyspark.sql import functions as F

from millrace.llm import bidiagonal, components, hamming, ranked, simhash, whitening

SF = "/root/testdata/sf0.001"


def triangle_of(x):
    r = np.linalg.qr(x, mode="r")
    return np.vstack((r, np.zeros((max(0, x.shape[1] - len(r)), x.shape[1]))))


def spaces():
    rng = np.random.default_rng(1)
    q, turn = np.linalg.qr(rng.standard_normal((400, 24)))[0], np.linalg.qr(rng.standard_normal((24, 24)))[0]
    gauss = rng.standard_normal((400, 24))
    return {
        "gauss": gauss, "falling": gauss * np.logspace(0, -5, 24), "rising": gauss * np.logspace(-5, 0, 24), "all equal": q, "two values": q * np.repeat([1, 3], 12), "two values, turned": q * np.repeat([1, 3], 12) @ turn,
        "nearly two values": q * (np.repeat([1, 3], 12) + 1e-9 * np.arange(24)) @ turn, "close": q * (1 + 1e-5 * np.arange(24)) @ turn, "rank 5": gauss[:, :5] @ turn[:5], "few rows": gauss[:7], "twice each": np.repeat(gauss[:, :12], 2, 1),
        "constant": np.hstack((gauss[:, :2], np.zeros((400, 3)))), "one": gauss[:, :1], "two": gauss[:, :2], "graded blocks": np.diag(np.abs(np.arange(-10, 11)) + 1.0) + np.diag(np.ones(20), 1),
    }


@pytest.mark.parametrize("name", spaces())
def test_singular_values_and_directions(name):
    x = spaces()[name]
    want = np.linalg.svd(x, compute_uv=False)
    rank = int((want > 1e-10 * want[0]).sum())
    directions, e, trace = whitening.directions_of(triangle_of(x), len(x), x.shape[1])
    assert len(e) >= rank
    assert np.allclose(np.sqrt(e[:rank] * len(x)), want[:rank], rtol=1e-8, atol=0)
    assert np.isclose(trace, (x**2).sum() / len(x))
    v = directions[:, :rank]
    assert np.abs(v.T @ v - np.eye(rank)).max() < 1e-9
    assert np.abs(x.T @ (x @ v) - v * e[:rank] * len(x)).max() < 1e-12 * want[0] ** 2


def test_bidiagonal_form():
    r = triangle_of(np.random.default_rng(2).standard_normal((50, 9)))
    a, b, v = bidiagonal.bidiagonalise(r)
    form = np.diag(a) + np.diag(b, 1)
    assert np.allclose(v @ form.T @ form @ v.T, r.T @ r)
    assert np.allclose(bidiagonal.squared_singular_values(a, b), np.linalg.svd(r, compute_uv=False) ** 2, rtol=1e-12)


def whitened_by_hand(vectors, k):
    x = np.floor(64 * np.array(vectors, float)).astype(np.int64) + 1000000
    n, s = len(x), x.sum(0)
    c = (n * x - s) / n
    e, v = np.linalg.eigh(c.T @ c / n)
    return ((n * x - s) ** 2).sum(1), c @ v[:, ::-1][:, :k] / np.sqrt(e[::-1][:k]), e[::-1][:k] / e.sum()


@pytest.mark.parametrize("fan_in", [2, 64])
def test_whitening(spark, fan_in, monkeypatch):
    monkeypatch.setattr(whitening, "FAN_IN", fan_in)
    df = spark.read.parquet(f"{SF}/embeddings.parquet").repartition(7)
    out, p = whitening.whiten(df).toPandas(), df.toPandas()
    deviation, want, explained = whitened_by_hand(p.embedding.tolist(), 32)
    got = out.pivot(index="vec_id", columns="component", values="whitened").loc[p.vec_id].to_numpy()
    assert np.abs(got * np.sign((got * want).sum(0)) - want).max() < 1e-8
    assert out.groupby("vec_id").deviation.first().loc[p.vec_id].tolist() == deviation.tolist()
    assert np.allclose(out.groupby("component").explained.first(), explained, rtol=1e-10)
    assert out.identity_error.max() < 1e-9 and set(out.n) == {len(p)} and len(out) == 32 * len(p)


def test_whitening_of_odd_rows(spark):
    rows = [(1, [1.0, 2.0]), (1, [1.0, 2.0]), (None, [0.0, 5.0]), (3, None), (4, [None, 1.0]), (5, [float("nan"), 1.0]), (6, [float("inf"), 1.0]), (7, []), (8, [1.0, 2.0, 3.0]), (9, [-3.0, 2.5])]
    odd = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({c: F.lit("x") for c in ("n", "id", "v", "s", "part")})
    got = whitening.whiten(odd).collect()
    assert sorted((str(r.vec_id), r.component) for r in got) == sorted((str(i), c) for i in (1, 1, None, 9) for c in (1, 2))
    deviation, _, _ = whitened_by_hand([rows[i][1] for i in (0, 1, 2, 9)], 2)
    assert {str(r.vec_id): r.deviation for r in got} == dict(zip(["1", "1", "None", "9"], deviation.tolist(), strict=True))
    assert whitening.whiten(odd.filter("vec_id = 1")).count() == 0  # nothing varies
    assert whitening.whiten(odd.limit(0)).count() == 0
    assert whitening.whiten(odd.filter("vec_id in (3, 4)")).count() == 0


def test_deviations_beyond_64_bits():
    c = whitening.Centred(1 << 20, np.array([5, 5]))
    assert c.deviation(np.array([[3, 4], [1 << 30, 7]])).to_pylist() == [((3 << 20) - 5) ** 2 + ((4 << 20) - 5) ** 2, None]


def ranked_by_sql(docs, items):
    c = duckdb.connect()
    c.register("documents", pd.DataFrame(docs, columns=["doc_id", "text"]).astype({"doc_id": "Int64"}))
    c.register("benchmark", pd.DataFrame(items, columns=["item_id", "text"]))
    return sorted(c.sql(ranked.OP12_SQL.replace("where score > 0", "where score > 0 and doc_id is not null")).fetchall())


@pytest.mark.parametrize(("segment", "terms", "width"), [(40, 1 << 19, 16), (1 << 15, 1 << 19, 1), (40, 16, 3)])
def test_ranked_search(spark, segment, terms, width, monkeypatch):
    monkeypatch.setattr(ranked, "SEGMENT_DOCS", segment)
    monkeypatch.setattr(ranked, "QUERY_TERMS", terms)
    monkeypatch.setattr(ranked, "WIDTH", width)
    rng = random.Random(5)
    words = ["a", "b", "c", "Éa", "ab9", "日本", *(f"w{i}" for i in range(30))]
    text = lambda n, sep: sep.join(rng.choice(words) for _ in range(n))
    docs = [(rng.randrange(200) if rng.random() < 0.95 else None, None if rng.random() < 0.05 else text(rng.choice([0, 1, 3, 10, 40]), rng.choice([" ", "-", "\x00", "! "]))) for _ in range(400)]
    docs += [(1000 + i, "a w1 w2 b") for i in range(50)] + [(2000, "w3 " * 5000), (2001, ""), (2001, "W4\x7fw5")]
    items = [(i, text(rng.choice([1, 2, 5, 20]), " ")) for i in range(20)] + [(31, None), (32, "zz"), (33, "a W1 w2 b"), (34, " .-")]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3).withColumns({c: F.lit("x") for c in ("score", "rank", "item_id", "terms", "item")})
    asked = spark.createDataFrame(items, "item_id long, text string").withColumns({c: F.lit("x") for c in ("doc_id", "terms", "item")})
    assert sorted(tuple(r) for r in ranked.rank_documents(df, asked).collect()) == ranked_by_sql(docs, items)


def test_ranked_search_of_nothing(spark):
    docs, items = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([(1, "a c")], "item_id long, text string")
    assert ranked.rank_documents(docs.limit(0), items).count() == 0
    assert ranked.rank_documents(docs, items.limit(0)).count() == 0
    assert [tuple(r) for r in ranked.rank_documents(docs, items).collect()] == ranked_by_sql([(1, "a b")], [(1, "a c")])


def test_intervals_far_from_the_best_are_never_split():
    """The best-first search looks at few documents if their scores differ."""
    n = 4096
    tf = np.random.default_rng(3).integers(1, 1000, n)
    get = lambda x, kind: np.asarray(x, kind).tobytes()
    row = {"ids": get(range(n), np.int64), "sizes": get(np.full(n, 1000), np.int64), "lists": get(np.zeros(n), np.int32), "places": get(range(n), np.int32), "tf": get(tf, np.int32)}
    s = ranked.SegmentSearch(row, n, 1000 * n)
    seen = []
    bounds = s._bounds
    s._bounds = lambda w, lo, hi: seen.append(len(lo)) or bounds(w, lo, hi)
    best = s.search(np.array([0]), np.array([7]), 10, [])
    order = sorted(range(n), key=lambda i: (-int(s.impact[i]), i))[:10]
    assert best == [(-7 * int(s.impact[i]), i) for i in order] and sum(seen) < 200


@pytest.mark.parametrize("n", [1, 2, 7, 64, 100])
def test_sparse_table(n):
    value = np.random.default_rng(n).integers(0, 9, n)
    t = ranked.SparseTable(value, n)
    for a in range(n):
        hi = np.arange(a + 1, n + 1)
        assert t.argmax(np.full(len(hi), a), hi).tolist() == [a + int(np.argmax(value[a:b])) for b in hi]


def fingerprint_by_hand(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]).encode(), 42) for i in range(max(1, len(w) - 2))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def components_by_hand(prints):
    """{print: smallest print reachable}."""
    parent = {p: p for p in prints}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    order = sorted(parent)
    for i, a in enumerate(order):
        for b in order[:i]:
            if ((a ^ b) & ((1 << 64) - 1)).bit_count() <= 2:
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {p: root(p) for p in order}


@pytest.mark.parametrize("chunk", [1, 3, 1 << 16])
def test_fingerprints_of_texts(chunk, monkeypatch):
    monkeypatch.setattr(simhash, "CHUNK", chunk)
    rng = random.Random(chunk)
    word = lambda: "".join(rng.choice("abÜ日X\x00") for _ in range(rng.randint(1, 9)))
    texts = [None, "", " \t\x0b", "One", "one two", "One two THREE", "a\x1fb \xa0 c\x85d e", *(rng.choice([" ", "\n\n", " \r\x0c"]).join(word() for _ in range(rng.randint(1, 60))) for _ in range(80))]
    for t in texts:
        assert simhash.fingerprint(t) == fingerprint_by_hand(t), repr(t)


def test_simhash_groups(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet").withColumns({c: F.lit("x") for c in ("fp", "least", "component_id", "node", "u", "v")})
    prints = {r.doc_id: fingerprint_by_hand(r.text) for r in df.collect()}
    of, least = components_by_hand(set(prints.values())), {}
    for i, p in prints.items():
        least[of[p]] = min(i, least.get(of[p], i))
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.simhash_groups(df).collect()}
    assert got == {i: (f"{p:016x}", least[of[p]]) for i, p in prints.items()}


def test_simhash_of_odd_rows(spark):
    rows = [(5, "x y z w"), (5, "x y z w"), (None, "x y z w"), (3, "X  y\nz w"), (8, None), (7, ""), (5, "q"), (None, "only here")]
    got = sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in simhash.simhash_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    want = ["3", "3", "3", "3", "7", "7", "5", "None"]
    assert got == sorted((str(i), f"{fingerprint_by_hand(t):016x}", c) for (i, t), c in zip(rows, want, strict=True))
    assert simhash.simhash_groups(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("most", [2, 64])
def test_links_in_short_and_long_lists(spark, most):
    rng = random.Random(3)
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    values = {0, (1 << 64) - 1, 1 << 63}
    for _ in range(3):
        start = rng.getrandbits(64)
        for _ in range(300):
            v = start
            for _ in range(rng.randint(0, 8)):
                v ^= 1 << rng.randrange(64)
            values.add(v)
    want = components_by_hand({signed(v) for v in values})
    links = simhash.linked_prints(spark.createDataFrame([(v,) for v in want], "fp long"), most)
    got = {r.node: r.component for r in components.connected_components(links).collect()}
    assert {v: got.get(v, v) for v in want} == want
    assert all(((r.u ^ r.v) & ((1 << 64) - 1)).bit_count() <= 2 for r in links.collect())


def test_segments_of_like_width():
    assert hamming.widths_of(64, 500) == [8] * 8 and hamming.widths_of(10, 20) == [4, 3, 3] and hamming.widths_of(3, 1000) == [3]
    for dims in (1, 40, 64, 1000):
        for n in (0, 1, 500, 2_000_000, 10**9):
            w = hamming.widths_of(dims, n)
            assert sum(w) == dims and max(w) - min(w) <= 1 and max(w) <= 30


def searched(spark, v, monkeypatch):
    """(rows of the result, {radius: probes, codes met} of the search)."""
    seen, reached = {}, hamming.SegmentIndex._reached

    def spy(self, probes, radius):
        out = reached(self, probes, radius)
        seen[radius] = (probes.count(), probes.join(self.dealt, ["seg", "value"]).count(), self.existing)
        return out

    monkeypatch.setattr(hamming.SegmentIndex, "_reached", spy)
    df = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)], "vec_id long, embedding array<float>")
    got = {tuple(r) for r in hamming.top_k(df).collect()}
    bits = np.asarray(v) >= 0
    want = set()
    for q in range(0, len(v), 20):
        near = sorted((int((bits[q] != bits[i]).sum()), i) for i in range(len(v)) if i != q)[:10]
        want |= {(q, n + 1, i, d) for n, (d, i) in enumerate(near)}
    assert got == want
    return seen


def test_codes_met_at_radius_0(spark, monkeypatch):
    seen = searched(spark, np.random.default_rng(4).normal(size=(500, 64)), monkeypatch)
    assert seen[0][1] / 25 <= 3 * 8  # each query meets about two codes in each of eight segments, itself among them


def test_an_outlier_probes_existing_values_only(spark, monkeypatch):
    v = np.ones((600, 64))
    for i, at in enumerate(np.random.default_rng(5).integers(0, 64, (600, 2))):
        v[i, at] = -1
    v[40] = -1
    seen = searched(spark, v, monkeypatch)
    assert max(seen) >= 6 and all(probes <= existing * 30 for probes, _, existing in seen.values()) and sum(p for r, (p, _, _) in seen.items() if r > 2) <= 2 * max(e for _, _, e in seen.values())
