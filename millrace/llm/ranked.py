"""Ranked lexical search with range-maximum sparse tables.

Terms are runs of ASCII letters and digits and of all other characters, A-Z lowered; a document's score for an item sums weight(term) *
impact(term, document) over the item's terms, repeats included, in whole numbers (see OP12_SQL for the formula).

1. Index: tasks cut the documents they read into segments, bounded in documents and postings. A segment has its documents in order of
   id, their numbers of terms, and for each term of the items a posting list (places of documents, occurrences). Other terms can't
   score, and are only counted. Segments are a table in the shared folder.
2. Statistics over all segments: documents, terms, and each term's document frequency.
3. Search: in each segment the impacts of the posting lists, one list after another, get a sparse table: for each power of two the place of
   the largest impact in the run of so many postings, so a list's maximum over any interval of documents is the larger of two entries. An
   item's search begins with the interval of all documents. The sum of its terms' maxima bounds every score in an interval. The
   interval with the highest bound is taken next, the document of its largest weighted impact is scored, and the two intervals beside that
   document get bounds of their own. When the best bound can't enter the best ten, nothing is left to find. A task goes through its
   segments with the best ten of each item so far, so later segments start with a bound to beat. Some intervals are split at once
   (WIDTH), which only looks at more of them.
4. The tasks' best ten of each item are ranked, first within shares by document, then all.

The items are a stated query set. A pass broadcasts at most about QUERY_TERMS of their terms; if there are more, items are dealt by hash
into so many passes. Terms are compared by 62-bit hashes modulo a prime (textbytes.py).

A null text has no terms. A row without an id is counted in the statistics and not found. Repeated rows are documents, each with a rank.
An item without terms, or whose terms no document holds (or all hold: weight 0), gives no row. Items that repeat an id and text are one; with
other texts they are ranked apart. Empty tables give an empty result. Other columns are left alone.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.llm.common import discard, settle, table
from millrace.llm.textbytes import NO_TERM, blocks, lower_ascii, prefix, range_hash, words

K = 10
#: Distinct terms of items in one pass.
QUERY_TERMS = 1 << 19
#: A segment ends with the block of texts in which it passes one of these.
SEGMENT_DOCS, SEGMENT_POSTINGS = 1 << 15, 1 << 20
#: Intervals that are split at once.
WIDTH = 16
SHARES = 64


def _hashed(batch: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, hashes of all terms, first term of each row and one more)."""
    for lo, hi, buf, offsets in blocks(batch, "text"):
        start, end, first = words(buf, offsets, NO_TERM)
        yield lo, hi, range_hash(prefix(lower_ascii(buf)), start, end).view(np.int64), first


def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi, terms, first in _hashed(batch):
            each = [np.unique(terms[a:b], return_counts=True) for a, b in zip(first[:-1], first[1:], strict=True)]
            part = batch.slice(lo, hi - lo)
            yield pa.RecordBatch.from_arrays([part.column("item_id"), part.column("item"), pa.array([t for t, _ in each], pa.list_(pa.int64())), pa.array([c for _, c in each], pa.list_(pa.int64()))], ["item_id", "item", "terms", "times"])


class _Segment:
    """What a task has gathered for its next segment."""

    def __init__(self):
        self.ids, self.sizes, self.doc, self.term, self.tf, self.docs, self.terms, self.at, self.postings = [], [], [], [], [], 0, 0, 0, 0

    def add(self, ids: pa.Array, first: np.ndarray, found: np.ndarray, known: np.ndarray, vocabulary: int) -> None:
        """found: the vocabulary's place of each term, where known."""
        size = np.diff(first)
        self.docs, self.terms = self.docs + int((size > 0).sum()), self.terms + int(size.sum())
        doc = np.repeat(np.arange(len(size)), size)[known]
        key, tf = np.unique(doc * vocabulary + found[known], return_counts=True)
        doc, term = key // vocabulary, key % vocabulary
        used = np.unique(doc)
        self.ids.append(ids.take(pa.array(used)))
        self.sizes.append(size[used])
        self.doc.append(np.searchsorted(used, doc) + self.at)
        self.term.append(term)
        self.tf.append(tf)
        self.at, self.postings = self.at + len(used), self.postings + len(key)

    def row(self) -> dict:
        ids = pa.chunked_array(self.ids, pa.int64()) if self.ids else pa.chunked_array([], pa.int64())
        size, doc, term, tf = (np.concatenate(x).astype(np.int64) if x else np.empty(0, np.int64) for x in (self.sizes, self.doc, self.term, self.tf))
        df_terms, df = np.unique(term, return_counts=True)
        valid = ~np.asarray(ids.is_null()) if len(ids) else np.empty(0, bool)
        number = np.asarray(ids.fill_null(0)).astype(np.int64)
        order = np.argsort(np.where(valid, number, np.iinfo(np.int64).max), kind="stable")[: int(valid.sum())]
        place = np.full(len(ids), -1)
        place[order] = np.arange(len(order))
        keep = valid[doc]
        term, doc, tf = term[keep], place[doc[keep]], tf[keep]
        by = np.lexsort((doc, term))
        arrays = {"ids": number[order], "sizes": size[order], "lists": term[by].astype(np.int32), "places": doc[by].astype(np.int32), "tf": tf[by].astype(np.int32)}
        return {k: v.tobytes() for k, v in arrays.items()} | {"docs": self.docs, "terms": self.terms, "df_terms": df_terms.tolist(), "df": df.tolist()}


SEGMENT = "ids binary, sizes binary, lists binary, places binary, tf binary, docs long, terms long, df_terms array<int>, df array<long>"
_ARROW = pa.schema([*((c, pa.binary()) for c in ("ids", "sizes", "lists", "places", "tf")), ("docs", pa.int64()), ("terms", pa.int64()), ("df_terms", pa.list_(pa.int32())), ("df", pa.list_(pa.int64()))])


def index_segments(docs: DataFrame, vocabulary: Broadcast) -> DataFrame:
    """A row for each segment. vocabulary: sorted hashes of the terms to index."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, now = vocabulary.value, _Segment()
        for batch in batches:
            for lo, hi, terms, first in _hashed(batch):
                at = np.searchsorted(known, terms)
                at[at == len(known)] = 0
                now.add(batch.column("doc_id").slice(lo, hi - lo), first, at, known[at] == terms if len(known) else np.zeros(len(terms), bool), max(1, len(known)))
                if now.at >= SEGMENT_DOCS or now.postings >= SEGMENT_POSTINGS:
                    yield pa.RecordBatch.from_pylist([now.row()], _ARROW)
                    now = _Segment()
        if now.docs:
            yield pa.RecordBatch.from_pylist([now.row()], _ARROW)

    return docs.mapInArrow(cut, SEGMENT)


class SparseTable:
    """Places of maxima: row p has, at i, the leftmost place of the largest of value[i:i + 2^p]."""

    def __init__(self, value: np.ndarray, longest: int):
        self.value, self.rows, step = value, [np.arange(len(value), dtype=np.int32)], 1
        while 2 * step <= longest:
            left, right = self.rows[-1][:-step], self.rows[-1][step:]
            self.rows.append(np.where(value[right] > value[left], right, left))
            step *= 2
        self.log = np.concatenate(([0], np.log2(np.arange(1, longest + 1)).astype(np.int64))) if longest else np.zeros(1, np.int64)
        width = len(value)
        self.flat = np.concatenate([np.pad(r, (0, width - len(r))) for r in self.rows]) if width else np.empty(0, np.int32)

    def argmax(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """The place of the largest value in each [lo, hi), none of which is empty."""
        p = self.log[hi - lo]
        row = p * len(self.value)
        left, right = self.flat[row + lo], self.flat[row + hi - (1 << p)]
        return np.where(self.value[right] > self.value[left], right, left)


class SegmentSearch:
    """One segment, with its impacts and their sparse table."""

    def __init__(self, row: dict, documents: int, terms: int):
        get = lambda c, kind: np.frombuffer(row[c], kind)
        self.ids, sizes, lists, places, tf = get("ids", np.int64), get("sizes", np.int64), get("lists", np.int32), get("places", np.int32), get("tf", np.int32).astype(np.int64)
        n = int(sizes.max(initial=0))
        sizes = sizes if 75 * n * documents < 1 << 62 else sizes.astype(object)  # Python's numbers where 64 bits don't hold the product
        m = (25 + 75 * sizes * documents // max(1, terms)).astype(np.int64)
        self.impact = 1_000_000_000 * tf // (1000 * tf + 8 * m[places])
        self.places = places
        self.lists, self.begin, count = np.unique(lists, return_index=True, return_counts=True)
        self.end = self.begin + count
        self.key = np.repeat(np.arange(len(count)), count) * (len(self.ids) + 1) + places  # sorted: list, then place
        self.table = SparseTable(self.impact, int(count.max(initial=0)))

    def _bounds(self, weight: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For rows of intervals and columns of terms, each with its postings [lo, hi): the sums of maxima, and the place to split at."""
        full = hi > lo
        at = np.where(full, self.table.argmax(np.where(full, lo, 0), np.where(full, hi, 1)), 0)
        most = np.where(full, weight * self.impact[at], 0)
        best = most.argmax(1)
        return most.sum(1), self.places[at[np.arange(len(at)), best]]

    def search(self, terms: np.ndarray, weight: np.ndarray, k: int, top: list) -> list:
        """The k best of `top` (in order) and this segment's documents: (-score, id). terms: sorted places in the vocabulary."""
        at = np.searchsorted(self.lists, terms)
        here = (at < len(self.lists)) & (self.lists[np.minimum(at, len(self.lists) - 1)] == terms) if len(self.lists) else np.zeros(len(terms), bool)
        at, weight = at[here], weight[here]
        if not len(at):
            return top
        base = at * (len(self.ids) + 1)
        lo, hi = self.begin[at], self.end[at]
        bound, split = self._bounds(weight, lo[None], hi[None])
        heap = [(-int(bound[0]), int(self.ids[0]), 0, len(self.ids), int(split[0]), lo, hi)]
        order = lambda x: (x[0], x[1])
        while heap:
            taken = []
            while heap and len(taken) < WIDTH and heap[0][0] < 0 and (len(top) < k or order(heap[0]) < top[-1]):
                taken.append(heapq.heappop(heap))
            if not taken:
                break
            doc = np.array([x[4] for x in taken])
            lo, hi = np.array([x[5] for x in taken]), np.array([x[6] for x in taken])
            mid = np.searchsorted(self.key, base + doc[:, None])
            inside = np.minimum(mid, len(self.key) - 1)
            met = (mid < hi) & (self.places[inside] == doc[:, None])
            score = np.where(met, weight * self.impact[inside], 0).sum(1)
            top = sorted([*top, *((-int(s), int(self.ids[d])) for s, d in zip(score, doc, strict=True) if s > 0)])[:k]
            mid = np.clip(mid, lo, hi)
            lo2, hi2 = np.vstack((lo, mid + met)), np.vstack((mid, hi))
            bound, split = self._bounds(weight, lo2, hi2)
            ends = [(x[2], x[4]) for x in taken] + [(x[4] + 1, x[3]) for x in taken]
            for i, (a, b) in enumerate(ends):
                if b > a and bound[i] > 0 and (len(top) < k or (-int(bound[i]), int(self.ids[a])) < top[-1]):
                    heapq.heappush(heap, (-int(bound[i]), int(self.ids[a]), a, b, int(split[i]), lo2[i], hi2[i]))
        return top


def _search(segments: DataFrame, items: Broadcast, weights: Broadcast, documents: int, terms: int, k: int) -> DataFrame:
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight, top = weights.value, {}
        for batch in batches:
            for i in range(len(batch)):
                segment = SegmentSearch(batch.slice(i, 1).to_pylist()[0], documents, terms)
                for q, (_, _, of, times) in enumerate(items.value):
                    w = weight[of] * times
                    top[q] = segment.search(of[w > 0], w[w > 0], k, top.get(q, []))
        found = [(items.value[q][0], items.value[q][1], doc, -score) for q, best in top.items() for score, doc in best]
        columns = list(zip(*found, strict=True)) if found else [[], [], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["item_id", "item", "doc_id", "score"])

    return segments.select("ids", "sizes", "lists", "places", "tf").mapInArrow(search, "item_id long, item long, doc_id long, score long")


def _one_pass(docs: DataFrame, items: DataFrame, k: int) -> DataFrame:
    context = docs.sparkSession.sparkContext
    rows = items.collect()  # QUERY_TERMS terms, or one item's
    known = np.unique(np.concatenate([np.array(r["terms"], np.int64) for r in rows])) if rows else np.empty(0, np.int64)
    vocabulary = context.broadcast(known)
    segments = settle(index_segments(docs, vocabulary), "segments")
    documents, terms = (int(x or 0) for x in segments.agg(F.sum("docs"), F.sum("terms")).first())
    df = segments.select(F.explode(F.arrays_zip("df_terms", "df")).alias("z")).groupBy("z.df_terms").agg(F.sum("z.df").alias("df")).collect()  # the vocabulary
    weight = np.zeros(len(known), np.int64)
    for r in df:
        weight[r["df_terms"]] = math.floor(1000 * math.log((2 * documents + 2) / (2 * r["df"] + 1)))
    queries = [(r["item_id"], r["item"], np.searchsorted(known, np.array(r["terms"], np.int64)), np.array(r["times"], np.int64)) for r in rows]
    found = settle(_search(segments, context.broadcast(queries), context.broadcast(weight), documents, terms, k), "found")
    discard(segments)
    return found


def rank_documents(docs: DataFrame, items: DataFrame, k: int = K) -> DataFrame:
    """item_id, rank, doc_id, score."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    items = items.select(F.col("item_id").cast("long").alias("item_id"), "text").distinct().withColumn("item", F.xxhash64("item_id", "text"))
    items = settle(items.mapInArrow(_item_terms, "item_id long, item long, terms array<long>, times array<long>").filter(F.size("terms") > 0), "items")
    passes = max(1, -(-int(items.agg(F.sum(F.size("terms"))).first()[0] or 0) // QUERY_TERMS))
    found = [_one_pass(docs, items.filter(F.pmod("item", F.lit(passes)) == p), k) for p in range(passes)]
    best = lambda *by: F.row_number().over(Window.partitionBy("item_id", "item", *by).orderBy(F.desc("score"), "doc_id"))
    share = F.pmod(F.xxhash64("doc_id"), F.lit(SHARES))
    out = reduce(DataFrame.unionByName, found).withColumn("share", share).withColumn("rank", best("share")).filter(F.col("rank") <= k)
    return out.withColumn("rank", best()).filter(F.col("rank") <= k).select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def op12_rank_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_TERMS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

OP12_SQL = f"""
with texts as (select row_number() over () as r, doc_id, {_TERMS} as w from documents),
sized as (select r, doc_id, cast(len(w) as bigint) as n, w from texts where len(w) > 0),
total as (select count(*) as docs, cast(sum(n) as bigint) as terms from sized),
asked as (select item_id, unnest({_TERMS}) as term from benchmark),
tf as (select r, doc_id, n, term, count(*) as tf from (select r, doc_id, n, unnest(w) as term from sized) where term in (select term from asked) group by all),
weights as (select term, cast(floor(1000 * ln((2 * docs + 2) / (2 * df + 1))) as bigint) as weight from (select term, count(*) as df from tf group by term), total),
scores as (
  select item_id, r, doc_id, cast(sum(weight * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + ((75 * n * docs) // terms))))) as bigint) as score
  from asked join weights using (term) join tf using (term), total group by all)
select item_id, cast(row_number() over (partition by item_id order by score desc, doc_id) as integer) as rank, doc_id, score
from scores where score > 0 qualify rank <= 10
"""
