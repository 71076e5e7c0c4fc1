"""Removal of repeated passages: each byte covered by a string of `length` bytes that also starts earlier in the corpus.

Earlier means a smaller doc_id, or the same one and an earlier start; matches never cross documents.

The method is a suffix array of the whole collection, built column by column (bwt.py). Its cost is the length of the collection
times the longest text, which whole texts of this size cannot meet; so it runs on the candidates, and candidates are cut short
by a rule that loses no match:

1. Of each window of `length` bytes, the anchor is the 32-byte string in it whose hash is smallest. Equal windows have equal
   anchors, at the same place within the window. Windows in a row with one anchor make a span. Each task writes the spans it
   saw first; repeats of the same span within the task are known to be repeats there and then, so no key has more rows than
   there are tasks times its different spans.
2. Spans meet by anchor, sorted, and pass by. Of equal spans all but the first are repeats. If an anchor has several different spans, the
   first of each is looked at more closely: these are the borders of repeats. Spans of frequent anchors (found in a share of the texts)
   meet by anchor and span, and all their firsts are looked at.
3. The bytes of those spans are fetched. The windows of a span that start near its anchor have 66 bytes in common, the others
   another 66; each of these halves goes where spans with the same common bytes meet. Of equal halves one is kept, and whole groups of the
   different ones, some at a time, build the transform and common prefixes of its different halves column by column, in files of its own temporary folder that
   each round reads and writes from start to end, a chunk at a time: windows with a common prefix of `length` form classes, and all but the first of a class are repeats.
4. Repeats are gathered by document and cut out of the whole text.

A null text counts as empty; a text shorter than `length` loses nothing. Rows with one id start at the same place: equal strings at
one start of them don't repeat each other, so rows that repeat an id and a text lose nothing by each other. A null id comes before all others. An empty table gives an
empty result; other columns are left alone. Spans, pieces and repeats are kept by id and hash of the text (`key`), so that rows that share an
id but not a text (all null ids do) each have their own; an id alone only says what is earlier. Memory: some tens of bytes for each byte of a block (1 MB), or of at most 8 MB of
one text. Spans and their hashes: 64 bits for the anchor and 64 for the span.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.bwt import window_classes
from millrace.llm.common import settle, table, text_column
from millrace.llm.textbytes import blocks, buffers, mix, prefix, range_hash

LENGTH, ANCHOR = 100, 32
_PLACE = np.uint64((1 << 24) - 1)
#: One text's segments; spans that a task holds before it writes; strings in one transform.
SEGMENT, HELD, STRINGS = 8 << 20, 1 << 20, 20_000
#: Anchors of about MANY spans, by one text in SHARE, are frequent ones; so many are listed at most.
MANY, SHARE, LISTED = 1 << 17, 64, 4096
_SPANS = "anchor long, span long, doc_id long, key long, place long"
NO_ID = -(1 << 63)


def _ranks(buf: np.ndarray) -> np.ndarray:
    """A number for each string of ANCHOR bytes, by which anchors are chosen: equal strings have equal ones, and that others may share
    one does no harm, as it picks a place and tells no strings apart."""
    out, size = buf.astype(np.uint64) + np.uint64(1), 1
    while size < ANCHOR:
        out = out[:-size] * np.uint64(0x9E3779B97F4A7C55) + out[size:]
        out ^= out >> np.uint64(29)
        size *= 2
    return mix(out)


def spans(buf: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(text, first window's start in it, number of windows, anchor's place after that start, hashes of anchor and span) of each
    span in a block."""
    n = len(buf) - length + 1
    if n <= 0:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.int64, np.uint64, np.uint64))
    gram = _ranks(buf)
    key = (gram & ~_PLACE) | (_PLACE - np.arange(len(gram), dtype=np.uint64))
    w = length - ANCHOR + 1
    square = np.concatenate((key, np.full(-len(key) % w, ~np.uint64(0)))).reshape(-1, w)
    ahead = np.minimum.accumulate(square[:, ::-1], axis=1)[:, ::-1].ravel()
    behind = np.minimum.accumulate(square, axis=1).ravel()
    anchor = (_PLACE - (np.minimum(ahead[:n], behind[w - 1 : w - 1 + n]) & _PLACE)).astype(np.int64)
    inside = np.arange(n) + length <= np.repeat(offsets[1:], np.diff(offsets))[:n]
    joined = inside[1:] & inside[:-1] & (anchor[1:] == anchor[:-1])
    first = np.flatnonzero(inside & ~np.concatenate(([False], joined)))
    after = np.flatnonzero(inside & ~np.concatenate((joined, [False]))) + 1
    text, sums = np.searchsorted(offsets, first, "right") - 1, prefix(buf)
    at = anchor[first]
    return text, first - offsets[text], after - first, at - first, range_hash(sums, at, at + ANCHOR), range_hash(sums, first, after + length - 1)


def _firsts(key: np.ndarray, start: np.ndarray, doc: np.ndarray, *group: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows in order of group (the last counts most, as in lexsort), doc, start and key, each once; which of them are firsts, and which
    begin a group. Firsts are those of the group's earliest doc and start, of all keys: none is earlier than another."""
    order = np.lexsort((key, start, doc, *group))
    change = lambda of: np.concatenate((np.ones(min(len(order), 1), bool), np.logical_or.reduce([k[order[1:]] != k[order[:-1]] for k in of])))
    order = order[change((key, start, doc, *group))]
    new = change(group)
    begin = order[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))] if len(order) else order
    return order, (doc[order] == doc[begin]) & (start[order] == start[begin]), new


#: `place` is start * 2^16 + number of windows * 2^8 + anchor's place, with HEAVY added where the anchor is a frequent one, or KNOWN instead of
#: anchor's place and mark in a span that is known to be a repeat.
_SPAN, KNOWN, HEAVY = ["anchor", "span", "doc_id", "key", "place"], 255, 128


def _task_spans(batches: Iterator[pa.RecordBatch], length: int, frequent: np.ndarray) -> Iterator[pa.RecordBatch]:
    held: list[tuple[np.ndarray, ...]] = []

    def flush() -> pa.RecordBatch:
        doc, key, start, n, lead, anchor, span = map(np.concatenate, zip(*held, strict=True))
        held.clear()
        lead = lead + HEAVY * np.isin(anchor.view(np.int64), frequent)
        order, first, _ = _firsts(key, start, doc, span, anchor)
        anchor = np.where(first, anchor[order], mix(doc[order].astype(np.uint64) + start[order].astype(np.uint64)))
        return pa.RecordBatch.from_arrays([pa.array(anchor.view(np.int64)), pa.array(span[order].view(np.int64)), pa.array(doc[order]), pa.array(key[order]), pa.array((start[order] << 16) | (n[order] << 8) | np.where(first, lead[order], KNOWN))], _SPAN)

    for batch in batches:
        ids, keys = batch.column("doc_id").fill_null(NO_ID).to_numpy(), batch.column("key").to_numpy()
        for lo, _, buf, offsets in blocks(batch):
            for at in range(0, max(1, len(buf) - length + 1), SEGMENT):  # more than one only of one long text
                end = offsets if len(buf) <= SEGMENT else np.array([0, min(len(buf), at + SEGMENT + length - 1) - at])
                text, start, n, lead, anchor, span = spans(buf[at : at + end[-1]], end, length)
                held.append((ids[lo + text], keys[lo + text], start + at, n, lead, anchor, span))
            if sum(len(x[0]) for x in held) >= HELD:
                yield flush()
    if held:
        yield flush()


def _meet(batches: Iterator[pa.RecordBatch], held: int) -> Iterator[pa.RecordBatch]:
    """From spans in order of _SPAN's columns: (doc_id, key, start, n, lead) of repeats (lead null) and of the firsts of each different
    span. They pass by; what waits are the firsts of an anchor's only span so far, until another span shows that they are wanted (or
    the anchor ends and they aren't). If more than `held` wait they are given out at once: the next step finds no other."""

    def out(rows: np.ndarray, repeat: bool) -> Iterator[pa.RecordBatch]:
        for a in range(0, rows.shape[1], 1 << 16):
            _, _, doc, key, place = rows[:, a : a + (1 << 16)]
            lead = pa.array((place & (HEAVY - 1)).astype(np.int16), mask=np.full(len(place), repeat))
            yield pa.RecordBatch.from_arrays([pa.array(doc), pa.array(key), pa.array(place >> 16), pa.array((place >> 8 & 255).astype(np.int16)), lead], ["doc_id", "key", "start", "n", "lead"])

    last, begin, many, waiting = None, (0, 0), False, []
    for batch in batches:
        if not len(batch):
            continue
        rows = np.stack([batch.column(c).to_numpy() for c in _SPAN])
        last = rows[:, :1] ^ np.array([[-1], [0], [0], [0], [0]]) if last is None else last  # another anchor than any row's before it
        rows = np.concatenate((last, rows), axis=1)
        last, differ = rows[:, -1:], rows[:, 1:] != rows[:, :-1]
        rows, again, new_anchor, new_span = rows[:, 1:], ~differ.any(0), differ[0], differ[0] | differ[1]
        at = np.maximum.accumulate(np.where(new_span, np.arange(len(new_span)), -1))
        doc0, start0 = (np.where(at >= 0, x[at], y) for x, y in zip((rows[2], rows[4] >> 16), begin, strict=True))
        known = rows[4] & 255 == KNOWN
        first, begin = (rows[2] == doc0) & (rows[4] >> 16 == start0) & ~known, (doc0[-1], start0[-1])
        run = np.cumsum(new_anchor)  # 0: the anchor of the batch before
        of_many = np.bincount(run, new_span & ~new_anchor | (rows[4] & HEAVY > 0) & ~known, run[-1] + 1) > 0
        of_many[0] |= many
        if of_many[0]:
            for x in waiting:
                yield from out(x, False)
        if of_many[0] or run[-1]:
            waiting = []
        many = bool(of_many[-1])
        yield from out(rows[:, ~first & ~again], True)
        yield from out(rows[:, first & ~again & of_many[run]], False)
        if not many:
            waiting.append(rows[:, first & ~again & (run == run[-1])])
            if sum(x.shape[1] for x in waiting) > held:
                for x in waiting:
                    yield from out(x, False)
                waiting, many = [], True


def _fetch(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = buffers(batch.column("text"))
        ids, keys = batch.column("doc_id"), batch.column("key")
        near, far = (length - ANCHOR) // 2, length - ANCHOR  # windows start up to so much before their anchor
        for i, wanted in enumerate(batch.column("wanted").to_pylist()):
            text, rows = data[offsets[i] : offsets[i + 1]].tobytes(), []
            for w in wanted:
                a, b, p = w["start"], w["start"] + w["n"], w["start"] + w["lead"]
                for first, after, low, high in ((max(a, p - near), b, 0, near), (a, min(b, p - near), near + 1, far)):
                    if first < after:
                        common = text[p - low : p - high + length]
                        rows.append((xxhash.xxh3_64_intdigest(common, low) - (1 << 63), first, after - first, text[first : after + length - 1]))
            h, s, n, p = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(h, pa.int64()), *(pa.array([x[i].as_py()] * len(h), pa.int64()) for x in (ids, keys)), pa.array(s, pa.int64()), pa.array(n, pa.int16()), pa.array(p, pa.binary())], ["half", "doc_id", "key", "start", "n", "piece"])


def _different(whole: pa.Table, alone: bool) -> tuple[pa.RecordBatch, pa.Table]:
    """Runs of the halves that an earlier one of their group equals, and the others, in order of group; of groups with one only if alone."""
    half, doc, key, start, n = (whole.column(c).to_numpy() for c in ("half", "doc_id", "key", "start", "n"))
    content = np.fromiter((xxhash.xxh3_64_intdigest(p.as_buffer()) for p in whole.column("piece")), np.uint64, len(whole))
    order, is_first, _ = _firsts(key, start, doc, content, half)
    equal, first = order[~is_first], order[is_first]
    if not alone:
        same = half[first[1:]] == half[first[:-1]]
        first = first[np.concatenate(([False], same)) | np.concatenate((same, [False]))] if len(first) > 1 else first[:0]
    return pa.RecordBatch.from_arrays([pa.array(x[equal]) for x in (doc, key, start, n)], _RUN), whole.take(pa.array(first))


def _transform(batches: Iterator[pa.RecordBatch], length: int, strings: int) -> Iterator[pa.RecordBatch]:
    """From halves sorted by group: the runs of windows that an earlier window equals. Groups pass by, and about `strings` halves of whole
    groups of different ones make a transform; of a group that is larger, what waits are its different halves."""
    held, least, ready = None, strings, []
    for batch in batches:
        more = pa.Table.from_batches([batch])
        held = pa.concat_tables([held, more]) if held else more
        if len(held) < least:
            continue
        half = held.column("half").to_numpy()
        cut = int(np.searchsorted(half, half[-1]))  # where the last group begins
        equal, whole = _different(held.slice(0, cut).combine_chunks(), False)
        yield equal
        ready.append(whole)
        if sum(map(len, ready)) >= strings:
            yield _late_windows(ready, length)
            ready = []
        equal, held = _different(held.slice(cut).combine_chunks(), True)
        yield equal
        least = max(strings, 2 * len(held))
    if held:
        equal, whole = _different(held.combine_chunks(), False)
        yield equal
        ready.append(whole)
    if any(map(len, ready)):
        yield _late_windows(ready, length)


_RUN = ["doc_id", "key", "start", "n"]


def _late_windows(groups: list[pa.Table], length: int) -> pa.RecordBatch:
    """Runs (doc_id, key, start, n) of windows of the halves that an earlier window equals."""
    whole = pa.concat_tables(groups)
    doc, key, start, n = (whole.column(c).to_numpy() for c in _RUN)
    n, pieces = n.astype(np.int64), whole.column("piece").to_pylist()
    bounds = np.concatenate(([0], np.cumsum([len(p) for p in pieces])))
    label = window_classes(np.frombuffer(b"".join(pieces), np.uint8), bounds, n, length)
    piece = np.repeat(np.arange(len(n)), n)
    place = start[piece] + np.arange(len(piece)) - np.repeat(np.cumsum(n) - n, n)
    order, first, _ = _firsts(piece, place, doc[piece], label)  # no window twice: all stay
    late = np.zeros(len(piece), bool)
    late[order] = ~first
    edge = piece[1:] != piece[:-1]
    first = np.flatnonzero(late & ~np.concatenate(([False], late[:-1] & ~edge)))
    last = np.flatnonzero(late & ~np.concatenate((late[1:] & ~edge, [False])))
    return pa.RecordBatch.from_arrays([pa.array(doc[piece[first]]), pa.array(key[piece[first]]), pa.array(place[first]), pa.array((last - first + 1).astype(np.int16))], _RUN)


def _cut(batches: Iterator[pa.RecordBatch], length: int, texts: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = buffers(text_column(batch))
        rows = []
        for i, repeats in enumerate(batch.column("repeats").to_pylist()):
            text = data[offsets[i] : offsets[i + 1]]
            gone = np.zeros(len(text) + 1, np.int32)
            for r in repeats or ():
                gone[r["start"]] += 1
                gone[min(len(text), r["start"] + r["n"] + length - 1)] -= 1
            gone = np.cumsum(gone[:-1]) > 0
            if texts:  # a character goes with its first byte, so that what stays is UTF-8
                lead = np.flatnonzero((text & 0xC0) != 0x80)
                whole = np.logical_and.reduceat(gone, lead) if len(lead) else gone
                rows.append(text[~np.repeat(whole, np.diff(np.append(lead, len(text))))].tobytes().decode())
            else:
                kept = text[~gone].tobytes()
                edges = np.count_nonzero(gone[1:] & ~gone[:-1]) + int(bool(len(gone) and gone[0]))
                rows.append((len(text), len(text) - len(kept), edges, hashlib.sha256(kept).hexdigest()))
        if texts:
            yield pa.RecordBatch.from_arrays([batch.column("_doc"), pa.array(rows, pa.string())], ["_doc", "_kept"])
        else:
            cols = zip(*rows, strict=True) if rows else ((), (), (), ())
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(cols, kinds, strict=True))], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def _keys() -> tuple[Column, Column]:
    """Of each row, its id and the hash of its text: what its spans and repeats are kept by."""
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)), F.xxhash64(F.coalesce("text", F.lit("")))


def _frequent(docs: DataFrame, length: int) -> np.ndarray:
    """The anchors, LISTED at most, that have the most spans in a share of the texts chosen by hash, if those are many. It changes only
    where spans meet: a frequent anchor's go by their own hash, each to a task of its own."""
    some = docs.filter(F.pmod(F.xxhash64("doc_id", "key"), F.lit(SHARE)) == 0)
    spans = some.mapInArrow(partial(_task_spans, length=length, frequent=np.zeros(0, np.int64)), _SPANS).filter(F.col("place").bitwiseAND(255) != KNOWN)
    most = spans.groupBy("anchor").count().filter(F.col("count") * SHARE >= MANY).orderBy(F.desc("count"), "anchor").limit(LISTED)
    return np.sort(np.array([r.anchor for r in most.collect()], np.int64))


def repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(doc_id, key, repeats): of each text with any, the runs of starts (start, n) whose strings also start earlier."""
    spark = docs.sparkSession
    of, key = _keys()
    docs = docs.select(of.alias("doc_id"), key.alias("key"), F.coalesce("text", F.lit("")).alias("text"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), size >> 26)  # of 64 MB of text, two million spans
    met = docs.mapInArrow(partial(_task_spans, length=length, frequent=_frequent(docs, length)), _SPANS)
    apart = F.when(F.col("place").bitwiseAND(HEAVY) > 0, F.xxhash64("anchor", "span")).otherwise(F.col("anchor"))
    met = met.repartition(parts, apart).sortWithinPartitions("anchor", "span", "doc_id", "place", "key")
    met = settle(met.mapInArrow(partial(_meet, held=HELD), "doc_id long, key long, start long, n short, lead short"), "spans")
    wanted = met.filter("lead is not null").groupBy("doc_id", "key").agg(F.collect_list(F.struct("start", "n", "lead")).alias("wanted"))
    pieces = docs.join(wanted, ["doc_id", "key"]).mapInArrow(partial(_fetch, length=length), "half long, doc_id long, key long, start long, n short, piece binary")
    near = pieces.repartition(parts, "half").sortWithinPartitions("half").mapInArrow(partial(_transform, length=length, strings=STRINGS), "doc_id long, key long, start long, n short")
    every = met.filter("lead is null").select("doc_id", "key", "start", "n").union(near)
    return every.groupBy("doc_id", "key").agg(F.collect_list(F.struct("start", "n")).alias("repeats"))


def remove_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    found = repeats(docs, length).withColumnsRenamed({"doc_id": "_of", "key": "_of_key"})
    of, key = _keys()
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), of.alias("_id"), key.alias("_key"))
    rows = rows.join(found, (F.col("_id") == F.col("_of")) & (F.col("_key") == F.col("_of_key")), "left")
    kind = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    return rows.select("doc_id", "text", "repeats").mapInArrow(partial(_cut, length=length, texts=False), kind)


def without_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """The documents with all their columns, and texts without what repeats; a character that is covered in part stays."""
    found = repeats(docs, length).withColumnsRenamed({"doc_id": "_of", "key": "_of_key"})
    of, key = _keys()
    rows = docs.select(F.struct("*").alias("_doc"), of.alias("_id"), key.alias("_key"))
    rows = rows.join(found, (F.col("_id") == F.col("_of")) & (F.col("_key") == F.col("_of_key")), "left").select("_doc", F.col("repeats").alias("repeats"))
    schema = rows.select("_doc", F.lit("").alias("_kept")).schema
    out = rows.mapInArrow(partial(_cut, length=length, texts=True), schema)
    return out.select(*(F.when(F.col("_doc.text").isNotNull(), F.col("_kept")).alias(c) if c == "text" else F.col(f"_doc.`{c}`") for c in docs.columns))


def op3_suffix_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))


OP3_SQL = """
with docs as (select doc_id, encode(coalesce(text, '')) as t from documents),
starts as (select doc_id, t[p:p + 99] as string, p from (select doc_id, t, unnest(range(1, octet_length(t) - 98)) as p from docs)),
late as (select doc_id, p from starts qualify row_number() over (partition by string order by doc_id, p) > 1),
edges as (select doc_id, p, cast(coalesce(p - lag(p) over (partition by doc_id order by p) > 100, true) as int) as edge from late),
runs as (select doc_id, min(p) as a, max(p) + 99 as b from (select *, sum(edge) over (partition by doc_id order by p) as run from edges) group by doc_id, run),
gaps as (
  select r.doc_id, a, hex(t[coalesce(lag(b) over w, 0) + 1:a - 1]) as kept, b - a + 1 as n, case when lead(b) over w is null then hex(t[b + 1:octet_length(t)]) else '' end as tail
  from runs r join docs using (doc_id) window w as (partition by r.doc_id order by a)),
cut as (select doc_id, cast(sum(n) as bigint) as n, count(*) as spans, unhex(string_agg(kept || tail, '' order by a)) as kept from gaps group by doc_id)
select doc_id, octet_length(t) as n_bytes, coalesce(n, 0) as n_removed, coalesce(spans, 0) as n_spans, sha256(coalesce(kept, t)) as kept_sha256 from docs left join cut using (doc_id)
"""
