"""Near-duplicate documents by SimHash.

Words are runs of anything but ASCII white space, A-Z lowered. Each shingle of some words in a row (repeats included; fewer words: all of
them as one) is hashed to 64 bits; a bit of the fingerprint is 1 if more than half of the shingles' hashes have it. A document without
words has the fingerprint zero, and is linked like any other. Fingerprints that differ in at most two bits are linked.

Two such fingerprints of eight bytes have at least six of them, place by place, in common. So the search is an inverted index of
positional bytes with count filtering: pairs are tallied by the bytes that they share, those with six or more are kept, and verified by
all their bits. The posting list of one positional byte holds 1/256 of all fingerprints, and tallying over such lists would be quadratic.
So the lists here are intersections: the eight places are cut into four pairs, and as at most two of the pairs hold a difference, two
others are equal in both: the six lists of two equal pairs, by 32 bits each, meet every pair that reaches six. A pair is tallied in the
first list that it meets in.

A list of more than LIST different fingerprints (documents made from one template, say) would still be quadratic. Its members differ in
the other four bytes only, so two of them are linked if and only if some value is within one bit of both. So each goes to itself and
the 32 values with one of those bits flipped, and all that meet there are linked through the smallest: 33 rows for a member, no pairs.

Equal fingerprints are one node, whatever the number of documents. Components come from alternating large-star and small-star rounds.

A null text has no words. A row without an id has its fingerprint and the component that the fingerprint falls into (null if nothing there
has an id). Repeated rows share theirs; rows that repeat an id with other texts are nodes by their texts and not linked by the id. An
empty table gives an empty result; other columns are left alone. Memory: some ten bytes for each byte of the longest text.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial, reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from millrace.llm.common import discard, settle, table
from millrace.llm.components import connected_components

SHINGLE, BITS, SEED = 3, 2, 42
#: Words that are worked on at once.
CHUNK = 1 << 16
#: Different fingerprints of a posting list that are compared with each other.
LIST = 64
#: Pairs of places of a fingerprint's bytes, and the lists of two of them.
PLACES = [(0, 1), (2, 3), (4, 5), (6, 7)]
LISTS = list(combinations(range(len(PLACES)), 2))
LEAST = 8 - BITS


def _chunks(text: str, k: int) -> Iterator[list[bytes]]:
    """The words, about CHUNK at a time, each chunk but the first beginning with the k - 1 last words before it, so that chunks have the
    shingles of the whole; at least one chunk, which has fewer than k words if the text has."""
    data, at, words, first = text.encode("utf-8", "surrogatepass").lower(), 0, [], True  # bytes know ASCII's letters and white space only
    while at < len(data):
        end = at + 8 * CHUNK
        while end < len(data) and data[end] not in b" \t\n\r\x0b\x0c":
            end += 1
        words += data[at:end].split()
        at = end
        if len(words) >= k:
            yield words
            words, first = words[len(words) - k + 1 :], False
    if first:
        yield words


def hash_bits(text: str, k: int = SHINGLE) -> tuple[np.ndarray, int]:
    """For each bit, lowest first, how many shingles' hashes have it; and the number of shingles."""
    counts, n = np.zeros(64, np.int64), 0
    for words in filter(None, _chunks(text, k)):
        joined = b" ".join(words)
        end = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        start = np.concatenate(([0], end[:-1] + 1))
        size = min(k, len(words))
        start, end = start[: len(words) - size + 1].tolist(), end[size - 1 :].tolist()
        h = np.fromiter((xxh64_intdigest(joined[a:b], SEED) for a, b in zip(start, end, strict=True)), "<u8", len(start))
        for at in range(0, len(h), CHUNK):
            bits = np.unpackbits(h[at : at + CHUNK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            counts += bits.sum(0, dtype=np.int64)
        n += len(h)
    return counts, n


def fingerprint(text: str | None, k: int = SHINGLE) -> int:
    counts, n = hash_bits(text or "", k)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0]) if n else 0


def _fingerprints(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        text = batch.column("text")
        prints = np.fromiter((fingerprint(t.as_py(), k) for t in text), np.uint64, len(text))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(prints.view(np.int64))], ["doc_id", "fp"])


def _byte(fp: Column, place: int) -> Column:
    """Place 0 is the highest byte."""
    return F.shiftrightunsigned(fp, 56 - 8 * place).bitwiseAND(F.lit(255))


def _mask(pairs: tuple[int, ...]) -> int:
    """The bits of some pairs of places, as a signed number."""
    mask = sum(255 << (56 - 8 * place) for p in pairs for place in PLACES[p])
    return mask - (1 << 64) if mask >> 63 else mask


def _postings(prints: DataFrame) -> DataFrame:
    """(list, key, fp): the fingerprint's entry in each list of two equal pairs of bytes."""
    entries = [F.struct(F.lit(i).alias("list"), F.col("fp").bitwiseAND(F.lit(_mask(both))).alias("key")) for i, both in enumerate(LISTS)]
    return prints.select("fp", F.inline(F.array(*entries)))


def shared_bytes(a: Column, b: Column) -> Column:
    """The tally of a pair: places whose bytes are equal."""
    return reduce(Column.__add__, [(_byte(a.bitwiseXOR(b), p) == 0).cast("int") for p in range(8)])


def _is_first(a: Column, b: Column, found: Column) -> Column:
    """Whether no earlier list holds both."""
    earlier = [(a.bitwiseXOR(b).bitwiseAND(F.lit(_mask(both))) == 0) & (found > i) for i, both in enumerate(LISTS)]
    return ~reduce(Column.__or__, earlier)


def _pairs(short: DataFrame) -> DataFrame:
    """Links in lists of at most LIST members: only verified pairs become rows."""
    lists = short.groupBy("list", "key").agg(F.array_sort(F.collect_list("fp")).alias("fps")).filter(F.size("fps") > 1)
    u = F.col("u")
    kept = lambda v: (shared_bytes(u, v) >= LEAST) & _is_first(u, v, F.col("list")) & (F.bit_count(u.bitwiseXOR(v)) <= BITS)
    return lists.select("list", "fps", F.posexplode("fps").alias("at", "u")).select("u", F.explode(F.filter(F.slice("fps", 1, F.col("at")), kept)).alias("v"))


def _around(long: DataFrame) -> DataFrame:
    """Links in longer lists: members that are within one bit of a common value, through the smallest of them."""
    flips = F.array(F.lit(0).cast("long"), *[F.lit(1 << b if b < 63 else -(1 << 63)).cast("long") for b in range(64)])
    free = [F.array(*[F.lit(not (_mask(both) >> b) & 1) for b in range(64)]) for both in LISTS]
    free = F.element_at(F.array(*free), F.col("list") + 1)
    flip = F.explode(F.filter(flips, lambda x, i: (i == 0) | F.get(free, i - 1)))
    near = long.select("fp", flip.alias("flip")).select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("value")).distinct()
    least = near.groupBy("value").agg(F.min("fp").alias("v"))
    return near.join(least, "value").filter("fp <> v").select(F.col("fp").alias("u"), "v").distinct()


def linked_prints(prints: DataFrame, most: int = LIST) -> DataFrame:
    """(u, v): links of fingerprints that join all that differ in at most 2 bits. prints: different values `fp`."""
    postings = settle(_postings(prints), "postings")
    sizes = settle(postings.groupBy("list", "key").agg(F.count("*").alias("n")).filter("n > 1"), "sizes")
    met = postings.join(sizes, ["list", "key"])
    links = settle(_pairs(met.filter(F.col("n") <= most)).unionByName(_around(met.filter(F.col("n") > most))), "links")
    discard(postings)
    discard(sizes)
    return links


def simhash_groups(docs: DataFrame, k: int = SHINGLE) -> DataFrame:
    """doc_id, fingerprint, component_id."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    prints = settle(docs.mapInArrow(partial(_fingerprints, k=k), "doc_id long, fp long"), "prints")
    nodes = settle(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes")
    links = linked_prints(nodes.select("fp"))
    of = settle(connected_components(links).withColumnRenamed("node", "fp"), "of")
    least = nodes.join(of, "fp").groupBy("component").agg(F.min("least").alias("component_id"))
    linked = of.join(least, "component").select("fp", "component_id")  # before nodes without links, whose component is null, come in
    final = nodes.join(linked, "fp", "left").select("fp", F.coalesce("component_id", "least").alias("component_id"))
    return prints.join(final, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op13_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_groups(table(spark, sf_dir, "documents"))
