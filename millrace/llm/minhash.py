"""Near-duplicate documents by MinHash.

Words are runs of anything but ASCII white space, A-Z lowered. A document's set holds its distinct shingles of some words in a row;
a shorter document is one shingle; one without words is linked with nothing.

1. Each set gets a signature: the minima of many universal hashes (multiply, add, take the upper half). Documents with equal
   sets become one class at once, represented by the smallest id.
2. Banding: classes whose signatures agree in all rows of a band meet in a bucket. Each class is compared, on full sets, with the
   smallest member of all its buckets.
3. Connected components of those links. In buckets whose members are still in several components, the members outside of the bucket's
   largest one are searched against all others, in squares of two blocks that are bounded in members and in shingles: pairs across
   components whose signatures agree well enough are verified on full sets as well, until the square's components that have a link are
   one. So each pair that meets in a bucket is either in one component already or tested, and no bucket's pairs are written out.
4. Components again, over all links.

With 24 bands of 5 rows, a pair of similarity 0.85 (0.8) misses all buckets with probability 8e-7 (7e-5). Pairs are verified from a
signature agreement of five standard deviations below the threshold.

Rows with a null id are in no group and kept. Repeated rows share their group. An empty table gives an empty result. Memory: some
tens of bytes for each byte of the longest text.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import discard, settle, table
from millrace.llm.components import connected_components
from millrace.llm.textbytes import blocks, lower_ascii, mix, prefix, range_hash, words

BANDS, ROWS = 24, 5
HASHES = BANDS * ROWS
_rng = np.random.default_rng(20250301)
_A = _rng.integers(0, 1 << 63, HASHES, np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, 1 << 63, HASHES, np.uint64)
#: Upper bits of a shingle's key hold its document's place in the block.
_DOC_BITS = np.uint64(10)
#: Blocks of a bucket's members: about so many members, and shingles, at most.
SQUARE, SQUARE_SHINGLES = 256, 1 << 20
#: Documents that are compared with one copy of a centre's text.
STAR = 1024


def shingle_sets(batch: pa.RecordBatch, k: int, col: str = "text") -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bounds, values): the sorted distinct shingles, as 54-bit hashes, of some rows of the batch; row first + i has
    values[bounds[i]:bounds[i + 1]]."""
    for lo, hi, buf, offsets in blocks(batch, col):
        start, end, first = words(buf, offsets)
        word = range_hash(prefix(lower_ascii(buf)), start, end)
        for a in range(0, hi - lo, 1 << int(_DOC_BITS)):
            b = min(hi - lo, a + (1 << int(_DOC_BITS)))
            own = word[first[a] : first[b]]
            bounds = first[a : b + 1] - first[a]
            count = np.diff(bounds)
            doc = np.repeat(np.arange(b - a, dtype=np.uint64), count)
            place = np.arange(len(own)) - np.repeat(bounds[:-1], count)
            value = np.zeros(len(own), np.uint64)
            short = bool((count < k).any())
            for i in range(k):  # of a document with fewer than k words only the first shingle stays, over the words there are
                step = mix(value[: max(0, len(own) - i)] + own[i:] * np.uint64(2 * i + 3))
                value[: len(step)] = np.where(i < np.repeat(count, count)[: len(step)], step, value[: len(step)]) if short else step
            keep = place <= np.maximum(np.repeat(count, count) - k, 0)
            key = np.sort((doc[keep] << (np.uint64(64) - _DOC_BITS)) | (value[keep] >> _DOC_BITS))
            if len(key):
                key = key[np.concatenate(([True], key[1:] != key[:-1]))]
            of = (key >> (np.uint64(64) - _DOC_BITS)).astype(np.int64)
            yield lo + a, np.searchsorted(of, np.arange(b - a + 1)), key & np.uint64((1 << 54) - 1)


def signatures(bounds: np.ndarray, values: np.ndarray) -> np.ndarray:
    """A row of HASHES minima for each set that isn't empty, in order."""
    begin = bounds[:-1][np.diff(bounds) > 0]
    out = np.empty((len(begin), HASHES), np.uint32)
    for j in range(HASHES if len(begin) else 0):
        out[:, j] = np.minimum.reduceat(((values * _A[j] + _B[j]) >> np.uint64(32)).astype(np.uint32), begin)
    return out


def _keys(bounds: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Two 64-bit sums that equal sets share."""
    out, full = np.zeros((2, len(bounds) - 1), np.uint64), np.diff(bounds) > 0
    if len(values):
        for i, x in enumerate((mix(values), mix(values ^ np.uint64(0x5851F42D4C957F2D)))):
            out[i, full] = np.add.reduceat(x, bounds[:-1][full])
    return out


def _buckets(sig: np.ndarray) -> np.ndarray:
    """A bucket for each band of each signature."""
    sig = sig.astype(np.uint64).reshape(len(sig), BANDS, ROWS)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), (len(sig), BANDS)).copy()
    for r in range(ROWS):
        key = mix(key * np.uint64(31) + sig[:, :, r])
    return key.view(np.int64)


def _sign(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row, bounds, values in shingle_sets(batch, k):
            n, full = np.diff(bounds), np.diff(bounds) > 0
            band = np.zeros((len(n), BANDS), np.int64)
            band[full] = _buckets(signatures(bounds, values))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1, dtype=np.int32) * BANDS), pa.array(band.ravel()))
            ids = batch.column("doc_id").slice(row, len(n))
            yield pa.RecordBatch.from_arrays([ids, pa.array(n.astype(np.int64)), *(pa.array(x.view(np.int64)) for x in _keys(bounds, values)), lists], ["doc_id", "n_shingles", "k1", "k2", "bands"])


def _with_signature(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row, bounds, values in shingle_sets(batch, k):
            sig = np.zeros((len(bounds) - 1, HASHES), np.uint32)
            sig[np.diff(bounds) > 0] = signatures(bounds, values)
            part = batch.slice(row, len(sig))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([x.tobytes() for x in sig], pa.binary()), part.column("text")], ["doc_id", "sig", "text"])


def _signed(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(-1, HASHES)


def least_agreement(threshold: float) -> int:
    """Equal minima of two signatures below which a pair isn't verified: five standard deviations under the threshold."""
    return int(np.floor(HASHES * threshold - 5 * np.sqrt(HASHES * threshold * (1 - threshold))))


def _sets(batch: pa.RecordBatch | pa.Table, k: int, col: str) -> list[np.ndarray]:
    out = []
    for _, bounds, values in shingle_sets(batch, k, col):
        out += [values[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    return out


def _linked(a: np.ndarray, b: np.ndarray, num: int, den: int) -> bool:
    """On full sets, sorted."""
    if num * max(len(a), len(b)) > den * min(len(a), len(b)):
        return False
    both = np.sort(np.concatenate((a, b)))
    common = np.count_nonzero(both[1:] == both[:-1])
    return den * common >= num * (len(a) + len(b) - common)


def _similar(batches: Iterator[pa.RecordBatch], k: int, num: int, den: int) -> Iterator[pa.RecordBatch]:
    """Of pairs with their texts, those whose full sets are similar enough."""
    for batch in batches:
        for at in range(0, len(batch), 256):
            part = batch.slice(at, 256)
            good = [_linked(a, b, num, den) for a, b in zip(_sets(part, k, "text_u"), _sets(part, k, "text_v"), strict=True)]
            yield part.select(["u", "v"]).filter(pa.array(good, pa.bool_()))


def _whole(held: list[pa.RecordBatch]) -> pa.RecordBatch:
    rows = pa.Table.from_batches(held)
    wide = {"string": pa.large_string(), "binary": pa.large_binary()}  # a column of more than 2 GB
    return rows.cast(pa.schema([f.with_type(wide.get(str(f.type), f.type)) for f in rows.schema])).combine_chunks().to_batches()[0]


def _squares(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of each square, of batches sorted by bucket and square."""
    held, now = [], None
    for batch in batches:
        bucket, square = batch.column("bucket").to_numpy(), batch.column("square").to_numpy()
        cuts = [0, *(np.flatnonzero((bucket[1:] != bucket[:-1]) | (square[1:] != square[:-1])) + 1), len(batch)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if held and b > a and (bucket[a], square[a]) != now:
                yield _whole(held)
                held = []
            if b > a:
                now = (bucket[a], square[a])
                held.append(batch.slice(a, b - a))
    if held:
        yield _whole(held)


#: Roles of a square's members: searched, found, found and searched, found where another square searches it. The largest component's
#: members are FOUND; of two others, the one with the larger id is searched.
SEARCHED, FOUND, BOTH, ELSEWHERE = 0, 1, 2, 3


def _candidates(square: pa.RecordBatch, least: int) -> Iterator[tuple[int, np.ndarray]]:
    """(i, others): pairs across components whose signatures agree and that have met in no earlier band."""
    label, role, bucket, ids = (square.column(c).to_numpy() for c in ("label", "role", "bucket", "doc_id"))
    sig = _signed(square.column("sig"))
    bands = _buckets(sig)
    band = int(np.argmax(bands[0] == bucket[0]))
    found = np.flatnonzero(role != SEARCHED)
    for i in np.flatnonzero((role == SEARCHED) | (role == BOTH)):
        other = found[(label[found] != label[i]) & ((role[found] == FOUND) | (ids[found] < ids[i]))]
        other = other[(sig[other] == sig[i]).sum(1) >= least]
        if band and len(other):
            other = other[~(bands[other, :band] == bands[i, :band]).any(1)]
        if len(other):
            yield i, other


def _involved(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    for square in _squares(batches):
        used = np.zeros(len(square), bool)
        for i, other in _candidates(square, least):
            used[i] = used[other] = True
        yield square.select(["bucket", "square", "role", "doc_id", "label"]).filter(pa.array(used))


def _bridges(batches: Iterator[pa.RecordBatch], k: int, num: int, den: int, least: int) -> Iterator[pa.RecordBatch]:
    """Links on full sets that join the square's components, as few as do."""
    for square in _squares(batches):
        ids, label = square.column("doc_id").to_numpy(), square.column("label").to_numpy()
        sets, parent, found = _sets(square, k, "text"), {x: x for x in label.tolist()}, []

        def root(x: int) -> int:
            while parent[x] != x:
                parent[x] = x = parent[parent[x]]
            return x

        for i, other in _candidates(square, least):
            for j in other:
                a, b = root(int(label[i])), root(int(label[j]))
                if a != b and _linked(sets[i], sets[j], num, den):
                    parent[a] = b
                    found.append((max(ids[i], ids[j]), min(ids[i], ids[j])))
        u, v = (pa.array([int(x[i]) for x in found], pa.int64()) for i in (0, 1))
        yield pa.RecordBatch.from_arrays([u, v], ["u", "v"])


def near_duplicates(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: documents are linked if den * intersection >= num * union of their k-word sets."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    least = least_agreement(num / den)
    sets = settle(docs.mapInArrow(partial(_sign, k=k), "doc_id long, n_shingles long, k1 long, k2 long, bands array<long>"), "sets")
    linkable = sets.filter("n_shingles > 0 and doc_id is not null")
    classes = settle(linkable.groupBy("k1", "k2", "n_shingles").agg(F.min(F.struct("doc_id", "bands")).alias("c")).select("k1", "k2", "n_shingles", "c.*"), "classes")
    rows = classes.select("doc_id", F.col("n_shingles").alias("size"), F.explode("bands").alias("bucket")).distinct()
    centers = rows.groupBy("bucket").agg(F.min("doc_id").alias("center"), F.count("*").alias("n")).filter("n > 1").drop("n")
    members = settle(rows.join(centers, "bucket"), "members")
    texts = docs.join(members.select("doc_id").distinct(), "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    texts = settle(texts.mapInArrow(partial(_with_signature, k=k), "doc_id long, sig binary, text string"), "texts")
    text_of = lambda c: texts.select(F.col("doc_id").alias(c), F.col("text").alias(f"text_{c}"))

    # a centre with many documents is dealt to several tasks, each with a copy of its text
    star = settle(members.groupBy(F.col("doc_id").alias("u")).agg(F.min("center").alias("v")).filter("u <> v"), "star")
    copies = star.groupBy("v").agg(F.ceil(F.count("*") / STAR).cast("int").alias("copies"))
    centre_texts = text_of("v").join(copies, "v").withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1))).drop("copies")
    star = star.join(copies, "v").withColumn("copy", F.pmod(F.xxhash64("u"), "copies").cast("int")).drop("copies")
    star = star.join(text_of("u"), "u").join(centre_texts, ["v", "copy"]).select("u", "v", "text_u", "text_v")
    links = settle(star.mapInArrow(partial(_similar, k=k, num=num, den=den), "u long, v long"), "links")
    found = connected_components(links)

    labels = members.join(found.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("bucket", "doc_id", "size", F.coalesce("component", "doc_id").alias("label"))
    labels = settle(labels, "labels")
    parts = labels.groupBy("bucket", "label").agg(F.count("*").alias("n"), F.sum("size").alias("size"))
    shape = parts.groupBy("bucket").agg(F.sum("n").alias("n"), F.sum("size").alias("total"), F.max(F.struct("n", "label", "size")).alias("main")).filter("n > main.n")
    blocks_of = lambda n, size: F.greatest(F.ceil(n / SQUARE), F.ceil(size / SQUARE_SHINGLES)).cast("int")
    shape = shape.select("bucket", "main.label", blocks_of(F.col("n"), F.col("total")).alias("all"), blocks_of(F.col("n") - F.col("main.n"), F.col("total") - F.col("main.size")).alias("others"))
    rest = labels.join(shape.withColumnRenamed("label", "main"), "bucket").withColumn("other", F.col("label") != F.col("main"))
    place, own = (F.pmod(F.xxhash64("doc_id", F.lit(i)), n).cast("int") for i, n in enumerate(("all", "others")))
    rest = rest.withColumns({"place": place, "own": own})
    square = lambda x, y: x * F.col("all") + y
    met = F.transform(F.sequence(F.lit(0), F.col("others") - 1), lambda x: F.struct(square(x, F.col("place")).alias("square"), F.when(~F.col("other"), FOUND).when(x == F.col("own"), BOTH).otherwise(ELSEWHERE).alias("role")))
    asked = F.transform(F.filter(F.sequence(F.lit(0), F.col("all") - 1), lambda y: y != F.col("place")), lambda y: F.struct(square(F.col("own"), y).alias("square"), F.lit(SEARCHED).alias("role")))
    rest = rest.select("bucket", "doc_id", "label", F.inline(F.when(F.col("other"), F.concat(met, asked)).otherwise(met)))

    def by_square(rows: DataFrame) -> DataFrame:
        return rows.repartition("bucket", "square").sortWithinPartitions("bucket", "square", "doc_id")

    kind = "bucket long, square int, role int, doc_id long, label long"
    used = settle(by_square(rest.join(texts.select("doc_id", "sig"), "doc_id")).mapInArrow(partial(_involved, least=least), kind), "squares")
    bridges = by_square(used.join(texts, "doc_id")).mapInArrow(partial(_bridges, k=k, num=num, den=den, least=least), "u long, v long")
    bridges = settle(bridges, "links")
    final = connected_components(links.union(bridges))
    for done in (members, labels, used, texts, links, bridges):
        discard(done)

    of_class = classes.join(final.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("k1", "k2", "n_shingles", F.coalesce("component", "doc_id").alias("of_class"))
    out = sets.select("doc_id", "n_shingles", "k1", "k2").join(of_class, ["k1", "k2", "n_shingles"], "left")
    component = F.when(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0), F.col("of_class")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def op5_minhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), k=3, num=85)


OP5_SQL = r"""
with recursive worded as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
shingles as (
  select distinct doc_id, unnest(case when len(w) >= 3 then list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) when len(w) > 0 then [array_to_string(w, ' ')] else [] end) as s from worded),
sizes as (select doc_id, count(*) as n from shingles group by doc_id),
shared as (select a.doc_id as a, b.doc_id as b, count(*) as n from shingles a join shingles b on a.s = b.s and a.doc_id < b.doc_id group by all),
links as (select a, b from shared join sizes x on x.doc_id = a join sizes y on y.doc_id = b where 100 * shared.n >= 85 * (x.n + y.n - shared.n)),
edges as (select a, b from links union all select b, a from links),
reached(a, b) as (select doc_id, doc_id from documents union select edges.b, reached.b from reached join edges on edges.a = reached.a)
select doc_id, coalesce(n, 0) as n_shingles, component_id, doc_id = component_id as kept
from (select a as doc_id, min(b) as component_id from reached group by a) left join sizes using (doc_id)
"""
