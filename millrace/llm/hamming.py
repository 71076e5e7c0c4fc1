"""Exact top-k search by incremental multi-index hashing of binary codes.

A vector's code has a bit for each dimension: whether it is at least zero. Codes are cut into m segments of about log2(n) bits, so
that a bucket of one segment value holds about one code; their widths differ by one bit at most. Two codes within distance m * (r + 1) - 1 agree in one of their m segments up
to r bits. So the radius of the segments' searches grows, 0, 1, 2 and so on, until a query's k-th verified distance is at most that
bound, and what was found is exact. A pair that several segments find is taken at its nearest segment, so it is verified once.

Each radius is a join of the probes (queries' segment values with r bits flipped, grown by one bit from those before) with the index,
dealt by (segment, value). From the radius on at which there are more ways to flip bits than values in the index, the probes of a query
are those of the existing values that lie so far, found by comparing it with them in blocks: so an outlier's probes never exceed the values
that there are. The index is not copied for queries, each code goes out once for each segment. Tasks keep a query's nearest
k + 1 codes before they shuffle what they found. Buckets of more than BUCKET codes are split, and their probes go to all parts.

Neighbours are ordered by distance, then id, and never are the query itself. Rows of one code beyond its first k + 1 ids can't be
among the first k of any query and aren't in the index, and queries of one code are searched once: large groups of equal vectors cost
no more than k + 1 rows.

A null vector, or one of another length than most have (of equally frequent lengths, the longest counts), has no code: it isn't found
and finds nothing. A null element counts as zero. A null id isn't searched or found. Repeated rows are one row. A query with fewer
than k others gets as many as there are. An empty table gives an empty result. Other columns are left alone. Built-in functions only.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.llm.common import discard, settle, table

K, EVERY = 10, 20
#: Codes in one part of a bucket.
BUCKET = 4096
#: Values of a segment in one block of comparisons.
BLOCK = 1 << 16


def _segment(v: Column, begin: int, width: int) -> Column:
    """The number whose bits are the signs of v[begin:begin + width]."""
    return F.aggregate(F.slice(v, begin + 1, width), F.lit(0).cast("long"), lambda acc, x: acc * 2 + F.when(F.coalesce(x >= 0, F.lit(True)), 1).otherwise(0))


def _by_segment(names: list[str]) -> Column:
    """(seg, value) for each segment."""
    return F.inline(F.array(*[F.struct(F.lit(i).alias("seg"), F.col(c).alias("value")) for i, c in enumerate(names)]))


def widths_of(dims: int, n: int) -> list[int]:
    """Bits of each segment: about log2(n), and the same in all, or one more in the first ones."""
    m = -(-dims // min(30, max(4, round(math.log2(n + 1)))))
    return [dims // m + (i < dims % m) for i in range(m)]


def _flipped(probes: DataFrame, widths: list[int]) -> DataFrame:
    """Probes with one more bit flipped, above those flipped before: each set of bits of the segment once."""
    last = F.when(F.col("seg") < sum(w > widths[-1] for w in widths), widths[0] - 1).otherwise(widths[-1] - 1)
    more = probes.filter(F.col("top") < last).withColumn("top", F.explode(F.sequence(F.col("top") + 1, last)))
    return more.withColumn("value", F.col("value").bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("top"))))


class SegmentIndex:
    """Codes by segment and value. codes: id and the columns s0, s1 and so on; ids are distinct within a code."""

    def __init__(self, codes: DataFrame, widths: list[int], k: int):
        self.widths, self.m, self.width, self.k = widths, (m := len(widths)), max(widths), k
        self.s, self.q = [f"s{i}" for i in range(m)], [f"q{i}" for i in range(m)]
        first = Window.partitionBy(*self.s).orderBy("id")
        kept = codes.withColumn("n", F.row_number().over(first)).filter(F.col("n") <= k + 1)
        index = kept.groupBy(*self.s).agg(F.array_sort(F.collect_list("id")).alias("ids")).select(*self.s, "ids", _by_segment(self.s))
        self.index = settle(index, "index")
        parts = F.ceil(F.count("*") / BUCKET).cast("int")
        self.values = settle(self.index.groupBy("seg", "value").agg(parts.alias("parts")), "values")
        self.existing = self.values.count()
        self.large = settle(self.values.filter("parts > 1"), "large")
        part = F.pmod(F.xxhash64(*self.s), F.coalesce("parts", F.lit(1))).cast("int")
        self.dealt = self.index.join(self.large, ["seg", "value"], "left").withColumn("part", part).drop("parts")

    def _reached(self, probes: DataFrame, radius: int) -> DataFrame:
        """(query, far, first, ids) of codes first reached at this radius: their nearest segment is so far."""
        to_all = probes.join(self.large, ["seg", "value"], "left").withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)))
        met = to_all.join(self.dealt, ["seg", "value", "part"])
        apart = [F.bit_count(F.col(a).bitwiseXOR(F.col(b))) for a, b in zip(self.q, self.s, strict=True)]
        nearest = F.least(*apart, F.lit(1 << 10)) if self.m > 1 else apart[0]
        here = (nearest == radius) & (F.array_position(F.array(*apart), F.lit(radius)) == F.col("seg") + 1)
        return met.filter(here).select(*self.q, reduce(lambda x, y: x + y, apart).cast("int").alias("far"), F.col("ids")[0].alias("first"), "ids")

    def _near(self, active: DataFrame, radius: int) -> DataFrame:
        """The queries' probes at a radius, by comparison with the existing values: as many as there are, not as could be."""
        blocks = max(1, self.existing // (self.m * BLOCK))
        mine = active.select(*self.q, _by_segment(self.q).alias("seg", "of")).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        values = self.values.select("seg", "value", F.pmod(F.xxhash64("value"), F.lit(blocks)).cast("int").alias("block"))
        met = mine.join(values, ["seg", "block"]).filter(F.bit_count(F.col("of").bitwiseXOR(F.col("value"))) == radius)
        return met.select(*self.q, "seg", "value", F.lit(-1).alias("top"))

    def search(self, queries: DataFrame) -> DataFrame:
        """(q0, q1 and so on, near): for each distinct query code its k + 1 nearest, (far, id) in order. queries: those columns."""
        active, held, done, walk = settle(queries.distinct(), "active"), None, [], False
        probes = settle(active.select(*self.q, _by_segment(self.q), F.lit(-1).alias("top")), "probes")
        by_distance = Window.partitionBy(*self.q).orderBy("far", "first")
        for radius in range(self.width + 1):
            found = self._reached(probes, radius)
            found = found if held is None else found.unionByName(held.join(active, self.q).select(*found.columns))
            found = found.withColumn("n", F.row_number().over(by_distance)).filter(F.col("n") <= self.k + 1)
            found = settle(found.withColumn("sum", F.sum(F.size("ids")).over(by_distance)), "found")
            sure = found.filter((F.col("sum") > self.k) & (F.col("far") <= self.m * (radius + 1) - 1)).select(*self.q).distinct()
            rest = settle(active.join(sure, self.q, "left_anti"), "active")
            done.append(found if radius == self.width else found.join(rest, self.q, "left_anti"))
            active, held = rest, found
            if radius == self.width or active.isEmpty():
                break
            ways = sum(math.comb(w, radius + 1) for w in self.widths)
            walk = walk or ways > self.existing
            before, probes = probes, settle(self._near(active, radius + 1) if walk else _flipped(probes.join(active, self.q), self.widths), "probes")
            discard(before)
        every = reduce(DataFrame.unionByName, [d.select(*self.q, "far", "ids") for d in done])
        pairs = F.flatten(F.collect_list(F.transform("ids", lambda i: F.struct(F.col("far"), i.alias("id")))))
        return every.groupBy(*self.q).agg(F.slice(F.array_sort(pairs), 1, self.k + 1).alias("near"))


def top_k(vectors: DataFrame, k: int = K, every: int = EVERY, id_col: str = "vec_id", col: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), neighbor_id, distance: for each row whose id is divisible by `every`, against all rows."""
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(col).alias("v")).filter("id is not null and size(v) > 0")
    usual = rows.groupBy(F.size("v").alias("dims")).count().orderBy(F.desc("count"), F.desc("dims")).first()  # one row
    dims, n = (usual["dims"], usual["count"]) if usual else (1, 1)
    widths = widths_of(dims, n)
    codes = rows.filter(F.size("v") == dims).select("id", *[_segment(F.col("v"), sum(widths[:i]), w).alias(f"s{i}") for i, w in enumerate(widths)]).distinct()
    codes = settle(codes, "codes")
    index = SegmentIndex(codes, widths, k)
    queries = codes.filter(F.col("id") % every == 0).select(F.col("id").alias("query_id"), *[F.col(s).alias(q) for s, q in zip(index.s, index.q, strict=True)])
    found = queries.join(index.search(queries.select(*index.q)), index.q)
    others = F.slice(F.filter("near", lambda x: x["id"] != F.col("query_id")), 1, k)
    found = found.select("query_id", F.posexplode(others).alias("place", "of"))
    return found.select("query_id", (F.col("place") + 1).alias("rank"), F.col("of.id").alias("neighbor_id"), F.col("of.far").alias("distance"))


def op7_multi_index_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"))


OP7_SQL = """
with pairs as (
  select q.vec_id as query_id, n.vec_id as neighbor_id,
         cast(list_sum(list_transform(list_zip(q.embedding, n.embedding), lambda p: case when (p[1] >= 0) = (p[2] >= 0) then 0 else 1 end)) as integer) as distance
  from embeddings q join embeddings n on q.vec_id <> n.vec_id where q.vec_id % 20 = 0)
select query_id, cast(row_number() over (partition by query_id order by distance, neighbor_id) as integer) as rank, neighbor_id, distance
from pairs qualify rank <= 10
"""
