"""Sharding by fixed virtual slots.

Records hash into a fixed number of virtual slots; bytes are summed per slot; a versioned table maps slots to shards. Growing
or rebalancing edits that map alone: a record never changes its slot. What the driver holds is one number per slot, so its size
depends on the number of slots and not on the data.

Null ids and texts hash as such, an empty text counts one byte, repeated rows share a slot and get places of their own, an empty
table gives an empty result, and columns besides those named in a call are left alone.
"""

from __future__ import annotations

import heapq

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.llm.common import scratch, table

#: Virtual slots; fixed for the life of a data set.
SLOTS = 4096


def virtual_slot(*keys: Column, slots: int = SLOTS) -> Column:
    """From the first 32 bits of the keys' MD5, which any system can make; a null key counts as empty text."""
    text = F.concat_ws(":", *[F.coalesce(k.cast("string"), F.lit("")) for k in keys])
    return (F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("long") % slots).cast("int")


def slot_loads(records: DataFrame, slots: int = SLOTS) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and rows per slot, from columns virtual_slot and size."""
    size, rows = np.zeros(slots, np.int64), np.zeros(slots, np.int64)
    for r in records.groupBy("virtual_slot").agg(F.sum("size").alias("b"), F.count("*").alias("n")).collect():  # at most one row a slot
        size[r[0]], rows[r[0]] = r[1], r[2]
    return size, rows


def first_map(load: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each slot: the heaviest slot goes to the lightest shard, again and again."""
    heap, out = [(0, s) for s in range(shards)], np.zeros(len(load), np.int32)
    for slot in np.argsort(-load, kind="stable"):
        total, shard = heapq.heappop(heap)
        out[slot] = shard
        heapq.heappush(heap, (total + int(load[slot]), shard))
    return out


def edit_map(old: np.ndarray, load: np.ndarray, shards: int, tolerance: float = 0.01) -> np.ndarray:
    """The map for new loads or more shards: moves slots from the fullest to the emptiest shard, each the largest that still
    narrows their gap, until the fullest is within tolerance of the mean or no move helps. Other slots stay."""
    out = old.copy()
    total = np.bincount(out, weights=load, minlength=shards).astype(np.int64)
    while total.max() > (1 + tolerance) * total.mean():
        a, b = int(total.argmax()), int(total.argmin())
        own = np.flatnonzero(out == a)
        fit = own[(load[own] > 0) & (load[own] < total[a] - total[b])]
        if not len(fit):
            break
        gap = (total[a] - total[b]) // 2
        pick = fit[np.argmin(np.abs(load[fit] - gap))]
        out[pick] = b
        total[a] -= load[pick]
        total[b] += load[pick]
    return out


def save_map(spark: SparkSession, path: str, version: int, shard_of: np.ndarray) -> None:
    """Versions stay beside each other; readers of an older one aren't disturbed."""
    rows = [(i, int(s)) for i, s in enumerate(shard_of)]
    spark.createDataFrame(rows, "virtual_slot int, shard int").coalesce(1).write.mode("overwrite").parquet(f"{path}/version={version}")


def load_map(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """Columns virtual_slot, shard, version: of the version asked for, else of the newest."""
    every = spark.read.parquet(path)
    version = every.agg(F.max("version")).first()[0] if version is None else version
    return every.filter(F.col("version") == version)


def shard_documents(docs: DataFrame, shards: int = 8, slots: int = SLOTS, map_path: str | None = None) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot (place in the shard, gapless from 0), grown_shard, virtual_slot, map_version.

    Law `bytes`: the shards' sizes are near equal. One shuffle, of ids and numbers, by virtual slot; a record's place in its
    shard is its place in its slot after the shard's earlier slots. The hash takes the id and the text's checksum, so even a
    null id that many rows share is spread."""
    spark = docs.sparkSession
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    records = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    records = records.withColumn("virtual_slot", virtual_slot(F.col("doc_id"), F.col("text_crc32"), slots=slots))
    load, rows = slot_loads(records, slots)
    path = map_path or scratch(spark, "slot-map")
    save_map(spark, path, 1, first_map(load, shards))
    placed = np.array([r.shard for r in load_map(spark, path, 1).orderBy("virtual_slot").collect()])  # one row a slot
    before = np.zeros(slots, np.int64)
    for s in range(shards):
        own = np.flatnonzero(placed == s)
        before[own] = np.cumsum(rows[own]) - rows[own]
    plan = F.broadcast(spark.createDataFrame([(i, int(s), int(b)) for i, (s, b) in enumerate(zip(placed, before, strict=True))], "virtual_slot int, shard int, before long"))
    order = Window.partitionBy("virtual_slot").orderBy("doc_id", "text_crc32", "size")
    return (
        records.withColumn("place", F.row_number().over(order))
        .join(plan, "virtual_slot")
        .select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("before") + F.col("place") - 1).alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", F.lit(1).alias("map_version"))
    )


def op8_shard_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents"), shards=8)


OP8_SQL = """
with recursive bits as (
  select doc_id, coalesce(text, '') as text, flatten(list_transform(regexp_extract_all(hex(coalesce(text, '')), '..'), lambda h: list_transform(range(8), lambda i: (cast('0x' || h as bigint) >> i) & 1))) as bits from documents),
records as (
  select doc_id, octet_length(encode(text)) + 1 as size, xor(4294967295, list_reduce(list_prepend(4294967295, bits), lambda c, b: xor(c >> 1, (xor(c, b) & 1) * 3988292384))) as text_crc32 from bits),
slotted as materialized (
  select *, cast(cast('0x' || substring(md5(doc_id || ':' || text_crc32), 1, 8) as bigint) % 4096 as integer) as virtual_slot from records),
loads as materialized (
  select s.slot, coalesce(b, 0) as b, coalesce(n, 0) as n, row_number() over (order by coalesce(b, 0) desc, s.slot) as turn
  from (select unnest(range(4096)) as slot) s left join (select virtual_slot as slot, cast(sum(size) as bigint) as b, count(*) as n from slotted group by all) using (slot)),
dealt(turn, slot, n, shard, totals) as (
  select cast(0 as bigint), cast(-1 as bigint), cast(0 as bigint), 0, list_transform(range(8), lambda i: cast(0 as bigint))
  union all
  select l.turn, l.slot, l.n, cast(list_position(totals, list_min(totals)) - 1 as integer), list_transform(totals, lambda t, i: case when i = list_position(totals, list_min(totals)) then t + l.b else t end)
  from dealt d join loads l on l.turn = d.turn + 1),
places as (select slot, shard, sum(n) over (partition by shard order by slot) - n as before from dealt where slot >= 0)
select doc_id, cast(size as bigint) as size, text_crc32, 'bytes' as law, shard, cast(before + row_number() over (partition by virtual_slot order by doc_id, text_crc32, size) - 1 as bigint) as slot,
       cast(null as integer) as grown_shard, virtual_slot, 1 as map_version
from slotted join places on slot = virtual_slot
"""
