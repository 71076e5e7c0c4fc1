"""Mixing sources to target weights by capped water-filling.

Each source asks for its weight's share of a budget of words; a source stops at max_epochs times its own size and what it can't
take is shared among the others by weight, until no source is above its cap. Clamping in the order of cap / weight reaches that
fixed point at once: the level is the largest of (budget - caps before) / (weights from here on), and a source's target is
the smaller of its cap and level * weight.

A source's whole repetitions go to all its documents. The fraction goes to documents in the order of a seeded hash until the
target is met (of the id, or of the text where there is no id); the one on the border repeats a part of its words. Bucket sums over hash ranges give each range its start, so
that no group larger than a range of a source is sorted by one task.

Null sources are one source, ordered last; null and empty texts have size 0 and take 0; repeated rows count each; an empty table
gives an empty result; other columns are left alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.llm.common import WORD, settle, table

WEIGHTS = (5, 2, 1)
SHARE, EPOCHS, SEED = 1.5, 2, 7


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, epochs: int = EPOCHS) -> DataFrame:
    """From source and source_size (one row a source): with columns weight, cap and target."""
    everything = Window.partitionBy()
    by_name = Window.orderBy(F.col("source").asc_nulls_last())  # one row a source, not a document
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    caps = sizes.withColumn("weight", weight).withColumn("cap", F.col("source_size") * epochs)
    by_level = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before, onward = by_level.rowsBetween(Window.unboundedPreceding, -1), by_level.rowsBetween(0, Window.unboundedFollowing)
    budget = F.sum("source_size").over(everything) * F.lit(share)
    level = (budget - F.coalesce(F.sum("cap").over(before), F.lit(0))) / F.sum("weight").over(onward)
    return caps.withColumn("level", level).withColumn("target", F.least(F.col("cap").cast("double"), F.max("level").over(everything) * F.col("weight"))).drop("level")


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, epochs: int = EPOCHS, seed: int = SEED, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, size, source, source_size, target, whole (repetitions of all the document), part (words of one more), taken;
    and the columns in keep."""
    own = F.coalesce(F.col("doc_id").cast("string"), F.md5(F.coalesce("text", F.lit("")).cast("binary")))
    draw = F.md5(F.concat(F.lit(f"{seed}:"), own).cast("binary"))
    sizes = docs.select("doc_id", "source", *keep, word_count(F.col("text")).alias("size"), draw.alias("draw"))
    rows = sizes.withColumn("bucket", F.substring("draw", 1, 3))
    rows = rows if keep else settle(rows, "mix")
    buckets = rows.groupBy("source", "bucket").agg(F.sum("size").alias("bucket_size"))
    targets = source_targets(buckets.groupBy("source").agg(F.sum("bucket_size").alias("source_size")), weights, share, epochs)
    starts = buckets.withColumn("start", F.sum("bucket_size").over(Window.partitionBy("source").orderBy("bucket")) - F.col("bucket_size"))
    starts = starts.join(targets, starts["source"].eqNullSafe(targets["source"])).drop(targets["source"]).drop("bucket_size", "weight", "cap")
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    starts = starts.withColumn("whole", whole).withColumn("rest", F.floor(F.col("target") + 0.5) - F.col("whole") * F.col("source_size"))
    starts = starts.withColumnsRenamed({"source": "s", "bucket": "b"})
    out = rows.join(starts, rows["source"].eqNullSafe(starts["s"]) & (rows["bucket"] == starts["b"]))
    order = Window.partitionBy("s", "b").orderBy("draw", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    room = F.col("rest") - F.col("start") - F.coalesce(F.sum("size").over(order), F.lit(0))
    out = out.withColumn("part", F.greatest(F.lit(0), F.least(F.col("size"), room)).cast("long"))
    return out.select("doc_id", *keep, "source", "size", "source_size", "target", "whole", "part", (F.col("whole") * F.col("size") + F.col("part")).alias("taken"))


def mixed_documents(docs: DataFrame, **how) -> DataFrame:
    """The documents of the mix, each as often as it is taken, with all columns of docs, whatever their names; of a document on
    the border, whole or no repetition, whichever is nearer."""
    packed = docs.select("doc_id", "source", "text", F.struct("*").alias("_doc"))
    taken = mix(packed, keep=("_doc",), **how)
    copies = (F.col("whole") + F.when((F.col("part") > 0) & (F.col("part") * 2 >= F.col("size")), 1).otherwise(0)).cast("int")
    return taken.withColumn("_copy", F.explode(F.array_repeat(F.lit(1), copies))).select("_doc.*")


def op9_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


OP9_SQL = r"""
with sized as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as size,
         md5('7:' || coalesce(cast(doc_id as varchar), '')) as draw from documents),
sources as (
  select source, cast(sum(size) as bigint) as source_size,
         [5, 2, 1][((row_number() over (order by source nulls last) - 1) % 3) + 1] as weight from sized group by source),
leveled as (
  select *, (1.5::double * sum(source_size) over ()
             - coalesce(sum(2 * source_size) over (order by 2 * source_size / weight, source nulls last rows between unbounded preceding and 1 preceding), 0))
            / sum(weight) over (order by 2 * source_size / weight, source nulls last rows between current row and unbounded following) as level
  from sources),
targets as (select source, source_size, least(cast(2 * source_size as double), max(level) over () * weight) as target from leveled),
split as (
  select *, case when source_size > 0 then cast(floor(target / source_size) as bigint) else 0 end as whole from targets),
placed as (
  select d.doc_id, d.size, s.source_size, s.target, s.whole, cast(floor(s.target + 0.5) as bigint) - s.whole * s.source_size
         - coalesce(sum(d.size) over (partition by d.source order by d.draw, d.doc_id, d.size rows between unbounded preceding and 1 preceding), 0) as room
  from sized d join split s on d.source is not distinct from s.source)
select doc_id, cast(size as bigint) as size, source_size, target,
       cast(whole * size + greatest(0, least(size, room)) as bigint) as taken from placed
"""
