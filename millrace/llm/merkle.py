"""Document fingerprints: a Merkle tree over the sections and paragraphs of a text.

A section ends at an empty line, a paragraph at a line's end, a leaf where two bytes meet a pattern, or after LEAF bytes: about one
place in thirty in any script, so that cuts depend on content only and an edit moves no leaf but those it touches. A leaf's node is
the SHA-256 of its bytes, a paragraph's that of its leaves' nodes, a section's that of its paragraphs' nodes, the root's that of its
sections' nodes. Roots test equality; where they differ, descending into the sections and paragraphs that the other tree lacks locates
the edit, whatever was moved by it; the likeness of two trees is the Jaccard index of their leaves' nodes.

A null text counts as empty (one paragraph with one empty leaf); two empty texts are alike. Repeated rows each get a row; among rows
of one id, those with the greater hash of their text come first; a null id comes last. An empty table gives an empty result. Only
doc_id and text are read, whatever other columns there are. Built-in functions only.
"""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.llm.common import table

#: Most bytes of a leaf.
LEAF = 64
#: Over a paragraph's bytes in hexadecimal: a byte that ends in 1, and one whose upper half is even, end a leaf.
LEAVES = rf"(?:..){{0,{LEAF - 2}}}?.1[02468ACE].|(?:..){{1,{LEAF}}}"
#: Ranges hold about RANGE_BYTES, or as much as makes RANGES; their borders come from about SAMPLED ids.
RANGE_BYTES, RANGES, SAMPLED = 8 << 20, 1 << 14, 1 << 18
_NO_ID = -(1 << 63)


def _node(kind: str, value: Column) -> Column:
    return F.sha2(F.concat(F.lit(kind), value), 256)


def tree(text: Column) -> Column:
    """Sections of paragraphs of leaves' nodes."""
    pieces = lambda p: F.regexp_extract_all(F.hex(p), F.lit(LEAVES), F.lit(0))
    leaves = lambda p: F.transform(F.when(p == "", F.array(F.lit(""))).otherwise(pieces(p)), lambda x: _node("l", x))
    return F.transform(F.split(text, "\n\n"), lambda s: F.transform(F.split(s, "\n"), leaves))


def sections(of: Column) -> Column:
    """Of a tree, sections of paragraphs' nodes."""
    return F.transform(of, lambda s: F.transform(s, lambda p: _node("p", F.concat_ws("", p))))


def section_nodes(of: Column) -> Column:
    """Of sections(), their nodes."""
    return F.transform(of, lambda s: _node("s", F.concat_ws("", s)))


def root(nodes: Column) -> Column:
    """Of section_nodes(), the fingerprint."""
    return _node("r", F.concat_ws("", nodes))


def leaves(of: Column) -> Column:
    return F.array_distinct(F.flatten(F.flatten(of)))


def likeness(left: Column, right: Column) -> Column:
    """Of two arrays of leaves()."""
    both = F.size(F.array_intersect(left, right))
    return both / (F.size(left) + F.size(right) - both)


def changed_paragraphs(left: Column, right: Column) -> Column:
    """Nodes of paragraphs in the right sections() that the left ones lack: found in the sections that the left lacks."""
    nodes = section_nodes(right)
    lacking = F.array_repeat(F.array_except(nodes, section_nodes(left)), F.size(right))  # beside each section, so that it is made once
    new = F.filter(F.arrays_zip(nodes.alias("node"), right.alias("own"), lacking.alias("lacking")), lambda s: F.array_contains(s["lacking"], s["node"]))
    return F.array_except(F.flatten(F.transform(new, lambda s: s["own"])), F.flatten(left))


def _count_below(bounds: list[int], key: Column, equal: bool) -> Column:
    """How many of the sorted bounds are less than a key (or equal to it), by way of every 128th of them."""
    side, test = 128, (lambda b: b <= key) if equal else (lambda b: b < key)
    parts = [bounds[i : i + side] for i in range(0, len(bounds), side)]
    constant = lambda x, kind: F.from_json(F.lit(json.dumps(x)), kind)
    part = F.size(F.filter(constant([p[0] for p in parts], "array<bigint>"), test))
    inside = F.size(F.filter(F.get(constant(parts, "array<array<bigint>>"), part - 1), test))
    return F.when(part == 0, 0).otherwise((part - 1) * side + inside)


def _borders(docs: DataFrame) -> list[int]:
    """Ids between ranges of about equal bytes, from a sample; an id that fills several ranges comes several times."""
    share = min(1.0, SAMPLED / max(1, docs.count()))
    drawn = docs.filter(F.shiftrightunsigned(F.xxhash64("key", "tie", F.lit(1)), 11) < F.lit(share * float(1 << 53)))
    got = drawn.select("key", (F.octet_length("text") + 64).cast("long").alias("size")).toPandas().sort_values("key")
    sums = np.cumsum(got["size"].to_numpy(np.int64))
    n = min(RANGES, -(-int(sums[-1] / share) // RANGE_BYTES)) if len(sums) else 1
    return got["key"].to_numpy()[np.searchsorted(sums, np.arange(1, n) * (sums[-1] / n))].tolist() if n > 1 else []


def with_next(docs: DataFrame) -> DataFrame:
    """doc_id, text, tree; next_text, next_leaves of the document after it in descending order of ids (after the last, the first).
    Documents are dealt to ranges of ids, an id that is more than a range by the hash of its texts; each range also gets a copy of the
    first document below it, so that each document finds the next one in its own range: one shuffle of the texts, and no task with more
    than about a range, wherever ids lie."""
    spark = docs.sparkSession
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)).alias("key"))
    docs = docs.withColumn("tie", F.xxhash64("text"))
    if borders := _borders(docs):
        low, high = _count_below(borders, F.col("key"), False), _count_below(borders, F.col("key"), True)
        part = F.floor((F.col("tie").cast("double") / float(1 << 64) + 0.5) * (high - low + 1)).cast("int")
        docs = docs.withColumn("range", low + F.when(high > low, F.least(part, high - low)).otherwise(0))
    else:
        docs = docs.withColumn("range", F.lit(0))
    place = F.struct(F.col("doc_id").isNotNull(), "key", "tie")
    tops = docs.groupBy("range").agg(F.max(place).alias("top")).orderBy("range").collect()  # RANGES rows at most
    visits = [(t["range"], *t["top"], tops[(i + 1) % len(tops)]["range"]) for i, t in enumerate(tops)]
    visits = F.broadcast(spark.createDataFrame(visits, "range int, real boolean, key long, tie long, visited int"))
    dealt = docs.withColumn("real", F.col("doc_id").isNotNull()).join(visits, ["range", "real", "key", "tie"], "left")
    own, guest = F.struct(F.col("range"), F.lit(False).alias("visitor")), F.struct(F.col("visited").alias("range"), F.lit(True).alias("visitor"))
    both = F.when(F.col("visited").isNull(), F.array(own)).otherwise(F.array(own, guest))
    dealt = dealt.select("doc_id", "text", "tie", F.inline(both)).repartition(max(1, len(tops)), "range").withColumn("tree", tree(F.col("text")))
    order = Window.partitionBy("range").orderBy("visitor", F.col("doc_id").desc_nulls_last(), F.col("tie").desc())
    dealt = dealt.withColumn("next", F.lead(F.struct("text", leaves(F.col("tree")).alias("leaves"))).over(order))
    return dealt.filter(~F.col("visitor")).select("doc_id", "text", "tree", F.col("next.text").alias("next_text"), F.col("next.leaves").alias("next_leaves"))


def fingerprint_edits(docs: DataFrame) -> DataFrame:
    """Fingerprints of all texts, and of each text whose last third is replaced by the start of the next document; and how many
    different paragraphs the edit made."""
    n, third = F.length("text"), F.floor(F.length("text") / 3).cast("int")
    edited = F.concat(F.substr("text", F.lit(1), n - third), F.substr("next_text", F.lit(1), third))
    rows = with_next(docs).withColumn("edited", edited).withColumn("edited_tree", tree(F.col("edited")))
    rows = rows.withColumns({"a": sections(F.col("tree")), "b": sections(F.col("edited_tree")), "own": leaves(F.col("tree"))})
    return rows.select(
        "doc_id", n.cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), root(section_nodes(F.col("a"))).alias("fingerprint"), root(section_nodes(F.col("b"))).alias("edited_fingerprint"),
        likeness(F.col("own"), leaves(F.col("edited_tree"))).alias("near_edited"), likeness(F.col("own"), F.col("next_leaves")).alias("near_next"),
        F.size(F.flatten("a")).alias("n_paragraphs"), F.size(changed_paragraphs(F.col("a"), F.col("b"))).alias("n_changed_paragraphs"),
    )


def op1_merkle_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_edits(table(spark, sf_dir, "documents"))


def _sql_tree(text: str) -> str:
    leaves = f"list_transform(case when p = '' then [''] else regexp_extract_all(hex(p), '{LEAVES}') end, lambda x: sha256('l' || x))"
    return f"list_transform(string_split({text}, chr(10) || chr(10)), lambda s: list_transform(string_split(s, chr(10)), lambda p: {leaves}))"


def _sql_likeness(left: str, right: str) -> str:
    both = f"len(list_intersect({left}, {right}))"
    return f"{both} / (len({left}) + len({right}) - {both})"


_SQL_PARAGRAPHS = "list_transform({0}, lambda s: list_transform(s, lambda p: sha256('p' || array_to_string(p, ''))))"
_SQL_ROOT = "sha256('r' || array_to_string(list_transform({0}, lambda s: sha256('s' || array_to_string(s, ''))), ''))"

OP1_SQL = f"""
with docs as (select doc_id, coalesce(text, '') as text from documents),
followed as (select *, coalesce(lead(text) over w, first_value(text) over w) as after from docs window w as (order by doc_id desc)),
edits as (select *, substring(text, 1, length(text) - length(text) // 3) || substring(after, 1, length(text) // 3) as edited from followed),
trees as (select *, {_sql_tree("text")} as t, {_sql_tree("edited")} as e, {_sql_tree("after")} as n from edits),
parts as (
  select *, {_SQL_PARAGRAPHS.format("t")} as a, {_SQL_PARAGRAPHS.format("e")} as b, list_distinct(flatten(flatten(t))) as x, list_distinct(flatten(flatten(e))) as y, list_distinct(flatten(flatten(n))) as z from trees)
select doc_id, length(text) as n_chars, sha256(edited) as edited_sha256, {_SQL_ROOT.format("a")} as fingerprint, {_SQL_ROOT.format("b")} as edited_fingerprint,
       {_sql_likeness("x", "y")} as near_edited, {_sql_likeness("x", "z")} as near_next, cast(len(flatten(a)) as integer) as n_paragraphs,
       cast(len(list_filter(list_distinct(flatten(b)), lambda q: not list_contains(flatten(a), q))) as integer) as n_changed_paragraphs
from parts
"""
