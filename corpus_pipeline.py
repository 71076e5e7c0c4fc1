"""The corpus pipeline: what is toxic goes, one document of each group of near copies stays, repeated passages go, sources are mixed
to their weights, and documents are packed into token sequences.

Each stage takes (spark, docs, sf_dir), docs being what the stage before returned, and works on all of it. Nulls, empty texts,
repeated rows and empty tables are handled as the operators' modules say; extra columns are kept by all stages but the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import settle, table
from millrace.llm.minhash import near_duplicates
from millrace.llm.mixing import mixed_documents
from millrace.llm.packing import pack_documents
from millrace.llm.suffixes import without_repeats
from millrace.llm.toxicity import REJECT, fit_toxicity, with_score


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learns from all labels of the documents there are, and keeps the documents that score below REJECT."""
    model = fit_toxicity(docs, table(spark, sf_dir, "labels"), F.lit(True))
    return with_score(docs, model).filter(F.col("score") < REJECT).select("_doc.*")


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with 80 of 100 five-word shingles in common, directly or through others, the one with the smallest id. Rows that
    repeat an id are one document, and share its fate."""
    groups = near_duplicates(docs, k=5, num=80).filter(~F.col("kept")).select("doc_id").distinct()
    return docs.join(groups, "doc_id", "left_anti").select(*docs.columns)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes out what lies in a passage of 100 bytes that also starts earlier. Documents stay, even without any text left; n_chars, if
    there is such a column, is counted again."""
    cut = without_repeats(docs)
    return cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else cut


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target takes them."""
    return mixed_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack_documents(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near-duplicates", one_of_each_group),
    ("repeated passages", cut_repeats),
    ("mixing", mix_sources),
    ("packing", pack),
]

#: Learned scores can't be had in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
