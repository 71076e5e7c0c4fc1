"""What the operators share: reading the tables, and cutting lineage by tables in the cluster's shared folder."""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

#: A word, everywhere in this package: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, or a folder in the warehouse where that is unset: driver and executors see both."""
    where = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    return (where or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch").rstrip("/")


def _file_system(spark: SparkSession, path: str) -> tuple:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), at


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, deleted when the application ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    fs, at = _file_system(spark, path)
    fs.mkdirs(at)
    fs.deleteOnExit(at)
    return path


def settle(df: DataFrame, name: str) -> DataFrame:
    """The same rows, read back from a table written to the shared folder: lineage ends here, so a lost executor costs only
    the tasks it ran. The table goes with discard(), or else when the application ends."""
    spark, path = df.sparkSession, scratch(df.sparkSession, name)
    df.write.mode("overwrite").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._settled = path  # for discard()
    return out


def discard(df: DataFrame | None) -> None:
    """Deletes the table behind what settle() returned, once nothing reads it any more."""
    if df is not None and getattr(df, "_settled", None):
        fs, at = _file_system(df.sparkSession, df._settled)
        fs.delete(at, True)


def quotas(counts: dict, sample: int) -> dict:
    """Of `sample` rows, how many of each class: as many of each, and where a class has fewer, all of it; one at least."""
    out, left = {}, sample
    for i, (name, n) in enumerate(sorted(counts.items(), key=lambda x: (x[1], x[0]))):
        out[name] = min(n, max(1, left // (len(counts) - i)))
        left -= out[name]
    return out


def sample_by_class(rows: DataFrame, col: str, sample: int, keys: tuple[str, ...] = ("doc_id",)) -> tuple[DataFrame, dict, dict]:
    """(keys, col) of quotas() of rows of each class (those with the smallest hash of their keys), for broadcast; each class's number
    of rows, and of those taken. The driver gets about twice the sample."""
    spark, rows = rows.sparkSession, rows.select(*keys, col)
    counts = {r[col]: r["count"] for r in rows.groupBy(col).count().collect()}
    quota = quotas(counts, sample)
    # shares of 2^53 under which about twice the quota lies
    under = [(c, min(1.0, (2 * quota[c] + 50) / n)) for c, n in counts.items()]
    under = spark.createDataFrame(under, StructType([rows.schema[col], StructField("under", DoubleType())]))
    place = F.shiftrightunsigned(F.xxhash64(*keys), 11)
    got = rows.join(F.broadcast(under), col).withColumn("place", place).filter(F.col("place") < F.col("under") * F.lit(float(1 << 53)))
    taken, chosen = dict.fromkeys(counts, 0), []
    for r in sorted(got.select(*keys, col, "place").distinct().collect(), key=lambda r: (r["place"], *(str(r[k]) for k in keys))):
        if taken[r[col]] < quota[r[col]]:
            taken[r[col]] += 1
            chosen.append((*(r[k] for k in keys), r[col]))
    return spark.createDataFrame(chosen, rows.schema), counts, taken


#: Bytes of text in a sample.
SAMPLE_BYTES = 128 << 20


def within_bytes(rows: DataFrame, chosen: DataFrame, taken: dict, keys: list[str], limit: int = SAMPLE_BYTES) -> tuple[DataFrame, dict]:
    """Of a sample by class, and its numbers of rows, what `limit` bytes of text hold: each class has its rows' share of them, and a text that
    is larger than what is left of it is passed over for the next. The driver gets one number for each row of the sample."""
    sizes = rows.join(F.broadcast(chosen), keys).groupBy(*chosen.columns).agg(F.max(F.octet_length("text")).alias("_bytes"))
    size, col = {tuple(r)[:-1]: r["_bytes"] for r in sizes.collect()}, chosen.columns[-1]
    left, kept, every = {c: limit * n // max(1, sum(taken.values())) for c, n in taken.items()}, [], chosen.collect()
    for r in every:
        n = size.get(tuple(r), 0)
        if n <= left[r[col]]:
            left[r[col]] -= n
            kept.append(tuple(r))
    if len(kept) == len(every):
        return chosen, taken
    return rows.sparkSession.createDataFrame(kept, chosen.schema), {c: sum(r[-1] == c for r in kept) for c in taken}


def first_rows(rows: DataFrame, chosen: DataFrame, keys: list[str]) -> DataFrame:
    """Of the rows with a chosen key, one for each (the one whose text has the smallest hash), so that repeated rows bring one text."""
    got = rows.join(F.broadcast(chosen), keys)
    return got.groupBy(*chosen.columns).agg(F.min_by("text", F.xxhash64("text")).alias("text"))


def crc_mod(doc_id: str, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % n


def text_column(batch: pa.RecordBatch) -> pa.Array:
    """The column `text`, or that of the packed documents in `_doc`, so that no text is sent twice."""
    at = batch.schema.get_field_index("text")
    return batch.column(at) if at >= 0 else batch.column("_doc").field("text")
