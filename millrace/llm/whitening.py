"""Whitening of embeddings through the singular values of the centred rows.

Entries become whole numbers (floor(64 * c) + 1000000), so that sums are exact. No covariance matrix is formed, which would square the
condition of the data:

1. Exact sums of each dimension: a row a task, added in Spark.
2. Blockwise QR: each task keeps one triangle R for all centred rows it has read (QR of R above the next block), and triangles are merged by
   64 in rounds, so that no task or driver gets more than 64 of them, each dims * dims numbers, whatever the number of rows.
3. On the one R that is left: Householder bidiagonalisation, dqds for the singular values, twisted factorisations for the right singular
   vectors (bidiagonal.py). R'R is n times the covariance, so these are its eigenvectors, and e = (singular value)^2 / n.
4. Rows are projected. The identity error comes from sums of products over all whitened rows: a row a task, added in Spark.

A row goes if its vector is null or empty or has a null or non-finite entry, or another length than most of the others have (of equally
frequent lengths, the longest counts). A null vec_id stays null. Repeated rows are rows. Where fewer than 32 directions vary (a singular value
over 64 * dims times the rounding error of the largest), there are only those; rows that are all equal, one row and an empty table give
an empty result. A deviation that doesn't fit into 64 bits is null. Other columns are left alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.bidiagonal import EPS, bidiagonalise, right_vectors, squared_singular_values
from millrace.llm.common import discard, settle, table

COMPONENTS, SCALE, LIFT = 32, 64, 1_000_000
#: Entries of a block, and triangles that are merged at once.
BLOCK, FAN_IN = 1 << 20, 64


def _blocks(batches: Iterator[pa.RecordBatch], dims: int) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """(ids, x): vectors as whole numbers, some rows at a time."""
    step = max(1, BLOCK // dims)
    for batch in batches:
        for at in range(0, len(batch), step):
            part = batch.slice(at, step)
            c = part.column("v").flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, dims)
            yield part.column("id"), np.floor(SCALE * c).astype(np.int64) + LIFT


@dataclass
class Centred:
    """What all rows have in common: their number and the exact sum of each dimension."""

    n: int
    sums: np.ndarray

    def scaled(self, x: np.ndarray) -> np.ndarray:
        """n * x - S, exact."""
        return self.n * x - self.sums

    def of(self, x: np.ndarray) -> np.ndarray:
        return self.scaled(x) / self.n

    def deviation(self, x: np.ndarray) -> pa.Array:
        d = self.scaled(x)
        if d.size and float(np.abs(d).max()) ** 2 * d.shape[1] >= 2.0**62:
            exact = [sum(v * v for v in row) for row in d.tolist()]
            return pa.array([v if v < 1 << 63 else None for v in exact], pa.int64())
        return pa.array((d * d).sum(1), pa.int64())


def vectors_of(df: DataFrame, id_col: str, col: str) -> tuple[DataFrame, int]:
    """(id, v) of the rows that count, and the vectors' length (0 if there are none)."""
    c = F.col(col).cast("array<double>")
    fine = F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = df.select(F.col(id_col).alias("id"), c.alias("v")).filter(c.isNotNull() & (F.size(c) > 0) & fine)
    usual = rows.groupBy(F.size("v").alias("dims")).count().orderBy(F.desc("count"), F.desc("dims")).first()  # one row
    return (rows.filter(F.size("v") == usual["dims"]), usual["dims"]) if usual else (rows, 0)


def _added(df: DataFrame, kind: str) -> list:
    """Sums of the arrays `s`, place by place: (total of n, the sums). The driver gets one number for each place."""
    placed = df.select("n", F.posexplode("s").alias("at", "x")).groupBy("at").agg(F.sum("n").cast("long").alias("n"), F.sum("x").cast(kind).alias("x"))
    got = placed.orderBy("at").collect()
    return [got[0]["n"] if got else 0, [r["x"] for r in got]]


def exact_sums(rows: DataFrame, dims: int) -> Centred:
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, s = 0, np.zeros(dims, np.int64)
        for _, x in _blocks(batches, dims):
            n, s = n + len(x), s + x.sum(0)
        yield pa.RecordBatch.from_pylist([{"n": n, "s": s.tolist()}], pa.schema([("n", pa.int64()), ("s", pa.list_(pa.int64()))]))

    n, s = _added(rows.mapInArrow(add, "n long, s array<long>"), "long")
    return Centred(n, np.array(s, np.int64))


_TRIANGLE = pa.schema([("part", pa.int64()), ("r", pa.binary())])


def _stacked(r: np.ndarray, more: np.ndarray) -> np.ndarray:
    return np.linalg.qr(np.vstack((r, more)), mode="r")


def triangle(rows: DataFrame, dims: int, centred: Centred) -> np.ndarray:
    """R of the QR factorisation of all centred rows."""

    def reduce_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = np.empty((0, dims))
        for _, x in _blocks(batches, dims):
            r = _stacked(r, centred.of(x))
        if len(r):
            yield pa.RecordBatch.from_pylist([{"part": TaskContext.get().partitionId(), "r": r.tobytes()}], _TRIANGLE)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r, part = np.empty((0, dims)), None
        for batch in batches:
            for row in batch.to_pylist():
                r, part = _stacked(r, np.frombuffer(row["r"]).reshape(-1, dims)), row["part"]
        if part is not None:
            yield pa.RecordBatch.from_pylist([{"part": part, "r": r.tobytes()}], _TRIANGLE)

    parts = settle(rows.mapInArrow(reduce_rows, "part long, r binary"), "triangles")
    while (n := parts.count()) > 1:
        groups = -(-n // FAN_IN)
        dealt = parts.withColumn("part", F.floor(F.col("part") / FAN_IN)).repartition(groups, "part")
        before, parts = parts, settle(dealt.sortWithinPartitions("part").mapInArrow(merge, "part long, r binary"), "triangles")
        discard(before)
    r = np.frombuffer(parts.first()["r"]).reshape(-1, dims) if n else np.empty((0, dims))
    discard(parts)
    return np.vstack((r, np.zeros((max(0, dims - len(r)), dims))))


@dataclass
class Whitening:
    """directions: a column for each component, e: its eigenvalue, trace: that of the covariance."""

    centred: Centred
    directions: np.ndarray
    e: np.ndarray
    trace: float

    def apply(self, x: np.ndarray) -> np.ndarray:
        return self.centred.of(x) @ (self.directions / np.sqrt(self.e))


def directions_of(r: np.ndarray, n: int, components: int) -> tuple[np.ndarray, np.ndarray, float]:
    """(directions, e, trace) from the triangle of n rows."""
    a, b, v = bidiagonalise(r)
    norm = float(np.linalg.norm(r))
    if norm == 0:
        return np.empty((len(v), 0)), np.empty(0), 0.0
    a = np.where(np.abs(a) < EPS * norm, EPS * norm, a)  # a zero would divide, and this much is below what counts
    squared = squared_singular_values(a, b)
    kept = int((np.sqrt(squared[:components]) > 64 * len(a) * EPS * np.sqrt(squared[0])).sum())
    return v @ right_vectors(a, b, squared[:kept]), squared[:kept] / n, float(squared.sum() / n)


def fit_whitening(rows: DataFrame, dims: int, components: int = COMPONENTS) -> Whitening:
    centred = exact_sums(rows, dims)
    return Whitening(centred, *directions_of(triangle(rows, dims, centred), centred.n, components))


def identity_error(rows: DataFrame, dims: int, model: Whitening) -> float:
    """The largest absolute entry of the whitened rows' covariance minus the identity."""
    k = len(model.e)

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, s = 0, np.zeros((k + 1, k))
        for _, x in _blocks(batches, dims):
            w = model.apply(x)
            n, s = n + len(x), s + np.vstack((w.sum(0), w.T @ w))
        yield pa.RecordBatch.from_pylist([{"n": n, "s": s.ravel().tolist()}], pa.schema([("n", pa.int64()), ("s", pa.list_(pa.float64()))]))

    n, s = _added(rows.mapInArrow(products, "n long, s array<double>"), "double")
    mean, product = np.split(np.array(s).reshape(k + 1, k) / n, [1])
    return float(np.abs(product - mean.T @ mean - np.eye(k)).max())


OUT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whiten(df: DataFrame, components: int = COMPONENTS, id_col: str = "vec_id", col: str = "embedding") -> DataFrame:
    """A row for each vector and component."""
    spark = df.sparkSession
    rows, dims = vectors_of(df, id_col, col)
    model = fit_whitening(rows, dims, components) if dims else None
    if model is None or not len(model.e):
        return spark.createDataFrame([], OUT)
    error, k = identity_error(rows, dims, model), len(model.e)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, x in _blocks(batches, dims):
            each = np.repeat(np.arange(len(x)), k)
            same = lambda v, kind: pa.array(np.full(len(each), v), kind)
            columns = [
                ids.cast(pa.int64()).take(pa.array(each)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))), same(model.centred.n, pa.int64()), model.centred.deviation(x).take(pa.array(each)),
                pa.array(model.apply(x).ravel()), pa.array(np.tile(model.e / model.trace, len(x))), same(error, pa.float64()),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(project, OUT)


def op11_whiten_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))
