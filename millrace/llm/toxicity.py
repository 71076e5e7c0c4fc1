"""Toxicity by a factorization machine over hashed terms.

A text's features are its different terms, hashed into buckets: runs of letters and digits, A-Z lowered, and the first four to
seven bytes of longer ones, which words with one stem share. The score is the logistic
of bias + sum of weights + sum over pairs of terms of the product of their factor vectors: pairs such as an insult beside a
group's name count for more than their two weights. Trained by AdaGrad with an L1 penalty on weights, on a sample of labelled
documents bounded by `sample`, half of them of each label (those with the smallest hash of their ids; all of a label that has fewer),
weighted by their label's share of all labelled ones; everything else reads all rows whole.

The driver holds the sample's bucket numbers and the model (BUCKETS * (RANK + 1) floats), whatever the input's size. Null and
empty texts have no terms and get the bias's score; a null label, or one that is neither a number nor a boolean, is no label; of
several labels of one id the largest holds (above 0: toxic), of several texts of one id one is learned from; repeated rows each get a row. Without a label the score is 0.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import crc_mod, first_rows, sample_by_class, table, text_column, within_bytes
from millrace.llm.textbytes import NO_TERM, blocks, lower_ascii, prefix, range_hash, words

BUCKETS, RANK = 1 << 18, 4
STEMS = (4, 5, 6, 7)
SAMPLE, EPOCHS, BATCH, RATE, L1, L2 = 12_000, 10, 256, 0.1, 2e-4, 1e-3
#: Factors learn slower, and after so many passes of the weights alone.
FACTOR_RATE, LINEAR = 0.002, 2
#: A toxic document counts as so many others.
POSITIVE = 3
#: Small samples are passed more often, for so many steps.
STEPS = 300
#: Terms of fewer labelled documents stay at zero.
MIN_DOCS = 5
REJECT = 0.3
_SHIFT = np.uint64(18)


def term_buckets(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bounds, buckets): row first + i has the different buckets[bounds[i]:bounds[i + 1]]."""
    for lo, hi, buf, offsets in blocks(batch):
        start, end, first = words(buf, offsets, NO_TERM)
        sums, doc = prefix(lower_ascii(buf)), np.repeat(np.arange(hi - lo, dtype=np.uint64), np.diff(first))
        keys = [(doc << _SHIFT) | (range_hash(sums, start, end) >> (np.uint64(64) - _SHIFT))]
        for stem in STEMS:
            own = end - start > stem
            keys.append((doc[own] << _SHIFT) | ((range_hash(sums, start[own], start[own] + stem) * np.uint64(stem * 2 + 1)) >> (np.uint64(64) - _SHIFT)))
        key = np.sort(np.concatenate(keys))
        key = key[np.concatenate(([True], key[1:] != key[:-1]))] if len(key) else key
        yield lo, np.searchsorted(key >> _SHIFT, np.arange(hi - lo + 1, dtype=np.uint64)), (key & np.uint64(BUCKETS - 1)).astype(np.int32)


class Machine:
    """A factorization machine over binary features."""

    def __init__(self, seed: int = 11):
        self.bias, self.w = np.float32(0), np.zeros(BUCKETS, np.float32)
        self.v = np.random.default_rng(seed).normal(0, 0.01, (BUCKETS, RANK)).astype(np.float32)

    def _sums(self, bounds: np.ndarray, x: np.ndarray) -> np.ndarray:
        """Of each document, sums of weight, factors and squared factors."""
        v = self.v[x]
        rows = np.concatenate((self.w[x][:, None], v, v * v), 1)
        out = np.zeros((len(bounds) - 1, rows.shape[1]), np.float32)
        full = np.diff(bounds) > 0
        if len(x):
            out[full] = np.add.reduceat(rows, bounds[:-1][full], axis=0)
        return out

    def score(self, bounds: np.ndarray, x: np.ndarray) -> np.ndarray:
        return self._logistic(self._sums(bounds, x))

    def _logistic(self, s: np.ndarray) -> np.ndarray:
        z = self.bias + s[:, 0] + 0.5 * ((s[:, 1 : RANK + 1] ** 2).sum(1) - s[:, RANK + 1 :].sum(1))
        return 1 / (1 + np.exp(-np.clip(z.astype(np.float64), -30, 30)))

    def fit(self, docs: list[np.ndarray], label: np.ndarray, seed: int = 5, factor_rate: float = FACTOR_RATE, weight: tuple[float, float] = (1, 1)) -> Machine:
        """weight: what a document of label 0 and of label 1 counts."""
        rng, seen = np.random.default_rng(seed), np.zeros(BUCKETS, np.int64)
        for d in docs:
            seen[d] += 1
        used = np.flatnonzero(seen >= MIN_DOCS)
        name = np.full(BUCKETS, -1, np.int32)
        name[used] = np.arange(len(used), dtype=np.int32)
        docs = [(n := name[d])[n >= 0] for d in docs]
        size, n = np.array([len(d) for d in docs]), len(used)
        own = Machine()
        own.w, own.v = np.zeros(n, np.float32), self.v[used]
        gw, gv, gb = np.full(n, 1e-6, np.float32), np.full((n, RANK), 1e-6, np.float32), 1e-6
        cost = np.where(label > 0, weight[1], weight[0])
        mean = np.clip(np.average(label, weights=cost), 1e-3, 1 - 1e-3)
        cost = np.where(label > 0, POSITIVE, 1) * cost
        own.bias = np.float32(np.log(mean / (1 - mean)))
        for turn in range(max(EPOCHS, -(-STEPS * BATCH // len(docs)))):
            order = rng.permutation(len(docs))
            for at in range(0, len(order), BATCH):
                rows = order[at : at + BATCH]
                x, bounds = np.concatenate([docs[i] for i in rows]), np.concatenate(([0], np.cumsum(size[rows])))
                sums = own._sums(bounds, x)
                miss = ((own._logistic(sums) - label[rows]) * cost[rows] / len(rows)).astype(np.float32)
                doc = np.repeat(np.arange(len(rows)), size[rows])
                each, total = miss[doc], sums[doc, 1 : RANK + 1]
                dw = np.bincount(x, each, n).astype(np.float32)
                pull = np.bincount(x, each, n)[:, None] * own.v
                dv = (np.stack([np.bincount(x, each * total[:, k], n) for k in range(RANK)], 1) - pull).astype(np.float32)
                here = dw != 0
                gw += dw * dw
                gv += dv * dv
                gb += float(miss.sum()) ** 2
                rate = here * RATE / np.sqrt(gw)
                w = own.w - rate * dw
                own.w = np.sign(w) * np.maximum(np.abs(w) - rate * L1, 0)
                own.v -= here[:, None] * (factor_rate / np.sqrt(gv)) * (dv + L2 * own.v) if turn >= LINEAR else 0
                own.bias -= np.float32(RATE / np.sqrt(gb) * miss.sum())
        self.bias, self.v[:] = own.bias, 0
        self.w[used], self.v[used] = own.w, own.v
        return self


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        label = batch.column("label")
        for row, bounds, x in term_buckets(batch):
            packed = pa.array([x[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays([label.slice(row, len(packed)), packed], ["label", "x"])


def _score(batches: Iterator[pa.RecordBatch], model) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = pa.RecordBatch.from_arrays([text_column(batch)], ["text"])
        out = [model.value.score(bounds, x) if model else np.zeros(len(bounds) - 1) for _, bounds, x in term_buckets(texts)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(out) if out else np.zeros(0))], [batch.schema.names[0], "score"])


def fit_toxicity(docs: DataFrame, labels: DataFrame, usable: Column, sample: int = SAMPLE) -> Machine | None:
    """Learns from at most `sample` labelled documents, and SAMPLE_BYTES of text, for which `usable` (over doc_id) holds."""
    toxic = F.when(F.col("toxic").cast("string").try_cast("double").isNotNull(), F.col("toxic").cast("string").try_cast("double") > 0).otherwise(F.col("toxic").cast("string").try_cast("boolean")).cast("int")
    chosen = labels.filter(F.col("doc_id").isNotNull() & usable).groupBy("doc_id").agg(F.max(toxic).alias("label")).filter("label is not null")
    chosen, counts, taken = sample_by_class(chosen, "label", sample)
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    chosen, taken = within_bytes(texts, chosen, taken, ["doc_id"])
    rows = first_rows(texts, chosen, ["doc_id"]).select("label", "text")
    got = rows.mapInArrow(_features, "label int, x binary").toArrow()
    share = len(got) and sum(taken.values()) / sum(counts.values())
    weight = tuple(share * sum(n for c, n in counts.items() if (c > 0) == side) / max(1, sum(n for c, n in taken.items() if (c > 0) == side)) for side in (False, True))
    return Machine().fit([np.frombuffer(x.as_buffer(), np.int32) for x in got.column("x")], got.column("label").to_numpy().astype(np.float32), weight=weight) if len(got) else None


def with_score(docs: DataFrame, model: Machine | None) -> DataFrame:
    """(_doc, score): all columns of docs, packed, and the score of the text."""
    shared = docs.sparkSession.sparkContext.broadcast(model) if model else None
    rows = docs.select(F.struct("*").alias("_doc"))
    return rows.mapInArrow(partial(_score, model=shared), rows.select("_doc", F.lit(0.0).alias("score")).schema)


def score_documents(docs: DataFrame, labels: DataFrame, threshold: float = REJECT) -> DataFrame:
    held_out = crc_mod("doc_id", 4) == 2
    model = fit_toxicity(docs, labels, ~held_out)
    shared = docs.sparkSession.sparkContext.broadcast(model) if model else None
    out = docs.select("doc_id", "text").mapInArrow(partial(_score, model=shared), docs.select("doc_id", F.lit(0.0).alias("score")).schema)
    return out.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def op4_toxicity_fm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
