"""Language identification by a linear-chain conditional random field over words.

A word's features are hashed: the word itself (lexicon), its first and last two and three bytes (affixes) and its byte trigrams.
Their weights and the transitions between languages are learned together, by gradients of the chain's likelihood, from a sample
of labelled documents bounded by `sample` and in bytes (common.py), as many of each language (those with the smallest hash of id and text; all of a language that
has fewer, so that rare ones are learned). Training chains are spliced from pieces of
several documents, so that transitions are learned from text that switches languages. Forward-backward gives each word's
probability of each language; a document's language is the one with the largest mean.

Chains run over whole documents, whatever their length: the products of each SEGMENT words' transfer matrices are made for all
segments at once, carried from segment to segment, and spread again within the segments, which is the same sum.

Text without a letter, or null, is `und` with score 0, and so is all text if nothing could be learned. Ties go to the first
language by name. Null ids are as others (their hash is that of empty text); repeated rows each get a row; other columns are left
alone. The driver holds the sample's words and the model (BUCKETS weights a language), whatever the input's size.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import crc_mod, first_rows, sample_by_class, table, within_bytes
from millrace.llm.textbytes import blocks, lower_ascii, mix, prefix, range_hash, words

UNKNOWN = "und"
BUCKETS, SEGMENT = 1 << 16, 64
SAMPLE, CHAINS, BATCH, RATE, L2 = 1500, 6000, 64, 0.2, 1e-6


def _few(buf: np.ndarray, at: np.ndarray, size: int, kind: int) -> np.ndarray:
    """Hashes of the two or three bytes at each place, others for each kind of feature."""
    value = np.full(len(at), kind, np.uint64)
    for i in range(size):
        value = value << np.uint64(8) | buf[at + i]
    return mix(value)


def word_features(buf: np.ndarray, start: np.ndarray, end: np.ndarray, whole: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(word, bucket) of each feature of the words at start..end of a block, `whole` being the words' hashes."""
    n, every = end - start, np.arange(len(start))
    of, value = [every], [whole]
    for kind, size, at in ((3, 2, start), (5, 3, start), (7, 2, end - 2), (9, 3, end - 3)):
        own = n > size
        of.append(every[own])
        value.append(_few(buf, at[own], size, kind))
    grams = np.maximum(n - 2, 0)
    word = np.repeat(every, grams)
    at = start[word] + np.arange(len(word)) - np.repeat(np.cumsum(grams) - grams, grams)
    of.append(word)
    value.append(_few(buf, at, 3, 11))
    return np.concatenate(of), (np.concatenate(value) >> np.uint64(48)).astype(np.int64)


class Field:
    """A linear-chain CRF; languages in order of name."""

    def __init__(self, languages: list[str]):
        self.languages, k = languages, len(languages)
        self.w, self.move = np.zeros((BUCKETS, k), np.float32), np.zeros((k, k))

    def emissions(self, buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """exp of the words' scores, the best language's scaled to 1. Words of one hash are looked at once."""
        whole, first, inverse = np.unique(range_hash(prefix(buf), start, end), return_index=True, return_inverse=True)
        of, bucket = word_features(buf, start[first], end[first], whole)
        score = np.stack([np.bincount(of, self.w[bucket, j], len(first)) for j in range(len(self.languages))], 1)
        return np.exp(score - score.max(1, keepdims=True))[inverse]

    def marginals(self, chance: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Each word's probabilities, of chains of words bounds[i]:bounds[i + 1] with the emissions `chance`."""
        k, n = chance.shape[1], np.diff(bounds)
        segments = -(-n // SEGMENT)
        begin = np.concatenate(([0], np.cumsum(segments)))
        chain = np.repeat(np.arange(len(n)), segments)
        at = bounds[chain] + (np.arange(begin[-1]) - begin[chain]) * SEGMENT
        size = np.minimum(SEGMENT, bounds[chain + 1] - at)
        step = np.exp(self.move - self.move.max())
        grid = at[:, None] + np.arange(SEGMENT)
        real = np.arange(SEGMENT) < size[:, None]
        e = np.where(real[:, :, None], chance[np.minimum(grid, len(chance) - 1)], 1).transpose(1, 0, 2)
        real = real.T
        through = np.broadcast_to(np.eye(k), (begin[-1], k, k)).copy()
        for t in range(SEGMENT):
            after = (through.reshape(-1, k) @ step).reshape(-1, k, k) * e[t][:, None, :]
            through = np.where(real[t][:, None, None], after / after.max((1, 2), keepdims=True), through)
        ahead, back = np.full((begin[-1], k), 1 / k), np.full((begin[-1], k), 1 / k)
        for j in range(1, int(segments.max(initial=0))):
            s = begin[:-1][segments > j] + j
            a = (ahead[s - 1][:, None, :] @ through[s - 1])[:, 0]
            ahead[s] = a / a.sum(1, keepdims=True)
            s = begin[1:][segments > j] - 1 - j
            b = (through[s + 1] @ back[s + 1][:, :, None])[:, :, 0]
            back[s] = b / b.sum(1, keepdims=True)
        alpha = np.empty((SEGMENT, begin[-1], k))
        for t in range(SEGMENT):
            a = (ahead @ step) * e[t]
            ahead = alpha[t] = np.where(real[t][:, None], a / a.sum(1, keepdims=True), ahead)
        for t in range(SEGMENT - 1, -1, -1):
            alpha[t] *= back
            b = (back * e[t]) @ step.T
            back = np.where(real[t][:, None], b / b.sum(1, keepdims=True), back)
        out = alpha.transpose(1, 0, 2)[real.T]
        return out / out.sum(1, keepdims=True)

    def fit(self, docs: list[tuple[np.ndarray, np.ndarray, np.ndarray]], seed: int = 3) -> Field:
        """docs: numbers of features of a document's words, the features, and its language's number. Chains of SEGMENT words, spliced from pieces of 8
        to SEGMENT words of different documents."""
        rng, k = np.random.default_rng(seed), len(self.languages)
        docs = [(np.concatenate(([0], np.cumsum(n, dtype=np.int64))), bucket, label) for n, bucket, label in docs if len(n)]
        gw, gm = np.full((BUCKETS, k), 1e-4, np.float32), np.full((k, k), 1e-4)
        for _ in range(-(-CHAINS // BATCH) if docs else 0):
            of, bucket, truth = [], [], np.full(BATCH * SEGMENT, -1)
            for row in range(BATCH):
                t = 0
                while t < SEGMENT:
                    bounds, own, label = docs[rng.integers(len(docs))]
                    take = min(int(rng.integers(8, SEGMENT + 1)), SEGMENT - t, len(bounds) - 1)
                    a = int(rng.integers(0, len(bounds) - take))
                    bucket.append(own[bounds[a] : bounds[a + take]])
                    of.append(np.repeat(row * SEGMENT + t + np.arange(take), np.diff(bounds[a : a + take + 1])))
                    truth[row * SEGMENT + t : row * SEGMENT + t + take] = label
                    t += take
            of, bucket = np.concatenate(of), np.concatenate(bucket).astype(np.int64)
            score = np.stack([np.bincount(of, self.w[bucket, j], len(truth)) for j in range(k)], 1)
            e = np.exp(score - score.max(1, keepdims=True)).reshape(BATCH, SEGMENT, k).transpose(1, 0, 2)
            step = np.exp(self.move - self.move.max())
            alpha, beta = np.empty_like(e), np.empty_like(e)
            a, b = np.full((BATCH, k), 1 / k), np.full((BATCH, k), 1 / k)
            for t in range(SEGMENT):
                a = (a @ step) * e[t]
                alpha[t] = a = a / a.sum(1, keepdims=True)
            for t in range(SEGMENT - 1, -1, -1):
                beta[t] = b
                b = (b * e[t]) @ step.T
                b /= b.sum(1, keepdims=True)
            p = alpha * beta
            p /= p.sum(2, keepdims=True)
            pair = alpha[:-1, :, :, None] * step * (e * beta)[1:, :, None, :]
            pair /= pair.sum((2, 3), keepdims=True)
            y = truth.reshape(BATCH, SEGMENT).T
            hot = np.eye(k)[y]
            miss = ((p - hot).transpose(1, 0, 2).reshape(-1, k) / BATCH).astype(np.float32)
            dw = np.stack([np.bincount(bucket, miss[of, j], BUCKETS) for j in range(k)], 1).astype(np.float32)
            here = dw.any(1)
            dw[here] += L2 * self.w[here]
            gw += dw * dw
            self.w -= RATE * dw / np.sqrt(gw)
            seen = hot[:-1, :, :, None] * hot[1:, :, None, :]
            dm = (pair - seen).sum((0, 1)) / BATCH + 1e-3 * self.move
            gm += dm * dm
            self.move -= RATE * dm / np.sqrt(gm)
        return self


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi, buf, offsets in blocks(batch):
            start, end, first = words(buf, offsets)
            buf = lower_ascii(buf)
            of, bucket = word_features(buf, start, end, range_hash(prefix(buf), start, end))
            by = np.argsort(of, kind="stable")
            of, bucket = of[by], bucket[by]
            cuts, n = np.searchsorted(of, first), np.bincount(of, minlength=len(start)).astype(np.uint32)
            packed = [(n[first[i] : first[i + 1]].tobytes(), bucket[cuts[i] : cuts[i + 1]].astype(np.uint16).tobytes()) for i in range(hi - lo)]
            yield pa.RecordBatch.from_arrays([batch.column("lang").slice(lo, hi - lo), *(pa.array([x[j] for x in packed], pa.binary()) for j in (0, 1))], ["lang", "n", "bucket"])


def fit_languages(docs: DataFrame, usable: Column, sample: int = SAMPLE) -> Field | None:
    """Learns from at most `sample` documents that have a language and a letter and for which `usable` holds."""
    rows = docs.filter(usable & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    rows = rows.select("lang", "text", F.xxhash64("doc_id", "text").alias("row"))  # an id alone may stand in many rows
    chosen, _, taken = sample_by_class(rows, "lang", sample, ("row",))
    chosen, _ = within_bytes(rows, chosen, taken, ["row", "lang"])
    got = first_rows(rows, chosen, ["row", "lang"]).select("lang", "text").mapInArrow(_features, "lang string, n binary, bucket binary").toArrow()
    if not len(got):
        return None
    label = got.column("lang").to_pylist()
    languages = sorted(set(label))
    read = lambda column, kind: [np.frombuffer(x.as_buffer(), kind) for x in got.column(column)]
    return Field(languages).fit([(n, b, languages.index(x)) for n, b, x in zip(read("n", np.uint32), read("bucket", np.uint16), label, strict=True)])


def _identify(batches: Iterator[pa.RecordBatch], model) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi, buf, offsets in blocks(batch):
            field, n = model.value, hi - lo
            start, end, first = words(buf, offsets)
            total = np.zeros((n, len(field.languages)))
            if len(start):
                p = field.marginals(field.emissions(lower_ascii(buf), start, end), first)
                doc = np.repeat(np.arange(n), np.diff(first))
                total = np.stack([np.bincount(doc, p[:, j], n) for j in range(p.shape[1])], 1)
            count = np.diff(first)
            best = total.argmax(1)
            lang = pa.array(np.array(field.languages, object)[best], pa.string())
            score = np.minimum(total[np.arange(n), best] / np.maximum(count, 1), 1)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, n), batch.column("letter").slice(lo, n), lang, pa.array(score)], ["doc_id", "letter", "lang_pred", "score"])


def _switches(batches: Iterator[pa.RecordBatch], model) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi, buf, offsets in blocks(batch):
            field = model.value
            start, end, first = words(buf, offsets)
            best = field.marginals(field.emissions(lower_ascii(buf), start, end), first).argmax(1) if len(start) else start
            rows = []
            for i in range(hi - lo):
                a, b = first[i], first[i + 1]
                cuts = [a, *(np.flatnonzero(best[a + 1 : b] != best[a : b - 1]) + a + 1), b] if b > a else []
                rows.append([{"start": int(start[x] - offsets[i]), "end": int(end[y - 1] - offsets[i]), "lang": field.languages[best[x]]} for x, y in zip(cuts, cuts[1:], strict=False)])
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("lang", pa.string())]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, hi - lo), pa.array(rows, kind)], ["doc_id", "runs"])


def language_runs(docs: DataFrame, field: Field) -> DataFrame:
    """(doc_id, runs): for code-switched text, runs of words of one language as byte ranges of the text."""
    model = docs.sparkSession.sparkContext.broadcast(field)
    kind = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, runs array<struct<start:long,end:long,lang:string>>"
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(partial(_switches, model=model), kind)


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score."""
    held_out = crc_mod("doc_id", 5) == 0
    field = fit_languages(docs, ~held_out)
    letter = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    if field is None:
        return docs.select("doc_id", held_out.alias("held_out"), F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    model = docs.sparkSession.sparkContext.broadcast(field)
    rows = docs.select("doc_id", letter.alias("letter"), F.coalesce("text", F.lit("")).alias("text"))
    out = rows.mapInArrow(partial(_identify, model=model), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, letter boolean, lang_pred string, score double")
    pick = lambda c, none: F.when(F.col("letter"), F.col(c)).otherwise(F.lit(none)).alias(c)
    return out.select("doc_id", held_out.alias("held_out"), pick("lang_pred", UNKNOWN), pick("score", 0.0))


def op2_language_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))
