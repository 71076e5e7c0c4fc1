"""Scoring documents by masked pseudo-likelihood.

A small network reads the two words on either side of a word and predicts it: embeddings by place, a hidden layer, and a softmax
over classes of words and then over the words of the class. A document's score is the sum over all its words of the logarithm of
the probability given both sides.

The vocabulary holds the most frequent words of the whole corpus, counted over all documents (words of one hash are one word), and
a few entries for all others, dealt by hash. The probability of a word in such an entry is the entry's times the word's share of the
entry's count in the corpus, so every word itself is predicted, however many there are; the counts are joined by word.

Training covers all words of all documents: each of ROUNDS rounds takes the documents whose hash falls to it, so that each word is a
target once, dealt by the same hash to shards of about SHARD bytes. A task passes a shard in order of hash and returns its parameters,
which are averaged, weighted by words seen; the next round starts from the average. What is learned depends on the rows only, not on
how they are partitioned (but for the rounding of sums).

The driver holds the vocabulary and one set of parameters, whatever the input's size. Null and empty texts have no words, a score
of 0 and no mean. Repeated rows each get a row; null ids are as others; an empty table gives an empty result; other columns are left
alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import settle, table
from millrace.llm.textbytes import blocks, lower_ascii, prefix, range_hash, words

CLASSES, CLASS, OTHERS = 64, 32, 64
VOCABULARY, SIDE, DEPTH, HIDDEN = CLASSES * CLASS, 2, 8, 24
ROUNDS, BATCH, RATE, SHARD = 2, 2048, 0.1, 16 << 20
AROUND = np.array([*range(-SIDE, 0), *range(1, SIDE + 1)])


def word_hashes(batch: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, hashes of all words, bounds of the rows' words)."""
    for lo, hi, buf, offsets in blocks(batch):
        start, end, first = words(buf, offsets)
        yield lo, hi, range_hash(prefix(lower_ascii(buf)), start, end), first


class Network:
    def __init__(self, vocabulary: np.ndarray, seed: int = 17):
        """vocabulary: hashes of the most frequent words, the first the most frequent."""
        rng = np.random.default_rng(seed)
        self.rank = np.argsort(vocabulary).astype(np.int32)
        self.known = vocabulary[self.rank]
        draw = lambda *shape: rng.normal(0, 0.1, shape).astype(np.float32)
        self.p = {
            "embed": draw(VOCABULARY + 1, DEPTH), "w": draw(DEPTH * len(AROUND), HIDDEN) * 2, "b": np.zeros(HIDDEN, np.float32), "wc": draw(HIDDEN, CLASSES), "bc": np.zeros(CLASSES, np.float32),
            "ww": draw(CLASSES, HIDDEN, CLASS), "bw": np.zeros((CLASSES, CLASS), np.float32),
        }

    def ids(self, hashes: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.known, hashes)
        at[at == len(self.known)] = 0
        out = (VOCABULARY - OTHERS + (hashes >> np.uint64(7)) % np.uint64(OTHERS)).astype(np.int32)
        if len(self.known):
            hit = self.known[at] == hashes
            out[hit] = self.rank[at[hit]]
        return out

    @staticmethod
    def contexts(ids: np.ndarray, bounds: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Ids around the words at `at`; VOCABULARY beyond the text's ends."""
        text = np.searchsorted(bounds, at, "right") - 1
        near = at[:, None] + AROUND
        inside = (near >= bounds[text][:, None]) & (near < bounds[text + 1][:, None])
        return np.where(inside, ids[np.where(inside, near, 0)], VOCABULARY)

    def _hidden(self, around: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        x = self.p["embed"][around].reshape(len(around), -1)
        return x, np.tanh(x @ self.p["w"] + self.p["b"])

    @staticmethod
    def _by_class(target: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
        """Targets in order of class, and (class, first, after the last) of each class there."""
        of = target // CLASS
        order = np.argsort(of, kind="stable")
        cuts = np.searchsorted(of[order], np.arange(CLASSES + 1))
        return order, [(c, cuts[c], cuts[c + 1]) for c in np.flatnonzero(np.diff(cuts))]

    def log_probabilities(self, around: np.ndarray, target: np.ndarray) -> np.ndarray:
        order, runs = self._by_class(target)
        _, h = self._hidden(around[order])
        n, mine = np.arange(len(order)), target[order]
        z = h @ self.p["wc"] + self.p["bc"]
        sums = self._exp(z)[1]
        out = z[n, mine // CLASS] - np.log(sums)
        z = self._words(h, mine, runs)
        sums = self._exp(z)[1]
        out += z[n, mine % CLASS] - np.log(sums)
        back = np.empty_like(out)
        back[order] = out
        return back

    def _words(self, h: np.ndarray, target: np.ndarray, runs: list[tuple[int, int, int]]) -> np.ndarray:
        """Scores of the words of each target's class, targets being in order of class."""
        z = np.empty((len(h), CLASS), h.dtype)
        for c, a, b in runs:
            np.matmul(h[a:b], self.p["ww"][c], out=z[a:b])
        z += self.p["bw"][target // CLASS]
        return z

    @staticmethod
    def _exp(z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """exp of scores, and each row's sum. Scores stay far within +-80, so no row's largest need be taken off first."""
        e = np.exp(np.clip(z, -80, 80, out=z))
        return e, e @ np.ones(z.shape[1], z.dtype)

    @classmethod
    def _softmax(cls, z: np.ndarray) -> np.ndarray:
        e, sums = cls._exp(z)
        e *= (1 / sums)[:, None]
        return e

    def gradients(self, around: np.ndarray, target: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean negative log-probability."""
        order, runs = self._by_class(target)
        around, target = around[order], target[order]
        n = len(target)
        x, h = self._hidden(around)
        d = self._softmax(h @ self.p["wc"] + self.p["bc"])
        d[np.arange(n), target // CLASS] -= 1
        g = {"wc": h.T @ d, "bc": d.sum(0), "ww": np.zeros_like(self.p["ww"]), "bw": np.zeros_like(self.p["bw"])}
        dh = d @ self.p["wc"].T
        e, down = self._softmax(self._words(h, target, runs)), np.empty_like(dh)
        e[np.arange(n), target % CLASS] -= 1
        for c, a, b in runs:
            np.matmul(h[a:b].T, e[a:b], out=g["ww"][c])
            np.matmul(e[a:b], self.p["ww"][c].T, out=down[a:b])
        g["bw"][[c for c, _, _ in runs]] = np.add.reduceat(e, [a for _, a, _ in runs])
        dh += down
        dz = dh * (1 - h * h)
        dx = (dz @ self.p["w"].T).reshape(-1, DEPTH)
        rows = around.ravel()
        embed = np.stack([np.bincount(rows, dx[:, j], VOCABULARY + 1) for j in range(DEPTH)], 1).astype(dx.dtype)
        return {k: v / n for k, v in (g | {"w": x.T @ dz, "b": dz.sum(0), "embed": embed}).items()}

    def flat(self) -> np.ndarray:
        return np.concatenate([v.ravel() for v in self.p.values()])

    def load(self, flat: np.ndarray) -> Network:
        at = 0
        for k, v in self.p.items():
            self.p[k] = flat[at : at + v.size].reshape(v.shape).astype(np.float32)
            at += v.size
        return self


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, n = [], 0

    def flush() -> pa.RecordBatch:
        word, count = np.unique(np.concatenate(held), return_counts=True)
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), pa.array(count)], ["word", "n"])

    for batch in batches:
        for _, _, word, _ in word_hashes(batch):
            held.append(word)
            n += len(word)
            if n >= 1 << 23:
                yield flush()
                n = 0
    if held:
        yield flush()


def _train(batches: Iterator[pa.RecordBatch], model) -> Iterator[pa.RecordBatch]:
    net = Network(np.zeros(0, np.uint64))
    net.known, net.rank, net.p = model.value.known, model.value.rank, {k: v.copy() for k, v in model.value.p.items()}
    square, seen, held = {k: np.full_like(v, 1e-6) for k, v in net.p.items()}, 0, []

    def step() -> None:
        around, target = (np.concatenate(x) for x in zip(*held, strict=True))
        held.clear()
        for a in range(0, len(target), BATCH):
            for k, g in net.gradients(around[a : a + BATCH], target[a : a + BATCH]).items():
                square[k] += g * g
                net.p[k] -= RATE * g / np.sqrt(square[k])

    for batch in batches:
        for _, _, word, bounds in word_hashes(batch):
            ids = net.ids(word)
            for a in range(0, len(ids), 8 * BATCH):
                at = np.arange(a, min(len(ids), a + 8 * BATCH))
                held.append((net.contexts(ids, bounds, at), ids[at]))
                seen += len(at)
                if sum(len(t) for _, t in held) >= 8 * BATCH:
                    step()
    if held:
        step()
    if seen:
        flat = net.flat()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat), dtype=np.int32)), pa.array(flat.astype(np.float64) * seen), pa.array(np.full(len(flat), seen))], ["i", "x", "n"])


_SCORED = ["row", "doc_id", "n_words", "log_likelihood", "word", "n"]


def _score(batches: Iterator[pa.RecordBatch], model) -> Iterator[pa.RecordBatch]:
    """A row for each document, whose log_likelihood takes a word outside the vocabulary for its entry; and a row for each different such
    word of it (word and n, how often), by `row`."""
    net, row = model.value, TaskContext.get().partitionId() << 40
    for batch in batches:
        for lo, hi, word, bounds in word_hashes(batch):
            ids, total, rows = net.ids(word), np.zeros(hi - lo), np.arange(row, row + hi - lo)
            logs = [net.log_probabilities(net.contexts(ids, bounds, at), ids[at]) for a in range(0, len(ids), 1 << 15) for at in [np.arange(a, min(len(ids), a + (1 << 15)))]]
            doc = np.repeat(np.arange(hi - lo), np.diff(bounds))
            if logs:
                total = np.bincount(doc, np.concatenate(logs), hi - lo)
            yield pa.RecordBatch.from_arrays([pa.array(rows), batch.column("doc_id").slice(lo, hi - lo), pa.array(np.diff(bounds)), pa.array(total), pa.nulls(hi - lo, pa.int64()), pa.nulls(hi - lo, pa.int64())], _SCORED)
            row += hi - lo
            rare = np.flatnonzero(ids >= VOCABULARY - OTHERS)
            if not len(rare):
                continue
            doc, word = doc[rare], word[rare]
            order = np.lexsort((word, doc))
            doc, word = doc[order], word[order]
            first = np.flatnonzero(np.concatenate(([True], (doc[1:] != doc[:-1]) | (word[1:] != word[:-1]))))
            n = np.diff(np.append(first, len(doc)))
            none = (pa.nulls(len(first), t) for t in (batch.schema.field("doc_id").type, pa.int64(), pa.float64()))
            yield pa.RecordBatch.from_arrays([pa.array(rows[doc[first]]), *none, pa.array(word[first].view(np.int64)), pa.array(n)], _SCORED)


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n) of all words' hashes. docs: column text without nulls."""
    return docs.select("text").mapInArrow(_counts, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


def fit_network(docs: DataFrame, counts: DataFrame | None = None) -> Network:
    """docs: column text without nulls, and others that tell rows apart; counts: its word_counts()."""
    spark = docs.sparkSession
    shards = max(1, (docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // max(1, ROUNDS) // SHARD)
    dealt = docs.select("text", F.xxhash64(*docs.columns).alias("hash"))
    counts = word_counts(docs) if counts is None else counts
    top = counts.orderBy(F.col("n").desc(), "word").limit(VOCABULARY - OTHERS).collect()
    net = Network(np.array([r["word"] for r in top], np.int64).view(np.uint64))
    for turn in range(ROUNDS):
        model = spark.sparkContext.broadcast(net)
        own = dealt.filter(F.pmod(F.col("hash"), F.lit(ROUNDS)) == turn).repartition(shards, "hash").sortWithinPartitions("hash", "text")
        parts = own.select("text").mapInArrow(partial(_train, model=model), "i int, x double, n long")
        mean = parts.groupBy("i").agg((F.sum("x") / F.sum("n")).alias("x")).toPandas().sort_values("i")
        if len(mean):
            net = Network(np.zeros(0, np.uint64)).load(mean["x"].to_numpy())
            net.known, net.rank = model.value.known, model.value.rank
    return net


def _shares(counts: DataFrame, net: Network) -> DataFrame:
    """(word, share): the logarithm of each word's share of its entry's count, for words outside the vocabulary."""
    known = counts.sparkSession.createDataFrame([(int(w),) for w in net.known.view(np.int64)], "word long")
    rare = counts.join(F.broadcast(known), "word", "left_anti").withColumn("entry", F.shiftrightunsigned("word", 7).bitwiseAND(F.lit(OTHERS - 1)))
    whole = rare.groupBy("entry").agg(F.sum("n").alias("whole"))
    return rare.join(F.broadcast(whole), "entry").select("word", F.log(F.col("n") / F.col("whole")).alias("share"))


def score(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, log_likelihood, mean_log_likelihood."""
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    counts = settle(word_counts(docs), "words")
    net = fit_network(docs, counts)
    model = docs.sparkSession.sparkContext.broadcast(net)
    kind = f"row long, doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_words long, log_likelihood double, word long, n long"
    scored = settle(docs.mapInArrow(partial(_score, model=model), kind), "scored")
    rare = scored.filter("word is not null").select("row", "word", "n").join(_shares(counts, net), "word")
    rare = rare.groupBy("row").agg(F.sum(F.col("n") * F.col("share")).alias("share"))
    out = scored.filter("word is null").join(rare, "row", "left")
    out = out.select("doc_id", "n_words", (F.col("log_likelihood") + F.coalesce("share", F.lit(0.0))).alias("log_likelihood"))
    return out.withColumn("mean_log_likelihood", F.when(F.col("n_words") > 0, F.col("log_likelihood") / F.col("n_words")))


def op6_pseudo_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"))
