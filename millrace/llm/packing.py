"""Packing documents into token sequences by a grouping genetic algorithm.

Documents become token ids by a public byte-level BPE vocabulary, each followed by an end id; longer ones are cut. Pieces are dealt
to shards of about SHARD pieces by a hash, and each shard is packed by islands: a solution is a partition of pieces into sequences,
a crossover injects whole well-filled sequences of one parent into the other, takes out the other's sequences that hold one of
their pieces, and best-fits the pieces that this displaced. After each epoch an island's best solutions migrate to the next
island; the best of all islands is the shard's. The first solution of all is best-fit decreasing, so none is worse.

The ids are those of the tokenizers library; they are made by tiktoken, which reads the same vocabulary faster, and only once for
each chunk of text that a task sees again, byte for byte: no token of this vocabulary reaches across a space that follows a visible
character.

A null text counts as empty (the end id alone); repeated rows and null ids are packed like others; an empty table gives an empty
result; other columns are left alone. A task holds a block of texts, or a shard.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import settle, table
from millrace.llm.textbytes import blocks, prefix, range_hash

CAPACITY, END_ID = 1024, 2
SHARD, ISLANDS, EPOCHS, POPULATION, CHILDREN = 8192, 2, 2, 5, 12
#: Different chunks of which a task remembers bytes and ids; longer ones than so many bytes are coded each time.
REMEMBERED, LONGEST = 1 << 19, 256


class Chunks:
    """Token ids of texts. Reads the vocabulary's rank file; its one special token counts where it stands in a text."""

    def __init__(self, ranks: str):
        import public_tokenizers
        import tiktoken

        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(ranks, "rb"))}
        special = {"<|endoftext|>": len(table)}
        self.coder = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens=special)
        self.width = np.zeros(len(table) + 1, np.int64)
        for token, i in (table | {k.encode(): v for k, v in special.items()}).items():
            self.width[i] = len(token)
        self._forget()

    def _forget(self) -> None:
        self.known, self.at, self.count, self.ids = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)
        self.text_at, self.size, self.text = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint8)

    def _code(self, text: bytes) -> np.ndarray:
        return np.array(self.coder.encode(text.decode(), allowed_special="all", disallowed_special=()), np.uint32)

    def _learn(self, keys: np.ndarray, texts: list[bytes]) -> None:
        ids = self._code(b"".join(texts))
        ends = np.searchsorted(np.cumsum(self.width[ids]), np.cumsum([len(t) for t in texts])) + 1
        count = np.diff(ends, prepend=0)
        keys = np.concatenate((self.known, keys))
        order = np.argsort(keys)
        self.at = np.concatenate((self.at, len(self.ids) + ends - count))[order]
        self.count, self.known = np.concatenate((self.count, count))[order], keys[order]
        self.ids = np.concatenate((self.ids, ids))
        size = np.array([len(t) for t in texts])
        self.text_at, self.size = np.concatenate((self.text_at, len(self.text) + np.cumsum(size) - size))[order], np.concatenate((self.size, size))[order]
        self.text = np.concatenate((self.text, np.frombuffer(b"".join(texts), np.uint8)))

    def _same(self, buf: np.ndarray, start: np.ndarray, size: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Which chunks of a block are, byte for byte, the known ones at `place`."""
        same = size == self.size[place]
        start, size, at = start[same], size[same], self.text_at[place[same]]
        if len(size):
            end = np.cumsum(size)
            each = np.arange(end[-1])
            equal = buf[np.repeat(start - end + size, size) + each] == self.text[np.repeat(at - end + size, size) + each]
            same[same] = np.logical_and.reduceat(equal, end - size)
        return same

    def encode(self, buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts of a block, and each text's bounds in them."""
        last = buf[:-1]
        visible = (last > 0x20) & (last < 0x7F)
        visible[1:] |= (buf[:-2] == 0xC3) & (last[1:] >= 0x80)  # the letters of Latin-1
        cut = np.zeros(len(buf) + 1, bool)
        cut[1:-1] = (buf[1:] == 0x20) & visible
        cut[offsets] = True
        start = np.flatnonzero(cut)[:-1] if len(buf) else np.zeros(0, np.int64)
        end = np.append(start[1:], len(buf)) if len(buf) else start
        data, key = buf.tobytes(), range_hash(prefix(buf), start, end)
        bounds = np.searchsorted(start, offsets)
        inner = np.ones(len(start), bool)  # the first and last chunks of a text are coded on their own, as their context counts
        full = np.diff(bounds) > 0
        inner[bounds[:-1][full]] = inner[bounds[1:][full] - 1] = False
        inner &= end - start <= LONGEST
        if len(self.known) > REMEMBERED:
            self._forget()
        different, at, inverse = np.unique(key[inner], return_index=True, return_inverse=True)
        place = np.searchsorted(self.known, different)
        new = np.flatnonzero((place == len(self.known)) | (np.append(self.known, np.uint64(0))[place] != different))
        if len(new):
            own = np.flatnonzero(inner)[at[new]]
            self._learn(different[new], [data[a:b] for a, b in zip(start[own], end[own], strict=True)])
            place = np.searchsorted(self.known, different)
        place = place[inverse]
        same = self._same(buf, start[inner], (end - start)[inner], place)
        inner[inner], place = same, place[same]
        outer = np.flatnonzero(~inner)
        alone = [self._code(data[a:b]) for a, b in zip(start[outer], end[outer], strict=True)]
        pool = np.concatenate((self.ids, *alone)) if alone else self.ids
        count, at = np.zeros(len(start), np.int64), np.zeros(len(start), np.int64)
        count[inner], at[inner] = self.count[place], self.at[place]
        count[outer] = [len(x) for x in alone]
        at[outer] = len(self.ids) + np.cumsum(count[outer]) - count[outer]
        done = np.concatenate(([0], np.cumsum(count)))
        ids = pool[np.repeat(at - done[:-1], count) + np.arange(done[-1])]
        return ids, done[bounds]


_chunks: dict[str, Chunks] = {}


def _pieces(batches: Iterator[pa.RecordBatch], ranks: str, capacity: int) -> Iterator[pa.RecordBatch]:
    chunks = _chunks.setdefault(ranks, None) or _chunks.update({ranks: Chunks(ranks)}) or _chunks[ranks]
    for batch in batches:
        for lo, hi, buf, offsets in blocks(batch):
            ids, bounds = chunks.encode(buf, offsets)
            rows: tuple[list, ...] = ([], [], [], [], [])
            for i in range(hi - lo):
                own = np.append(ids[bounds[i] : bounds[i + 1]], np.uint32(END_ID)).astype("<u4")
                cuts = [0, *range(len(own) % capacity or capacity, len(own) + 1, capacity)]
                for piece, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                    for row, x in zip(rows, (i, piece, a, b - a, zlib.crc32(own[a:b])), strict=True):
                        row.append(x)
            doc = batch.column("doc_id").slice(lo, hi - lo).take(pa.array(rows[0], pa.int64()))
            yield pa.RecordBatch.from_arrays([doc, pa.array(rows[1], pa.int32()), *(pa.array(x, pa.int64()) for x in rows[2:])], ["doc_id", "piece", "start", "length", "ids_crc32"])


def token_pieces(docs: DataFrame, ranks: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32."""
    import public_tokenizers

    ranks = ranks or public_tokenizers.path("byte_bpe_50k.tiktoken")
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(partial(_pieces, ranks=ranks, capacity=capacity), f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


def best_fit(sizes: np.ndarray, order: np.ndarray, bins: np.ndarray, free: list[int], capacity: int = CAPACITY) -> None:
    """Puts the pieces in `order` where the least room is left that holds them, or into new bins; bins and free are changed.
    Bins of equal room lie on a pile; a number's bits tell which piles aren't empty."""
    piles: list[list[int]] = [[] for _ in range(capacity + 1)]
    bits = 0
    for b, room in enumerate(free):
        piles[room].append(b)
        bits |= 1 << room
    for i, size in zip(order.tolist(), sizes[order].tolist(), strict=True):
        rest = bits >> size
        if rest:
            room = size + (rest & -rest).bit_length() - 1
            b = piles[room].pop()
            if not piles[room]:
                bits ^= 1 << room
        else:
            b, room = len(free), capacity
            free.append(room)
        bins[i] = b
        free[b] = room = room - size
        piles[room].append(b)
        bits |= 1 << room


class Island:
    """Solutions of one shard: arrays of each piece's bin, the best first. Fitness: mean squared fill of the bins."""

    def __init__(self, sizes: np.ndarray, seed: int, capacity: int = CAPACITY):
        self.sizes, self.capacity, self.rng, self.pool = sizes, capacity, np.random.default_rng(seed), []

    def fitness(self, bins: np.ndarray) -> float:
        fill = np.bincount(bins, self.sizes) / self.capacity
        return float((fill * fill).mean())

    def add(self, bins: np.ndarray) -> None:
        self.pool = sorted([*self.pool, (self.fitness(bins), bins)], key=lambda x: -x[0])[:POPULATION]

    def packed(self, noise: float) -> np.ndarray:
        bins = np.empty(len(self.sizes), np.int32)
        best_fit(self.sizes, np.argsort(-self.sizes * self.rng.uniform(1 - noise, 1, len(self.sizes)), kind="stable"), bins, [], self.capacity)
        return bins

    def cross(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        fill = np.bincount(one, self.sizes)
        good = np.argsort(-fill + self.rng.uniform(0, self.capacity / 64, len(fill)))[: max(1, len(fill) // 2)]
        chosen = np.zeros(len(fill), bool)
        chosen[self.rng.choice(good, max(1, len(good) // 2), replace=False)] = True
        injected = chosen[one]
        hit = np.zeros(two.max() + 1, bool)
        hit[two[injected]] = True
        stays = ~injected & ~hit[two]
        child = np.empty_like(one)
        names, child[stays] = np.unique(two[stays], return_inverse=True)
        child[injected] = len(names) + np.unique(one[injected], return_inverse=True)[1]
        placed = injected | stays
        free = (self.capacity - np.bincount(child[placed], self.sizes[placed]).astype(np.int64)).tolist()
        displaced = np.flatnonzero(~placed)
        best_fit(self.sizes, displaced[np.argsort(-self.sizes[displaced], kind="stable")], child, free, self.capacity)
        return child

    def evolve(self) -> list[np.ndarray]:
        least = -(-int(self.sizes.sum()) // self.capacity)
        if not self.pool:
            self.add(self.packed(0))
        while len(self.pool) < POPULATION and self.pool[0][1].max() + 1 > least:
            self.add(self.packed(0.2))
        for _ in range(CHILDREN):
            if len(self.pool) < 2 or self.pool[0][1].max() + 1 <= least:
                break
            one, two = self.rng.choice(len(self.pool), 2, replace=False)
            self.add(self.cross(self.pool[one][1], self.pool[two][1]))
        return [bins for _, bins in self.pool[:2]]


_ORDER = ["length", "doc_id", "piece", "start", "ids_crc32"]


def _epoch_of(epoch: int, capacity: int):
    def evolved(key: tuple, pieces: pd.DataFrame, elites: pd.DataFrame) -> pd.DataFrame:
        shard, island = map(int, key)
        sizes = np.sort(pieces["length"].to_numpy())  # equal lengths are as good as each other
        own = Island(sizes, (shard * ISLANDS + island) * EPOCHS + epoch, capacity)
        for bins in sorted(elites["bins"]):
            own.add(np.frombuffer(bins, np.int32))
        best = own.evolve() if len(sizes) else []  # the best one stays, the next moves to the next island
        return pd.DataFrame([(shard, (island + i) % ISLANDS, own.fitness(b), b.astype(np.int32).tobytes()) for i, b in enumerate(best)], columns=["shard", "island", "fitness", "bins"])

    return evolved


def _place(key: tuple, pieces: pd.DataFrame, elites: pd.DataFrame, capacity: int) -> pd.DataFrame:
    pieces = pieces.sort_values(_ORDER, ignore_index=True)
    small = int((pieces["length"] < capacity).sum())
    bins = np.arange(len(pieces), dtype=np.int64)
    if small:
        best = np.frombuffer(elites.sort_values(["fitness", "bins"], ascending=[False, True])["bins"].iloc[0], np.int32)
        bins[:small], bins[small:] = best, best.max() + 1 + np.arange(len(pieces) - small)
    order = np.argsort(bins, kind="stable")
    length = pieces["length"].to_numpy()[order]
    before = np.cumsum(length) - length
    first = np.flatnonzero(np.diff(bins[order], prepend=-1))
    out = pieces.iloc[order].assign(sequence_id=(np.int64(key[0]) << 32) + bins[order], offset=before - np.repeat(before[first], np.diff(np.append(first, len(order)))))
    return out[["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]]


def pack_documents(docs: DataFrame, ranks: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    pieces = settle(token_pieces(docs, ranks, capacity), "pieces")
    shards = max(1, round(pieces.count() / SHARD))
    shard = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", F.monotonically_increasing_id()), F.lit(shards)).cast("int")
    pieces = settle(pieces.withColumn("shard", shard), "shards")
    small = pieces.filter(F.col("length") < capacity).select("shard", "length", F.explode(F.array(*map(F.lit, range(ISLANDS)))).alias("island"))
    kind = "shard int, island int, fitness double, bins binary"
    elites = docs.sparkSession.createDataFrame([], kind)
    for epoch in range(EPOCHS):
        groups = small.groupBy("shard", "island").cogroup(elites.groupBy("shard", "island"))
        elites = settle(groups.applyInPandas(_epoch_of(epoch, capacity), kind), "elites")
    id_kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {id_kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    return pieces.groupBy("shard").cogroup(elites.groupBy("shard")).applyInPandas(lambda k, p, e: _place(k, p, e, capacity), schema)


def op10_pack_grouping(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
