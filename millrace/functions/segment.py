"""Words of text that is written without blanks, by a dictionary.

A run of letters is cut along its most probable path: a word costs -1000 times the logarithm of its share of all weights, the path with the
lowest sum counts, of equal ones that with fewer words, then that whose first words are longer. Letters that no word covers cost more than any
path of words; neighbours among them stay together, so a run of another script stays whole.

Each Python worker holds the dictionary as sorted arrays of bytes, looks up all strings of a block of texts in them at once, and makes
prefixes of the words found there only: the prefixes of a whole dictionary are a hundred times its letters.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.text import tokens

#: What a letter costs that no word covers.
UNKNOWN = 100_000_000
#: Letters of all words of a dictionary, which each Python worker holds as a whole (its bytes, and four for each word).
LIMIT = 256_000_000
#: Letters of a block of texts; places in it that are looked up at once.
BLOCK, PLACES = 1_000_000, 250_000


class Trie:
    """The prefixes of words, each with its node's cost: None where a word goes on but none ends."""

    def __init__(self, words: Iterable[tuple[str, int]]):
        self.nodes: dict[str, int | None] = {}
        for word, cost in words:
            for end in range(1, len(word)):
                self.nodes.setdefault(word[:end], None)
            self.nodes[word] = cost

    def cut(self, run: str) -> list[str]:
        """The words of the best path, found from the end: best[i] is that of run[i:] as (cost, words, -length of the first one)."""
        n, nodes = len(run), self.nodes
        best: list[tuple[int, int, int]] = [(0, 0, 0)] * (n + 1)
        known = [False] * n
        for i in range(n - 1, -1, -1):
            cost, count, _ = best[i + 1]
            choice = (cost + UNKNOWN, count + 1, -1)
            for end in range(i + 1, n + 1):
                node = nodes.get(run[i:end], False)
                if node is False:
                    break
                if node is not None:
                    cost, count, _ = best[end]
                    other = (cost + node, count + 1, i - end)
                    if other < choice:
                        choice, known[i] = other, True
            best[i] = choice
        out, at, loose = [], 0, False
        while at < n:
            end = at - best[at][2]
            if known[at]:
                out.append(run[at:end])
            elif loose:
                out[-1] += run[at:end]
            else:
                out.append(run[at:end])
            loose, at = not known[at], end
        return out


class Lexicon:
    """A dictionary as sorted arrays, one for each length in bytes, with the costs beside them."""

    def __init__(self, words: pa.Array, costs: np.ndarray):
        sizes = pc.binary_length(words).to_numpy(zero_copy_only=False)
        self.words: dict[int, np.ndarray] = {}
        self.costs: dict[int, np.ndarray] = {}
        for n in np.unique(sizes).tolist():
            rows = np.flatnonzero(sizes == n)
            data = words.take(pa.array(rows)).buffers()[2]
            of = _strings(np.frombuffer(data, np.uint8, n * len(rows)).reshape(-1, n))
            order = np.argsort(of, kind="stable")
            self.words[n], self.costs[n] = of[order], costs[rows[order]].astype(np.int32)

    @property
    def nbytes(self) -> int:
        return sum(a.nbytes for arrays in (self.words, self.costs) for a in arrays.values())

    def trie(self, runs: list[str]) -> Trie:
        """Of the words that occur in these runs, which is all that cutting them asks for."""
        parts = [r.encode("utf-8", "surrogatepass") for r in runs]
        text = np.frombuffer(b"".join(parts), np.uint8)
        ends = np.repeat(np.cumsum([len(p) for p in parts]), [len(p) for p in parts])
        places = np.flatnonzero((text & 0xC0) != 0x80)
        found: dict[str, int] = {}
        for begin in range(0, len(places), PLACES):
            at = places[begin : begin + PLACES]
            for n in self.words:  # ascending
                at = at[ends[at] - at >= n]
                if not len(at):
                    break
                seen = np.unique(_strings(np.lib.stride_tricks.sliding_window_view(text, n)[at]))  # in order, they are found faster
                place = np.minimum(np.searchsorted(self.words[n], seen), len(self.words[n]) - 1)
                place = place[self.words[n][place] == seen]
                found.update(zip(_texts(self.words[n][place], n), self.costs[n][place].tolist(), strict=True))
        return Trie(found.items())


def _strings(rows: np.ndarray) -> np.ndarray:
    """Rows of n bytes as one comparable value each: integers where they fit, in the order of the bytes."""
    n = rows.shape[1]
    if n > 8:
        return np.ascontiguousarray(rows).view(f"S{n}").ravel()
    wide = np.zeros((len(rows), 8), np.uint8)
    wide[:, :n] = rows
    return wide.view(">u8").ravel().astype(np.uint64)


def _texts(values: np.ndarray, n: int) -> Iterator[str]:
    for v in values.tolist():
        yield (v.ljust(n, b"\0") if n > 8 else v.to_bytes(8, "big")[:n]).decode("utf-8", "surrogatepass")


def _blocks(runs: Iterable[str]) -> Iterator[list[str]]:
    block, letters = [], 0
    for r in runs:
        block.append(r)
        letters += len(r)
        if letters >= BLOCK:
            yield block
            block, letters = [], 0
    if block:
        yield block


def word_costs(words: DataFrame, word: str = "word", weight: str = "weight") -> DataFrame:
    """(word, cost): weights of equal words are added; words without a letter or a positive weight are left out."""
    rows = words.filter((F.length(word) > 0) & (F.col(weight) > 0)).groupBy(F.col(word).alias("word")).agg(F.sum(weight).alias("weight"))
    total = rows.agg(F.sum("weight").alias("total"))
    return rows.join(F.broadcast(total)).select("word", F.floor(1000 * F.ln(F.col("total") / F.col("weight"))).cast("long").alias("cost"))  # one row


def _lexicon(costs: DataFrame) -> Lexicon:
    table = costs.toArrow()
    words = table["word"].combine_chunks() if table.num_rows else pa.array([], pa.string())
    return Lexicon(words, table["cost"].to_numpy())


def dictionary_segmenter(words: DataFrame, word: str = "word", weight: str = "weight", limit: int = LIMIT) -> Callable[[Column], Column]:
    """For explode_words(): texts to arrays of words. The dictionary is broadcast; one of more than `limit` letters is refused, as it isn't
    one (dictionaries don't grow with the texts)."""
    costs = word_costs(words, word, weight)
    if (letters := costs.agg(F.sum(F.length("word"))).first()[0] or 0) > limit:
        raise ValueError(f"a dictionary of {letters} letters")
    held = words.sparkSession.sparkContext.broadcast(_lexicon(costs))

    @F.pandas_udf("array<string>")
    def cut(runs: pd.Series) -> pd.Series:
        cuts: dict[str, list[str]] = {}
        for block in _blocks(dict.fromkeys(run for r in runs if r is not None for run in r)):
            trie = held.value.trie(block)
            cuts.update((run, trie.cut(run)) for run in block)
        return runs.map(lambda r: None if r is None else [w for run in r for w in cuts[run]])

    return lambda text: cut(tokens(text))
