"""Column-wise construction of the Burrows-Wheeler transform and common prefixes of many strings, in external memory.

Strings are aligned at their ends. Each round puts one more symbol in front of each string's current suffix: the symbols are
written at those suffixes' places in the transform, and the longer suffixes go where the last-to-first mapping sends them. The
common prefix of a new suffix with its neighbour is one more than the smallest common prefix between the two places that their
tails have.

The transform and the prefixes live in two files. Each round reads them twice from start to end, CHUNK suffixes at a time: once to
count symbols and take minima up to the places of new symbols, carrying from chunk to chunk a count and a minimum for each symbol;
and once to merge the new suffixes in, into the next round's files. Memory: CHUNK suffixes, and a few numbers for each string.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator
from pathlib import Path

import numpy as np

#: Symbols are bytes + 1 (no UTF-8 text has a byte 255); END stands before a whole string, and where the next round writes.
END, SYMBOLS = 0, 256
#: Suffixes that are in memory at a time.
CHUNK = 1 << 21
#: Above all common prefixes.
FAR = np.uint16(0xFFFF)


def _least_between(prefixes: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """min(prefixes[begin:end]) of each pair; no end is beyond the last of prefixes. Pairs in descending order make each pair's
    reduction stop at its own end."""
    down = np.argsort(-end)
    pairs = np.stack((begin[down], end[down]), 1).ravel()
    out = np.empty(len(begin), prefixes.dtype)
    out[down] = np.minimum.reduceat(prefixes, pairs)[::2] if len(begin) else 0
    return out


class _Scan:
    """What one reading of the transform finds for new symbols at ascending places `at`: how often each occurs before its place, and
    the common prefixes (one symbol included) with its occurrences before and after, 0 where there is none."""

    def __init__(self, at: np.ndarray):
        self.at, self.count = at, np.zeros(SYMBOLS, np.int64)
        self.rank, self.down, self.up = np.zeros(len(at), np.int64), np.zeros(len(at), np.int32), np.zeros(len(at), np.int32)
        self.since = np.full(SYMBOLS, -1, np.int32)  # the least prefix since the symbol's last occurrence; -1 before its first
        self.open = np.full(SYMBOLS, -1)  # the new symbol that waits for its next occurrence

    def take(self, start: int, bwt: np.ndarray, lcp: np.ndarray, last: bool) -> None:
        lo, hi = np.searchsorted(self.at, (start, start + len(bwt)))
        lcp = np.append(lcp, FAR)
        order, n = np.argsort(bwt, kind="stable"), np.bincount(bwt, minlength=SYMBOLS)
        end = np.cumsum(n)
        begin, met = end - n, np.flatnonzero(n)
        reached = self.since.copy()  # from the last occurrence to the first of this chunk
        if start:
            so_far = np.minimum.accumulate(lcp[:-1])
            reached[met] = np.minimum(self.since[met], so_far[order[begin[met]]])
        waited = met[self.open[met] >= 0]
        self.up[self.open[waited]] = 1 + reached[waited]
        self.open[met] = -1

        new = np.zeros(len(bwt), bool)
        new[self.at[lo:hi] - start] = True
        slot = np.flatnonzero(new[order])
        place, symbol = order[slot], bwt[order[slot]]
        mine = lo + np.searchsorted(self.at[lo:hi], place + start)
        self.rank[mine] = self.count[symbol] + slot - begin[symbol]
        before, after = slot > begin[symbol], slot + 1 < end[symbol]
        self.down[mine[~before]] = 1 + reached[symbol[~before]]
        self.open[symbol[~after]] = mine[~after]
        near = _least_between(lcp, np.concatenate((order[slot[before] - 1], place[after])) + 1, np.concatenate((place[before], order[slot[after] + 1])) + 1)
        cut = np.count_nonzero(before)
        self.down[mine[before]], self.up[mine[after]] = 1 + near[:cut], 1 + near[cut:]

        self.count += n
        if not last:
            onward = np.minimum.accumulate(lcp[::-1])[::-1]
            self.since = np.minimum(self.since, onward[0])
            self.since[met] = onward[order[end[met] - 1] + 1]


class Collection:
    """The suffixes of all strings, in order: files of 8-bit symbols of the transform and 16-bit common prefixes with the suffix
    before; string k's whole text is the suffix at `place[k]`."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray, folder: str):
        self.folder, self.turn = Path(folder), 0
        self.n, length = len(bounds) - 1, np.diff(bounds)
        for name, kind in (("bwt", np.uint8), ("lcp", np.uint16)):
            np.zeros(self.n, kind).tofile(self._file(name))
        self.size, self.place, self.before = self.n, np.arange(self.n), np.zeros(SYMBOLS + 1, np.int64)
        for done in range(int(length.max(initial=0))):
            grows = np.flatnonzero(length > done)
            grows = grows[np.argsort(self.place[grows])]
            self._insert(grows, data[bounds[grows + 1] - 1 - done] + np.uint8(1))

    def _file(self, name: str, turn: int = 0) -> Path:
        return self.folder / f"{name}{(self.turn + turn) % 2}"

    def _chunks(self, at: np.ndarray, symbols: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(place of the first, symbols, prefixes) of the files from start to end, with `symbols` at the ascending places `at`."""
        with self._file("bwt").open("rb") as b, self._file("lcp").open("rb") as c:
            for start in range(0, self.size, CHUNK):
                bwt, lcp = np.fromfile(b, np.uint8, CHUNK), np.fromfile(c, np.uint16, CHUNK)
                lo, hi = np.searchsorted(at, (start, start + len(bwt)))
                bwt[at[lo:hi] - start] = symbols[lo:hi]
                yield start, bwt, lcp

    def _insert(self, grows: np.ndarray, symbols: np.ndarray) -> None:
        """One more symbol in front of the strings `grows`, which are in order of their places."""
        at = self.place[grows]
        scan = _Scan(at)
        for start, bwt, lcp in self._chunks(at, symbols):
            scan.take(start, bwt, lcp, start + len(bwt) == self.size)
        # suffixes that begin with END are the empty ones, of which there are n
        self.before = np.concatenate(([0, 0], np.cumsum(scan.count[1:]))) + self.n
        moved = self.before[symbols] + scan.rank
        by = np.argsort(moved)
        gap = moved[by] - np.arange(len(by))  # the suffix before which each goes
        with self._file("bwt", 1).open("wb") as b, self._file("lcp", 1).open("wb") as c:
            for start, bwt, lcp in self._chunks(at, symbols):
                last = start + len(bwt) == self.size
                lo, hi = np.searchsorted(gap, start), len(gap) if last else np.searchsorted(gap, start + len(bwt))
                new = gap[lo:hi] - start + np.arange(hi - lo)
                old = np.ones(len(bwt) + hi - lo, bool)
                old[new] = False
                grown, common = np.full(len(old), END, np.uint8), np.empty(len(old) + 1, np.uint16)
                grown[old], common[:-1][old] = bwt, lcp
                common[new], common[new + 1] = scan.down[by[lo:hi]], scan.up[by[lo:hi]]
                grown.tofile(b)
                common[:-1].tofile(c)
        self.turn += 1
        self.size += len(grows)
        self.place += np.searchsorted(gap, self.place, "right")
        self.place[grows] = moved

    def _look_up(self, name: str, at: np.ndarray) -> np.ndarray:
        """What a file of 32-bit numbers holds at places, in one reading."""
        order, out = np.argsort(at), np.empty(len(at), np.int64)
        ascending = at[order]
        with (self.folder / name).open("rb") as f:
            for start in range(0, self.size, CHUNK):
                values = np.fromfile(f, np.uint32, CHUNK)
                lo, hi = np.searchsorted(ascending, (start, start + len(values)))
                out[order[lo:hi]] = values[ascending[lo:hi] - start]
        return out

    def classes(self, starts: np.ndarray, length: int) -> np.ndarray:
        """For the first starts[k] suffixes of each string k, in turn, numbers that are equal if and only if the suffixes agree in
        the first `length` symbols, which they must have."""
        label, to, none = 0, self.before.copy(), np.zeros(0, np.int64)
        with (self.folder / "label").open("wb") as names, (self.folder / "tail").open("wb") as tails:
            tails.truncate(4 * self.size)
            for start, bwt, lcp in self._chunks(none, none):
                own = label + np.cumsum(lcp < length)
                label = own[-1]
                own.astype(np.uint32).tofile(names)
                order, n = np.argsort(bwt, kind="stable"), np.bincount(bwt, minlength=SYMBOLS)
                end = np.cumsum(n)
                for c in np.flatnonzero(n[1:]) + 1:  # the suffixes that begin with c have their tails at c's occurrences
                    tails.seek(4 * to[c])
                    tails.write((order[end[c] - n[c] : end[c]] + start).astype(np.uint32).tobytes())
                    to[c] += n[c]
        begin = np.concatenate(([0], np.cumsum(starts)))
        out, at = np.empty(begin[-1], np.int64), self.place.copy()
        for step in range(int(starts.max(initial=0))):
            here = np.flatnonzero(starts > step)
            out[begin[here] + step] = self._look_up("label", at[here])
            at[here] = self._look_up("tail", at[here])
        return out


def window_classes(data: np.ndarray, bounds: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    with tempfile.TemporaryDirectory() as folder:
        return Collection(data, bounds, folder).classes(starts, length)
