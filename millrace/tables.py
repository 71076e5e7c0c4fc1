"""Tables that are upserted while others read them.

A table is a list of segments (Parquet), each with at most one row a key, and each row with its place in the order of changes. An upsert
writes one small segment, whatever the size of the table; readers merge segments by key, and the row that is last in order counts, also if
an older change comes in a later batch. When FAN_IN segments are of like size they are merged into one (so each row is rewritten a
logarithmic number of times). Deleted keys stay as marks: without them, an older change that comes later would bring the row back.

What belongs to a version is a numbered entry of a log, written whole or not at all: a version never changes, and files of one are deleted
by vacuum() only, when it is neither the newest, nor pinned by a reader, nor young. The same entry holds the last batch of each source, so a
batch that comes again changes nothing. Writers that meet take the next number each: what they add doesn't depend on what the others add.
"""

from __future__ import annotations

import math
import time
import uuid
from datetime import timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.shared import CommitLog, Folder

#: Segments of like size that are merged into one, and the bytes under which all are alike.
FAN_IN, SMALL = 8, 1 << 20


class VersionedTable:
    """Columns are text; rows come with GONE (whether the key is deleted) and SEQ (an array of numbers, compared from the first on)."""

    GONE, SEQ = "_gone", "_seq"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.log, self.data = CommitLog(spark, f"{self.path}/versions"), Folder(spark, f"{self.path}/data")

    def create(self, columns: list[str], key: list[str]) -> None:
        """Nothing happens if the table is there."""
        if missing := [k for k in key if k not in columns]:
            raise ValueError(f"{missing[0]} is no column of {self.path}")
        self.log.put(0, {"columns": columns, "key": key, "segments": [], "sources": {}})

    def version(self) -> int | None:
        """The newest; None if there is no table."""
        return max(self.log.numbers(), default=None)

    def _entry(self, version: int | None) -> dict:
        newest = self.version() if version is None else version
        if newest is None:
            raise ValueError(f"there is no table at {self.path}")
        return self.log.get(newest)

    def columns(self) -> list[str]:
        return self._entry(None)["columns"]

    def _last(self, rows: DataFrame, entry: dict) -> DataFrame:
        """The last row of each key."""
        rest = [c for c in entry["columns"] if c not in entry["key"]]
        last = rows.groupBy(*entry["key"]).agg(F.max(F.struct(self.SEQ, *rest, self.GONE)).alias("r"))
        return last.select(*[F.col(c) if c in entry["key"] else F.col("r")[c].alias(c) for c in entry["columns"]], F.col("r")[self.GONE].alias(self.GONE), F.col("r")[self.SEQ].alias(self.SEQ))

    def _merged(self, entry: dict, segments: list[dict]) -> DataFrame:
        kind = ", ".join([*(f"`{c}` string" for c in entry["columns"]), f"{self.GONE} boolean", f"{self.SEQ} array<bigint>"])
        if not segments:
            return self.spark.createDataFrame([], kind)
        rows = self.spark.read.schema(kind).parquet(*[f"{self.path}/data/{s['name']}" for s in segments])
        return rows if len(segments) == 1 else self._last(rows, entry)

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version, the newest by default: those of that version whenever they are read, until a vacuum() that may take it."""
        entry = self._entry(version)
        return self._merged(entry, entry["segments"]).filter(~F.col(self.GONE)).select(*entry["columns"])

    def _write(self, rows: DataFrame) -> dict:
        name = uuid.uuid4().hex
        rows.write.parquet(f"{self.path}/data/{name}")
        return {"name": name, "bytes": self.data.size(name)}

    def _commit(self, change) -> int:
        """change: of the newest entry to the next. Tried again if another writer was faster."""
        while True:
            newest = self.version()
            entry = change(self.log.get(newest))
            if entry is None:
                return newest
            if self.log.put(newest + 1, entry):
                return newest + 1

    def upsert(self, rows: DataFrame, source: str | None = None, batch: int | None = None) -> int:
        """The version that has these rows (columns, GONE, SEQ). Rows without a key are left out. source and batch: of a batch that its
        source has put before, nothing is written."""
        entry = self._entry(None)
        done = lambda e: source is not None and batch is not None and e["sources"].get(source, -1) >= batch
        if done(entry):
            return self.version()
        keyed = rows.filter(" and ".join(f"`{k}` is not null" for k in entry["key"])).select(*entry["columns"], self.GONE, self.SEQ)
        segment = self._write(self._last(keyed, entry))

        def add(e: dict) -> dict | None:
            if done(e):
                return None
            return e | {"segments": [*e["segments"], segment], "sources": e["sources"] | ({source: batch} if source is not None and batch is not None else {})}

        self._commit(add)
        return self.compact()

    def compact(self) -> int:
        """Merges segments of like size until fewer than FAN_IN of any size are left. Rows stay as they are."""
        while True:
            entry, sizes = self._entry(None), {}
            for s in entry["segments"]:
                sizes.setdefault(max(0, int(math.log(max(1, s["bytes"]) / SMALL, FAN_IN))), []).append(s)
            many = next((of for _, of in sorted(sizes.items()) if len(of) >= FAN_IN), None)
            if many is None:
                return self.version()
            segment, names = self._write(self._merged(entry, many)), {s["name"] for s in many}

            def replace(e: dict, names=names, segment=segment) -> dict | None:
                if not names <= {s["name"] for s in e["segments"]}:  # others have merged them
                    return None
                return e | {"segments": [*(s for s in e["segments"] if s["name"] not in names), segment]}

            before = self.version()
            if self._commit(replace) == before:
                return before

    def vacuum(self, pinned: set[int] = frozenset(), keep: timedelta = timedelta(days=1)) -> None:
        """Deletes versions that aren't the newest, pinned, or younger than `keep` (for readers that pin nothing), and files of none that is
        left (files of writers that haven't committed yet are young)."""
        young = (time.time() - keep.total_seconds()) * 1000
        times = self.log.times()
        stay = {v for v, at in times.items() if v == max(times) or v in pinned or at > young}
        used = {s["name"] for v in stay for s in self.log.get(v)["segments"]}
        for v in set(times) - stay:
            self.log.delete(v)
        for name, (_, at) in self.data.names().items():
            if name not in used and at <= young:
                self.data.delete(name)


class Pins:
    """Which versions the micro-batches of streams read: the newest when a batch first begins, and the same when it comes again."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.folder = spark, Folder(spark, path)

    def _log(self, reader: str) -> CommitLog:
        return CommitLog(self.spark, f"{self.folder.path}/{reader}")

    def take(self, reader: str, batch: int, newest: dict[str, int]) -> dict[str, int]:
        """The pinned versions by table; pins of batches before the last one go, which can't come again."""
        log = self._log(reader)
        pinned = log.once(batch, newest)
        for n in log.numbers():
            if n < batch - 1:
                log.delete(n)
        return pinned

    def held(self, table: str) -> set[int]:
        """Versions of a table that some reader may still read."""
        return {e[table] for reader in self.folder.names() for log in [self._log(reader)] for e in map(log.get, log.numbers()) if table in e}


def change_order(order: list[Column], batch: int | None = None) -> Column:
    """SEQ of changes: the first column (a time, say), then the batch, in which later ones come later, then the other columns. What is
    no number counts as the least."""
    first, *rest = [c.try_cast("bigint") for c in order]
    return F.array(first, F.lit(-1 if batch is None else batch).cast("bigint"), *rest)
