"""The keyed operators on streams: a little state for each key, in vectorized processors.

A key's rows of a micro-batch are taken in order of event time, all chunks of it together; across micro-batches rows must come in
time order, as from a topic's partitions (replace_by_cancel() puts them in order itself). State that ends expires by event-time timers,
which late rows never move backwards. What rows without a time do is what they do in a batch (see operators/keyed.py).
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import DecimalType, IntegralType, StructType, TimestampNTZType, TimestampType

DAY = pd.Timedelta(days=1)
#: Repeats of a row come within seconds of each other.
REPEATS = pd.Timedelta(seconds=10)
#: The time after which a row can't be taken back any more.
FINAL = "final_at"


def millis(time: pd.Timestamp) -> int:
    """Epoch milliseconds, rounded up, so that what a timer of that time ends is past."""
    return -int(-pd.Timestamp(time).value // 1_000_000)


def _in_order(rows: Iterator[pd.DataFrame], *by: str) -> pd.DataFrame:
    return pd.concat(list(rows)).sort_values(list(by), kind="stable", ignore_index=True)


class _Processor(StatefulProcessor):
    """One row of state, with the time that its expiry is counted from; `keep` ends it so long after that."""

    state_schema = "v string, latest timestamp"

    def __init__(self, keep: pd.Timedelta | None = None):
        self.keep = keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.state = handle, handle.getValueState("state", self.state_schema)

    def expire_after(self, time: pd.Timestamp) -> None:
        if self.keep is not None:
            for t in self.handle.listTimers():
                self.handle.deleteTimer(t)
            self.handle.registerTimer(millis(time + self.keep))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.state.clear()
        return iter(())

    def close(self) -> None:
        pass


class FirstOfDay(_Processor):
    """Rows that begin a new day of their key; is_first on the key's very first, is_back after `days` days without one."""

    def __init__(self, key: str, time: str, tie: str, days: int = 8, keep: pd.Timedelta | None = None):
        super().__init__(keep)
        self.key, self.time, self.tie, self.days = key, time, tie, days

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        df = _in_order(rows, self.time, self.tie)
        df = df[df[self.time].notna()].reset_index(drop=True)
        if not len(df):
            return
        (last, latest), out = (self.state.get() if self.state.exists() else (None, None)), []
        for i, day in enumerate(df[self.time].dt.strftime("%Y-%m-%d")):
            if last is None or day > last:
                back = last is not None and (pd.Timestamp(day) - pd.Timestamp(last)).days >= self.days
                out.append((i, day, int(last is None), int(back)))
                last = day
        latest = max([df[self.time].iloc[-1], *([pd.Timestamp(latest)] if latest is not None else [])])
        self.state.update((last, latest.to_pydatetime()))
        self.expire_after(latest)
        at, day, first, back = (list(x) for x in zip(*out, strict=True)) if out else ([], [], [], [])
        yield df.iloc[at].assign(date=pd.array(day, "string").astype(object), is_first=pd.array(first, "int32"), is_back=pd.array(back, "int32"))


class FirstOfShare(FirstOfDay):
    """Only the rows."""

    def __init__(self, columns: list[str], key: str, time: str, tie: str, keep: pd.Timedelta):
        super().__init__(key, time, tie, keep=keep)
        self.columns = columns

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        for out in super().handleInputRows(key, rows, timerValues):
            yield out[self.columns]


class RepairIsNew(_Processor):
    """State: the one date on which the key's visitor is new."""

    def __init__(self, flag: str, time: str, tie: str):
        super().__init__()
        self.flag, self.time, self.tie = flag, time, tie

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        df = _in_order(rows, self.time, self.tie)
        timed = df[self.time].notna()
        if not timed.any():
            yield df
            return
        day = df[self.time].dt.strftime("%Y-%m-%d")
        if self.state.exists():
            base = self.state.get()[0]
        else:
            first = timed.idxmax()  # rows without a time come last
            base = day[first] if df[self.flag][first] == "1" else (df[self.time][first] - DAY).strftime("%Y-%m-%d")
            self.state.update((base, None))
        yield df.assign(**{self.flag: df[self.flag].where(~(timed & (df[self.flag] == "1") & (day != base)), "0")})


class ReplaceByCancel(_Processor):
    """Each row, and the negative of each that another of its key follows; state: the key's last row, with the columns' own types. A row
    that sorts before the state (an earlier one that comes late) doesn't replace it: it leaves at once, as it would in a batch.

    A row can be taken back until `keep` after its own time, and says so in FINAL, which is what later operators take for event time: the
    negative of a row that is older than the watermark is then no late row, and no other row of the key can end its time early."""

    def __init__(self, schema: StructType, order: list[str], measures: list[str], time: str, keep: pd.Timedelta):
        super().__init__(keep)
        self.state_schema, self.columns, self.order, self.time = schema, schema.names, order, time
        self.measures = {m: Decimal(0) if isinstance(schema[m].dataType, DecimalType) else 0 for m in measures}
        self.times = [f.name for f in schema if isinstance(f.dataType, (TimestampType, TimestampNTZType))]
        self.whole = [f.name for f in schema if isinstance(f.dataType, IntegralType)]  # pandas has floats for those with nulls

    def _out(self, rows: pd.DataFrame) -> pd.DataFrame:
        return rows.assign(**{FINAL: pd.to_datetime(rows[self.time]) + self.keep})[[*self.columns, "sign", FINAL]]

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows))[self.columns].astype(object).assign(_old=False)
        if key[0] is not None and self.state.exists():
            new = pd.concat([pd.DataFrame([[*self.state.get(), True]], columns=[*self.columns, "_old"], dtype=object), new])
        new = new.where(new.notna(), None)
        for m, zero in self.measures.items():
            new[m] = new[m].map(lambda x, zero=zero: zero if x is None else x)
        new[self.times] = new[self.times].apply(pd.to_datetime)
        # what the watermark has made final in this micro-batch, before its timer: it stays
        new = new[~((new["_old"] == True) & (new[self.time].map(millis) + self.keep.total_seconds() * 1000 <= timerValues.getCurrentWatermarkInMs()))]  # noqa: E712
        if key[0] is None:
            yield self._out(new.assign(sign=1))
            return
        new = new.sort_values(self.order, kind="stable", na_position="first", ignore_index=True)
        last = new.iloc[-1]
        self.state.update(tuple(None if pd.isna(x := last[c]) else x.to_pydatetime() if c in self.times else int(x) if c in self.whole else x for c in self.columns))
        self.expire_after(last[self.time])
        gone = new.iloc[:-1].assign(sign=-1)
        for m in self.measures:
            gone[m] = gone[m].map(lambda x: -x)
        yield self._out(pd.concat([new[new["_old"] == False].assign(sign=1), gone], ignore_index=True))  # noqa: E712


def _run(df: DataFrame, keys: list[str], processor: StatefulProcessor, time: str, schema: str) -> DataFrame:
    return df.groupBy(*keys).transformWithStateInPandas(processor, schema, "Append", "EventTime", eventTimeColumnName=time)


def _schema(df: DataFrame, *more: str) -> str:
    return ", ".join([*(f"`{c}` {t}" for c, t in df.dtypes), *more])


def first_of_shares(df: DataFrame, key: str, time: str, tie: str, salts: int) -> DataFrame:
    """The rows that begin a day of their key in one of `salts` shares of its rows: at most so many rows for each key and day, among them
    the day's first. A share's state ends a day after its last row."""
    shared = df.withColumn("_share", F.pmod(F.xxhash64(time, tie), F.lit(salts)).cast("int"))
    return _run(shared, [key, "_share"], FirstOfShare(df.columns, key, time, tie, DAY), time, _schema(df))


def first_of_day(df: DataFrame, key: str, time: str, tie: str, days: int = 8, keep: pd.Timedelta | None = None, salts: int = 1) -> DataFrame:
    """The stream's rows (with a watermark on time) that begin a day of their key, with date, is_first and is_back. keep: one day is
    enough where only days count; without it, first days and returns are known for ever. salts: over 1 where a key may have a large part of
    all rows (a null or a robot's); its rows are then looked through by so many tasks first, and its own state meets only what they leave."""
    rows = first_of_shares(df, key, time, tie, salts) if salts > 1 else df
    return _run(rows, [key], FirstOfDay(key, time, tie, days, keep), time, _schema(df, "date string", "is_first int", "is_back int"))


def repair_is_new(df: DataFrame, key: str = "mid", flag: str = "is_new", time: str = "time", tie: str = "event_id") -> DataFrame:
    return _run(df, [key], RepairIsNew(flag, time, tie), time, _schema(df))


def replace_by_cancel(df: DataFrame, key: str, order: list[str], measures: list[str], time: str = "time", keep: pd.Timedelta = REPEATS) -> DataFrame:
    """Rows and negatives, with `sign` and FINAL: time + keep, the event time of what comes out. `order` tells which of a key's rows is
    the last, in whatever order they come; of equal ones, the one that came last. A repeat replaces the key's last row if it comes before
    the watermark is `keep` past that row's time. The watermark's delay may be anything: a negative leaves with its own time, however far
    the watermark is. Windows over these rows: by_window() of streaming/summaries.py."""
    columns = df.columns
    rows = df.filter(F.col(time).isNotNull()).withColumn("_apart", F.when(F.col(key).isNull(), F.xxhash64(*columns)))
    schema = StructType([f for f in rows.schema if f.name != "_apart"])
    return _run(rows, [key, "_apart"], ReplaceByCancel(schema, order, measures, time, keep), FINAL, _schema(df, "sign int", f"`{FINAL}` timestamp"))
