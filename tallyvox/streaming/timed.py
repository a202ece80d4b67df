"""Streams whose state ends: keyed state with event-time timers, for what fixed windows cannot say."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructField, StructType, TimestampType

#: Timers and typed state live in this store; set it on the session before a stream with a timer starts.
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
_DUE = "month_ends"


def _millis(t: pd.Timestamp) -> int:
    return t.value // 1_000_000


class _LastArrival(StatefulProcessor):
    """The last row of a key by some columns, given out once when the watermark passes its time and the delay."""

    def __init__(self, schema: StructType, names: list[str], order: list[str], time_col: str, delay_ms: int) -> None:
        self.schema, self.names, self.order, self.time_col, self.delay_ms = schema, names, order, time_col, delay_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", self.schema)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        frames = list(rows)
        if self.last.exists():
            frames.insert(0, pd.DataFrame([self.last.get()], columns=self.names))
        held = pd.concat([f.astype(object) for f in frames], ignore_index=True)
        best = held.sort_values(self.order, kind="stable", na_position="first").iloc[-1]
        due = _millis(max(pd.Timestamp(t) for t in held[self.time_col])) + self.delay_ms
        self.last.update(tuple(None if pd.isna(best[c]) else best[c] for c in self.names))
        for old in self.handle.listTimers():
            self.handle.deleteTimer(old)
        self.handle.registerTimer(due)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        row = self.last.get()
        self.last.clear()
        yield pd.DataFrame([row], columns=self.names)

    def close(self) -> None:
        pass


def stream_last(rows: DataFrame, keys: list[str], order: list[str], delay_seconds: int, time_col: str = "submission_time") -> DataFrame:
    """The last row of each key, by order, then as it came, once no row for it has come for delay_seconds of event time.

    Rows without a time go. A key's row is given out and forgotten when the watermark, itself delay_seconds behind the
    latest time, has passed the key's latest time by delay_seconds; what comes later begins anew. State: one row for
    each key that is still open. Needs STATE_STORE.
    """
    timed = rows.where(F.col(time_col).isNotNull()).withWatermark(time_col, f"{delay_seconds} seconds")
    names = timed.columns
    place = {c: f"c{i}" for i, c in enumerate(names)}  # names that begin with an underscore do not reach the processor
    plain = timed.select(*[F.col(c).alias(place[c]) for c in names])
    processor = _LastArrival(plain.schema, plain.columns, [place[c] for c in order or [time_col]], place[time_col], delay_seconds * 1000)
    return plain.groupBy(*[place[c] for c in keys]).transformWithStateInPandas(processor, plain.schema, "append", "eventTime").toDF(*names)


class _Month(StatefulProcessor):
    """Sums of a group's days in a month, given out once when the watermark passes the month's end."""

    def __init__(self, keys: list[str], sums: list[str]) -> None:
        self.keys, self.sums = keys, sums

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.total = handle.getValueState("total", ", ".join(f"{c} double" for c in self.sums))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        total = list(self.total.get()) if self.total.exists() else [0.0] * len(self.sums)
        due = None
        for f in rows:
            total = [a + float(f[c].fillna(0).sum()) for a, c in zip(total, self.sums, strict=True)]
            due = _millis(f[_DUE].max())
        if due is not None:
            self.total.update(tuple(total))
            if due not in list(self.handle.listTimers()):
                self.handle.registerTimer(due)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        total = self.total.get()
        self.total.clear()
        yield pd.DataFrame([(*key, *total)], columns=[*self.keys, *self.sums])

    def close(self) -> None:
        pass


def stream_months(rows: DataFrame, cols: list[str], values: list[str], delay: str = "30 days", time_col: str = "submission_time") -> DataFrame:
    """cols, period_start (a month's first day), n, and for each value its sum and count: a row for each group and month, once, when the watermark has passed the month's end.

    Days are summed first, in fixed windows and with partial sums before the shuffle, so a group with a large share of
    all rows sends at most a row a day and task; a month then holds the sums of its days. State: the days and months
    that the watermark has not passed. Rows without a time go. Null groups are groups. Needs STATE_STORE.
    """
    timed = rows.where(F.col(time_col).isNotNull()).withWatermark(time_col, delay)
    sums = ["n", *[f"{kind}_{v}" for v in values for kind in ("sum", "count")]]
    measures = [F.count(F.lit(1)).cast("double").alias("n")]
    for v in values:
        measures += [F.sum(F.col(v).cast("double")).alias(f"sum_{v}"), F.count(v).cast("double").alias(f"count_{v}")]
    days = timed.groupBy(*cols, F.window(time_col, "1 day").alias("_day")).agg(*measures)
    start = F.date_trunc("month", "_day.start")
    by_month = days.select(*cols, F.window_time("_day").alias("day_ends"), start.alias("period_start"), F.add_months(start, 1).cast("timestamp").alias(_DUE), *sums)
    keys = [*cols, "period_start"]
    out = StructType([*(days.schema[c] for c in cols), StructField("period_start", TimestampType())])
    for c in sums:
        out = out.add(c, "double")
    return by_month.groupBy(*keys).transformWithStateInPandas(_Month(keys, sums), out, "append", "eventTime")
