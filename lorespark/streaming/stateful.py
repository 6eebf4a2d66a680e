"""Operators with several states and timers, by ``transformWithState``.

Rows of a key are taken in order of event time, and what is due before a row comes first,
so results don't depend on how rows fall into micro-batches (rows later than the watermark
aside).  The state store is RocksDB, which this API asks for."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .processors import LEVEL_HOURS

_STORE = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_HOUR, _HOUR_US = 3_600_000, 3_600_000_000
ESCALATED = "id long, level int, automatic boolean, us long"
ANSWERED = "key string, request long, hit boolean, value string, at timestamp"


@contextmanager
def state_store(spark: SparkSession):
    """Streams that start inside keep their state in RocksDB."""
    before = spark.conf.get(_STORE)
    spark.conf.set(_STORE, _ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(_STORE, before)


def _ms(t: pd.Timestamp) -> int:
    return int(pd.Timestamp(t).timestamp() * 1000)


def levels_until(began: int, level: int, snoozed: int, until: int, hour: int = _HOUR) -> list[tuple[int, int]]:
    """(level, when) of what a wait since ``began`` reaches by ``until``: a level that falls
    into a snooze comes at its end, with all that have passed by then."""
    out = []
    while level < len(LEVEL_HOURS):
        due = max(began + LEVEL_HOURS[level] * hour, snoozed)
        if due > until:
            break
        level = sum(began + h * hour <= due for h in LEVEL_HOURS)
        out.append((level, due))
    return out


class Escalation(StatefulProcessor):
    """Levels of waiting actions: one state for the wait, its level and a snooze, and a timer
    for what is due next, which the state names.  Every call of the state goes to the JVM and
    back, so a key takes as few as can be: one to read, and one to write and one or two for
    the timer where they change.  Times are microseconds, of timers milliseconds."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.wait = handle.getValueState("wait", "began long, kind string, level int, snoozed long, timer long")

    def _keep(self, before: tuple | None, wait: tuple | None, fired: int, watermark: int) -> None:
        """State and timer become those of ``wait`` (began, kind, level, snoozed)."""
        timer = 0
        if wait is not None and wait[2] < len(LEVEL_HOURS):
            due = max(wait[0] + LEVEL_HOURS[wait[2]] * _HOUR_US, wait[3])
            timer = max(-(-due // 1000), watermark + 1)
        old = before[4] if before is not None else 0
        if timer != old:
            if old and old != fired:  # Spark deletes the one that has fired
                self.handle.deleteTimer(old)
            if timer:
                self.handle.registerTimer(timer)
        if wait is None:
            if before is not None:
                self.wait.clear()
        elif (*wait, timer) != before:
            self.wait.update((*wait, timer))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        before = self.wait.get()
        wait = before[:4] if before is not None else None
        for row in sorted(rows, key=lambda r: (r.us, r.status is None, r.status or "")):
            if wait is not None:
                began, kind, level, snoozed = wait
                for level, when in levels_until(began, level, snoozed, row.us, _HOUR_US):
                    yield Row(id=key[0], level=level, automatic=kind != "email", us=when)
                wait = (began, kind, level, snoozed)
            if row.status == "pending":
                if wait is None:
                    wait = (row.us, row.kind, 0, 0)
                    yield Row(id=key[0], level=0, automatic=False, us=row.us)
            elif row.status == "snoozed":
                if wait is not None and row.until_us is not None:
                    wait = (*wait[:3], row.until_us)
            else:
                wait = None
        self._keep(before, wait, 0, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        before = self.wait.get()
        if before is None:
            return
        began, kind, level, snoozed, _ = before
        fired, watermark = expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs()
        for level, when in levels_until(began, level, snoozed, max(fired, watermark) * 1000, _HOUR_US):
            yield Row(id=key[0], level=level, automatic=kind != "email", us=when)
        self._keep(before, (began, kind, level, snoozed), fired, watermark)

    def close(self) -> None:
        pass


def escalate(stream: DataFrame, late: str = "1 hour") -> DataFrame:
    """(id, level, automatic, at): a row when an action comes and one for each level that it
    reaches before it is closed.  ``stream``: id, at, status (pending, snoozed, or what
    closes it), until (of a snooze), kind (mail never runs by itself)."""
    own = stream.select("id", "at", "status", "kind", F.unix_micros("at").alias("us"), F.unix_micros("until").alias("until_us")).withWatermark("at", late)
    found = own.groupBy("id").transformWithState(Escalation(), ESCALATED, "append", "eventTime")
    return found.select("id", "level", "automatic", F.timestamp_micros("us").alias("at"))


class ContextCache(StatefulProcessor):
    """Contexts by key: the last one put, with its time, which answers for ``minutes``; a timer
    has it forgotten then."""

    def __init__(self, minutes: float):
        self.life = int(minutes * 60_000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.made = handle.getValueState("made", "at long, value string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        out: list[tuple] = []
        every = pd.concat(list(rows)).sort_values(["at", "is_put"], ascending=[True, False], kind="stable")
        made = self.made.get() if self.made.exists() else None
        put = False
        for row in every.itertuples():
            at = _ms(row.at)
            if row.is_put:
                made, put = (at, row.value), True
                continue
            hit = made is not None and at - made[0] <= self.life
            out.append((key[0], int(row.request), hit, made[1] if hit else None, row.at))
        if put:
            self.made.update(made)
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(max(made[0] + self.life, timerValues.getCurrentWatermarkInMs()) + 1)
        if out:
            yield pd.DataFrame(out, columns=["key", "request", "hit", "value", "at"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.made.clear()
        yield from ()

    def close(self) -> None:
        pass


def answer_from_cache(stream: DataFrame, minutes: float, late: str = "1 hour") -> DataFrame:
    """(key, request, hit, value, at) of requests: what was put last under their key (in any
    case) if it isn't older than ``minutes``.  ``stream``, in order of time from batch to
    batch: key, at, is_put, request, value."""
    own = stream.select(F.lower("key").alias("key"), "at", "is_put", "request", "value").withWatermark("at", late)
    return own.groupBy("key").transformWithStateInPandas(ContextCache(minutes), ANSWERED, "append", "eventTime")


def drained(stream: DataFrame, path: str) -> DataFrame:
    """Run a stream over what is there; its rows are written below ``path``, where a further
    run goes on."""
    spark = stream.sparkSession
    with state_store(spark):
        out = stream.writeStream.format("parquet").option("path", f"{path}/rows").option("checkpointLocation", f"{path}/checkpoint")
        out.outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/rows")
