"""Stateful operators against the same rows by hand, in one micro-batch and in several."""

import time
from datetime import datetime, timedelta

import pytest
from pyspark.sql import Row
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, TimerValues

from lorespark.streaming import processors, stateful

BEGIN = datetime(2024, 1, 1)
at = lambda hours: BEGIN + timedelta(hours=hours)
ACTIONS = "id long, at timestamp, status string, until timestamp, kind string"
#: Day by day: 1 waits on, 2 is closed, 3 is snoozed over two levels, 4 is mail, 5 is snoozed for good.
DAYS = [
    [(i, at(0), "pending", None, "email" if i == 4 else "call") for i in range(1, 6)] + [(5, at(1), "snoozed", at(500), "call")],
    [(2, at(30), "done", None, "call"), (3, at(20), "snoozed", at(60), "call")],
    [(9, at(50), "pending", None, "call")],
    [(2, at(90), "pending", None, "call"), (9, at(91), "done", None, "call")],
    [(8, at(100), "pending", None, "call")],
]
LEVELS = {1: [0, 1, 2, 3], 2: [0, 1, 0], 3: [0, 2, 3], 4: [0, 1, 2, 3], 5: [0], 9: [0, 1], 8: [0]}


@pytest.mark.parametrize("files", ["one by one", "together"])
def test_escalations(spark, tmp_path, files):
    for day in DAYS:
        spark.createDataFrame(day, ACTIONS).coalesce(1).write.mode("append").parquet(f"{tmp_path}/log")
        time.sleep(0.05)  # files are taken in order of their times
    stream = processors.events(spark, f"{tmp_path}/log", spark.read.parquet(f"{tmp_path}/log").schema, 1 if files == "one by one" else 100)
    got: dict = {}
    for r in stateful.drained(stateful.escalate(stream, "0 seconds"), f"{tmp_path}/out").orderBy("id", "at", "level").collect():
        assert r.automatic == (r.level > 0 and r.id != 4)
        got.setdefault(r.id, []).append(r.level)
    assert got == LEVELS


def test_levels_by_hand():
    hour = 3_600_000
    assert stateful.levels_until(0, 0, 0, 24 * hour - 1) == []
    assert stateful.levels_until(0, 0, 0, 80 * hour) == [(1, 24 * hour), (2, 48 * hour), (3, 72 * hour)]
    assert stateful.levels_until(0, 0, 50 * hour, 60 * hour) == [(2, 50 * hour)]
    assert stateful.levels_until(0, 2, 0, 100 * hour) == [(3, 72 * hour)]


def test_contexts_that_expire(spark, tmp_path):
    rows = [("A", at(0), True, None, "one"), ("a", at(0.2), False, 1, None), ("a", at(0.5), False, 2, None), ("a", at(0.51), False, 3, None), ("b", at(0.1), False, 4, None)]
    more = [("B", at(1), True, None, "two"), ("b", at(1), False, 5, None), ("a", at(1.1), True, None, "three"), ("A", at(1.2), False, 6, None)]
    for part in (rows, more):
        spark.createDataFrame(part, "key string, at timestamp, is_put boolean, request long, value string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/log")
        time.sleep(0.05)
    stream = processors.events(spark, f"{tmp_path}/log", spark.read.parquet(f"{tmp_path}/log").schema)
    got = {r.request: (r.hit, r.value) for r in stateful.drained(stateful.answer_from_cache(stream, 30), f"{tmp_path}/out").collect()}
    assert got == {1: (True, "one"), 2: (True, "one"), 3: (False, None), 4: (False, None), 5: (True, "two"), 6: (True, "three")}


class Counted:
    """A handle of one key, with the calls that would go to the JVM."""

    def __init__(self):
        self.calls, self.value, self.timers = [], None, set()

    def getValueState(self, name, schema):  # noqa: N802
        return self

    def exists(self):
        self.calls.append("exists")
        return self.value is not None

    def get(self):
        self.calls.append("get")
        return self.value

    def update(self, value):
        self.calls.append("update")
        self.value = value

    def clear(self):
        self.calls.append("clear")
        self.value = None

    def listTimers(self):  # noqa: N802
        self.calls.append("list")
        return iter(self.timers)

    def registerTimer(self, at):  # noqa: N802
        self.calls.append("register")
        self.timers.add(at)

    def deleteTimer(self, at):  # noqa: N802
        self.calls.append("delete")
        self.timers.remove(at)


def test_an_action_takes_few_calls_of_its_state():
    hour = 3_600_000
    action, handle = stateful.Escalation(), Counted()
    action.init(handle)
    row = lambda hours, status, until=None: Row(id=7, us=hours * hour * 1000, status=status, until_us=until and until * hour * 1000, kind="call")

    def step(rows, watermark, fired=None):
        handle.calls.clear()
        now = TimerValues(0, watermark * hour)
        if fired is None:
            out = list(action.handleInputRows((7,), iter(rows), now))
        else:
            out = list(action.handleExpiredTimer((7,), now, ExpiredTimerInfo(fired * hour)))
            handle.timers.remove(fired * hour)  # as Spark does afterwards
        return [r.level for r in out], handle.calls, {t / hour for t in handle.timers}

    assert step([row(20, "snoozed", 30), row(0, "pending")], 0) == ([0], ["get", "register", "update"], {30})
    assert step([row(21, "snoozed", 30)], 0) == ([], ["get"], {30})
    assert step([row(22, "snoozed", 40)], 0) == ([], ["get", "delete", "register", "update"], {40})
    assert step([], 50, 40) == ([1, 2], ["get", "register", "update"], {72})
    assert step([row(60, "done")], 50) == ([], ["get", "delete", "clear"], set())
    assert step([row(61, "pending"), row(62, "done")], 50) == ([0], ["get"], set())


def test_levels_are_reached_to_the_microsecond(spark, tmp_path):
    """One begins half a millisecond too late for a level, the other just in time."""
    began = {1: at(0) + timedelta(microseconds=500), 2: at(0)}
    rows = [(i, t, "pending", None, "call") for i, t in began.items()] + [(-1, at(24), "pending", None, "email")]
    spark.createDataFrame(rows, ACTIONS).coalesce(1).write.parquet(f"{tmp_path}/log")
    stream = processors.events(spark, f"{tmp_path}/log", spark.read.parquet(f"{tmp_path}/log").schema)
    got = sorted((r.id, r.level, r.at) for r in stateful.drained(stateful.escalate(stream, "0 seconds"), f"{tmp_path}/out").filter("id > 0").collect())
    assert got == [(1, 0, began[1]), (2, 0, began[2]), (2, 1, at(24))]
