"""Streaming forms of the polling and stateful operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

# Hours at which a waiting action escalates.
LEVEL_HOURS = (24, 48, 72)


def events(spark: SparkSession, path: str, schema, per_trigger: int = 1) -> DataFrame:
    """A stream of the Parquet files of a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(path)


def hourly_counts(stream: DataFrame, time: str, key: str, late: str = "1 hour", width: str = "1 hour") -> DataFrame:
    """Tumbling counts; rows later than the watermark are left out."""
    return stream.withWatermark(time, late).groupBy(F.window(time, width), key).agg(F.count("*").alias("n"))


def rolling_activity(stream: DataFrame, time: str, key: str, width: str = "7 days", slide: str = "1 day", late: str = "1 day") -> DataFrame:
    """Sliding counts by key."""
    return stream.withWatermark(time, late).groupBy(F.window(time, width, slide), key).agg(F.count("*").alias("n"))


def sessions(stream: DataFrame, time: str, key: str, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    return stream.withWatermark(time, late).groupBy(F.session_window(time, gap), key).agg(F.count("*").alias("n"))


def once(stream: DataFrame, time: str, ids: list[str], late: str = "1 hour") -> DataFrame:
    """Replays within the watermark are dropped."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark(ids)


def key_entity_triggers(stream: DataFrame, key_entities: DataFrame, key: str = "entity_id") -> DataFrame:
    """Rows of key entities: a stream joined with a table."""
    return stream.join(key_entities, key, "left_semi")


def incremental_edges(stream: DataFrame, a: str, b: str) -> DataFrame:
    """Counts of unordered pairs, updated as rows come."""
    return stream.filter(F.col(a) != F.col(b)).groupBy(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).agg(F.count("*").alias("n"))


def signal_labels(stream: DataFrame, key: str = "entity_id", signal: str = "signal") -> DataFrame:
    """Counters of signals with the label that they give: noise from three ignored,
    partner from five acted on."""
    schema = f"{key} long, ignored long, acted long, label string, confidence double"

    def count(k: tuple, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        ignored, acted = state.get if state.exists else (0, 0)
        for frame in rows:
            ignored += int((frame[signal] == "ignored").sum())
            acted += int((frame[signal] == "acted").sum())
        state.update((ignored, acted))
        label, sure = ("partner", 0.7) if acted >= 5 else ("noise", 0.6) if ignored >= 3 else (None, None)
        yield pd.DataFrame({key: [k[0]], "ignored": [ignored], "acted": [acted], "label": [label], "confidence": [sure]})

    return stream.groupBy(key).applyInPandasWithState(count, schema, "ignored long, acted long", "update", GroupStateTimeout.NoTimeout)


def escalations(stream: DataFrame, late: str = "1 hour") -> DataFrame:
    """Levels of waiting actions by event time: a row when an action comes, and one
    for each level that its wait reaches before it is closed.

    ``stream``: id, at, status (pending, or what closes it)."""
    schema = "id long, level int, at timestamp"

    def step(k: tuple, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        out: list[tuple] = []
        if state.hasTimedOut:
            began, level = state.get
            level += 1
            out.append((k[0], level, pd.Timestamp(began + LEVEL_HOURS[level - 1] * 3_600_000, unit="ms")))
            if level < len(LEVEL_HOURS):
                state.update((began, level))
                state.setTimeoutTimestamp(max(began + LEVEL_HOURS[level] * 3_600_000, state.getCurrentWatermarkMs() + 1))
            else:
                state.remove()
        else:
            for frame in rows:
                for at, status in sorted(zip(frame["at"], frame["status"], strict=True)):
                    if status != "pending":
                        if state.exists:
                            state.remove()
                    elif not state.exists:
                        began = int(at.timestamp() * 1000)
                        state.update((began, 0))
                        out.append((k[0], 0, at))
            if state.exists:
                began, level = state.get
                state.setTimeoutTimestamp(max(began + LEVEL_HOURS[level] * 3_600_000, state.getCurrentWatermarkMs() + 1))
        if out:
            yield pd.DataFrame(out, columns=["id", "level", "at"])

    return stream.withWatermark("at", late).groupBy("id").applyInPandasWithState(step, schema, "began long, level int", "append", GroupStateTimeout.EventTimeTimeout)


def upsert_sink(stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, every: str | None = None):
    """Hand each micro-batch to ``write``; all that is there at once unless ``every``."""
    out = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (out.trigger(processingTime=every) if every else out.trigger(availableNow=True)).start()


def drain(stream: DataFrame, name: str, mode: str) -> DataFrame:
    """Run a stream over what is there and return its result as a table in memory
    (for checks and small results)."""
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.table(name)


def to_table(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Run an aggregation over what is there; its whole result replaces the table at
    ``path`` with each micro-batch, and a further run goes on from the checkpoint."""

    def write(df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(path)

    stream.writeStream.foreachBatch(write).outputMode("complete").option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.parquet(path)


class VersionedTable:
    """A keyed Parquet table that micro-batches bring up to date, in buckets by key.

    A batch rewrites just the buckets that it touches, beside the last ones and under its own
    number, and names them when they are whole: one that runs again after a failure writes the
    same again, so nothing counts twice, and a new process goes on where the last one ended.
    What no bucket needs any more is deleted after the next batch; a table that was read
    before then no longer reads."""

    def __init__(self, spark: SparkSession, root: str, schema: str, key: str, buckets: int = 16) -> None:
        self.spark, self.root, self.schema, self.key, self.buckets = spark, root, schema, key, buckets

    def _path(self, path: str):
        hadoop = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return hadoop, hadoop.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _versions(self) -> list[int]:
        """Batches that are whole."""
        folder, fs = self._path(f"{self.root}/touched")
        names = [s.getPath().getName() for s in fs.listStatus(folder)] if fs.exists(folder) else []
        return sorted(int(n) for n in names if n.isdigit() and fs.exists(self._path(f"{self.root}/touched/{n}/_SUCCESS")[0]))

    def _latest(self, before: int | None = None) -> dict[int, int]:
        """The version of each bucket."""
        own = [v for v in self._versions() if before is None or v < before]
        if not own:
            return {}
        touched = self.spark.read.schema("bucket int, version int").parquet(*(f"{self.root}/touched/{v}" for v in own))
        return {r.bucket: r.version for r in touched.groupBy("bucket").agg(F.max("version").alias("version")).collect()}  # a row a bucket

    def read(self, before: int | None = None, only: list[int] | None = None) -> DataFrame:
        paths = [f"{self.root}/data/{v}/bucket={b}" for b, v in self._latest(before).items() if only is None or b in only]
        paths = [p for p in paths if self._path(p)[1].exists(self._path(p)[0])]  # a bucket may have become empty
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int").alias("bucket")

    def sync(self, stream: DataFrame, checkpoint: str, change: Callable[[DataFrame, DataFrame], DataFrame]) -> DataFrame:
        """One tick: touched buckets become ``change(their rows, new rows)`` with each
        micro-batch."""

        def write(df: DataFrame, batch: int) -> None:
            touched = [r.bucket for r in df.select(self._bucket()).distinct().collect()]  # at most ``buckets`` rows
            new = change(self.read(batch, touched), df)
            new.select("*", self._bucket()).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.root}/data/{batch}")
            self.spark.createDataFrame([(b, batch) for b in touched], "bucket int, version int").coalesce(1).write.mode("overwrite").parquet(f"{self.root}/touched/{batch}")

        stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
        needed = set(self._latest().values())
        for version in self._versions():
            if version not in needed:
                for kind in ("touched", "data"):
                    path, fs = self._path(f"{self.root}/{kind}/{version}")
                    fs.delete(path, True)
        return self.read()


def thread_update(threads: DataFrame, messages: DataFrame) -> DataFrame:
    """Threads (``thread_id, messages, last_position, awaiting_reply``) after further
    messages (``thread_id, position, sent``): counts grow, replays of a position that
    is not after the last are left out, and the tag follows the last message."""
    known = threads.select("thread_id", F.col("messages").alias("had"), "last_position", F.col("awaiting_reply").alias("was"))
    new = messages.dropDuplicates(["thread_id", "position"]).join(known.select("thread_id", "last_position"), "thread_id", "left")
    new = new.filter(F.col("last_position").isNull() | (F.col("position") > F.col("last_position")))
    new = new.groupBy("thread_id").agg(F.count("*").alias("more"), F.max("position").alias("last"), F.max_by(~F.col("sent"), "position").alias("waits"))
    return known.join(new, "thread_id", "full_outer").select(
        "thread_id", (F.coalesce("had", F.lit(0)) + F.coalesce("more", F.lit(0))).alias("messages"), F.coalesce("last", "last_position").alias("last_position"), F.coalesce("waits", "was").alias("awaiting_reply")
    )


# Hours between runs, and how long a lock holds.
RUN_GAP_HOURS, LOCK_HOURS = 4, 1


def may_run(state: DataFrame, as_of: str, gap: float = RUN_GAP_HOURS, lock: float = LOCK_HOURS) -> DataFrame:
    """Jobs (``job, completed_at, locked_at``) and whether each may start: its last run
    is ``gap`` hours old or none, and no lock younger than ``lock`` hours holds it."""
    now = F.lit(as_of).cast("timestamp_ntz")
    old = lambda c, hours: F.col(c).isNull() | (F.col(c) <= now - F.expr(f"INTERVAL '{int(hours * 60)}' MINUTE"))
    return state.withColumn("ready", old("completed_at", gap) & old("locked_at", lock))


def due_steps(steps: DataFrame, as_of: str) -> DataFrame:
    """Steps (``step, every_hours, last_run``) whose cadence has passed."""
    now = F.lit(as_of).cast("timestamp_ntz")
    return steps.filter(F.col("last_run").isNull() | (F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col("last_run").cast("timestamp")) > F.col("every_hours") * 3_600_000_000))


def unexpired(contexts: DataFrame, as_of: str, minutes: float) -> DataFrame:
    """Cached contexts (``key, made_at``, any more) that still hold; keys in any case."""
    now = F.lit(as_of).cast("timestamp_ntz")
    own = contexts.withColumn("key", F.lower("key"))
    return own.filter(F.col("made_at") + F.expr(f"INTERVAL '{int(minutes * 60)}' SECOND") >= now)
