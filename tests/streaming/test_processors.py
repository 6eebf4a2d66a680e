"""Streams give what the same rows give as a table."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from lorespark.streaming import processors as p

EVENTS = "/root/testdata/sf0.001/events.parquet"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Events in order of time, a file a day."""
    path = str(tmp_path_factory.mktemp("events"))
    rows = spark.read.parquet(EVENTS).withColumn("ts", F.col("ts").cast("timestamp"))
    for k, day in enumerate(sorted(r.d for r in rows.select(F.to_date("ts").alias("d")).distinct().collect())[:6]):
        rows.filter(F.to_date("ts") == day).coalesce(1).write.mode("append").parquet(f"{path}/{k:03d}")
    return path


def stream(spark, folder):
    schema = spark.read.parquet(f"{folder}/*").schema
    return p.events(spark, f"{folder}/*", schema)


def rows(df):
    return Counter(str(sorted(r.asDict(True).items(), key=str)) for r in df.collect())


@pytest.mark.parametrize("make", [lambda s: p.hourly_counts(s, "ts", "event_type"), lambda s: p.rolling_activity(s, "ts", "user_id"), lambda s: p.sessions(s, "ts", "user_id", "3 hours")])
def test_windows_match_batch(spark, folder, make):
    batch = spark.read.parquet(f"{folder}/*")
    mode = "complete"
    got = p.drain(make(stream(spark, folder)), f"w{id(make)}", mode)
    assert rows(got) == rows(make(batch))


def test_replays_are_dropped(spark, folder):
    twice = stream(spark, folder).unionByName(stream(spark, folder))
    got = p.drain(p.once(twice, "ts", ["event_id"], "10 days").select("event_id"), "once", "append")
    assert rows(got) == rows(spark.read.parquet(f"{folder}/*").select("event_id"))


def test_triggers_and_edges(spark, folder):
    batch = spark.read.parquet(f"{folder}/*")
    key = spark.range(5).select(F.col("id").alias("user_id"))
    got = p.drain(p.key_entity_triggers(stream(spark, folder), key, "user_id").select("event_id"), "keyed", "append")
    assert rows(got) == rows(batch.join(key, "user_id", "left_semi").select("event_id"))
    pairs = lambda s: p.incremental_edges(s.withColumn("other", F.col("event_id") % 7), "user_id", "other")
    assert rows(p.drain(pairs(stream(spark, folder)), "edges", "complete")) == rows(pairs(batch))


def test_signal_labels(spark, tmp_path):
    spark.createDataFrame([(1, "ignored")] * 3 + [(2, "acted")] * 5 + [(3, "ignored"), (3, "acted")], "entity_id long, signal string").coalesce(1).write.parquet(str(tmp_path / "s"))
    s = spark.readStream.schema("entity_id long, signal string").parquet(str(tmp_path / "s"))
    got = {r.entity_id: (r.ignored, r.acted, r.label) for r in p.drain(p.signal_labels(s), "signals", "update").collect()}
    assert got == {1: (3, 0, "noise"), 2: (0, 5, "partner"), 3: (1, 1, None)}


def test_escalations(spark, tmp_path):
    steps = [[(1, "2024-01-01 00:00:00", "pending"), (2, "2024-01-01 00:00:00", "pending")], [(2, "2024-01-02 06:00:00", "done"), (9, "2024-01-02 06:00:00", "done")], [(9, "2024-01-03 06:00:00", "done")], [(9, "2024-01-06 00:00:00", "done")], [(9, "2024-01-07 00:00:00", "done")], [(9, "2024-01-08 00:00:00", "done")]]
    for k, step in enumerate(steps):
        df = spark.createDataFrame(step, "id long, at string, status string").withColumn("at", F.col("at").cast("timestamp"))
        df.coalesce(1).write.parquet(str(tmp_path / f"{k:02d}"))
    s = spark.readStream.schema("id long, at timestamp, status string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "*"))
    got = [(r.id, r.level) for r in p.drain(p.escalations(s), "levels", "append").collect()]
    assert sorted(x for x in got if x[0] == 1) == [(1, 0), (1, 1), (1, 2), (1, 3)]
    assert (2, 0) in got and (2, 2) not in got


def test_upsert_sink(spark, folder, tmp_path):
    out = str(tmp_path / "out")
    query = p.upsert_sink(stream(spark, folder).select("event_id"), lambda df, n: df.write.mode("append").parquet(out), str(tmp_path / "check"))
    query.awaitTermination()
    assert rows(spark.read.parquet(out)) == rows(spark.read.parquet(f"{folder}/*").select("event_id"))


def test_a_versioned_table_outlives_its_process(spark, tmp_path):
    """A new object goes on from what is on disk; untouched buckets stay where they are."""
    from lorespark.operators.rollups import upsert

    schema, root = "id long, value long", str(tmp_path)
    put = lambda rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{root}/in")
    held = lambda: p.VersionedTable(spark, f"{root}/table", schema, "id", 4)
    sync = lambda: held().sync(spark.readStream.schema(schema).parquet(f"{root}/in"), f"{root}/checkpoint", lambda old, new: upsert(old, new, ["id"]))
    read = lambda df: {r.id: r.value for r in df.collect()}
    put([(i, 0) for i in range(20)])
    assert read(sync()) == {i: 0 for i in range(20)}
    assert read(sync()) == read(held().read()) == {i: 0 for i in range(20)}  # no new files
    put([(3, 1), (40, 1)])
    assert read(sync()) == {i: int(i in (3, 40)) for i in [*range(20), 40]}
    touched = {r.bucket for r in spark.read.parquet(f"{root}/table/touched/1").collect()}
    assert 1 <= len(touched) <= 2 and {int(d.name.split("=")[1]) for d in (tmp_path / "table/data/1").glob("bucket=*")} == touched
    (tmp_path / "table/data/2").mkdir()  # a batch that broke off
    assert read(held().read()) == read(sync())
    put([(i, 2) for i in range(41)])
    assert set(read(sync()).values()) == {2} and not (tmp_path / "table/data/0").exists()
