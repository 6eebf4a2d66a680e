"""Validity intervals, components that grow, expansion, paths and day tables, by hand."""

import random

import pytest
from pyspark.sql import functions as F

from lorespark.operators import activity, graph, retrieval, rollups, versions

A, B, C = "2024-01-01 00:00:00", "2024-01-10 00:00:00", "2024-01-20 00:00:00"


def edges_of(spark, rows):
    return spark.createDataFrame(rows, "a long, b long, n long, confidence double")


def read(df, when):
    return sorted((r.a, r.b, r.n, r.confidence) for r in versions.as_of(df, when).collect())


def test_merge_opens_and_closes_versions(spark):
    start = versions.opened(edges_of(spark, [(1, 5, 2, 0.6), (5, 2, 3, 0.7), (5, 6, 1, 0.5), (1, 2, 4, 0.9), (7, 8, 1, 0.5), (6, 2, 1, 0.95)]), A)
    mapping = spark.createDataFrame([(5, 1), (6, 1)], "old_id long, new_id long")
    merged = versions.merge(start, mapping, B)
    before = [(1, 2, 4, 0.9), (1, 5, 2, 0.6), (2, 5, 3, 0.7), (2, 6, 1, 0.95), (5, 6, 1, 0.5), (7, 8, 1, 0.5)]
    assert read(merged, A) == read(merged, "2024-01-09 23:59:59") == before
    assert read(merged, B) == [(1, 2, 8, 1.0), (7, 8, 1, 0.5)]  # 5-1 and 5-6 were loops then
    gone = versions.dismiss(merged, spark.createDataFrame([(7,)], "node long"), C)
    assert read(gone, C) == [(1, 2, 8, 1.0)] and read(gone, B) == read(merged, B) and read(gone, A) == before
    again = versions.merge(merged, mapping, C)
    assert read(again, C) == read(merged, C) and again.count() == merged.count()
    new = versions.merge(start, spark.createDataFrame([(8, 9), (6, 9)], "old_id long, new_id long"), B)
    assert read(new, B) == [(1, 2, 4, 0.9), (1, 5, 2, 0.6), (2, 5, 3, 0.7), (2, 9, 1, 0.95), (5, 9, 1, 0.5), (7, 9, 1, 0.5)]


def test_aliases(spark):
    aliases = spark.createDataFrame([(5, "five"), (1, "one")], "entity_id long, alias string")
    names = spark.createDataFrame([(5, "Five"), (1, "One")], "id long, name string")
    got = versions.merge_aliases(aliases, names, spark.createDataFrame([(5, 1)], "old_id long, new_id long"))
    assert sorted(map(tuple, got.collect())) == [(1, "Five"), (1, "five"), (1, "one")]


def by_hand(edges):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and b is not None:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {n: find(n) for n in list(root)}


def test_components_grow_and_survive_a_restart(spark, tmp_path):
    r = random.Random(5)
    every = [(r.randrange(60), r.randrange(60)) for _ in range(45)] + [(None, 3), (70, 70)]
    state = versions.GrowingComponents(spark, f"{tmp_path}/c")
    assert state.read().collect() == []
    for k in range(0, len(every), 24):
        own = spark.createDataFrame(every[k : k + 24], "a long, b long")
        state = versions.GrowingComponents(spark, f"{tmp_path}/c").add(own)  # another process goes on
        assert {x.node: x.component for x in state.read().collect()} == by_hand(every[: k + 24])
    assert {x.node: x.component for x in state.add(own).read().collect()} == by_hand(every)  # a batch that is repeated
    (tmp_path / "c/roots/9").mkdir()  # one that never finished
    assert versions.GrowingComponents(spark, f"{tmp_path}/c").version == state.version


def test_expansion_by_hand(spark):
    members = spark.createDataFrame([(10, 1), (11, 2), (12, 3), (12, 2), (13, 4), (14, 5)], "item_id long, entity_id long")
    edges = spark.createDataFrame([(1, 2, 4), (1, 3, 2), (2, 4, 8), (3, 5, 1), (4, 5, 9)], "a long, b long, n long")
    seeds = spark.createDataFrame([(1,)], "entity_id long")
    threads = spark.createDataFrame([("t", 13), ("t", 20), ("u", 13), ("v", 30)], "thread_id string, id long")
    items = spark.createDataFrame([(i, "2024-01-01 00:00:00") for i in (10, 11, 12, 13, 14, 20, 30)], "id long, d string").select("id", F.col("d").cast("timestamp_ntz").alias("source_date"))
    run = lambda **kw: {r.id: round(r.score, 6) for r in retrieval.graph_expansion(members, edges, seeds, threads, items, "2024-01-01 00:00:00", 20, **kw).collect()}
    assert run() == {10: 0.9, 11: 0.6, 12: 0.6, 13: 0.6, 14: 0.0375, 20: 0.55}
    assert run(fans=(1, 1)) == {10: 0.9, 11: 0.6, 12: 0.6, 13: 0.6, 20: 0.55}  # 3 and 5 lie beyond the fans
    assert run(fans=(30,), bases=(0.6,)) == {10: 0.9, 11: 0.6, 12: 0.6}


def test_paths_by_confidence(spark):
    edges = spark.createDataFrame([(1, 2, 0.5), (1, 3, 0.9), (2, 4, 1.0), (3, 4, 0.4), (4, 5, 0.5), (5, 1, 0.1)], "a long, b long, confidence double")
    got = graph.confident_neighbourhood(edges, spark.createDataFrame([(1,)], "node long"), 9).collect()
    assert [(r.node, r.depth, round(r.confidence, 6)) for r in got] == [(1, 0, 1.0), (3, 1, 0.9), (2, 1, 0.5), (4, 2, 0.5), (5, 1, 0.1)]


def test_day_tables_of_several_loads(spark):
    rows = [(e, i, "r", "inbound" if i % 3 else None, f"2024-01-{1 + i % 30:02d} {i % 24:02d}:00:00") for e in range(4) for i in range(e, 90, e + 1)]
    own = spark.createDataFrame(rows, "entity_id long, item_id long, role string, direction string, d string").select("*", F.col("d").cast("timestamp_ntz").alias("mention_date"))
    now = "2024-01-31 00:00:00"
    days = rollups.daily(own.filter("item_id < 40")).unionByName(rollups.daily(own.filter("item_id >= 40")))
    want = sorted(map(tuple, activity.momentum(own, now).collect()))
    assert sorted(map(tuple, activity.trends(rollups.weekly_from_days(days, now, ("entity_id",)), ("entity_id",)).collect())) == want
    assert sorted(map(tuple, activity.judged(rollups.baseline_from_days(days, now), now).collect())) == sorted(map(tuple, activity.communication_baseline(own, now).collect()))
    week = {r.entity_id: (r.mentions, r["items"], r.days) for r in rollups.window_from_days(days, now, 7, ("entity_id",)).collect()}
    exact = own.filter("mention_date >= '2024-01-24'").groupBy("entity_id").agg(F.count("*"), F.countDistinct("item_id"), F.countDistinct(F.to_date("mention_date"))).collect()
    assert week == {r[0]: tuple(r)[1:] for r in exact}
    with pytest.raises(ValueError):
        rollups.weekly_from_days(days, "2024-01-31 10:00:00", ("entity_id",))
