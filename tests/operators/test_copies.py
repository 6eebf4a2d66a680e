"""Large groups of copies, and what they must not be expanded to."""

import pytest
from pyspark.sql import functions as F

from lorespark.operators import activity, context, graph, quality

SF = "/root/testdata/sf0.001"


def test_supersession_compares_texts_not_facts(spark, monkeypatch):
    rows = spark.range(3_000).select("id", F.lit("p").alias("project"), F.lit("k").alias("kind"), F.when(F.col("id") % 2 == 0, "red big ring").otherwise("red big bolt").alias("text"), F.col("id").alias("at"))
    rows = rows.unionByName(spark.createDataFrame([(9_000, "p", "k", "none of it", 9_000), (9_001, "q", "k", "red big ring", 9_001)], rows.schema))
    compared, whole = [], quality.overlapping
    monkeypatch.setattr(quality, "overlapping", lambda sets, prefix: compared.append(sets.count()) or whole(sets, prefix))
    got = {r.id: r.by for r in quality.superseded_facts(rows, 0.5).collect()}
    assert got == {i: 2_999 if i % 2 == 0 else 2_998 for i in range(2_998)} | {2_998: 2_999}
    assert compared == [4]


def test_overlaps_count_days_not_pairs(spark):
    rows = spark.range(400_000).select("id", F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("project"), F.lit("2024-01-01").cast("timestamp_ntz").alias("due_date"))
    rows = rows.unionByName(spark.createDataFrame([(-1, "b", None), (-2, None, None)], "id long, project string, due_date string").withColumn("due_date", F.lit("2024-01-08").cast("timestamp_ntz")))
    (one,) = activity.date_overlaps(rows).collect()
    assert (one.project, one.project2, one.pairs, one.gap, one.id, one.id2) == ("a", "b", 200_000 * 200_001, 0, 0, 1)


def test_near_duplicates_count_copies(spark):
    rows = spark.range(60_000).select("id", F.lit(1).alias("project"), F.when(F.col("id") < 59_999, "large ring economy of brass").otherwise("large ring economy of brasses").alias("text"))
    got = quality.near_duplicate_texts(rows).groupBy("class_id").agg(F.count("*").alias("n"), F.min("links").alias("least"), F.max("links").alias("most"))
    assert sorted(map(tuple, got.collect())) == [(0, 59_999, 59_999, 59_999), (59_999, 1, 59_999, 59_999)]


def test_parts_of_a_project_are_members(spark):
    rows = spark.range(100_000).select("id", F.when(F.col("id") < 99_999, "p").alias("project"))
    assert [tuple(r) for r in context.same_project(rows).groupBy("class_id", "links").count().collect()] == [(0, 99_998, 99_999)]


def test_owner_holds_name_from_a_word_on(spark):
    c = spark.createDataFrame([(1, "xAnn Lee met Ann"), (2, "Ann Leeds")], "id long, owner string")
    e = spark.createDataFrame([(7, "Ann Lee"), (8, "ann lee")], "id long, name string")
    assert sorted(map(tuple, context.owned_by(c, e).collect())) == [(2, 7), (2, 8)]


def test_owners_are_never_sent_whole(spark):
    from lorespark.plans import CATALOG

    assert "Broadcast" not in CATALOG["owned_commitments"].plan(spark, SF)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("seen", [True, False])
def test_resolution_by_prefix_and_by_a_foreign_alias(spark, seen):
    e = spark.createDataFrame([(1, "Ann Lee", 5), (2, "Ann Leeds", 9), (3, "Ann Lea", None), (4, "Ann Lex", 9)], "id long, name string, last_seen int").select("id", "name", F.lower("name").alias("normal"), F.lit(None).cast("string").alias("email"), (F.col("id") == 4).alias("dismissed"), *(["last_seen"] if seen else []))
    a = spark.createDataFrame([(77, "nick")], "entity_id long, alias string")
    names = spark.createDataFrame([("Ann", None), ("Ann Lee", None), ("NICK", None), ("Ann Lex!", None)], "name string, email string").withColumn("normal", F.lower("name"))
    got = {r.name: (r.entity_id, r.tier) for r in graph.resolve(names, e, a).collect()}
    assert got == {"Ann": (2 if seen else 1, 5), "Ann Lee": (1, 1), "NICK": (77, 4)}


@pytest.mark.parametrize("wide", [2, 32])
def test_sharing_by_pairs_and_by_single_entities(spark, monkeypatch, wide):
    monkeypatch.setattr(graph, "WIDE", wide)
    has = {1: {1, 2, 3, 4}, 2: {2, 3, 4, 9}, 3: {1, 9}, 4: {1, 9, 7}, 5: {5}, 6: {1, 2, 3, 4, 9}, 7: {7, 8}}
    rows = spark.createDataFrame([(i, e) for i, es in has.items() for e in es], "item_id long, entity_id long")
    want = {(a, len(has[a]), b, len(has[b]), len(has[a] & has[b])) for a in has for b in has if a < b and len(has[a] & has[b]) >= 2}
    got = [tuple(r) for r in graph._sharing(rows.unionByName(rows.limit(3)), 2).select("id", "size", "id_b", "size_b", "shared").collect()]
    assert len(got) == len(want) and set(got) == want


def test_databases_are_read_by_tasks(spark):
    from lorespark.session import scratch
    from lorespark.sources import files

    rows = spark.range(5_001).select(F.col("id").alias("rowid"), F.when(F.col("id") % 2 == 0, "é'\n").alias("text"))
    path = scratch(spark, "databases")
    files.write_databases(rows.coalesce(1), path, "messages")
    assert spark.read.parquet(path).count() == 3
    got = files.databases_after(spark, path, "messages", "rowid", 4_997, "rowid long, text string")
    assert sorted(map(tuple, got.collect())) == [(4_998, "é'\n"), (4_999, None), (5_000, "é'\n")]
    assert files.databases_after(spark, path, "messages", "rowid", 9_999, "rowid long, text string").count() == 0


def test_profiles_count_all_open_commitments(spark):
    from lorespark.plans import CATALOG

    owners = [f"user_{r.o_custkey % 300} of {r.o_orderpriority.lower()}" for r in spark.read.parquet(f"{SF}/orders.parquet").filter("o_orderstatus = 'O'").collect()]
    found = CATALOG["entity_profiles"].plan(spark, SF).select("name", "commitments").collect()
    assert found and {r.name: r.commitments for r in found} == {r.name: sum(r.name in o for o in owners) for r in found}


def test_profiles_look_up_owners_once(spark, monkeypatch):
    from lorespark.operators import profiles

    e = spark.createDataFrame([(1, "Ann", False), (2, "Annabel", False), (3, "Bob", True), (4, "Cy", False)], "id long, name string, dismissed boolean")
    c = spark.range(30_000).select((F.col("id") % 10_000).alias("id"), F.when(F.col("id") % 2 == 0, "ANN or Annabel").when(F.col("id") % 3 == 0, "bob's").alias("owner"), F.when(F.col("id") < 24_000, "active").when(F.col("id") < 27_000, "fulfilled").alias("state"))
    none = lambda schema: spark.createDataFrame([], schema)
    looked_up, whole = [], profiles.names_in_texts
    monkeypatch.setattr(profiles, "names_in_texts", lambda names, texts: looked_up.append(texts.count()) or whole(names, texts))
    got = profiles.entity_profiles(e, none("entity_id long, item_id long, direction string, mention_date timestamp_ntz"), none("id long, project string, source_date timestamp_ntz"), none("item_id long, entity_id long"), none("entity_id long, alias string"), c, "2024-01-31 00:00:00")
    assert {r.entity_id: r.commitments for r in got.collect()} == {1: 12_000, 2: 12_000, 3: 4_000, 4: 0}
    assert looked_up == [3]  # of 24,000 open ones: two spellings, and those without an owner


@pytest.mark.parametrize("size", [2, 100])
def test_most_met_in_blocks(spark, monkeypatch, size):
    monkeypatch.setattr(graph, "MEETING", size)
    monkeypatch.setattr(graph, "MET", size + 1)
    has = {i: {x for x in range(1, 30) if x % (i + 1) < 2} for i in range(12)}
    rows = spark.createDataFrame([(i, e) for i, es in has.items() for e in es] + [(99, 500)], "item_id long, entity_id long")
    others = spark.range(1, 25).toDF("entity_id")
    n = lambda a, b: sum(a in es and b in es for es in has.values())
    want = {(a, b, n(a, b)) for a in range(1, 30) for b in sorted((x for x in range(1, 25) if x != a and n(a, x)), key=lambda x: (-n(a, x), x))[:5]}
    got = [tuple(r) for r in graph.most_met(rows, others, 5).collect()]
    assert len(got) == len(want) and set(got) == want


def test_blocks_meet_in_no_more_tasks_than_pairs_of_blocks(spark):
    rows = spark.range(60).selectExpr("id DIV 3 AS item_id", "id % 7 AS entity_id")
    hold = {"spark.sql.shuffle.partitions": "50", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    was = {k: spark.conf.get(k) for k in hold}
    try:
        for k, v in hold.items():
            spark.conf.set(k, v)
        assert graph._packed(rows, 3).rdd.getNumPartitions() == 3
    finally:
        for k, v in was.items():
            spark.conf.set(k, v)


def test_tasks_stay_small_as_members_grow(spark, monkeypatch):
    """Shuffles by size packed all items, and then all pairs, into as few tasks as there are cores."""
    from lorespark import session
    from lorespark.operators import graph

    rows = spark.range(3_000).selectExpr("id DIV 3 AS item_id", "id * 7 % 500 AS entity_id")
    want = sorted(map(tuple, graph.cooccurrence_edges(rows).collect()))
    monkeypatch.setattr(session, "DEALT", 100)
    edges = graph.cooccurrence_edges(rows.unionByName(rows))  # repeated members change nothing
    assert edges.rdd.getNumPartitions() >= 60 and graph.pairs(rows).rdd.getNumPartitions() >= 30
    assert sorted(map(tuple, edges.collect())) == want
    ends = graph.symmetric(edges)
    assert sorted((r.a, r.b, r.n) for r in ends.collect()) == sorted([(a, b, n) for a, b, n, _ in want] + [(b, a, n) for a, b, n, _ in want])


def test_contacts_are_dealt(spark, monkeypatch):
    from lorespark import session
    from lorespark.plans import CATALOG, selections
    from lorespark.sources.fixtures import Tables

    sf = "/root/testdata/sf0.001"
    want = sorted(map(str, CATALOG["graph_entities"].plan(spark, sf).collect()))
    monkeypatch.setattr(session, "DEALT", 100)
    assert selections._contacts(Tables(spark, sf)).rdd.getNumPartitions() >= 60
    assert sorted(map(str, CATALOG["graph_entities"].plan(spark, sf).collect())) == want
