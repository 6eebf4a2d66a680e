"""Boundaries of gaps, and the look-up of names in texts."""

from datetime import datetime, timedelta

import pytest

from lorespark.operators import context, gaps, quality
from lorespark.operators.sets import names_in_texts

NOW = "2024-03-31 12:00:00"
now = datetime.fromisoformat(NOW)
ago = lambda days: now - timedelta(days=days)


@pytest.mark.parametrize("days, severity", [(7.0, None), (7.1, "medium"), (14.9, "medium"), (15.0, "high"), (21.9, "high"), (22.0, "critical")])
def test_threads(spark, days, severity):
    rows = spark.createDataFrame([("t", "active", "Follow it UP", ago(days))], "title string, status string, current_state string, updated_at timestamp_ntz")
    got = gaps.thread(rows, NOW).collect()
    assert [(r.severity, r.days) for r in got] == ([(severity, int(days))] if severity else [])


@pytest.mark.parametrize("ahead, severity, days", [(3.0, None, 0), (2.9, "medium", 0), (1.9, "high", 0), (-0.5, "high", 0), (-1.0, "critical", 1), (-9.7, "critical", 9)])
def test_commitments(spark, ahead, severity, days):
    due = spark.createDataFrame([(1, "Send the offer", ago(-ahead), "active"), (2, "Send the bill", ago(-ahead), "active"), (3, "x", None, "active")], "id long, text string, due_date timestamp_ntz, state string")
    told = spark.createDataFrame([(9, "re: SEND THE BILL now")], "id long, text string")
    assert [(r.subject, r.severity, r.days) for r in gaps.commitment(due, told, NOW).collect()] == ([("Send the offer", severity, days)] if severity else [])


@pytest.mark.parametrize("days, severity", [(5.9, None), (6.0, "medium"), (8.0, "high"), (15.0, "critical")])
def test_communication(spark, days, severity):
    who = spark.createDataFrame([(1, "Ann", "key", False), (2, "Bob", "key", False), (3, "Cy", "client", True)], "id long, name string, label string, dismissed boolean")
    mentions = spark.createDataFrame([(i, ago(days)) for i in (1, 2, 3)], "entity_id long, mention_date timestamp_ntz")
    texts = spark.createDataFrame([(1, "call ANNA, cy")], "id long, text string")
    assert [(r.subject, r.severity) for r in gaps.communication(mentions, who, texts, NOW).collect()] == ([("Ann", severity)] if severity else [])


def test_projects_predictions_and_order(spark):
    profiles = spark.createDataFrame([("a", "stalled"), ("b", "stalling"), ("c", "stalling"), ("d", "moving")], "project string, status string")
    staged = spark.createDataFrame([("c", "pending"), ("b", "done")], "project string, status string")
    items = spark.createDataFrame([("a", ago(9.4))], "project string, source_date timestamp_ntz")
    slow = gaps.project(profiles, staged, items, NOW)
    assert sorted((r.subject, r.severity, r.days) for r in slow.collect()) == [("a", "critical", 9), ("b", "high", 999)]
    told = spark.createDataFrame([("x", "it will", ago(8), "pending"), ("y", "it will", ago(0.5), "pending"), ("z", "it will", ago(9), "correct"), ("w", "it will", ago(-1), "pending")], "subject string, prediction string, check_by timestamp_ntz, outcome string")
    late = gaps.prediction(told, NOW)
    assert [(r.kind, r.subject) for r in gaps.in_order(late, slow).collect()] == [("project", "a"), ("project", "b"), ("prediction", "x"), ("prediction", "y")]
    one = gaps.summary(gaps.in_order(late, slow)).first()
    assert (one.total, one.critical, one.high, one.medium, one.project_gaps, one.prediction_gaps, one.thread_gaps) == (4, 1, 2, 1, 2, 2, 0)
    assert gaps.summary(gaps.in_order(late.limit(0), slow.limit(0))).first().total == 0


def test_names_in_texts_by_hand(spark):
    names = ["ann", "Anna", "an", "b", "", None, "user_1", "user_11", "nobody", "AB[c", "é"]
    texts = ["Anna and Bob", "USER_11 wrote", "user_1", "", None, "x ab[c y", "café"]
    a = spark.createDataFrame(list(enumerate(names)), "name_id long, name string")
    b = spark.createDataFrame(list(enumerate(texts)), "text_id long, text string")
    want = {(i, j) for i, n in enumerate(names) for j, t in enumerate(texts) if n and t and n.lower() in t.lower()}
    assert {tuple(r) for r in names_in_texts(a, b).collect()} == want
    assert names_in_texts(a.filter("length(name) > 2"), b).count() == sum(len(names[i]) > 2 for i, _ in want)
    assert names_in_texts(a, b.limit(0)).collect() == [] and names_in_texts(a.limit(0), b).collect() == []


def test_judged_states_change_open_commitments_only(spark):
    c = spark.createDataFrame([(1, "a", "active"), (2, "a", "overdue"), (3, "b", "dropped"), (4, "c", "detected"), (5, "d", "active")], "id long, text string, state string")
    v = spark.createDataFrame([("a", "stale"), ("b", "fulfilled"), ("c", "waiting"), ("d", "active")], "text string, verdict string")
    assert sorted(tuple(r)[:3:1] for r in context.judged_states(c, v).select("id", "state").collect()) == [(1, "abandoned"), (2, "overdue"), (3, "dropped"), (4, "waiting"), (5, "active")]


def test_claims_by_hand(spark):
    page = "\n".join(["# Heading without facts at all here", "* John Smith met them in the hall", "- it was signed by both, " + "x" * 400, "short 12", "  > > 12 of them came to the house  ", "nothing to be seen in this long line", "---------------------------12"])
    df = spark.createDataFrame([(1, page), (2, None), (3, "")], "id long, text string")
    got = {r.id: r.c for r in df.select("id", quality.claims(df.text).alias("c")).collect()}
    assert got[1] == ["John Smith met them in the hall", ("it was signed by both, " + "x" * 400)[:300], "12 of them came to the house", "12"] and not got[2] and got[3] == []
    drawn = quality.sampled_claims(df, 2, 5)
    assert drawn.count() == 2 and drawn.collect() == quality.sampled_claims(df, 2, 5).collect()


def test_prediction_gaps_takes_all_that_is_past_its_check(spark):
    from lorespark.plans import CATALOG
    from lorespark.sources.fixtures import ORDERS_NOW, Tables

    found = CATALOG["prediction_gaps"].plan(spark, "/root/testdata/sf0.001")
    late = Tables(spark, "/root/testdata/sf0.001").commitments().filter(f"state = 'active' AND due_date < timestamp_ntz'{ORDERS_NOW}'")
    assert found.count() == late.count() and found.agg({"days": "max"}).first()[0] > 20


def test_quarantine_takes_all_signups(spark):
    from lorespark.plans import CATALOG
    from lorespark.sources.fixtures import Tables

    sf = "/root/testdata/sf0.01"
    n = {r.entity_id: r.n for r in Tables(spark, sf).mentions().filter("role = 'signup'").groupBy("entity_id").agg({"*": "count"}).toDF("entity_id", "n").collect()}
    found = CATALOG["quarantine"].plan(spark, sf).collect()
    assert found and all(r.mentions == n[r.entity_id] for r in found)
