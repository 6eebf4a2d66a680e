"""Thresholds at their boundaries, on tables of a few rows."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from lorespark.functions import text
from lorespark.functions.time import at, days_between
from lorespark.functions.vector import cosine
from lorespark.operators import activity, alerts, graph, quality, retrieval, rollups
from lorespark.sources import files

NOW = datetime(2024, 1, 31)
AS_OF = str(NOW)


def table(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def one(spark, expression):
    return spark.range(1).select(expression.alias("x")).first().x


def mentions(spark, ages, entity=1):
    return [(entity, k, "r", None, NOW - timedelta(days=a)) for k, a in enumerate(ages)]


SCHEMA = "entity_id long, item_id long, role string, direction string, mention_date timestamp_ntz"


@pytest.mark.parametrize("days, status", [(0, "active"), (3, "active"), (4, "warm"), (7, "warm"), (8, "cooling"), (14, "cooling"), (15, "cold"), (30, "cold"), (31, "dormant"), (None, "unknown")])
def test_status(spark, days, status):
    assert one(spark, activity.status_bucket(F.lit(days).cast("int"))) == status


@pytest.mark.parametrize("ages, trend", [([10], "cold"), ([16], "cold"), ([1], "new_burst"), ([1, 2, 10], "accelerating"), ([1, 10, 11, 17, 18, 19], "decelerating"), ([1, 10, 11], "steady"), ([1, 10], "steady"), ([24], "steady"), ([1, 2, 10, 16, 17], "steady")])
def test_trend(spark, ages, trend):
    got = activity.momentum(table(spark, mentions(spark, ages), SCHEMA), AS_OF).first()
    assert got.trend == trend


def test_weeks_hold_their_later_bound(spark):
    got = activity.weekly_counts(table(spark, mentions(spark, [7, 14, 21, 28, 28.001]), SCHEMA), AS_OF, ("entity_id",)).first()
    assert (got.w1, got.w2, got.w3, got.w4) == (1, 1, 1, 1)


@pytest.mark.parametrize("age, next_", [(0, "active"), (0.001, "overdue"), (14, "overdue"), (14.001, "dropped"), (-1, "active"), (None, "active")])
def test_commitment_states(spark, age, next_):
    due = None if age is None else NOW - timedelta(days=age)
    got = alerts.advance_states(table(spark, [(1, "active", due)], "id long, state string, due_date timestamp_ntz"), AS_OF).first()
    assert got.next == next_


@pytest.mark.parametrize("hours, level", [(23.9, 0), (24, 1), (48, 2), (72, 3)])
@pytest.mark.parametrize("kind", ["email", "task"])
def test_escalation(spark, hours, level, kind):
    row = (1, kind, "pending", NOW - timedelta(hours=hours), None, 0)
    got = alerts.escalation_level(table(spark, [row], "id long, type string, status string, created_at timestamp_ntz, snoozed_until timestamp_ntz, level int"), AS_OF).first()
    assert got.next_level == level and got.automatic == (level >= 1 and kind != "email")


def test_pileups(spark):
    days = [datetime(2024, 1, d) for d in (1, 1, 1, 4, 4, 4, 8, 8, 8, 8)]
    got = activity.pileups(table(spark, [(d.date(),) for d in days], "day date")).collect()
    assert [(str(r.first_day), str(r.last_day), r.total) for r in got] == [("2024-01-01", "2024-01-04", 6)]


def test_edge_confidence_is_capped(spark):
    rows = [(i, e) for i in range(8) for e in (1, 2)] + [(100, 1), (100, 3)]
    got = {(r.a, r.b): (r.n, r.confidence) for r in graph.cooccurrence_edges(table(spark, rows, "item_id long, entity_id long")).collect()}
    assert got == {(1, 2): (8, 1.0), (1, 3): (1, 0.5)}


def test_threads_keep_threes_and_strong_pairs(spark):
    rows = [(1, 2, 2), (2, 3, 2), (10, 11, 2), (20, 21, 3)]
    got = graph.threads(table(spark, rows, "a long, b long, shared long"))
    assert {(r.component, r.node) for r in got.collect()} == {(1, 1), (1, 2), (1, 3), (20, 20), (20, 21)}


def test_thread_score(spark):
    members = [(1, e) for e in (1, 2, 3)] + [(2, e) for e in (1, 2, 3)] + [(3, 1), (3, 2)]
    day = NOW.date()
    items = [(1, "p", "a", day), (2, "p", "b", day - timedelta(days=2)), (3, "q", "a", day - timedelta(days=15))]
    got = graph.thread_candidates(table(spark, members, "item_id long, entity_id long"), table(spark, items, "id long, project string, source string, day date")).collect()
    assert [(r.a, r.b, r.score) for r in got] == [(1, 2, 1.0)]


@pytest.mark.parametrize("a, b, score", [("call the bank", "call the bank", 1.0), ("a", "a", 0.0), ("ab", "cd", 0.0), ("send report", "send reports", 0.952381)])
def test_dice(spark, a, b, score):
    assert round(one(spark, text.dice(text.bigrams(F.lit(a)), text.bigrams(F.lit(b)))), 6) == score


def test_vectors(spark):
    v = lambda *x: F.array(*(F.lit(float(i)) for i in x))
    got = [one(spark, cosine(v(1, 0), b)) for b in (v(2, 0), v(0, 1), v(-1, 0), v(0, 0))]
    assert got == [1.0, 0.0, -1.0, None]


@pytest.mark.parametrize("name, normal", [("Dr. John S. Smith Jr.", "smith"), ("Ann-Marie O'Neil", "ann-marie oneil"), ("Bob Ray III", "bob ray"), ("J. R. Stone", "stone"), ("  Kim   Lee PhD", "kim lee")])
def test_names(spark, name, normal):
    got = one(spark, text.normalize_name(F.lit(name)))
    assert got.endswith(normal)


@pytest.mark.parametrize("header, name, mail, domain", [('"A B" <X@Firm.example>', "A B", "x@firm.example", "firm.example"), ("q@gmail.com", "", "q@gmail.com", None), ("no mail", None, None, None)])
def test_headers(spark, header, name, mail, domain):
    h = F.lit(header)
    assert one(spark, text.header_name(h)) == name and one(spark, text.header_mail(h)) == mail and one(spark, text.mail_domain(text.header_mail(h))) == domain


def test_noise_layers(spark):
    word = "word " * 150
    rows = [
        (1, "news@mailchimp.com", "", ""), (2, "a@b.c", "Weekly Report", ""), (3, "a@b.c", "", "unsubscribe exclusive " + "word " * 190),
        (4, "a@b.c", "", "unsubscribe exclusive " + "word " * 220), (5, "a@b.c", "", "unsubscribe exclusive limited time " + word * 3), (6, None, None, None),
        (7, "a@b.c", "", "x" * 490 + " newsletter"), (8, "a@b.c", "", "x" * 520 + " newsletter"),
    ]
    got = quality.classify_noise(table(spark, rows, "id long, f string, s string, b string"), "f", "s", "b")
    want = {1: ("blocked_domain", 1.0), 2: ("automated_report", 0.9), 3: ("cold_email", 0.8), 4: (None, None), 5: ("cold_email", 0.9), 6: (None, None), 7: (None, None), 8: (None, None)}
    # row 7's pattern ends past 500 characters
    assert {r.id: (r.noise_type, r.noise_confidence) for r in got.collect()} == want


def test_keep_longest(spark):
    rows = [(1, "r", "aa"), (2, "r", "aaaa"), (3, "r", "aaaa"), (4, None, "x"), (5, None, "x")]
    got = quality.keep_longest(table(spark, rows, "id long, ref string, t string"), "ref", F.length("t"))
    assert sorted(r.id for r in got.collect()) == [2, 4, 5]


def test_quotes_anywhere(spark):
    docs = table(spark, [(1, "x" * 30 + "Quote one that is long enough to have forty characters"), (2, "nothing here"), (3, "a" * 60), (4, None)], "doc_id long, text string")
    quotes = [(1, "quote ONE that is long enough to have forty characters"), (2, "too short"), (3, "A" * 45), (4, None), (5, "one that is long enough to have forty characters and more")]
    got = quality.quotes_anywhere(table(spark, quotes, "quote_id long, quote string"), docs)
    assert sorted(map(tuple, got.collect())) == [(1, 1), (3, 3), (5, 1)]


def test_recency_and_confidence(spark):
    assert one(spark, retrieval.recency(at("2024-01-11"), AS_OF)) == 0.5
    assert one(spark, retrieval.recency(at("2024-03-01"), AS_OF)) == 1.0
    ranked = table(spark, [(i, 1.0) for i in range(20)], "id long, score double")
    assert retrieval.confidence(ranked).first().confidence == 1.0
    assert retrieval.confidence(ranked.limit(0)).first().confidence == 0.0


def test_thread_bonus(spark):
    ranked = table(spark, [(1, 0.9)], "id long, score double")
    members = table(spark, [("t", 1), ("t", 2), ("u", 1), ("u", 2), ("v", 9)], "thread_id string, id long")
    got = {r.id: round(r.score, 6) for r in retrieval.thread_bonus(ranked, members).collect()}
    assert got == {1: 1.0, 2: 0.7}


def test_temporal_words():
    t = lambda q: text.temporal_since(q, datetime(2024, 1, 31, 15, 30))  # noqa: E731  a Wednesday
    assert t("today") == datetime(2024, 1, 31) and t("Yesterday?") == datetime(2024, 1, 30)
    assert t("this week") == datetime(2024, 1, 28) and t("last week") == datetime(2024, 1, 21)
    assert t("this month") == datetime(2024, 1, 1) and t("last month") == datetime(2023, 12, 1)
    assert t("latest") == datetime(2024, 1, 24, 15, 30) and not text.has_temporal_intent("who is it")


@pytest.mark.parametrize("message, kind", [("Find the memo", "search"), ("Draft an email", "action"), ("actually no", "correction"), ("Bob is a vendor", "correction"), ("why is it late", "investigation"), ("the project looks overdue to everyone here", "investigation"), ("is overdue", "question"), ("hello", "question")])
def test_intents(spark, message, kind):
    assert one(spark, text.intent(F.lit(message))) == kind


def test_upsert_and_validity(spark):
    old = table(spark, [(1, "a", 1), (2, "b", 2)], "id long, x string, y int")
    new = table(spark, [(2, "c"), (3, "d")], "id long, x string")
    assert sorted(map(tuple, rollups.upsert(old, new, ["id"]).collect())) == [(1, "a", 1), (2, "c", 2), (3, "d", None)]
    rows = rollups.supersede(table(spark, [(1, "k", 10), (2, "k", 20)], "id long, key string, at int"), "key", "at")
    assert [(r.id, r.valid_until, r.superseded_by) for r in rows.orderBy("id").collect()] == [(1, 20, 2), (2, None, None)]


def test_primary_and_derived_partition_the_rows(spark):
    rows = table(spark, [(1, "mail"), (2, "briefing"), (3, None), (4, "verification")], "id long, source string")
    assert {r.id for r in rollups.primary(rows).collect()} == {1, 3} and {r.id for r in rollups.derived(rows).collect()} == {2, 4}


def test_text_files_and_sessions(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "n.md").write_text("---\ntitle: Plan: one\nkind: memo\n---\nbody text here")
    (tmp_path / "a" / "r_v2.txt").write_text("version two text")
    (tmp_path / "a" / "r_v10.txt").write_text("version ten text")
    (tmp_path / "a" / "tiny.md").write_text("x")
    (tmp_path / ".hidden").mkdir()
    (tmp_path / ".hidden" / "h.md").write_text("hidden text here")
    found = files.text_files(spark, str(tmp_path))
    got = {r.name: r.meta for r in found.collect()}
    assert set(got) == {"n.md", "r_v2.txt", "r_v10.txt"} and got["n.md"] == {"title": "Plan: one", "kind": "memo"}
    assert {r.name for r in files.latest_outputs(found).collect()} == {"n.md", "r_v10.txt"}
    log = tmp_path / "s1.jsonl"
    log.write_text('{"timestamp": "t", "message": {"role": "user", "content": "hi"}}\nnot json\n{"message": {"role": "assistant", "content": [{"type": "text", "text": "yes"}, {"type": "image"}]}}\n')
    assert [(r.session_id, r.role, r.text) for r in files.session_logs(spark, str(log)).collect()] == [("s1", "user", "hi"), ("s1", "assistant", "yes")]


def test_outline_order(spark):
    rows = table(spark, [(1, None, 1, "a"), (2, 1, 2, "a2"), (3, 1, 1, "a1"), (4, 3, 1, "a1x"), (5, None, 2, "b")], "id long, parent_id long, position int, text string")
    assert [r.text for r in files.outline(rows).orderBy("path").collect()] == ["a", "a1", "a1x", "a2", "b"]


def test_row_order_changes_nothing(spark):
    rows = mentions(spark, [1, 2, 3, 9, 17, 25]) + mentions(spark, [2, 16], 2)
    a = activity.communication_baseline(table(spark, rows, SCHEMA), AS_OF).collect()
    b = activity.communication_baseline(table(spark, rows[::-1], SCHEMA).repartition(3), AS_OF).collect()
    assert sorted(map(str, a)) == sorted(map(str, b))
    assert one(spark, days_between(at("2024-01-02"), at("2024-01-01"))) == 1.0


def test_components_of_long_paths(spark):
    path = [(i, i + 1) for i in range(1000, 1079)] + [(1079, 1)]
    other = [(3000, 3000), (2001, 2000), (2000, 2001), (None, 5), (6, None)]
    got = dict(map(tuple, graph.components(table(spark, path + other, "a long, b long")).collect()))
    assert got == {1: 1, **dict.fromkeys(range(1000, 1080), 1), 2000: 2000, 2001: 2000, 3000: 3000}
    assert graph.components(table(spark, [], "a long, b long")).collect() == []
