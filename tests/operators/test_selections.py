"""Selections and small operators without a fixture of their own."""

import struct
from datetime import datetime

from pyspark.sql import functions as F

from lorespark.functions import text
from lorespark.operators import alerts, context, profiles, quality, retrieval
from lorespark.sources import files


def test_decode_vectors(spark):
    rows = [(1, struct.pack("<3f", 1, 2, 3)), (2, None), (3, b"abc"), (4, b"")]
    got = {r.id: r.embedding for r in files.decode_vectors(spark.createDataFrame(rows, "id long, blob binary"), "blob").collect()}
    assert got == {1: [1.0, 2.0, 3.0], 2: None, 3: None, 4: None}


def test_sent_mails(spark):
    rows = [("t", 1, "Me <me@x.org>", "A <a@b.org>, b@c.org"), ("t", 2, "a@b.org", "me@x.org"), ("u", 1, "z@z.org", "me@x.org")]
    got = files.sent_mails(spark.createDataFrame(rows, "thread_id string, at int, sender string, to string"), "me@x.org").collect()
    assert [(r.thread_id, r.i_began, r.i_answered_last, r.wrote_to) for r in got] == [("t", True, False, ["a@b.org", "b@c.org"])]


def test_owned_by(spark):
    c = spark.createDataFrame([(1, "Ann Lee and Bob"), (2, "Joann Lee"), (3, None)], "id long, owner string")
    e = spark.createDataFrame([(7, "Ann Lee"), (8, "Bob"), (9, "Lee Ann")], "id long, name string")
    assert sorted(map(tuple, context.owned_by(c, e).collect())) == [(1, 7), (1, 8)]


def test_corrections(spark):
    e = spark.createDataFrame([(1, "client"), (2, None)], "id long, label string")
    m = spark.createDataFrame([(1, 10, "cc"), (2, 10, "to")], "entity_id long, item_id long, role string")
    c = spark.createDataFrame([("label", 1, None, "vendor", None, 1), ("label", 1, None, "partner", None, 2), ("role", 2, 10, "from", None, 1), ("fact", 2, None, None, "left", 3)], "kind string, entity_id long, item_id long, value string, text string, at int")
    labelled, roles, facts = context.propagate_corrections(e, m, c)
    assert sorted((r.id, r.label) for r in labelled.collect()) == [(1, "partner"), (2, None)]
    assert sorted((r.entity_id, r.role) for r in roles.collect()) == [(1, "cc"), (2, "from")]
    assert [(r.entity_id, r.text) for r in facts.collect()] == [(2, "left")]


def test_fulfilment_evidence(spark):
    day = lambda d: f"2024-01-{d:02d} 00:00:00"
    owed = [(1, "Will send the Budget report", day(5), None, "active"), (2, "Promised: call the notary office", day(5), day(2), "overdue"), (3, "should do it", day(5), None, "active"), (4, "budget again", day(5), None, "dropped")]
    told = [(10, "budget", "is not yet there", "mail", day(7)), (11, "Re", "subBUDGETs were Approved", "mail", day(6)), (12, "budget", "sent", "mail", day(5)), (13, "Notary", "thinks", "gmail-sent", day(3)), (14, "report", "done", "mail", day(9))]
    c = spark.createDataFrame(owed, "id long, text string, due string, detected string, state string").selectExpr("id", "text", "state", "CAST(due AS TIMESTAMP_NTZ) AS due_date", "CAST(detected AS TIMESTAMP_NTZ) AS detected_at")
    i = spark.createDataFrame(told, "item_id long, title string, summary string, source string, d string").selectExpr("item_id", "title", "summary", "source", "CAST(d AS TIMESTAMP_NTZ) AS source_date")
    assert sorted(map(tuple, alerts.fulfilment_evidence(c, i).collect())) == [(1, 11), (2, 13)]
    assert spark.range(1).select(alerts.keywords(F.lit("Committed to sending some reports, agreed with THEM about Q3-numbers also soon"))).first()[0] == ["sending", "reports", "THEM", "Q3numbers", "soon"]


def test_rerank_and_passages(spark):
    ranked = spark.createDataFrame([(1, 0.9), (2, 0.8), (3, 0.7)], "id long, score double")
    given = spark.createDataFrame([(3, 1)], "id long, rank int")
    assert [r.id for r in retrieval.rerank(ranked, given).collect()] == [3, 1, 2]
    got = spark.createDataFrame([("aaaa needle bbbb Needle cccc",)], "t string").select(retrieval.passages(F.col("t"), "needle", 5).alias("p")).first().p
    assert got == ["aaaa needle bbbb", "bbbb Needle cccc"]


def test_texts(spark):
    one = lambda x: spark.range(1).select(x.alias("x")).first().x
    assert one(text.artifact_body(F.lit('a <antArtifact id="1">one\ntwo</antArtifact> b'))) == ["one\ntwo"]
    assert one(text.without_artifacts(F.lit("a <antArtifact>x</antArtifact> b"))) == "a [artifact] b"
    assert one(text.tail(F.lit("abc"), F.lit("de"), 4)) == "c\nde"
    assert one(text.tones(F.lit("Great, but the deadline is a RISK"))) == ["urgent", "positive", "negative"]
    assert one(F.size(text.chunks(F.lit("x" * 8000)))) == 3 and one(F.size(text.chunks(F.lit("")))) == 1
    assert one(text.frontmatter(F.lit("no front"))) is None


def test_lessons_and_queues(spark):
    rows = [(1, None, None, "mail"), (2, 9, None, "mail"), (3, None, datetime(2024, 1, 1), "general"), (4, None, datetime(2024, 3, 1), "general"), (5, None, None, "other")]
    lessons = spark.createDataFrame(rows, "id long, superseded_by long, expires_at timestamp_ntz, domain string")
    assert {r.id for r in context.active_lessons(lessons, "2024-01-31", "mail").collect()} == {1, 4}


def test_ambient_priorities(spark):
    now, day = "2024-01-31 00:00:00", lambda m, d: datetime(2024, m, d)
    c = spark.createDataFrame([(1, "p", "active", day(2, 3)), (2, "q", "active", day(3, 3)), (3, "r", "overdue", day(1, 20)), (4, "s", "dropped", day(1, 20)), (5, "p", "active", day(2, 2))], "id long, project string, state string, due_date timestamp_ntz")
    p = spark.createDataFrame([("p", "stalling", "call"), ("q", "steady", "write"), ("u", "new", "see"), ("v", "active", None), ("w", "active", "No action needed here")], "project string, status string, next_action string")
    a = [(5, "q", "pending", 1, False, day(1, 30), None), (6, "q", "pending", 2, False, day(1, 29), None), (7, "q", "pending", 1, False, day(1, 27), None), (8, "q", "pending", 1, True, day(1, 27), None), (9, "q", "pending", 3, True, day(1, 30), None), (10, "q", "pending", 1, True, day(1, 30), day(1, 31)), (11, "q", "done", 1, True, day(1, 30), None)]
    a = spark.createDataFrame(a, "id long, project string, status string, target long, in_session boolean, created_at timestamp_ntz, expires_at timestamp_ntz")
    gone = spark.createDataFrame([(3,)], "target long")
    heard = spark.createDataFrame([(2, day(1, 30)), (1, day(1, 1))], "target long, source_date timestamp_ntz")
    got = profiles.ambient_priorities(c, p, a, gone, heard, now).collect()
    assert [(r.id, r.tier, r.urgency, r.stale) for r in got] == [
        ("commitment-3", 1, "critical", False), ("commitment-5", 1, "high", False), ("project-p", 2, "high", False), ("commitment-1", 1, "medium", False),
        ("project-u", 1, "medium", False), ("action-5", 2, "medium", False), ("action-6", 2, "medium", True), ("action-8", 2, "medium", False), ("project-q", 1, "low", False),
    ]


def test_facts_and_quotes(spark):
    facts = spark.createDataFrame([(1, 1, "Hello World", 0.9), (2, 1, "Hello World", 0.5), (3, 1, "absent", 0.9)], "fact_id long, source_id long, quote string, confidence double")
    sources = spark.createDataFrame([(1, "say HELLO world twice")], "source_id long, text string")
    assert [r.fact_id for r in quality.supported_quotes(facts, sources).collect()] == [1]
    items = spark.createDataFrame([(1, ["a"]), (2, None)], "id long, x array<string>")
    assert {r.id for r in context.needs_vector(items, "x").collect()} == {2}


def test_sinks(spark, tmp_path):
    from lorespark.sources import sinks

    root = str(tmp_path)
    a = spark.createDataFrame([(1, "a"), (2, "b")], "id long, x string")
    sinks.save_result(a, root, "k", history="one")
    sinks.save_result(a.limit(1), root, "k")
    assert sinks.load_result(spark, root, "k").count() == 1 and sinks.load_result(spark, root, "k-history/one").count() == 2
    target = sinks.upsert_table(spark, f"{root}/k-history/one", spark.createDataFrame([(2, "c"), (3, "d")], "id long, x string"), ["id"], "2")
    assert sorted(map(tuple, spark.read.parquet(target).collect())) == [(1, "a"), (2, "c"), (3, "d")]
    sinks.save_text(context.markdown(a, F.col("x"), F.col("id").cast("string")), f"{root}/text", ["line"])
    assert [r.value for r in spark.read.text(f"{root}/text").collect()] == ["- **a** 1", "- **b** 2"]


def test_folders_below_a_dot_folder(spark, tmp_path):
    root = tmp_path / ".notes" / "node_modules" / "mine"
    for name, text in {"a.md": "---\nlang: en\n---\nlong enough", ".hidden/b.md": "long enough text", "c/.d.txt": "long enough text", "e/f.TXT": "long enough text", "g.bin": "long enough text", "h.txt": "short"}.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text)
    found = {r.name: r for r in files.text_files(spark, str(root)).collect()}
    assert set(found) == {"a.md", "f.TXT"} and found["a.md"].meta["lang"] == "en" and found["f.TXT"].extension == "txt"
