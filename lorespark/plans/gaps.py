"""Queries of gaps: each kind, all in order, and their summary."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.time import ago, at
from ..operators import gaps
from ..sources.fixtures import NOW, ORDERS_NOW, Tables
from .catalog import query

_T, _O = f"TIMESTAMP '{NOW}'", f"TIMESTAMP '{ORDERS_NOW}'"
_days = lambda later, earlier: f"trunc((epoch_us({later}) - epoch_us({earlier})) / 86400000000.0)::INTEGER"

_COMMUNICATION = f"""heard AS (SELECT entity_id, max(mention_date) AS last FROM mentions WHERE role = 'purchase' AND item_id % 4 = 0 GROUP BY 1),
quiet AS (SELECT name, label, {_days(_T, "last")} AS days FROM entities JOIN heard ON id = entity_id WHERE label IN ('partner', 'client', 'key') AND NOT dismissed AND {_days(_T, "last")} > 5),
open_texts AS (SELECT 'Call USER_' || (c_custkey * 3) || ' about ' || c_mktsegment AS text FROM customer WHERE c_custkey % 4 = 0),
communication AS (SELECT 'communication' AS kind, name AS subject, CASE WHEN days > 14 THEN 'critical' WHEN days > 7 THEN 'high' ELSE 'medium' END AS severity, days, label || ' silent for ' || days || ' days' AS detail
  FROM quiet WHERE EXISTS (SELECT 1 FROM open_texts WHERE contains(lower(text), lower(name))))"""
_COMMITMENT = f"""promised AS (SELECT s_suppkey AS id, 'Send the new offer to ' || s_name AS text, {_T} + to_hours((s_suppkey % 20 * 13 - 130)::INTEGER) AS due_date, CASE WHEN s_suppkey % 3 = 0 THEN 'fulfilled' ELSE 'active' END AS state FROM supplier),
recent_texts AS (SELECT 'RE: SEND THE NEW OFFER TO ' || s_name AS text FROM supplier WHERE s_suppkey % 7 = 0),
late AS (SELECT *, {_days("due_date", _T)} AS ahead FROM promised WHERE state = 'active' AND due_date < {_T} + INTERVAL 3 DAY),
commitment AS (SELECT 'commitment' AS kind, substring(text, 1, 80) AS subject, CASE WHEN ahead < 0 THEN 'critical' WHEN ahead <= 1 THEN 'high' ELSE 'medium' END AS severity, CASE WHEN ahead < 0 THEN -ahead ELSE 0 END AS days,
  CASE WHEN ahead < 0 THEN 'overdue by ' || -ahead || ' days' ELSE 'due in ' || ahead || ' days' END AS detail
  FROM late l WHERE NOT EXISTS (SELECT 1 FROM recent_texts r WHERE contains(lower(r.text), lower(substring(l.text, 1, 40)))))"""
_STATES = ["Awaiting their answer", "signed and sent", "pending", "to follow this matter up", "waiting", "a response is badly needed", "no reply yet", "Follow-up due"]
_THREAD = f"""lying AS (SELECT 'thread ' || id AS title, [{", ".join(f"'{s}'" for s in _STATES)}][id % 8 + 1] AS current_state, day::TIMESTAMP AS updated_at, CASE WHEN id % 5 = 0 THEN 'closed' ELSE 'active' END AS status FROM texts),
still AS (SELECT *, {_days(_T, "updated_at")} AS days FROM lying WHERE status = 'active' AND updated_at < {_T} - INTERVAL 7 DAY),
thread AS (SELECT 'thread' AS kind, title AS subject, CASE WHEN days > 21 THEN 'critical' WHEN days > 14 THEN 'high' ELSE 'medium' END AS severity, days, substring(current_state, 1, 100) AS detail
  FROM still WHERE current_state ILIKE '%await%' OR current_state ILIKE '%pending%' OR current_state ILIKE '%follow%up%' OR current_state ILIKE '%follow-up%' OR current_state ILIKE '%waiting%' OR current_state ILIKE '%response%needed%' OR current_state ILIKE '%no reply%')"""
_PROJECT = f"""profiles AS (SELECT 'q' || k AS project, CASE k % 3 WHEN 0 THEN 'stalled' WHEN 1 THEN 'stalling' ELSE 'moving' END AS status FROM (SELECT DISTINCT k FROM knowledge)),
staged AS (SELECT DISTINCT 'q' || k AS project FROM knowledge WHERE source = 'click' AND importance = 'critical'),
active AS (SELECT 'q' || k AS project, max(source_date) AS last FROM knowledge WHERE source = 'error' AND k % 2 = 0 GROUP BY 1),
project AS (SELECT 'project' AS kind, project AS subject, CASE status WHEN 'stalled' THEN 'critical' ELSE 'high' END AS severity, coalesce(round((epoch_us({_T}) - epoch_us(last)) / 86400000000.0)::INTEGER, 999) AS days, status || ' without an action' AS detail
  FROM profiles LEFT JOIN active USING (project) WHERE status IN ('stalled', 'stalling') AND project NOT IN (SELECT project FROM staged))"""
_PREDICTED = f"""prediction AS (SELECT 'prediction' AS kind, owner AS subject, CASE WHEN {_days(_O, "due_date")} > 7 THEN 'high' ELSE 'medium' END AS severity, {_days(_O, "due_date")} AS days, substring('order ' || id || ' will ship', 1, 80) AS detail
  FROM commitments WHERE state = 'active' AND due_date < {_O})"""
_PREDICTION = _PREDICTED[:-1] + f" AND due_date >= {_O} - INTERVAL 20 DAY)"  # in the summaries of all kinds
_EVERY = f"{_COMMUNICATION},\n{_COMMITMENT},\n{_THREAD},\n{_PROJECT},\n{_PREDICTION},\nevery AS (SELECT * FROM communication UNION ALL SELECT * FROM commitment UNION ALL SELECT * FROM thread UNION ALL SELECT * FROM project UNION ALL SELECT * FROM prediction)"


def _communication(t: Tables) -> DataFrame:
    customers = t.read("customer").filter("c_custkey % 4 = 0")
    texts = customers.select(F.col("c_custkey").alias("id"), F.concat(F.lit("Call USER_"), (F.col("c_custkey") * 3).cast("string"), F.lit(" about "), "c_mktsegment").alias("text"))
    return gaps.communication(t.mentions().filter("role = 'purchase' AND item_id % 4 = 0"), t.entities(), texts, NOW)


def _commitment(t: Tables) -> DataFrame:
    suppliers = t.read("supplier")
    due = at(NOW) + F.make_dt_interval(F.lit(0), (F.col("s_suppkey") % 20 * 13 - 130).cast("int"))
    promised = suppliers.select(F.col("s_suppkey").alias("id"), F.concat(F.lit("Send the new offer to "), "s_name").alias("text"), due.alias("due_date"), F.when(F.col("s_suppkey") % 3 == 0, "fulfilled").otherwise("active").alias("state"))
    recent = suppliers.filter("s_suppkey % 7 = 0").select(F.col("s_suppkey").alias("id"), F.concat(F.lit("RE: SEND THE NEW OFFER TO "), "s_name").alias("text"))
    return gaps.commitment(promised, recent, NOW)


def _thread(t: Tables) -> DataFrame:
    state = F.element_at(F.array(*map(F.lit, _STATES)), (F.col("id") % 8 + 1).cast("int"))
    status = F.when(F.col("id") % 5 == 0, "closed").otherwise("active")
    return gaps.thread(t.texts().select(F.concat(F.lit("thread "), F.col("id").cast("string")).alias("title"), state.alias("current_state"), F.col("day").cast("timestamp_ntz").alias("updated_at"), status.alias("status")), NOW)


def _project(t: Tables) -> DataFrame:
    items = t.knowledge().withColumn("project", F.concat(F.lit("q"), F.col("k").cast("string")))
    status = F.when(F.col("k") % 3 == 0, "stalled").when(F.col("k") % 3 == 1, "stalling").otherwise("moving")
    profiles = items.select("project", status.alias("status")).distinct()
    staged = items.filter("source = 'click' AND importance = 'critical'").select("project", F.lit("pending").alias("status"))
    return gaps.project(profiles, staged, items.filter("source = 'error' AND k % 2 = 0"), NOW)


def _prediction(own: DataFrame) -> DataFrame:
    outcome = F.when(F.col("state") == "active", "pending").otherwise("correct")
    return gaps.prediction(own.select(F.col("owner").alias("subject"), F.concat(F.lit("order "), F.col("id").cast("string"), F.lit(" will ship")).alias("prediction"), F.col("due_date").alias("check_by"), outcome.alias("outcome")), ORDERS_NOW)


@query("T16 J9", f"WITH {_COMMUNICATION} SELECT * FROM communication")
def communication_gaps(t: Tables) -> DataFrame:
    """Key people who are silent although their name stands in something open."""
    return _communication(t)


@query("T17", f"WITH {_COMMITMENT} SELECT * FROM commitment")
def commitment_gaps(t: Tables) -> DataFrame:
    return _commitment(t)


@query("T18 P17", f"WITH {_THREAD} SELECT * FROM thread")
def thread_gaps(t: Tables) -> DataFrame:
    return _thread(t)


@query("T19", f"WITH {_PROJECT} SELECT * FROM project")
def project_gaps(t: Tables) -> DataFrame:
    return _project(t)


@query("T20 T31", f"WITH {_PREDICTED} SELECT * FROM prediction")
def prediction_gaps(t: Tables) -> DataFrame:
    """Every prediction that is past its check, however long ago."""
    return _prediction(t.commitments())


def _every(t: Tables) -> DataFrame:
    lately = t.commitments().filter(F.col("due_date") >= ago(ORDERS_NOW, 20))
    return gaps.in_order(_communication(t), _commitment(t), _thread(t), _project(t), _prediction(lately))


@query("T21 W14", f"WITH {_EVERY} SELECT * FROM every ORDER BY CASE severity WHEN 'critical' THEN 0 WHEN 'high' THEN 1 ELSE 2 END, days DESC, kind, subject, detail LIMIT 60")
def gaps_union(t: Tables) -> DataFrame:
    """The gravest gaps of all kinds, in order."""
    return _every(t).limit(60)


@query(
    "T21 A21",
    f"""WITH {_EVERY} SELECT count(*) AS total, {", ".join(f"count(*) FILTER (severity = '{s}') AS {s}" for s in ("critical", "high", "medium"))},
{", ".join(f"count(*) FILTER (kind = '{k}') AS {k}_gaps" for k in ("communication", "commitment", "thread", "project", "prediction"))} FROM every""",
)
def gap_counts(t: Tables) -> DataFrame:
    return gaps.summary(_every(t))
