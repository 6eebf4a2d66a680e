"""Queries over commitments, alerts and gaps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.time import since
from ..operators import alerts
from ..sources.fixtures import NOW, ORDERS_NOW, Tables
from . import activity  # noqa: F401  registers what the union reads
from .catalog import CATALOG, query

_O, _T = f"TIMESTAMP '{ORDERS_NOW}'", f"TIMESTAMP '{NOW}'"
_LATE = f"(epoch_us({_O}) - epoch_us(due_date)) / 86400000000.0"


@query(
    "T25",
    f"""WITH a AS (SELECT *, CASE WHEN state IN ('active', 'detected') AND due_date < {_O} THEN 'overdue' ELSE state END AS s FROM commitments)
SELECT id, CASE WHEN s = 'overdue' AND due_date < {_O} - INTERVAL 14 DAY THEN 'dropped' ELSE s END AS next FROM a""",
)
def commitment_states(t: Tables) -> DataFrame:
    return alerts.advance_states(t.commitments(), ORDERS_NOW).select("id", "next")


@query(
    "T26 P20",
    f"""SELECT bucket, count(*) AS n, round(sum(amount), 2) AS amount FROM (SELECT amount, CASE WHEN state IN ('detected', 'active', 'overdue') AND {_LATE} > 0 THEN 'fire'
  WHEN state IN ('detected', 'active', 'overdue') AND {_LATE} >= -3 THEN 'due_soon' WHEN state IN ('detected', 'active', 'overdue') THEN 'active'
  WHEN state = 'fulfilled' AND {_LATE} >= 0 AND {_LATE} <= 7 THEN 'recently_fulfilled' WHEN state = 'dropped' THEN 'dropped' ELSE 'closed' END AS bucket FROM commitments) GROUP BY 1""",
)
def commitment_buckets(t: Tables) -> DataFrame:
    return alerts.commitment_buckets(t.commitments(), ORDERS_NOW).groupBy("bucket").agg(F.count("*").alias("n"), F.round(F.sum("amount"), 2).alias("amount"))


@query(
    "T10 P9 P10",
    f"""SELECT id, owner, CASE WHEN {_LATE} > 0 THEN 'overdue' ELSE 'due_soon' END AS kind, floor({_LATE})::BIGINT AS days,
  CASE WHEN {_LATE} > 7 THEN 'high' WHEN {_LATE} > 3 THEN 'medium' WHEN {_LATE} > 0 THEN 'low' ELSE 'medium' END AS severity
FROM commitments WHERE state IN ('detected', 'active', 'overdue') AND {_LATE} >= -3""",
)
def commitment_alerts(t: Tables) -> DataFrame:
    return alerts.commitment_alerts(t.commitments(), ORDERS_NOW)


@query(
    "T8 T9 T29 J15",
    f"""
WITH g AS (SELECT entity_id, (epoch_us(mention_date) - epoch_us(lag(mention_date) OVER (PARTITION BY entity_id ORDER BY mention_date))) / 86400000000.0 AS gap FROM mentions),
a AS (SELECT entity_id, round(coalesce(avg(gap), 0), 6) AS average_gap FROM g GROUP BY 1),
o AS (SELECT entity_id, max(mention_date) AS contacted FROM mentions WHERE direction = 'outbound' GROUP BY 1),
w AS (SELECT m.item_id AS id, m.entity_id, m.mention_date AS waiting_since, (epoch_us({_T}) - epoch_us(m.mention_date)) / 86400000000.0 AS age, average_gap, label, dismissed, coalesce(contacted > m.mention_date, false) AS contacted_since
  FROM mentions m JOIN a USING (entity_id) LEFT JOIN o USING (entity_id) JOIN entities e ON e.id = m.entity_id WHERE direction = 'inbound')
SELECT id, entity_id, floor(age)::BIGINT AS days, CASE WHEN age > 14 THEN 'high' WHEN age > 7 THEN 'medium' ELSE 'low' END AS severity,
  round(.5 + CASE WHEN label IN ('partner', 'client') THEN .2 ELSE 0 END + CASE WHEN age > 14 THEN .1 ELSE 0 END, 6)::DOUBLE AS confidence
FROM w WHERE NOT dismissed AND NOT coalesce(label = 'employee', false) AND NOT contacted_since AND age >= greatest(3.0, 2 * average_gap) AND age <= 45""",
)
def dropped_balls(t: Tables) -> DataFrame:
    from ..operators.activity import average_gap

    m = t.mentions()
    contacted = m.filter("direction = 'outbound'").groupBy("entity_id").agg(F.max("mention_date").alias("contacted"))
    who = t.entities().withColumnRenamed("id", "entity_id")
    waiting = m.filter("direction = 'inbound'").join(average_gap(m).drop("mentions"), "entity_id").join(contacted, "entity_id", "left").join(who, "entity_id")
    since_then = F.coalesce(F.col("contacted") > F.col("mention_date"), F.lit(False)).alias("contacted_since")
    return alerts.dropped_balls(waiting.select(F.col("item_id").alias("id"), "entity_id", F.col("mention_date").alias("waiting_since"), "average_gap", "label", "dismissed", since_then), NOW)


@query(
    "T12 W14",
    f"""
WITH a AS (SELECT 'commitment' AS family, id::VARCHAR AS id, CASE WHEN {_LATE} > 7 THEN 'high' WHEN {_LATE} > 3 THEN 'medium' WHEN {_LATE} > 0 THEN 'low' ELSE 'medium' END AS severity, .8::DOUBLE AS confidence
  FROM commitments WHERE state IN ('detected', 'active', 'overdue') AND {_LATE} >= -3 AND {_LATE} < 30)
SELECT * FROM a ORDER BY CASE severity WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END, confidence DESC, family, id LIMIT 50""",
)
def alerts_union(t: Tables) -> DataFrame:
    return alerts.union_alerts(commitment=alerts.commitment_alerts(t.commitments().filter(since("due_date", ORDERS_NOW, 29.999999)), ORDERS_NOW)).limit(50)


@query(
    "T12 W14",
    f"""
WITH c AS ({CATALOG["commitment_alerts"].sql}), d AS ({CATALOG["dropped_balls"].sql}), p AS ({CATALOG["predictor_anomalies"].sql}),
every AS (SELECT 'commitment' AS family, id::VARCHAR AS id, severity, .8::DOUBLE AS confidence FROM c WHERE days < 30
  UNION ALL SELECT 'dropped', id::VARCHAR, severity, confidence FROM d UNION ALL SELECT 'rhythm', entity_id::VARCHAR, severity, .8 FROM p WHERE anomaly IS NOT NULL)
SELECT * FROM every ORDER BY CASE severity WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END, confidence DESC, family, id LIMIT 200""",
)
def alerts_of_all_kinds(t: Tables) -> DataFrame:
    """Commitments, dropped balls and changes of rhythm in one order."""
    from ..operators.activity import communication_baseline

    rhythm = communication_baseline(t.mentions(), NOW).filter("anomaly IS NOT NULL").select(F.col("entity_id").alias("id"), "severity")
    owed = alerts.commitment_alerts(t.commitments(), ORDERS_NOW).filter("days < 30")
    return alerts.union_alerts(commitment=owed, dropped=dropped_balls(t), rhythm=rhythm).limit(200)


@query("T37 P10", f"SELECT id, owner, state FROM commitments WHERE state IN ('active', 'overdue') AND due_date BETWEEN {_O} - INTERVAL 48 HOUR AND {_O} + INTERVAL 24 HOUR")
def urgent_commitments(t: Tables) -> DataFrame:
    return alerts.urgent(t.commitments(), ORDERS_NOW).select("id", "owner", "state")


@query(
    "Z5 T32",
    f"""
WITH a AS (SELECT id, CASE source WHEN 'view' THEN 'email' ELSE 'task' END AS type, CASE WHEN id % 3 = 0 THEN 'done' ELSE 'pending' END AS status, id % 11 = 0 AS snoozed,
  (epoch_us({_T}) - epoch_us(source_date)) / 3600000000.0 AS hours FROM knowledge WHERE source_date >= {_T} - INTERVAL 5 DAY),
b AS (SELECT *, CASE WHEN snoozed OR status <> 'pending' THEN 0 WHEN hours >= 72 THEN 3 WHEN hours >= 48 THEN 2 WHEN hours >= 24 THEN 1 ELSE 0 END AS next_level FROM a)
SELECT next_level, next_level >= 1 AND type <> 'email' AND status = 'pending' AS automatic, count(*) AS n FROM b GROUP BY ALL""",
)
def escalation_levels(t: Tables) -> DataFrame:
    own = t.knowledge().filter(since("source_date", NOW, 5))
    snoozed = F.when(F.col("id") % 11 == 0, F.lit("2024-02-10 00:00:00").cast("timestamp_ntz"))
    actions = own.select("id", F.when(F.col("source") == "view", "email").otherwise("task").alias("type"), F.when(F.col("id") % 3 == 0, "done").otherwise("pending").alias("status"), F.col("source_date").alias("created_at"), snoozed.alias("snoozed_until"), F.lit(0).alias("level"))
    return alerts.escalation_level(actions, NOW).groupBy("next_level", "automatic").agg(F.count("*").alias("n"))


@query("Q18", f"SELECT status, count(*) AS n FROM (SELECT CASE WHEN id % 3 <> 0 AND source_date < {_T} - INTERVAL 48 HOUR THEN 'expired' WHEN id % 3 <> 0 THEN 'pending' ELSE 'done' END AS status FROM knowledge) GROUP BY 1")
def expired_actions(t: Tables) -> DataFrame:
    actions = t.knowledge().select("id", F.when(F.col("id") % 3 == 0, "done").otherwise("pending").alias("status"), F.col("source_date").alias("created_at"))
    return alerts.expire_actions(actions, NOW).groupBy("status").agg(F.count("*").alias("n"))


@query("T34 Z3", f"SELECT id, entity_id, source FROM knowledge WHERE source_date >= {_T} - INTERVAL 240 MINUTE AND entity_id IN (SELECT id FROM entities WHERE label = 'partner') ORDER BY source_date DESC, id LIMIT 5")
def recent_triggers(t: Tables) -> DataFrame:
    key = t.entities().filter("label = 'partner'").select(F.col("id").alias("entity_id"))
    return alerts.recent_triggers(t.knowledge(), key, NOW, minutes=240).select("id", "entity_id", "source")


@query("T36", f"SELECT importance, count(*) AS n FROM (SELECT CASE WHEN direction = 'inbound' AND mention_date < {_T} - INTERVAL 30 DAY THEN 'critical' WHEN direction = 'inbound' AND mention_date < {_T} - INTERVAL 14 DAY THEN 'high' ELSE 'normal' END AS importance FROM mentions) GROUP BY 1")
def waiting_importance(t: Tables) -> DataFrame:
    items = t.mentions().select("direction", F.col("mention_date").alias("source_date"), F.lit("normal").alias("importance"))
    return alerts.waiting_importance(items, NOW).groupBy("importance").agg(F.count("*").alias("n"))


@query("T6 J9", f"SELECT entity_id, count(*) AS open, floor((epoch_us({_T}) - epoch_us(max(last))) / 86400000000.0)::BIGINT AS days FROM (SELECT id % 150 AS entity_id FROM commitments WHERE state = 'active') c JOIN (SELECT entity_id, max(mention_date) AS last FROM mentions WHERE role = 'signup' GROUP BY 1) m USING (entity_id) WHERE last < {_T} - INTERVAL 7 DAY GROUP BY 1")
def silent_owners(t: Tables) -> DataFrame:
    owned = t.commitments().filter("state = 'active'").select("id", (F.col("id") % 150).alias("entity_id"))
    return alerts.silent_owners(owned, t.mentions().filter("role = 'signup'"), NOW)


@query("A19 C3", f"SELECT source, count(*) AS n FROM knowledge WHERE source_date >= {_T} - INTERVAL 3 DAY GROUP BY 1")
def catchup_sources(t: Tables) -> DataFrame:
    return alerts.recent_by(t.knowledge(), NOW, 3, "source")
