"""Queries of entity profiles and of priorities."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.time import ago
from ..operators import profiles
from ..sources.fixtures import NOW, ORDERS_NOW, Tables
from .catalog import query

_T, _O = f"TIMESTAMP '{NOW}'", f"TIMESTAMP '{ORDERS_NOW}'"


@query(
    "G14",
    f"""
WITH e AS (SELECT id, name, dismissed FROM entities),
st AS (SELECT entity_id, count(*) AS mentions, count(*) FILTER (direction = 'inbound') AS inbound, count(*) FILTER (direction = 'outbound') AS outbound, min(mention_date) AS first_seen, max(mention_date) AS last_seen FROM mentions GROUP BY 1),
met AS (SELECT m.entity_id, m.item_id, k.project, k.source_date FROM mentions m JOIN knowledge k ON k.id = m.item_id),
pr AS (SELECT entity_id, string_agg(DISTINCT project, ',' ORDER BY project) AS projects FROM met GROUP BY 1),
al AS (SELECT c_custkey AS entity_id, c_name || ',' || c_mktsegment AS aliases FROM customer WHERE c_name < c_mktsegment UNION ALL SELECT c_custkey, c_mktsegment || ',' || c_name FROM customer WHERE c_name >= c_mktsegment),
rc AS (SELECT entity_id, string_agg(item_id::VARCHAR, ',' ORDER BY place) AS recent_items FROM (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY source_date DESC, item_id) AS place FROM met) WHERE place <= 5 GROUP BY 1),
pairs AS (SELECT x.u AS a, y.u AS b, count(*) AS n FROM (SELECT DISTINCT event_id % 2000 AS i, user_id AS u FROM events) x JOIN (SELECT DISTINCT event_id % 2000 AS i, user_id AS u FROM events) y ON x.i = y.i AND x.u < y.u GROUP BY 1, 2),
both_ AS (SELECT a, b, n FROM pairs UNION ALL SELECT b, a, n FROM pairs),
cn AS (SELECT entity_id, string_agg(name, ',' ORDER BY place) AS connected FROM (SELECT a AS entity_id, name, row_number() OVER (PARTITION BY a ORDER BY n DESC, b) AS place FROM both_ JOIN e ON e.id = b WHERE NOT dismissed) WHERE place <= 10 GROUP BY 1),
ow AS (SELECT e.id AS entity_id, count(*) AS commitments FROM e JOIN (SELECT 'USER_' || (o_custkey % 300) || ' of ' || o_orderpriority AS owner FROM orders WHERE o_orderstatus = 'O') c ON contains(lower(owner), lower(name)) GROUP BY 1),
a AS (SELECT e.id AS entity_id, name, coalesce(mentions, 0) AS mentions, coalesce(inbound, 0) AS inbound, coalesce(outbound, 0) AS outbound, first_seen, last_seen, projects, aliases, recent_items, connected, coalesce(commitments, 0) AS commitments,
  floor((epoch_us({_T}) - epoch_us(last_seen)) / 86400000000.0)::BIGINT AS days_since
  FROM e LEFT JOIN st ON st.entity_id = e.id LEFT JOIN pr ON pr.entity_id = e.id LEFT JOIN al ON al.entity_id = e.id LEFT JOIN rc ON rc.entity_id = e.id LEFT JOIN cn ON cn.entity_id = e.id LEFT JOIN ow ON ow.entity_id = e.id)
SELECT *, CASE WHEN days_since IS NULL THEN 'unknown' WHEN days_since <= 3 THEN 'active' WHEN days_since <= 7 THEN 'warm' WHEN days_since <= 14 THEN 'cooling' WHEN days_since <= 30 THEN 'cold' ELSE 'dormant' END AS status FROM a""",
)
def entity_profiles(t: Tables) -> DataFrame:
    events, customers = t.read("events"), t.read("customer")
    meetings = events.select((F.col("event_id") % 2000).alias("item_id"), F.col("user_id").alias("entity_id"))
    aliases = customers.select(F.col("c_custkey").alias("entity_id"), F.explode(F.array("c_name", "c_mktsegment")).alias("alias"))
    owner = F.concat(F.lit("USER_"), (F.col("o_custkey") % 300).cast("string"), F.lit(" of "), "o_orderpriority")
    owed = t.read("orders").filter("o_orderstatus = 'O'").select(F.col("o_orderkey").alias("id"), owner.alias("owner"), F.lit("active").alias("state"))
    return profiles.entity_profiles(t.entities(), t.mentions(), t.knowledge(), meetings, aliases, owed, NOW)


@query(
    "T32",
    f"""
WITH due AS (SELECT id, project, floor((epoch_us(due_date) - epoch_us({_O})) / 86400000000.0 + .5) AS ahead, due_date FROM commitments WHERE state IN ('active', 'overdue') AND due_date < {_O} + INTERVAL 7 DAY AND due_date >= {_O} - INTERVAL 2 DAY ORDER BY due_date, id LIMIT 5),
p AS (SELECT DISTINCT o_orderpriority AS project, CASE o_orderpriority WHEN '1-URGENT' THEN 'accelerating' WHEN '2-HIGH' THEN 'stalling' WHEN '3-MEDIUM' THEN 'active' WHEN '5-LOW' THEN 'steady' ELSE 'odd' END AS status FROM orders),
ac AS (SELECT o_orderkey AS id, o_orderpriority AS project, o_custkey AS target, o_orderkey % 2 = 0 AS in_session, {_O} - to_hours((o_orderkey % 211)::INTEGER) AS created_at, CASE WHEN o_orderkey % 3 = 0 THEN {_O} - to_hours((o_orderkey % 211)::INTEGER) + INTERVAL 100 HOUR END AS expires_at FROM orders WHERE o_orderkey % 15 = 0),
heard AS (SELECT o_custkey AS target, max(o_orderdate) AS heard FROM orders WHERE o_orderdate <= {_O} GROUP BY 1),
every AS (SELECT 'commitment-' || id AS id, 1 AS tier, 'milestone' AS kind, project, CASE WHEN ahead < 0 THEN 'critical' WHEN ahead <= 2 THEN 'high' ELSE 'medium' END AS urgency, false AS stale, due_date AS at_ FROM due
  UNION ALL SELECT 'project-' || project, CASE WHEN project IN (SELECT project FROM due) THEN 2 ELSE 1 END, 'strategic', project, CASE status WHEN 'accelerating' THEN 'critical' WHEN 'stalling' THEN 'high' WHEN 'active' THEN 'medium' WHEN 'steady' THEN 'low' ELSE 'medium' END, false, NULL FROM p WHERE project <> '3-MEDIUM'
  UNION ALL SELECT 'action-' || id, 2, 'action', project, 'medium', coalesce(heard > created_at, false), created_at FROM ac LEFT JOIN heard USING (target)
    WHERE (expires_at IS NULL OR expires_at > {_O}) AND (epoch_us({_O}) - epoch_us(created_at)) / 3600000000.0 <= CASE WHEN in_session THEN 168 ELSE 72 END AND target NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING'))
SELECT id, tier, kind, project, urgency, stale, round(CASE WHEN at_ IS NULL THEN 1.0 ELSE 1 / (1 + greatest((epoch_us({_O}) - epoch_us(at_)) / 86400000000.0, 0) * .05::DOUBLE) END, 6) AS weight FROM every""",
)
def ambient_priorities(t: Tables) -> DataFrame:
    orders, now = t.read("orders"), F.lit(ORDERS_NOW).cast("timestamp_ntz")
    kind = F.col("o_orderpriority")
    status = F.when(kind == "1-URGENT", "accelerating").when(kind == "2-HIGH", "stalling").when(kind == "3-MEDIUM", "active").when(kind == "5-LOW", "steady").otherwise("odd")
    plans = orders.select(kind.alias("project"), status.alias("status"), F.when(kind == "3-MEDIUM", "No action needed now").otherwise("call them").alias("next_action")).distinct()
    hours = lambda n: F.make_dt_interval(F.lit(0), n.cast("int"))
    made = now - hours(F.col("o_orderkey") % 211)
    actions = orders.filter("o_orderkey % 15 = 0").select(F.col("o_orderkey").alias("id"), kind.alias("project"), F.lit("pending").alias("status"), F.col("o_custkey").alias("target"), (F.col("o_orderkey") % 2 == 0).alias("in_session"), made.alias("created_at"), F.when(F.col("o_orderkey") % 3 == 0, made + hours(F.lit(100))).alias("expires_at"))
    gone = t.read("customer").filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("target"))
    heard = orders.filter(F.col("o_orderdate") <= now).select(F.col("o_custkey").alias("target"), F.col("o_orderdate").alias("source_date"))
    due = t.commitments().filter(F.col("due_date") >= ago(ORDERS_NOW, 2))
    return profiles.ambient_priorities(due, plans, actions, gone, heard, ORDERS_NOW).withColumn("weight", F.round("weight", 6))


@query(
    "C4 T29 T30",
    f"""
WITH i AS (SELECT id, 'about ' || project || ' ' || k AS title, CASE WHEN k % 9 = 4 THEN 'calendar' ELSE source END AS source, source_date + CASE WHEN k % 9 = 4 THEN INTERVAL 10 DAY ELSE INTERVAL 0 DAY END AS source_date, k % 4 = 1 AS waiting, id % 23 AS days_since_last, entity_id FROM knowledge),
c AS (SELECT id, owner AS text, state, due_date FROM commitments WHERE due_date >= {_O} - INTERVAL 3 DAY),
seen AS (SELECT 'user_' || entity_id || '/' || (id % 40) AS contact, count(*) AS n, max(source_date) AS last FROM i GROUP BY 1 HAVING count(*) >= 3)
SELECT 'recent' AS section, id::VARCHAR AS key, title, floor((epoch_us({_T}) - epoch_us(source_date)) / 86400000000.0)::BIGINT AS days FROM i WHERE source_date >= {_T} - INTERVAL 2 DAY
UNION ALL SELECT 'commitment', id::VARCHAR, text, floor((epoch_us({_T}) - epoch_us(due_date)) / 86400000000.0)::BIGINT FROM c WHERE state IN ('active', 'detected')
UNION ALL SELECT 'overdue', id::VARCHAR, text, floor((epoch_us({_T}) - epoch_us(due_date)) / 86400000000.0)::BIGINT FROM c WHERE state IN ('active', 'detected') AND due_date < {_T}
UNION ALL SELECT 'dropped', arg_max(id, days_since_last * 10000000 + id)::VARCHAR, title, max(days_since_last) FROM i WHERE waiting AND days_since_last > 7 GROUP BY title
UNION ALL SELECT 'cold', contact, n || ' mentions', floor((epoch_us({_T}) - epoch_us(last)) / 86400000000.0)::BIGINT FROM seen WHERE floor((epoch_us({_T}) - epoch_us(last)) / 86400000000.0) > 14
UNION ALL SELECT 'calendar', id::VARCHAR, title, 0 FROM i WHERE source = 'calendar' AND source_date >= {_T} AND source_date < {_T} + INTERVAL 2 DAY""",
)
def briefing_rows(t: Tables) -> DataFrame:
    k = t.knowledge()
    event = F.col("k") % 9 == 4
    moved = F.col("source_date") + F.when(event, F.make_dt_interval(F.lit(10))).otherwise(F.make_dt_interval(F.lit(0)))
    items = k.select("id", F.concat(F.lit("about "), "project", F.lit(" "), F.col("k").cast("string")).alias("title"), F.when(event, "calendar").otherwise(F.col("source")).alias("source"), moved.alias("source_date"), (F.col("k") % 4 == 1).alias("waiting"), (F.col("id") % 23).alias("days_since_last"))
    contacts = k.select("id", F.concat(F.lit("user_"), F.col("entity_id").cast("string"), F.lit("/"), (F.col("id") % 40).cast("string")).alias("contact"))
    owed = t.commitments().filter(F.col("due_date") >= ago(ORDERS_NOW, 3)).select("id", F.col("owner").alias("text"), "state", "due_date")
    return profiles.briefing_rows(items, contacts, owed, NOW)
