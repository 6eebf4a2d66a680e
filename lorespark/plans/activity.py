"""Queries over activity: counts, statuses, trends, baselines, pile-ups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.time import since
from ..operators import activity, rollups
from ..sources.fixtures import NOW, ORDERS_NOW, Tables
from .catalog import query

_STATUS = "CASE WHEN d IS NULL THEN 'unknown' WHEN d <= 3 THEN 'active' WHEN d <= 7 THEN 'warm' WHEN d <= 14 THEN 'cooling' WHEN d <= 30 THEN 'cold' ELSE 'dormant' END"
_T = f"TIMESTAMP '{NOW}'"
_DAYS = f"(epoch_us({_T}) - epoch_us({{}})) / 86400000000.0"

_MOMENTUM = f"""
WITH w AS (SELECT {{keys}},
  count(*) FILTER (mention_date >= {_T} - INTERVAL 7 DAY) AS w1,
  count(*) FILTER (mention_date >= {_T} - INTERVAL 14 DAY AND mention_date < {_T} - INTERVAL 7 DAY) AS w2,
  count(*) FILTER (mention_date >= {_T} - INTERVAL 21 DAY AND mention_date < {_T} - INTERVAL 14 DAY) AS w3,
  count(*) FILTER (mention_date >= {_T} - INTERVAL 28 DAY AND mention_date < {_T} - INTERVAL 21 DAY) AS w4
  FROM mentions WHERE mention_date >= {_T} - INTERVAL 28 DAY GROUP BY ALL)
SELECT *, CASE WHEN w1 = 0 AND (w2 > 0 OR w3 > 0) THEN 'cold' WHEN w1 > 0 AND w2 = 0 AND w3 = 0 THEN 'new_burst'
  WHEN w1 > w2 AND w2 >= w3 THEN 'accelerating' WHEN w1 < w2 AND w2 <= w3 THEN 'decelerating' ELSE 'steady' END AS trend
FROM w WHERE w1 + w2 + w3 + w4 > 0"""


@query("T2 W3 A2 W14", _MOMENTUM.format(keys="entity_id"))
def momentum(t: Tables) -> DataFrame:
    return activity.momentum(t.mentions(), NOW)


@query("T2 W3", _MOMENTUM.format(keys="entity_id, role"))
def momentum_by_kind(t: Tables) -> DataFrame:
    return activity.momentum(t.mentions(), NOW, ("entity_id", "role"))


@query("T1 A6", f"SELECT entity_id, mentions, d AS days_since, {_STATUS} AS status FROM (SELECT entity_id, count(*) AS mentions, floor({_DAYS.format('max(mention_date)')})::BIGINT AS d FROM mentions GROUP BY 1)")
def relationship_status(t: Tables) -> DataFrame:
    return activity.relationship_status(t.mentions(), NOW)


@query(
    "T3 W2",
    f"""
WITH b AS (SELECT entity_id, count(*) AS n, max(mention_date) AS l,
  count(*) FILTER (mention_date >= {_T} - INTERVAL 30 DAY) AS m, count(*) FILTER (mention_date >= {_T} - INTERVAL 7 DAY) AS w,
  count(*) FILTER (mention_date >= {_T} - INTERVAL 30 DAY AND direction = 'inbound') AS i,
  min(mention_date) FILTER (mention_date >= {_T} - INTERVAL 30 DAY) AS f1, max(mention_date) FILTER (mention_date >= {_T} - INTERVAL 30 DAY) AS l1
  FROM mentions GROUP BY 1 HAVING count(*) >= 3),
c AS (SELECT *, m / 4.3::DOUBLE AS rate, CASE WHEN m > 1 THEN (epoch_us(l1) - epoch_us(f1)) / 86400000000.0 / (m - 1) ELSE 0 END AS gap, {_DAYS.format("l")} AS silent FROM b),
d AS (SELECT *, CASE WHEN rate > 0 THEN w / rate WHEN w > 0 THEN 2.0 ELSE 0.0 END AS velocity FROM c),
e AS (SELECT *, CASE WHEN rate >= 1 THEN CASE WHEN velocity < 0.3 AND silent > gap * 2 THEN 'decelerating' WHEN velocity > 2.5 THEN 'surge' WHEN silent > 14 AND rate >= 2 THEN 'silent' END
  WHEN n >= 5 AND silent > 30 THEN 'silent' END AS anomaly FROM d)
SELECT entity_id, n AS mentions, floor(rate * 10 + .5) / 10 AS per_week, floor(gap * 10 + .5) / 10 AS average_gap, floor(i / greatest(m, 1) * 100 + .5) / 100 AS inbound_ratio,
  floor(silent * 10 + .5) / 10 AS days_silent, floor(velocity * 100 + .5) / 100 AS velocity, anomaly,
  CASE WHEN anomaly = 'decelerating' THEN CASE WHEN silent > gap * 3 THEN 'high' ELSE 'medium' END WHEN anomaly = 'surge' THEN CASE WHEN velocity > 4 THEN 'high' ELSE 'medium' END
  WHEN anomaly = 'silent' AND rate >= 1 THEN CASE WHEN silent > 21 THEN 'high' ELSE 'medium' END WHEN anomaly = 'silent' THEN 'low' END AS severity FROM e""",
)
def predictor_anomalies(t: Tables) -> DataFrame:
    return activity.communication_baseline(t.mentions(), NOW)


@query(
    "T5 W16 A7",
    f"""
WITH a AS (SELECT entity_id, role, count(*) FILTER (mention_date >= {_T} - INTERVAL 7 DAY) AS last_week,
  count(*) FILTER (mention_date >= {_T} - INTERVAL 28 DAY AND mention_date < {_T} - INTERVAL 7 DAY) AS before FROM mentions GROUP BY ALL),
r AS (SELECT *, last_week / nullif(before / 3.0::DOUBLE, 0) AS ratio FROM a WHERE before >= 3)
SELECT entity_id, role, last_week, before, round(ratio, 6) AS ratio FROM r WHERE last_week = 0 OR ratio >= 3 ORDER BY abs(ratio - 1) DESC, entity_id, role LIMIT 10""",
)
def frequency_anomalies(t: Tables) -> DataFrame:
    return activity.frequency_anomalies(t.mentions(), NOW, ("entity_id", "role"))


@query(
    "W1",
    """WITH g AS (SELECT entity_id, (epoch_us(mention_date) - epoch_us(lag(mention_date) OVER (PARTITION BY entity_id ORDER BY mention_date))) / 86400000000.0 AS gap FROM mentions)
SELECT entity_id, count(*) AS mentions, round(coalesce(avg(gap), 0), 6) AS average_gap FROM g GROUP BY 1""",
)
def avg_gap_lag(t: Tables) -> DataFrame:
    return activity.average_gap(t.mentions())


@query(
    "G15",
    f"""
WITH a AS (SELECT entity_id, count(*) FILTER (mention_date >= {_T} - INTERVAL 7 DAY) AS week,
  count(*) FILTER (mention_date >= {_T} - INTERVAL 28 DAY AND mention_date < {_T} - INTERVAL 7 DAY) AS before, floor({_DAYS.format("max(mention_date)")})::BIGINT AS days,
  entity_id % 3 AS n_open, entity_id % 2 AS n_overdue FROM mentions GROUP BY entity_id),
b AS (SELECT *, week / greatest(before / 3.0::DOUBLE, 1.0) AS ratio FROM a)
SELECT entity_id, week, before, CASE WHEN ratio > 2 THEN 'surging' WHEN ratio >= .5 THEN 'active' WHEN ratio >= .25 THEN 'cooling' ELSE 'cold' END AS trend,
  least(100, floor(ratio * 100 + .5))::BIGINT AS health, days AS days_since,
  concat_ws(',', CASE WHEN ratio > 3 THEN 'surge' END, CASE WHEN ratio < .25 AND before > 3 THEN 'drop' END, CASE WHEN n_overdue > 0 THEN 'overdue' END, CASE WHEN days > 14 AND n_open > 0 THEN 'silent' END) AS risks FROM b""",
)
def living_profile(t: Tables) -> DataFrame:
    known = t.entities().select(F.col("id").alias("entity_id"), (F.col("id") % 3).alias("n_open"), (F.col("id") % 2).alias("n_overdue"))
    return activity.living_profile(t.mentions(), known, NOW)


@query(
    "G16 T35 T13",
    f"""
WITH r AS (SELECT entity_id, count(*) AS mentions, floor({_DAYS.format("max(mention_date)")})::BIGINT AS d FROM mentions WHERE mention_date >= {_T} - INTERVAL 30 DAY GROUP BY 1)
SELECT entity_id, name, label, mentions, {_STATUS} AS status FROM r JOIN entities ON id = entity_id WHERE NOT dismissed ORDER BY mentions DESC, entity_id LIMIT 20""",
)
def world_people(t: Tables) -> DataFrame:
    return activity.top_entities(t.mentions(), t.entities(), NOW)


@query(
    "T11 T30 J3",
    f"""
WITH a AS (SELECT entity_id, count(*) AS mentions, count(*) FILTER (mention_date >= {_T} - INTERVAL 3 DAY) AS recent, floor({_DAYS.format("max(mention_date)")})::BIGINT AS d FROM mentions WHERE role = 'signup' GROUP BY 1)
SELECT entity_id, name, mentions, d AS days_since, round(.5 + CASE WHEN label IN ('partner', 'client') THEN .2 ELSE 0 END + CASE WHEN mentions >= 10 THEN .1 ELSE 0 END, 6)::DOUBLE AS confidence
FROM a JOIN entities ON id = entity_id WHERE NOT dismissed AND mentions >= 2 AND recent = 0 AND d > 2 AND (coalesce(label IN ('partner', 'client'), false) OR mentions >= 10)""",
)
def cold_relationships(t: Tables) -> DataFrame:
    return activity.cold_relationships(t.mentions().filter("role = 'signup'"), t.entities(), NOW, least=2, silent=2, window=3)


@query("T7 P6", f"SELECT DISTINCT 'q' || k AS project FROM knowledge WHERE k NOT IN (SELECT k FROM knowledge WHERE source = 'signup' AND source_date >= {_T} - INTERVAL 2 DAY)")
def stale_projects(t: Tables) -> DataFrame:
    items = t.knowledge().withColumn("project", F.concat(F.lit("q"), F.col("k").cast("string")))
    return activity.stale_projects(items.filter("source = 'signup'"), items.select("project").distinct(), NOW, days=2)


@query(
    "T22 T38 A3 A4",
    f"""SELECT entity_id, count(DISTINCT project) AS n_projects, count(*) AS mentions, string_agg(DISTINCT project, ',' ORDER BY project) AS projects
FROM knowledge WHERE source_date >= {_T} - INTERVAL 30 DAY GROUP BY 1 HAVING count(DISTINCT project) >= 2 ORDER BY 2 DESC, 3 DESC, 1 LIMIT 15""",
)
def connector_entities(t: Tables) -> DataFrame:
    return activity.multi_project_entities(t.knowledge(), NOW)


@query(
    "T24 W7 A8",
    """
WITH d AS (SELECT due_date::DATE AS day, count(*) AS n FROM commitments WHERE state = 'detected' GROUP BY 1 HAVING count(*) >= 3),
b AS (SELECT *, CASE WHEN day - lag(day) OVER (PARTITION BY year(day) ORDER BY day) <= 3 THEN 0 ELSE 1 END AS begin FROM d),
i AS (SELECT *, sum(begin) OVER (PARTITION BY year(day) ORDER BY day) AS island FROM b)
SELECT min(day) AS first_day, max(day) AS last_day, sum(n)::BIGINT AS total FROM i GROUP BY year(day), island HAVING sum(n) >= 5""",
)
def pileup_islands(t: Tables) -> DataFrame:
    return activity.pileups(t.commitments().filter("state = 'detected'").select(F.to_date("due_date").alias("day")))


@query(
    "T23 J10",
    f"""
WITH c AS (SELECT id, project, due_date::DATE AS day FROM commitments WHERE state <> 'fulfilled' AND due_date >= TIMESTAMP '{ORDERS_NOW}'),
p AS (SELECT a.project, b.project AS project2, abs(a.day - b.day) AS gap, a.id, b.id AS id2 FROM c a JOIN c b ON a.project < b.project AND abs(a.day - b.day) <= 7),
n AS (SELECT project, project2, count(*) AS pairs FROM p GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY project, project2 ORDER BY gap, id, id2) AS k FROM p)
SELECT project, project2, pairs, gap::INTEGER AS gap, id, id2 FROM r JOIN n USING (project, project2) WHERE k = 1""",
)
def timeline_overlap_band_join(t: Tables) -> DataFrame:
    return activity.date_overlaps(t.commitments().filter((F.col("state") != "fulfilled") & since("due_date", ORDERS_NOW, 0)))


@query(
    "T15 A16",
    f"""
WITH p AS (SELECT project, count(*) AS items, count(*) FILTER (source_date >= {_T} - INTERVAL 7 DAY) AS week,
  count(*) FILTER (source_date >= {_T} - INTERVAL 14 DAY AND source_date < {_T} - INTERVAL 7 DAY) AS prior, count(DISTINCT entity_id) AS people FROM knowledge GROUP BY 1)
SELECT project, items, week, prior, people, CASE WHEN week > prior * 1.5 THEN 'accelerating' WHEN week > 0 AND week >= prior * .5 THEN 'steady' WHEN week > 0 THEN 'decelerating' ELSE 'stalled' END AS trend,
  floor(100 * items / (SELECT sum(items) FROM p) + .5) AS share FROM p WHERE items >= 3""",
)
def pipeline_trend(t: Tables) -> DataFrame:
    return activity.project_pipeline(t.knowledge(), NOW)


@query("A1 A20", "SELECT source, count(*) AS n FROM knowledge GROUP BY 1")
def source_counts(t: Tables) -> DataFrame:
    return rollups.counts_by(t.knowledge(), "source")


@query("A1 P1 P5", "SELECT importance, count(*) AS n FROM knowledge WHERE source IN ('view', 'click') AND project = 'p3' GROUP BY 1")
def importance_rollup(t: Tables) -> DataFrame:
    return rollups.counts_by(rollups.select_where(t.knowledge(), source=["view", "click"], project="p3", importance=None), "importance")


@query("A10 A4", "SELECT entity_id, count(*) AS mentions, string_agg(DISTINCT source, ',' ORDER BY source) AS sources, count(DISTINCT project) AS n_projects FROM knowledge GROUP BY 1")
def contact_rollup(t: Tables) -> DataFrame:
    return rollups.contact_rollup(t.knowledge())


@query(
    "A12 T13",
    """SELECT project, count(*) AS items, max(source_date) AS last, arg_min(importance, CASE importance WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'normal' THEN 2 ELSE 3 END) AS importance FROM knowledge GROUP BY 1""",
)
def world_projects(t: Tables) -> DataFrame:
    return rollups.project_rollup(t.knowledge())


@query(
    "A13",
    f"""SELECT entity_id, mentions, n_sources, n_projects, d AS days_since, {_STATUS} AS status FROM (SELECT entity_id, count(*) AS mentions, count(DISTINCT source) AS n_sources, count(DISTINCT project) AS n_projects,
  floor({_DAYS.format("max(source_date)")})::BIGINT AS d FROM knowledge GROUP BY 1 HAVING count(*) >= 2)""",
)
def relationship_health(t: Tables) -> DataFrame:
    return rollups.relationship_health(t.knowledge(), NOW)


@query("A14", "SELECT entity_id, source, n FROM (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY n DESC, source) AS k FROM (SELECT entity_id, source, count(*) AS n FROM knowledge GROUP BY ALL)) WHERE k = 1")
def primary_source_mode(t: Tables) -> DataFrame:
    return rollups.mode_by(t.knowledge(), "entity_id", "source")


@query("A16", "SELECT project, count(*) AS n, floor(100 * count(*) / sum(count(*)) OVER () + .5)::BIGINT AS percent FROM knowledge GROUP BY 1")
def time_allocation_pct(t: Tables) -> DataFrame:
    return rollups.share_of_total(t.knowledge(), "project")


@query("A18", "SELECT count(*) FILTER (state = 'fulfilled') AS correct, count(*) FILTER (state = 'detected') AS partial, count(*) FILTER (state = 'active') AS wrong, round((count(*) FILTER (state = 'fulfilled') + .5::DOUBLE * count(*) FILTER (state = 'detected')) / count(*), 6) AS accuracy FROM commitments")
def prediction_accuracy(t: Tables) -> DataFrame:
    outcome = F.when(F.col("state") == "fulfilled", "correct").when(F.col("state") == "detected", "partial").otherwise("wrong")
    return rollups.accuracy(t.commitments().select(outcome.alias("outcome")))


@query("A17 Q10", "SELECT md5(text) AS print, count(*) AS n, min(doc_id) AS first_id FROM documents GROUP BY 1 HAVING count(*) > 1")
def duplicate_groups(t: Tables) -> DataFrame:
    return rollups.duplicate_groups(t.read("documents"), [F.md5(F.col("text").cast("binary")).alias("print")], "doc_id")


@query("A22", "SELECT entity_id, count(DISTINCT item_id) AS n, count(DISTINCT item_id) > .3 * (SELECT count(DISTINCT item_id) FROM members) AS common FROM members GROUP BY 1")
def contact_commonness(t: Tables) -> DataFrame:
    return rollups.common_contacts(t.members())


@query("W13 C9", "SELECT project, entity_id, n, rank FROM (SELECT *, row_number() OVER (PARTITION BY project ORDER BY n DESC, entity_id) AS rank FROM (SELECT project, entity_id, count(*) AS n FROM knowledge GROUP BY ALL)) WHERE rank <= 5")
def project_top_people(t: Tables) -> DataFrame:
    n = t.knowledge().groupBy("project", "entity_id").agg(F.count("*").alias("n"))
    return rollups.top_per_group(n, "project", [F.desc("n"), F.col("entity_id")], 5)


@query("W8 W9 W11", "SELECT entity_id, id, project FROM (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY source_date DESC, id) AS place FROM knowledge) WHERE place = 1")
def latest_item_per_entity(t: Tables) -> DataFrame:
    return rollups.latest_by(t.knowledge(), ["entity_id"], [F.desc("source_date"), F.col("id")]).select("entity_id", "id", "project")


@query("W5 Q30", "SELECT entity_id, id, row_number() OVER w AS version, id = last_value(id) OVER (PARTITION BY entity_id ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS is_latest FROM knowledge WHERE source = 'purchase' WINDOW w AS (PARTITION BY entity_id ORDER BY id)")
def artifact_versions(t: Tables) -> DataFrame:
    return rollups.versions(t.knowledge().filter("source = 'purchase'"), "entity_id", "id").select("entity_id", "id", "version", "is_latest")


@query("S2 S3 P5 P8", "SELECT role IN ('error') AS derived, count(*) AS n FROM (SELECT CASE source WHEN 'error' THEN 'error' ELSE source END AS role FROM knowledge) GROUP BY 1")
def provenance_split(t: Tables) -> DataFrame:
    items = t.knowledge().withColumn("source", F.when(F.col("source") == "error", "briefing").otherwise(F.col("source")))
    return rollups.primary(items).withColumn("derived", F.lit(False)).unionByName(rollups.derived(items).withColumn("derived", F.lit(True))).groupBy("derived").agg(F.count("*").alias("n"))


@query(
    "S18 S20",
    """SELECT coalesce(n.id, o.id) AS id, coalesce(n.project, o.project) AS project, o.value FROM (SELECT id, project, value FROM knowledge WHERE source <> 'error') o
FULL JOIN (SELECT id, CASE WHEN importance = 'high' THEN 'new' END AS project FROM knowledge WHERE source IN ('view', 'error')) n ON o.id = n.id""",
)
def upsert_keeps_unlisted(t: Tables) -> DataFrame:
    items = t.knowledge()
    new = items.filter("source in ('view', 'error')").select("id", F.when(F.col("importance") == "high", "new").alias("project"))
    return rollups.upsert(items.filter("source <> 'error'").select("id", "project", "value"), new, ["id"])
