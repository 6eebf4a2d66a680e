"""Queries of the selections that briefings, answers and reviews are made from."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.time import at, days_between, since
from ..operators import alerts, graph, rollups
from ..sources.fixtures import NOW, ORDERS_NOW, Tables
from .catalog import query

_T, _O = f"TIMESTAMP '{NOW}'", f"TIMESTAMP '{ORDERS_NOW}'"


@query(
    "C4 T29",
    f"""SELECT 'recent' AS section, source AS key, count(*) AS n FROM knowledge WHERE source_date >= {_T} - INTERVAL 2 DAY GROUP BY ALL
UNION ALL SELECT 'commitments', state, count(*) FROM commitments GROUP BY ALL
UNION ALL SELECT 'calendar', strftime(o_orderdate, '%Y-%m-%d'), count(*) FROM orders WHERE o_orderdate BETWEEN {_O} AND {_O} + INTERVAL 2 DAY GROUP BY ALL""",
)
def briefing_sections(t: Tables) -> DataFrame:
    part = lambda rows, section, key: rows.groupBy(key.alias("key")).agg(F.count("*").alias("n")).select(F.lit(section).alias("section"), "key", "n")
    recent = part(t.knowledge().filter(since("source_date", NOW, 2)), "recent", F.col("source"))
    states = part(t.commitments(), "commitments", F.col("state"))
    days = t.read("orders").filter(F.col("o_orderdate").between(at(ORDERS_NOW), at(ORDERS_NOW) + F.expr("INTERVAL 2 DAY")))
    return recent.unionByName(states).unionByName(part(days, "calendar", F.date_format("o_orderdate", "yyyy-MM-dd")))


@query(
    "C5",
    """WITH t AS (SELECT entity_id FROM knowledge GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 20), n AS (SELECT entity_id, project, count(*) AS n FROM knowledge JOIN t USING (entity_id) GROUP BY ALL)
SELECT entity_id, project, n, row_number() OVER (PARTITION BY entity_id ORDER BY n DESC, project) AS rank FROM n""",
)
def contact_projects(t: Tables) -> DataFrame:
    k = t.knowledge()
    top = k.groupBy("entity_id").agg(F.count("*").alias("c")).orderBy(F.desc("c"), "entity_id").limit(20).select("entity_id")
    n = k.join(top, "entity_id").groupBy("entity_id", "project").agg(F.count("*").alias("n"))
    return rollups.top_per_group(n, "entity_id", [F.desc("n"), F.col("project")], 1_000)


@query(
    "C11 C9",
    """WITH s AS (SELECT project FROM knowledge GROUP BY 1 HAVING count(*) FILTER (source = 'error') * 5 > count(*))
SELECT project, count(*) AS items, count(DISTINCT entity_id) AS people, count(*) FILTER (importance IN ('critical', 'high')) AS moments FROM knowledge JOIN s USING (project) GROUP BY 1""",
)
def stalling_projects(t: Tables) -> DataFrame:
    k = t.knowledge()
    stalling = k.groupBy("project").agg(F.count_if(F.col("source") == "error").alias("e"), F.count("*").alias("n")).filter("e * 5 > n").select("project")
    return k.join(stalling, "project", "left_semi").groupBy("project").agg(F.count("*").alias("items"), F.countDistinct("entity_id").alias("people"), F.count_if(F.col("importance").isin("critical", "high")).alias("moments"))


@query(
    "C12 R26",
    """(SELECT 0 AS tier, id FROM knowledge WHERE source = 'error' ORDER BY source_date DESC, id LIMIT 20) UNION ALL (SELECT 1, id FROM knowledge WHERE source = 'signup' ORDER BY source_date DESC, id LIMIT 10)""",
)
def corrections_first(t: Tables) -> DataFrame:
    newest = lambda source, tier, k: t.knowledge().filter(F.col("source") == source).orderBy(F.desc("source_date"), "id").limit(k).select(F.lit(tier).alias("tier"), "id")
    return newest("error", 0, 20).unionByName(newest("signup", 1, 10))


@query(
    "C14",
    f"""WITH r AS (SELECT * FROM knowledge WHERE source_date >= {_T} - INTERVAL 3 DAY)
SELECT signal, count(*) AS n FROM (SELECT 'correction' AS signal FROM r WHERE source = 'error' UNION ALL SELECT 'decision' FROM r WHERE source = 'purchase' UNION ALL SELECT 'manual' FROM r WHERE importance IN ('critical', 'high') UNION ALL SELECT 'lesson' FROM r WHERE source = 'signup') GROUP BY 1""",
)
def learning_signals(t: Tables) -> DataFrame:
    r = t.knowledge().filter(since("source_date", NOW, 3))
    tags = F.array_compact(F.array(F.when(F.col("source") == "error", "correction"), F.when(F.col("source") == "purchase", "decision"), F.when(F.col("importance").isin("critical", "high"), "manual"), F.when(F.col("source") == "signup", "lesson")))
    return r.select(F.explode(tags).alias("signal")).groupBy("signal").agg(F.count("*").alias("n"))


@query("C16 W13", "SELECT entity_id, id, rank FROM (SELECT entity_id, id, row_number() OVER (PARTITION BY entity_id ORDER BY source_date DESC, id) AS rank FROM knowledge) WHERE rank <= 5")
def entity_snippets(t: Tables) -> DataFrame:
    return rollups.top_per_group(t.knowledge(), "entity_id", [F.desc("source_date"), F.col("id")], 5).select("entity_id", "id", "rank")


@query(
    "C26 A20",
    "SELECT 'items' AS what, count(*) AS n FROM knowledge UNION ALL SELECT 'entities', count(*) FROM entities WHERE NOT dismissed UNION ALL SELECT 'edges', count(*) FROM (SELECT DISTINCT a.entity_id, b.entity_id AS o FROM members a JOIN members b ON a.item_id = b.item_id AND a.entity_id < b.entity_id)",
)
def orientation_counts(t: Tables) -> DataFrame:
    n = lambda rows, what: rows.agg(F.count("*").alias("n")).select(F.lit(what).alias("what"), "n")
    return n(t.knowledge(), "items").unionByName(n(t.entities().filter(~F.col("dismissed")), "entities")).unionByName(n(graph.cooccurrence_edges(t.meetings()), "edges"))


@query(
    "C27 J9",
    f"""WITH i AS (SELECT entity_id, least(10, count(*)) AS items FROM knowledge WHERE source_date >= {_T} - INTERVAL 7 DAY GROUP BY 1),
c AS (SELECT c_custkey AS entity_id, count(*) AS open FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus <> 'F' GROUP BY 1)
SELECT e.id AS entity_id, coalesce(items, 0)::BIGINT AS items, coalesce(open, 0) AS open FROM entities e LEFT JOIN i ON i.entity_id = e.id LEFT JOIN c ON c.entity_id = e.id WHERE label = 'employee'""",
)
def team_activity(t: Tables) -> DataFrame:
    items = t.knowledge().filter(since("source_date", NOW, 7)).groupBy("entity_id").agg(F.least(F.lit(10), F.count("*")).cast("long").alias("items"))
    owed = t.read("orders").filter("o_orderstatus <> 'F'").groupBy(F.col("o_custkey").alias("entity_id")).agg(F.count("*").alias("open"))
    team = t.entities().filter("label = 'employee'").select(F.col("id").alias("entity_id"))
    return team.join(items, "entity_id", "left").join(owed, "entity_id", "left").fillna(0, ["items", "open"])


@query(
    "R29",
    f"""SELECT id, place, CASE WHEN d > 30 THEN 'stale' WHEN d > 14 THEN 'ageing' ELSE 'fresh' END AS note FROM (SELECT id, row_number() OVER (ORDER BY value DESC, id) AS place, (epoch_us({_T}) - epoch_us(source_date)) / 86400000000.0 AS d FROM knowledge) WHERE place <= 15""",
)
def answer_context(t: Tables) -> DataFrame:
    top = t.knowledge().orderBy(F.desc("value"), "id").limit(15)
    age = days_between(at(NOW), F.col("source_date"))
    ranked = rollups.top_per_group(top.withColumn("page", F.lit(1)), "page", [F.desc("value"), F.col("id")], 15)
    return ranked.select("id", F.col("rank").alias("place"), F.when(age > 30, "stale").when(age > 14, "ageing").otherwise("fresh").alias("note"))


@query("S26", f"SELECT id, length(substring(raw_content, 1, 10000)) AS chars, source FROM texts WHERE day >= DATE '2024-01-01'")
def recent_documents(t: Tables) -> DataFrame:
    own = t.texts().filter(F.col("day") >= F.lit("2024-01-01").cast("date"))
    return own.select("id", F.length(F.substring("raw_content", 1, 10_000)).cast("long").alias("chars"), "source")


@query(
    "T8 T33",
    f"""SELECT owner, count(*) AS open, min(id) AS first_id FROM commitments WHERE state IN ('active', 'detected') AND due_date < {_O} GROUP BY 1 HAVING count(*) >= 3""",
)
def owners_with_overdue(t: Tables) -> DataFrame:
    late = alerts.advance_states(t.commitments(), ORDERS_NOW, drop_after=100_000).filter("next = 'overdue'")
    return late.groupBy("owner").agg(F.count("*").alias("open"), F.min("id").alias("first_id")).filter("open >= 3")
