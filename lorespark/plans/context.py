"""Queries of selections for prompts and reports, and of the graph's upkeep."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.time import at, since
from ..operators import alerts, context, graph, retrieval, rollups
from ..sources.fixtures import NOW, ORDERS_NOW, Tables
from .catalog import query

_T, _O = f"TIMESTAMP '{NOW}'", f"TIMESTAMP '{ORDERS_NOW}'"


@query("G12", "SELECT e.id, coalesce(CASE WHEN c_mktsegment = 'BUILDING' THEN 'builder' END, label) AS label FROM entities e LEFT JOIN customer ON c_custkey = e.id")
def label_override(t: Tables) -> DataFrame:
    own = t.read("customer").select(F.col("c_custkey").alias("id"), F.when(F.col("c_mktsegment") == "BUILDING", "builder").alias("user_label"))
    return context.apply_labels(t.entities(), own).select("id", "label")


@query("G13 Z6", "SELECT entity_id, ignored, acted, CASE WHEN acted >= 5 THEN 'partner' WHEN ignored >= 3 THEN 'noise' END AS label FROM (SELECT user_id AS entity_id, count(*) FILTER (event_type = 'error') AS ignored, count(*) FILTER (event_type = 'purchase') AS acted FROM events GROUP BY 1)")
def signal_relabel(t: Tables) -> DataFrame:
    signal = F.when(F.col("event_type") == "error", "ignored").when(F.col("event_type") == "purchase", "acted")
    return context.signal_relabel(t.read("events").select(F.col("user_id").alias("entity_id"), signal.alias("signal")))


@query(
    "G32",
    """WITH n AS (SELECT DISTINCT p_type AS name FROM part UNION SELECT DISTINCT p_type || ' ' || p_brand FROM part), m AS (SELECT a.name, b.name AS longer FROM n a JOIN n b ON substring(lower(a.name), 1, 4) = substring(lower(b.name), 1, 4) AND length(b.name) > length(a.name) AND contains(lower(b.name), lower(a.name)))
SELECT name, max(longer) AS longer FROM (SELECT *, length(longer) AS n, max(length(longer)) OVER (PARTITION BY name) AS m FROM m) WHERE n = m GROUP BY 1""",
)
def contact_variants(t: Tables) -> DataFrame:
    names = t.read("part").select(F.col("p_type").alias("name")).unionByName(t.read("part").select(F.concat_ws(" ", "p_type", "p_brand").alias("name"))).distinct()
    return context.contained_names(names)


@query("G27 W6", "WITH c AS (SELECT project AS cluster, id FROM vectors), k AS (SELECT cluster, min(id // 50) AS old FROM c WHERE cluster % 3 <> 0 AND id % 4 = 1 GROUP BY 1) SELECT cluster, id, coalesce(old, cluster)::BIGINT AS thread_id FROM c LEFT JOIN k USING (cluster)")
def thread_assignment(t: Tables) -> DataFrame:
    """Clusters of which some hold items of older threads; the others are new."""
    clusters = t.vectors().select(F.col("project").alias("cluster"), "id")
    old = clusters.filter("cluster % 3 <> 0 and id % 4 = 1").select("id", F.floor(F.col("id") / 50).alias("thread_id"))
    return context.extend_threads(old, clusters).withColumn("thread_id", F.col("thread_id").cast("long"))


@query("W6", "WITH l AS (SELECT conv_id, max(turn) AS last FROM conversations WHERE role = 'user' GROUP BY 1) SELECT conv_id AS thread_id, turn AS id, (coalesce(last, 0) + row_number() OVER (PARTITION BY conv_id ORDER BY turn))::BIGINT AS position FROM conversations LEFT JOIN l USING (conv_id) WHERE role = 'assistant'")
def appended_positions(t: Tables) -> DataFrame:
    c = t.read("conversations").select(F.col("conv_id").alias("thread_id"), F.col("turn").alias("id"), F.col("turn").alias("at"), F.col("turn").alias("position"), "role")
    return context.append_positions(c.filter("role = 'user'"), c.filter("role = 'assistant'").select("thread_id", "id", "at")).select("thread_id", "id", "position")


@query("C6", "SELECT entity_id, name, mentions FROM (SELECT entity_id, count(*) AS mentions FROM mentions GROUP BY 1 HAVING count(*) >= 5) JOIN entities ON id = entity_id WHERE label IS NULL AND NOT dismissed ORDER BY mentions DESC, entity_id LIMIT 20")
def classification_candidates(t: Tables) -> DataFrame:
    return context.candidates(t.mentions(), t.entities())


@query("C7 J4", f"SELECT entity_id, mentions FROM (SELECT entity_id, count(*) AS mentions FROM mentions GROUP BY 1 HAVING count(*) >= 3) LEFT JOIN customer ON c_custkey = entity_id WHERE NOT coalesce(c_mktsegment = 'BUILDING', false) AND (c_custkey IS NULL OR c_acctbal < 5000) ORDER BY mentions DESC, entity_id LIMIT 60")
def review_candidates(t: Tables) -> DataFrame:
    seen = F.when(F.col("c_acctbal") < 5000, F.lit("2024-01-01 00:00:00")).otherwise(F.lit("2024-01-30 00:00:00")).cast("timestamp_ntz")
    profiles = t.read("customer").select(F.col("c_custkey").alias("entity_id"), (F.col("c_mktsegment") == "BUILDING").alias("user_override"), seen.alias("last_verified_at"))
    return context.due_for_review(t.mentions(), profiles, NOW)


@query("C10 C13 S22 P6", f"SELECT id FROM knowledge WHERE source_date >= {_T} - INTERVAL 7 DAY AND id NOT IN (SELECT id FROM knowledge WHERE source = 'purchase') ORDER BY source_date DESC, id LIMIT 30")
def extraction_backlog(t: Tables) -> DataFrame:
    k = t.knowledge()
    return context.backlog(k, k.filter("source = 'purchase'").select("id"), NOW).select("id")


_PHRASES = ["An acquisition is near", "the weather", "Restructuring plans", "new REGULATORY terms", "kept confidential", "an Opportunity", "a competitor", "she is leaving", "he is joining", "they pivot", "lunch"]
_SUMMARIES = f"told AS (SELECT *, [{', '.join(f"'{x}'" for x in _PHRASES)}][k % 11 + 1] AS summary, CASE WHEN k % 13 = 0 THEN 'briefing' ELSE source END AS kind FROM knowledge)"


@query(
    "P16",
    f"""WITH {_SUMMARIES} SELECT id, summary FROM told
WHERE source_date >= {_T} - INTERVAL 7 DAY AND kind NOT IN ('calendar', 'agent-notification', 'agent-report', 'briefing', 'directive') AND entity_id % 3 <> 0
  AND (summary ILIKE '%acqui%' OR summary ILIKE '%restructur%' OR summary ILIKE '%regulat%' OR summary ILIKE '%confidential%' OR summary ILIKE '%opportunity%' OR summary ILIKE '%compet%'
    OR summary ILIKE '%leaving%' OR summary ILIKE '%joining%' OR summary ILIKE '%pivot%')
ORDER BY source_date DESC, id LIMIT 10""",
)
def strategic_unthreaded(t: Tables) -> DataFrame:
    k = t.knowledge()
    summary = F.element_at(F.array(*map(F.lit, _PHRASES)), (F.col("k") % 11 + 1).cast("int"))
    told = k.withColumn("summary", summary).withColumn("source", F.when(F.col("k") % 13 == 0, "briefing").otherwise(F.col("source")))
    return context.strategic_items(told, k.filter("entity_id % 3 = 0").select("id"), NOW).select("id", "summary")


@query(
    "T39",
    """
WITH c AS (SELECT id, state, project || ' for ' || owner AS text FROM commitments),
v AS (SELECT DISTINCT text, CASE WHEN text LIKE '1-URGENT%' THEN 'fulfilled' WHEN text LIKE '5-LOW%' THEN 'stale' WHEN text LIKE '2-HIGH%' THEN 'invalid' WHEN text LIKE '3-MEDIUM%' THEN 'blocked' ELSE 'active' END AS verdict FROM c),
f AS (SELECT text, min(id) AS id FROM c WHERE state IN ('detected', 'active', 'overdue') GROUP BY 1)
SELECT c.id, CASE WHEN f.id IS NULL OR verdict = 'active' THEN state ELSE CASE verdict WHEN 'fulfilled' THEN 'fulfilled' WHEN 'stale' THEN 'abandoned' WHEN 'invalid' THEN 'abandoned' ELSE verdict END END AS state
FROM c JOIN v USING (text) LEFT JOIN f ON f.id = c.id""",
)
def judged_commitments(t: Tables) -> DataFrame:
    own = t.commitments().withColumn("text", F.concat_ws(" for ", "project", "owner"))
    verdict = F.when(F.col("project") == "1-URGENT", "fulfilled").when(F.col("project") == "5-LOW", "stale").when(F.col("project") == "2-HIGH", "invalid").when(F.col("project") == "3-MEDIUM", "blocked").otherwise("active")
    return context.judged_states(own, own.select("text", verdict.alias("verdict")).distinct()).select("id", "state")


@query("Q23", f"SELECT id FROM knowledge WHERE source = 'view' AND entity_id NOT IN (SELECT entity_id FROM mentions WHERE direction = 'inbound' AND mention_date >= {_T} - INTERVAL 1 DAY) AND entity_id NOT IN (SELECT id FROM entities WHERE dismissed)")
def gated_actions(t: Tables) -> DataFrame:
    spoke = t.mentions().filter((F.col("direction") == "inbound") & since("mention_date", NOW, 1)).select("entity_id")
    gone = t.entities().filter("dismissed").select(F.col("id").alias("entity_id"))
    return context.quality_gate(t.knowledge().filter("source = 'view'"), spoke, gone).select("id")


_LABELS = ["Leaving in May", "client", "LEFT the firm", "former owner", "in a new role", "in transition", "moving to Rome", "partner", "old friend"]


@query(
    "Q15",
    f"""
WITH e AS (SELECT id AS entity_id, [{", ".join(f"'{x}'" for x in _LABELS)}][id % 9 + 1] AS user_label, {_T} - to_days((id % 10)::INTEGER) AS updated_at FROM entities),
g AS (SELECT * FROM e WHERE updated_at >= {_T} - INTERVAL 7 DAY AND (user_label ILIKE '%leaving%' OR user_label ILIKE '%left%' OR user_label ILIKE '%former%' OR user_label ILIKE '%new role%' OR user_label ILIKE '%transition%' OR user_label ILIKE '%moving to%'))
SELECT g.entity_id, user_label, count(DISTINCT k.id) AS items, string_agg(DISTINCT project, ',' ORDER BY project) AS projects
FROM g JOIN mentions m ON m.entity_id = g.entity_id JOIN knowledge k ON k.id = m.item_id WHERE k.source_date < updated_at AND importance NOT IN ('archived', 'noise') GROUP BY ALL""",
)
def departures(t: Tables) -> DataFrame:
    """Entities whose users' label tells that they have gone, and what still mentions them."""
    label = F.element_at(F.array(*map(F.lit, _LABELS)), (F.col("id") % 9 + 1).cast("int"))
    entities = t.entities().select("id", label.alias("user_label"), (at(NOW) - F.make_dt_interval((F.col("id") % 10).cast("int"))).alias("updated_at"))
    return context.leaving(entities, t.mentions(), t.knowledge(), NOW)


@query(
    "T33 C8 J5",
    f"""
WITH s AS (SELECT o_orderkey AS meeting_id FROM orders WHERE o_orderdate BETWEEN {_O} AND {_O} + INTERVAL 48 HOUR AND o_orderkey IN (SELECT l_orderkey FROM lineitem) ORDER BY o_orderdate, o_orderkey LIMIT 3),
w AS (SELECT DISTINCT meeting_id, l_suppkey AS entity_id FROM s JOIN lineitem ON l_orderkey = meeting_id),
i AS (SELECT l_suppkey AS entity_id, least(5, count(*)) AS n FROM (SELECT DISTINCT l_suppkey, l_orderkey FROM lineitem) GROUP BY 1),
o AS (SELECT l_suppkey AS entity_id, count(*) AS open FROM (SELECT DISTINCT l_suppkey, l_orderkey FROM lineitem) JOIN orders ON o_orderkey = l_orderkey WHERE o_orderstatus IN ('O', 'P') GROUP BY 1)
SELECT meeting_id, entity_id, coalesce(n, 0)::INTEGER AS items, coalesce(open, 0) AS open FROM w LEFT JOIN i USING (entity_id) LEFT JOIN o USING (entity_id)""",
)
def meeting_prep(t: Tables) -> DataFrame:
    m = t.members()
    when = t.read("orders").select(F.col("o_orderkey").alias("item_id"), F.col("o_orderdate").alias("start"))
    meetings = when.join(m, "item_id").groupBy(F.col("item_id").alias("id"), "start").agg(F.collect_set("entity_id").alias("attendees"))
    items = m.join(when, "item_id").select(F.col("item_id").alias("id"), "entity_id", F.col("start").alias("source_date"))
    owed = m.join(t.commitments().select(F.col("id").alias("item_id"), "state"), "item_id").select("entity_id", "state")
    return context.meeting_prep(meetings, items, owed, ORDERS_NOW)


@query("R30 C19 R14", f"""
WITH p AS (SELECT id FROM knowledge WHERE entity_id = 77 AND importance = 'critical'),
w AS (SELECT entity_id FROM mentions WHERE item_id IN (SELECT id FROM p) GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 5)
SELECT id FROM knowledge WHERE id IN (SELECT item_id FROM mentions WHERE entity_id IN (SELECT entity_id FROM w)) AND id NOT IN (SELECT id FROM p) ORDER BY source_date DESC, id LIMIT 10""")
def deep_context(t: Tables) -> DataFrame:
    primary = t.knowledge().filter("entity_id = 77 and importance = 'critical'").select("id")
    return context.deep_context(primary, t.mentions(), t.knowledge()).select("id")


@query("C21", "SELECT o_orderkey AS id, o_orderkey + 1 IN (SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT') AS over FROM orders")
def decision_log(t: Tables) -> DataFrame:
    own = t.read("orders").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderpriority") == "1-URGENT", F.col("o_orderkey") - 1).alias("supersedes"))
    return context.decision_log(own).select("id", (~F.col("active")).alias("over"))


@query("C22 W14", "SELECT o_orderkey AS id FROM orders WHERE o_orderstatus = 'P' ORDER BY CASE o_orderpriority WHEN '1-URGENT' THEN 0 WHEN '2-HIGH' THEN 1 WHEN '5-LOW' THEN 3 ELSE 2 END, o_orderdate DESC, o_orderkey LIMIT 50")
def question_queue(t: Tables) -> DataFrame:
    priority = F.when(F.col("o_orderpriority") == "1-URGENT", "urgent").when(F.col("o_orderpriority") == "2-HIGH", "high").when(F.col("o_orderpriority") == "5-LOW", "low").otherwise("normal")
    own = t.read("orders").filter("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("id"), priority.alias("priority"), F.col("o_orderdate").alias("created_at"))
    return context.question_queue(own).limit(50).select("id")


@query("T14 S23", f"SELECT count(*) FILTER (source_date > TIMESTAMP '2024-01-30 18:00:00') AS newer, count(*) FILTER (source_date > TIMESTAMP '2024-01-30 18:00:00') >= 10 AS stale FROM knowledge")
def world_staleness(t: Tables) -> DataFrame:
    return context.is_stale(t.knowledge(), "2024-01-30 18:00:00", NOW)


@query("S24 A5", "SELECT '- **' || name || '** ' || coalesce(label, 'none') || ', ' || mentions AS line FROM (SELECT entity_id, count(*) AS mentions FROM mentions GROUP BY 1) JOIN entities ON id = entity_id")
def world_markdown(t: Tables) -> DataFrame:
    n = t.mentions().groupBy("entity_id").agg(F.count("*").alias("mentions"))
    own = n.join(t.entities(), F.col("entity_id") == F.col("id"))
    return context.markdown(own, F.col("name"), F.coalesce("label", F.lit("none")), F.col("mentions").cast("string"))


@query("S25 S21", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)")
def missing_vectors(t: Tables) -> DataFrame:
    v = t.read("embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    return context.needs_vector(t.read("documents").select("doc_id").join(v, "doc_id", "left")).select("doc_id")


@query("S26 S27 S31", "SELECT id, md5(coalesce(CASE WHEN importance <> 'low' THEN raw_content END, CASE WHEN length(summary) > 10 THEN summary END, title)) AS print FROM texts")
def source_text(t: Tables) -> DataFrame:
    own = t.texts()
    bare = own.withColumn("raw_content", F.when(F.col("importance") != "low", F.col("raw_content")))
    full = context.backfill(bare, own.select("id", F.col("summary").alias("text")))
    got = context.source_text(full.withColumn("summary", F.col("title")))
    return got.select("id", F.md5(F.col("content").cast("binary")).alias("print"))


@query("T28 S29", "SELECT conv_id || '/' || turn AS id FROM (SELECT conv_id, turn, max(turn) FILTER (role = 'assistant') OVER (PARTITION BY conv_id) AS a FROM conversations) WHERE a IS NULL OR a <= turn")
def unanswered(t: Tables) -> DataFrame:
    items = t.read("conversations").select(F.concat_ws("/", "conv_id", "turn").alias("id"), F.col("conv_id").alias("thread"), F.col("turn").alias("at"), (F.col("role") == "assistant").alias("sent"), F.array(F.lit("awaiting_reply")).alias("tags"))
    return alerts.resolve_replies(items).filter(F.size("tags") > 0).select("id")


@query("A11", "SELECT id, line FROM (SELECT conv_id AS id, unnest(string_split(text, chr(10))) AS line FROM conversations) WHERE line <> ''")
def flattened_lines(t: Tables) -> DataFrame:
    """A row for each line."""
    return t.read("conversations").select(F.col("conv_id").alias("id"), F.explode(F.split("text", "\n")).alias("line")).filter("line <> ''")


@query("R25", "SELECT id FROM texts WHERE importance = 'high' AND project = 'fr' AND contains(lower(raw_content), 'tion') ORDER BY id LIMIT 30")
def filtered_search(t: Tables) -> DataFrame:
    from ..functions.text import like_any

    return rollups.select_where(t.texts(), importance="high", project="fr").filter(like_any(["raw_content"], "tion")).orderBy("id").limit(30).select("id")


@query("W15", "SELECT id FROM commitments WHERE state = 'active' ORDER BY due_date NULLS LAST, id LIMIT 40")
def next_due(t: Tables) -> DataFrame:
    return t.commitments().filter("state = 'active'").orderBy(F.asc_nulls_last("due_date"), "id").limit(40).select("id")


@query("C3 C4", f"SELECT project, source, count(*) AS n FROM knowledge WHERE source_date >= {_T} - INTERVAL 3 DAY AND importance IN ('critical', 'high') GROUP BY ALL")
def briefing_selection(t: Tables) -> DataFrame:
    own = rollups.select_where(t.knowledge(), importance=["critical", "high"]).filter(since("source_date", NOW, 3))
    return own.groupBy("project", "source").agg(F.count("*").alias("n"))
