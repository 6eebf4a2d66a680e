"""Queries of dossiers, topics, logs, search in texts and upkeep that return their rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..functions.time import ordinal, since
from ..operators import activity, alerts, context, graph, retrieval, rollups, themes
from ..session import dealt
from ..sources import files
from ..sources.fixtures import NOW, ORDERS_NOW, Tables
from . import activity as _activity  # registers predictor_anomalies
from .catalog import CATALOG, query

_T, _O = f"TIMESTAMP '{NOW}'", f"TIMESTAMP '{ORDERS_NOW}'"
_COS = "list_sum([x.embedding[i] * y.embedding[i] for i in range(1, 65)]) / (sqrt(list_sum([v * v for v in x.embedding])) * sqrt(list_sum([v * v for v in y.embedding])))"
_EDGES = "edges AS (SELECT a.entity_id AS a, b.entity_id AS b, count(*) AS n FROM members a JOIN members b ON a.item_id = b.item_id AND a.entity_id < b.entity_id GROUP BY 1, 2)"
_RANK = "CASE importance WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'normal' THEN 2 WHEN 'low' THEN 3 WHEN 'noise' THEN 4 ELSE 5 END"


# Entities and their graph ------------------------------------------------------

_PEOPLE = """p AS (SELECT o_orderkey AS id, o_orderdate AS day, CASE o_orderstatus WHEN 'F' THEN false WHEN 'O' THEN true END AS waiting, c_name AS who FROM orders JOIN customer ON o_custkey = c_custkey
UNION SELECT o_orderkey, o_orderdate, CASE o_orderstatus WHEN 'F' THEN false WHEN 'O' THEN true END, s_name FROM orders JOIN lineitem ON o_orderkey = l_orderkey JOIN supplier ON l_suppkey = s_suppkey)"""


def _contacts(t: Tables) -> DataFrame:
    """Orders as items, with their customer and suppliers as contacts."""
    o = t.read("orders")
    waiting = F.when(F.col("o_orderstatus") == "F", False).when(F.col("o_orderstatus") == "O", True)
    lines = t.read("lineitem")
    rows = o.count() + lines.count()
    one = o.join(t.read("customer").hint("shuffle_hash"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", F.col("c_name").alias("who"))
    two = dealt(lines.select("l_orderkey", "l_suppkey"), rows, "l_suppkey").join(t.read("supplier").hint("shuffle_hash"), F.col("l_suppkey") == F.col("s_suppkey"))
    two = two.select(F.col("l_orderkey").alias("o_orderkey"), F.concat(F.lit(" "), F.upper("s_name")).alias("who"))
    o = dealt(o, rows, "o_orderkey")
    who = dealt(one.unionByName(two), rows, "o_orderkey").groupBy("o_orderkey").agg(F.collect_set("who").alias("contacts"))
    return o.join(who, "o_orderkey").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("at"), waiting.alias("waiting"), "contacts")


@query("G5 A3", f"WITH {_PEOPLE} SELECT lower(who) AS name, min(day) AS first_seen, max(day) AS last_seen, count(DISTINCT id) AS mentions FROM p GROUP BY 1")
def graph_entities(t: Tables) -> DataFrame:
    return context.entity_rows(context.mention_rows(_contacts(t))).drop("entity_id")


@query("G6", f"WITH {_PEOPLE} SELECT lower(who) AS name, id AS item_id, CASE WHEN waiting THEN 'inbound' WHEN NOT waiting THEN 'outbound' END AS direction FROM p")
def mention_directions(t: Tables) -> DataFrame:
    return context.mention_rows(_contacts(t)).select(F.col("normal").alias("name"), "item_id", "direction")


@query(
    "G4 J5",
    """
WITH e AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 11 = 0 THEN 'mail' || c_custkey || '@x.example' ELSE c_name END AS name, CASE WHEN c_custkey % 3 = 0 THEN 'mail' || c_custkey || '@x.example' END AS email, c_custkey % 7 = 0 AS dismissed,
  c_custkey * 37 % 1000 AS seen FROM customer),
a AS (SELECT s_suppkey AS entity_id, 'nick ' || s_suppkey AS alias FROM supplier),
n AS (SELECT DISTINCT CASE o_custkey % 6 WHEN 0 THEN c_name WHEN 1 THEN 'MAIL' || o_custkey || '@x.example' WHEN 2 THEN upper(c_name) WHEN 3 THEN 'Nick ' || o_custkey % 300 WHEN 4 THEN substring(c_name, 1, 16) ELSE 'nobody' || o_custkey END AS name FROM orders JOIN customer ON c_custkey = o_custkey),
m AS (SELECT n.name, e.id, 1 AS tier, 0 AS late FROM n JOIN e ON n.name = e.name UNION ALL SELECT n.name, e.id, 2, 0 FROM n JOIN e ON lower(n.name) = lower(e.email) UNION ALL SELECT n.name, e.id, 3, 0 FROM n JOIN e ON lower(n.name) = lower(e.name)
  UNION ALL SELECT n.name, entity_id, 4, 0 FROM n JOIN a ON lower(n.name) = alias UNION ALL SELECT n.name, e.id, 5, -seen FROM n JOIN e ON starts_with(lower(e.name), lower(n.name)) WHERE NOT contains(n.name, '@') AND NOT contains(e.name, '@') AND NOT dismissed)
SELECT name, id AS entity_id, tier FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY tier, late, id) AS place FROM m) WHERE place = 1""",
)
def entity_resolution(t: Tables) -> DataFrame:
    """All five tiers: exact name, address, name in any case, alias, and prefix (the one
    seen last, neither dismissed nor an address)."""
    k = F.col("c_custkey")
    mail = F.concat(F.lit("mail"), k.cast("string"), F.lit("@x.example"))
    c = t.read("customer")
    shown = F.when(k % 11 == 0, mail).otherwise(F.col("c_name"))
    entities = c.select(k.alias("id"), shown.alias("name"), F.lower(shown).alias("normal"), F.when(k % 3 == 0, mail).alias("email"), (k % 7 == 0).alias("dismissed"), (k * 37 % 1000).alias("last_seen"))
    aliases = t.read("supplier").select(F.col("s_suppkey").alias("entity_id"), F.concat(F.lit("nick "), F.col("s_suppkey").cast("string")).alias("alias"))
    way = k % 6
    name = F.when(way == 0, F.col("c_name")).when(way == 1, F.upper(F.concat(F.lit("mail"), k.cast("string")))).when(way == 2, F.upper("c_name")).when(way == 3, F.concat(F.lit("Nick "), (k % 300).cast("string"))).when(way == 4, F.substring("c_name", 1, 16)).otherwise(F.concat(F.lit("nobody"), k.cast("string")))
    name = F.when(way == 1, F.concat(name, F.lit("@x.example"))).otherwise(name)
    names = t.read("orders").join(c, F.col("o_custkey") == k).select(name.alias("name")).distinct()
    names = names.select("name", F.lower("name").alias("normal"), F.when(F.col("name").contains("@"), F.col("name")).alias("email"))
    return graph.resolve(names, entities, aliases)


@query("G11", f"WITH {_EDGES} SELECT a, b, n FROM edges JOIN supplier x ON x.s_suppkey = a JOIN supplier y ON y.s_suppkey = b WHERE x.s_acctbal >= 0 AND y.s_acctbal >= 0")
def edges_after_dismissal(t: Tables) -> DataFrame:
    gone = t.read("supplier").filter("s_acctbal < 0").select(F.col("s_suppkey").alias("entity_id"))
    return context.dismiss(graph.cooccurrence_edges(t.meetings()), gone).select("a", "b", "n")


@query("G18", "SELECT id, min(id) OVER (PARTITION BY project) AS class_id, count(*) OVER (PARTITION BY project) - 1 AS links, 1.0::DOUBLE AS confidence FROM vectors WHERE project IS NOT NULL")
def part_of_pairs(t: Tables) -> DataFrame:
    """Items of one project, as its members with the number of their links."""
    return context.same_project(t.vectors()).withColumn("confidence", F.lit(1.0))


@query(
    "G24",
    """
WITH m AS (SELECT DISTINCT l_orderkey AS item_id, l_suppkey AS entity_id FROM lineitem), d AS (SELECT item_id FROM m WHERE entity_id = 7),
v AS (SELECT b.item_id, min(b.entity_id) AS via FROM m a JOIN d USING (item_id) JOIN m b ON a.entity_id = b.entity_id WHERE a.entity_id <> 7 AND b.item_id NOT IN (SELECT item_id FROM d) GROUP BY 1),
i AS (SELECT item_id, NULL AS via FROM d UNION ALL SELECT item_id, via FROM v)
SELECT 'direct' AS kind, item_id::VARCHAR AS name, NULL::BIGINT AS via, 1::BIGINT AS n FROM d UNION ALL SELECT 'hop', item_id::VARCHAR, via, 1 FROM v
UNION ALL SELECT 'project', o_orderpriority, NULL, count(*) FROM i JOIN orders ON o_orderkey = item_id GROUP BY 2 UNION ALL SELECT 'relation', s_nationkey::VARCHAR, NULL, count(*) FROM m JOIN d USING (item_id) JOIN supplier ON s_suppkey = entity_id WHERE entity_id <> 7 GROUP BY 2""",
)
def contact_graph(t: Tables) -> DataFrame:
    items = t.read("orders").select(F.col("o_orderkey").alias("item_id"), F.col("o_orderpriority").alias("project"))
    relations = t.read("supplier").select(F.col("s_suppkey").alias("entity_id"), F.col("s_nationkey").cast("string").alias("relation"))
    return graph.contact_graph(t.members(), 7, items, relations)


@query(
    "G30 A15",
    """WITH RECURSIVE e AS (SELECT DISTINCT x.id AS a, y.id AS b FROM vectors x JOIN vectors y ON x.project = y.project AND x.id < y.id AND round(""" + _COS + """, 6) > .3),
s AS (SELECT a, b FROM e UNION SELECT b, a FROM e), r(node, root) AS (SELECT id, id FROM vectors UNION SELECT s.b, r.root FROM r JOIN s ON s.a = r.node),
c AS (SELECT node, min(root) AS id FROM r GROUP BY 1)
SELECT id, array_to_string(list_sort(list_distinct(flatten(list([node * 10, node % 40])))), ',') AS items FROM c GROUP BY 1""",
)
def merged_facts(t: Tables) -> DataFrame:
    """Facts joined over pairs above a cosine, with the union of their items."""
    v = t.vectors()
    facts = v.select("id", F.array(F.col("id") * 10, F.col("id") % 40).alias("items"))
    return themes.merged_facts(facts, graph.related(v, 0.3)).select("id", F.array_join("items", ",").alias("items"))


@query("G31 G29")
def theme_members(t: Tables) -> DataFrame:
    """Seeded k-means has no SQL; a test compares it with the rule done by hand."""
    return themes.themes(_facts(t))


def _facts(t: Tables) -> DataFrame:
    """Vectors of many small projects, some of none, some without a vector."""
    v = t.vectors()
    k = F.col("id")
    project = F.when(k % 5 == 0, None).when(k % 5 == 1, F.concat(F.lit("p"), (k % 101).cast("string"))).otherwise(F.concat(F.lit("q"), F.col("project").cast("string")))
    return v.select("id", project.alias("project"), F.when(k % 13 != 0, F.col("embedding")).alias("embedding"))


@query("A15", "SELECT project, i, round(avg(x), 6) AS x FROM (SELECT project, unnest(embedding) AS x, unnest(range(64)) AS i FROM vectors) GROUP BY ALL")
def theme_centroids(t: Tables) -> DataFrame:
    return graph.centroids(t.vectors()).select("project", F.posexplode("centroid").alias("i", "x")).select("project", F.col("i").cast("long").alias("i"), F.round("x", 6).alias("x"))


@query("P23", f"SELECT entity_id, greatest(coalesce(max(mention_date) FILTER (role = 'purchase'), TIMESTAMP '2024-01-15'), TIMESTAMP '2024-01-15') AS last_seen FROM mentions GROUP BY 1")
def last_seen(t: Tables) -> DataFrame:
    m = t.mentions().groupBy("entity_id").agg(F.max(F.when(F.col("role") == "purchase", F.col("mention_date"))).alias("last_seen"))
    return context.moved_on(m, "last_seen", F.lit("2024-01-15 00:00:00").cast("timestamp_ntz"))


@query("A9", "SELECT id, name, label, count(*) AS mentions, max(mention_date) AS last FROM entities JOIN mentions ON entity_id = id GROUP BY id, name, label")
def entities_with_counts(t: Tables) -> DataFrame:
    own = t.mentions().join(t.entities(), F.col("entity_id") == F.col("id"))
    return rollups.with_bare_columns(own, ["id"], ["name", "label"], F.count("*").alias("mentions"), F.max("mention_date").alias("last"))


# Commitments --------------------------------------------------------------------

@query(
    "P4",
    """WITH e AS (SELECT min(p_partkey) AS id, p_name AS name FROM part GROUP BY p_name UNION ALL SELECT -1 - min(p_partkey), split_part(p_name, ' ', 2) FROM part GROUP BY 2),
c AS (SELECT DISTINCT p_partkey AS id, lower('Order of ' || p_name || ' and ' || p_type) AS owner FROM part)
SELECT c.id, e.id AS entity_id FROM c JOIN e ON contains(' ' || owner, ' ' || lower(name))""",
)
def owned_commitments(t: Tables) -> DataFrame:
    p = t.read("part")
    one = p.groupBy("p_name").agg(F.min("p_partkey").alias("id")).select("id", F.col("p_name").alias("name"))
    two = p.groupBy(F.split("p_name", " ")[1].alias("name")).agg(F.min("p_partkey").alias("id")).select((-1 - F.col("id")).alias("id"), "name")
    owner = F.concat(F.lit("Order of "), "p_name", F.lit(" and "), "p_type")
    return context.owned_by(p.select(F.col("p_partkey").alias("id"), owner.alias("owner")), one.unionByName(two))


@query(
    "J11 T27 Q14",
    r"""
WITH c AS (SELECT doc_id AS id, 'Will ' || regexp_replace(split_part(text, chr(10), 1), '[.]', ', ', 'g') || ' about that' AS text, TIMESTAMP '2024-01-01 00:00:00' + to_days((doc_id % 40)::INTEGER) AS due_date, CASE WHEN doc_id % 10 = 4 THEN 'dropped' ELSE 'overdue' END AS state FROM documents WHERE doc_id % 2 = 0),
o AS (SELECT * FROM c WHERE state IN ('active', 'overdue', 'detected') ORDER BY due_date NULLS FIRST, id LIMIT 30),
w AS (SELECT id, due_date, list_filter(string_split_regex(trim(regexp_replace(regexp_replace(text, '(?i)\b(committed to|will|should|needs to|promised|agreed|going to|plan to)\b', '', 'g'), '[^0-9A-Za-z_\s]', '', 'g')), '\s+'),
  lambda x: length(x) > 3 AND lower(x) NOT IN ('that', 'this', 'with', 'from', 'they', 'have', 'been', 'would', 'could', 'about', 'their', 'some', 'also'))[1:5] AS ws FROM o),
k AS (SELECT id, due_date, unnest(ws) AS word, unnest(range(len(ws))) AS place FROM w),
i AS (SELECT doc_id AS item_id, split_part(text, chr(10), 1) AS title, substring(text, 1, 200) || CASE WHEN doc_id % 3 = 0 THEN ' Was Signed.' ELSE '' END AS summary, CASE source WHEN 'src1' THEN 'gmail-sent' ELSE source END AS source, TIMESTAMP '2024-01-01 00:00:00' + to_days((doc_id % 40)::INTEGER) AS source_date FROM documents WHERE doc_id % 2 = 1),
m AS (SELECT id, place, item_id, lower(title) || chr(10) || lower(summary) AS said, source, row_number() OVER (PARTITION BY id, place ORDER BY source_date DESC, item_id) AS rank
  FROM k JOIN i ON source_date > due_date AND contains(lower(title) || chr(10) || lower(summary), lower(word))),
d AS (SELECT * FROM m WHERE rank <= 5 AND (source = 'gmail-sent' OR contains(said, 'sent') OR contains(said, 'completed') OR contains(said, 'done') OR contains(said, 'delivered') OR contains(said, 'submitted')
  OR contains(said, 'signed') OR contains(said, 'approved') OR contains(said, 'finalized') OR contains(said, 'confirmed') OR contains(said, 'scheduled')))
SELECT id, arg_min(item_id, place * 10 + rank) AS evidence_id FROM d GROUP BY 1""",
)
def fulfilled(t: Tables) -> DataFrame:
    """Promises that a later item tells of, by their keywords in turn."""
    d = t.read("documents")
    on = (F.lit("2024-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval((F.col("doc_id") % 40).cast("int"))).alias("source_date")
    first = F.substring_index("text", "\n", 1)
    text = F.concat(F.lit("Will "), F.regexp_replace(first, "[.]", ", "), F.lit(" about that")).alias("text")
    state = F.when(F.col("doc_id") % 10 == 4, "dropped").otherwise("overdue").alias("state")
    owed = d.filter("doc_id % 2 = 0").select(F.col("doc_id").alias("id"), text, on.alias("due_date"), F.lit(None).cast("timestamp_ntz").alias("detected_at"), state)
    summary = F.concat(F.substring("text", 1, 200), F.when(F.col("doc_id") % 3 == 0, " Was Signed.").otherwise("")).alias("summary")
    items = d.filter("doc_id % 2 = 1").select(F.col("doc_id").alias("item_id"), first.alias("title"), summary, F.when(F.col("source") == "src1", "gmail-sent").otherwise(F.col("source")).alias("source"), on)
    return alerts.fulfilment_evidence(owed, items)


@query(
    "C20 W14",
    f"""SELECT id, owner, state FROM commitments WHERE {" OR ".join(f"contains(lower({c}), '{p}')" for p in ("urgent", "00012", "low") for c in ("owner", "project", "state"))}
ORDER BY CASE state WHEN 'overdue' THEN 0 WHEN 'active' THEN 1 WHEN 'detected' THEN 2 ELSE 3 END, due_date, id LIMIT 10""",
)
def topic_commitments(t: Tables) -> DataFrame:
    return context.topic_commitments(t.commitments(), ["urgent", "00012", "LOW"], ["owner", "project", "state"]).select("id", "owner", "state")


# Logs and selections --------------------------------------------------------------

@query("C23", "SELECT event_id AS id FROM events WHERE event_type = 'error' ORDER BY ts DESC, event_id LIMIT 50")
def correction_log(t: Tables) -> DataFrame:
    rows = t.read("events").filter("event_type = 'error'").select(F.col("event_id").alias("id"), F.col("ts").alias("at"))
    return context.newest(rows, 50).select("id")


@query("C24", f"SELECT id FROM knowledge WHERE (source IN ('agent-notification', 'task') OR k % 4 = 1) AND k % 5 = 2 ORDER BY source_date DESC, id LIMIT 20")
def agent_feed(t: Tables) -> DataFrame:
    tags = F.array_compact(F.array(F.when(F.col("k") % 4 == 1, "agent-report"), F.concat(F.lit("agent:"), (F.col("k") % 5).cast("string"))))
    return context.agent_feed(t.knowledge().withColumn("tags", tags), agent="2").select("id")


@query(
    "C28",
    f"""SELECT 'profile' AS kind, id::VARCHAR AS id, n AS weight FROM entities JOIN (SELECT entity_id, count(*) AS n FROM mentions GROUP BY 1) ON entity_id = id WHERE label = 'partner' AND NOT dismissed
UNION ALL (SELECT 'acted', id::VARCHAR, NULL FROM knowledge WHERE source = 'purchase' AND source_date >= {_T} - INTERVAL 2 DAY ORDER BY source_date DESC, id LIMIT 10)
UNION ALL SELECT 'today', o_orderkey::VARCHAR, NULL FROM orders WHERE o_orderdate::DATE = {_O}::DATE""",
)
def narrative_inputs(t: Tables) -> DataFrame:
    n = t.mentions().groupBy("entity_id").agg(F.count("*").alias("weight"))
    profiles = t.entities().filter("label = 'partner' and not dismissed").join(n, F.col("entity_id") == F.col("id")).select("id", "weight")
    acted = t.knowledge().filter("source = 'purchase'").select("id", F.col("source_date").alias("at"))
    today = t.read("orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("at"))
    return context.narrative_inputs(profiles, acted, today, NOW, ORDERS_NOW)


@query("C29", f"SELECT o_orderkey AS id FROM orders WHERE o_orderkey % 4 <> 0 AND (o_orderstatus <> 'F' OR o_orderdate > {_O}) AND o_orderpriority IN ('1-URGENT', '5-LOW')")
def active_lessons(t: Tables) -> DataFrame:
    k = F.col("o_orderkey")
    domain = F.when(F.col("o_orderpriority") == "5-LOW", "general").otherwise(F.lower("o_orderpriority"))
    own = t.read("orders").select(k.alias("id"), F.when(k % 4 == 0, k + 1).alias("superseded_by"), F.when(F.col("o_orderstatus") == "F", F.col("o_orderdate")).alias("expires_at"), domain.alias("domain"))
    return context.active_lessons(own, ORDERS_NOW, "1-urgent").select("id")


_LATER = "2024-03-05 00:00:00"


@query("T4", "WITH p AS (" + CATALOG["predictor_anomalies"].sql.replace(NOW, _LATER) + ") SELECT entity_id, anomaly, severity FROM p WHERE anomaly IS NOT NULL")
def anomaly_list(t: Tables) -> DataFrame:
    return activity.anomalies(activity.communication_baseline(t.mentions(), _LATER)).select("entity_id", "anomaly", "severity")


@query("Q4", "SELECT DISTINCT CASE WHEN c_custkey % 3 = 0 THEN 'spam' || c_custkey % 50 || '@x.example' ELSE lower(c_name) END AS sender, CASE WHEN c_custkey % 3 = 0 AND c_custkey % 50 < 10 THEN 'fixed' ELSE 'found' END AS origin FROM customer UNION SELECT 'spam' || range || '@x.example', 'fixed' FROM range(10)")
def blocklist(t: Tables) -> DataFrame:
    """Senders found, added to those known; what is known stays as it is."""
    k = F.col("c_custkey")
    found = t.read("customer").select(F.when(k % 3 == 0, F.concat(F.lit("Spam"), (k % 50).cast("string"), F.lit("@x.example"))).otherwise(F.col("c_name")).alias("sender")).select(F.lower("sender").alias("sender"), F.lit("found").alias("origin"))
    known = found.sparkSession.range(10).select(F.concat(F.lit("spam"), F.col("id").cast("string"), F.lit("@x.example")).alias("sender"), F.lit("fixed").alias("origin"))
    return rollups.insert_ignore(known, found, ["sender"])


@query("Q7", "SELECT conv_id AS id, string_agg(role, ',' ORDER BY turn) AS names, count(*) FILTER (role = 'user') AS users FROM conversations GROUP BY 1")
def converted_schema(t: Tables) -> DataFrame:
    """Arrays of named structs to arrays of names, and back."""
    rows = t.read("conversations").groupBy(F.col("conv_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct("turn", F.col("role").alias("name")))).alias("contacts"))
    names = files.names_only(rows, "contacts")
    back = files.names_as_structs(names, "contacts", role="unknown")
    return back.select("id", F.array_join(F.transform("contacts", lambda c: c["name"]), ",").alias("names"), F.size(F.filter("contacts", lambda c: (c["name"] == "user") & (c["role"] == "unknown"))).cast("long").alias("users"))


@query(
    "Q20",
    """WITH c AS (SELECT CASE event_type WHEN 'error' THEN 'label' WHEN 'signup' THEN 'role' WHEN 'purchase' THEN 'fact' END AS kind, user_id, event_id, ts, 'v' || event_id % 9 AS value FROM events),
l AS (SELECT user_id, arg_max(value, ts) AS v FROM c WHERE kind = 'label' GROUP BY 1), r AS (SELECT user_id, event_id, arg_max(value, ts) AS v FROM c WHERE kind = 'role' GROUP BY 1, 2)
SELECT 'label' AS kind, id, NULL::BIGINT AS item_id, coalesce(v, label) AS value FROM entities LEFT JOIN l ON user_id = id UNION ALL SELECT 'role', entity_id, item_id, coalesce(v, role) FROM mentions LEFT JOIN r ON user_id = entity_id AND event_id = item_id
UNION ALL SELECT 'fact', user_id, NULL, value FROM c WHERE kind = 'fact'""",
)
def propagated_corrections(t: Tables) -> DataFrame:
    kind = F.when(F.col("event_type") == "error", "label").when(F.col("event_type") == "signup", "role").when(F.col("event_type") == "purchase", "fact")
    value = F.concat(F.lit("v"), (F.col("event_id") % 9).cast("string"))
    said = t.read("events").select(kind.alias("kind"), F.col("user_id").alias("entity_id"), F.col("event_id").alias("item_id"), value.alias("value"), value.alias("text"), F.col("ts").alias("at"))
    labels, roles, facts = context.propagate_corrections(t.entities(), t.mentions(), said)
    out = labels.select(F.lit("label").alias("kind"), "id", F.lit(None).cast("long").alias("item_id"), F.col("label").alias("value"))
    out = out.unionByName(roles.select(F.lit("role").alias("kind"), F.col("entity_id").alias("id"), "item_id", F.col("role").alias("value")))
    return out.unionByName(facts.select(F.lit("fact").alias("kind"), F.col("entity_id").alias("id"), F.lit(None).cast("long").alias("item_id"), F.col("text").alias("value")))


@query("Q29", "SELECT id FROM knowledge WHERE k % 3 <> 2 ORDER BY source_date DESC, id LIMIT 100")
def reextraction_backlog(t: Tables) -> DataFrame:
    version = F.when(F.col("k") % 3 == 1, 1).when(F.col("k") % 3 == 2, 2)
    return context.reextraction_backlog(t.knowledge().withColumn("extraction_version", version), 100).select("id")


@query("S19 J16", "SELECT user_id, event_type, CASE WHEN event_type = 'view' THEN 'old' ELSE 'new' END AS origin FROM (SELECT DISTINCT user_id, event_type FROM events)")
def insert_ignore(t: Tables) -> DataFrame:
    own = t.read("events").select("user_id", "event_type")
    old = own.filter("event_type = 'view'").distinct().withColumn("origin", F.lit("old"))
    return rollups.insert_ignore(old, own.withColumn("origin", F.lit("new")), ["user_id", "event_type"])


# Search in texts ------------------------------------------------------------------

@query(
    "R27",
    """WITH h AS (SELECT id, raw_content AS t, string_split(lower(raw_content), 'thing') AS parts FROM texts WHERE contains(lower(raw_content), 'thing')),
p AS (SELECT id, t, parts, unnest(range(1, least(5, len(parts) - 1) + 1)) AS k FROM h),
a AS (SELECT id, t, k, list_sum(list_transform(parts[1:k], lambda x: length(x)))::BIGINT + 5 * (k - 1) AS b FROM p)
SELECT id, k AS place, md5(substring(t, greatest(0, b - 250) + 1, least(length(t), b + 255) - greatest(0, b - 250))) AS passage FROM a""",
)
def passage_windows(t: Tables) -> DataFrame:
    found = t.texts().select("id", F.posexplode(retrieval.passages(F.col("raw_content"), "thing")).alias("place", "passage"))
    return found.select("id", (F.col("place") + 1).cast("long").alias("place"), F.md5(F.col("passage").cast("binary")).alias("passage"))


@query(
    "R27 P19",
    """SELECT id, md5(CASE WHEN length(raw_content) <= 1500 THEN raw_content ELSE substring(raw_content, 1, 800) || '...[' || (length(raw_content) - 1600) || ' chars omitted]...' || substring(raw_content, length(raw_content) - 799, 800) END) AS summary,
  md5(substring(raw_content, 1001, 500)) AS page FROM texts""",
)
def text_summary_and_page(t: Tables) -> DataFrame:
    raw = F.col("raw_content")
    return t.texts().select("id", F.md5(retrieval.head_and_tail(raw).cast("binary")).alias("summary"), F.md5(retrieval.page(raw, 1000, 500).cast("binary")).alias("page"))


@query("R28", "SELECT identifier, version, id FROM (SELECT doc_id % 60 AS identifier, doc_id AS id, text, row_number() OVER (PARTITION BY doc_id % 60 ORDER BY doc_id) AS version, count(*) OVER (PARTITION BY doc_id % 60) AS n FROM documents) WHERE version = n AND contains(lower(text), 'en') ORDER BY id")
def artifact_search(t: Tables) -> DataFrame:
    own = t.read("documents").select((F.col("doc_id") % 60).alias("identifier"), F.col("doc_id").alias("id"), F.substring_index("text", "\n", 1).alias("title"), F.col("text").alias("content"))
    return retrieval.artifact_search(rollups.versions(own, "identifier", "id"), "EN").select("identifier", "version", "id")


@query(
    "R17",
    f"""
WITH c AS (SELECT project, i, avg(x) AS x FROM (SELECT project, unnest(embedding) AS x, unnest(range(1, 65)) AS i FROM vectors) GROUP BY ALL),
themes AS (SELECT project AS id, list(x ORDER BY i) AS embedding FROM c GROUP BY 1),
best AS (SELECT x.id FROM themes x, vectors y WHERE y.id = 3 ORDER BY {_COS} DESC, x.id LIMIT 3),
sem AS (SELECT x.id, x.id // 5 AS episode, {_COS} AS score FROM vectors x, vectors y WHERE y.id = 3 AND x.project IN (SELECT id FROM best)),
top AS (SELECT id FROM sem ORDER BY score DESC, id LIMIT 15),
items AS (SELECT id * 2 AS id FROM top UNION SELECT id + 7 FROM top UNION SELECT v.id * 2 FROM vectors v WHERE v.id // 5 IN (SELECT episode FROM sem) AND (SELECT avg(score) FROM sem) < .5)
SELECT items.id, round(coalesce({_COS}, .5), 6) AS score FROM items LEFT JOIN vectors x ON x.id = items.id JOIN vectors y ON y.id = 3 ORDER BY coalesce({_COS}, .5) DESC, items.id LIMIT 20""",
)
def hierarchical_search(t: Tables) -> DataFrame:
    """Themes, their facts, and the items of these and of their episodes."""
    v = t.vectors()
    one = v.filter("id = 3")
    topics = graph.centroids(v).select(F.col("project").alias("id"), F.col("centroid").alias("embedding"))
    facts = v.select("id", F.col("project").alias("theme_id"), "embedding", F.array(F.col("id") * 2, F.col("id") + 7).alias("items"), F.array(F.floor(F.col("id") / 5)).alias("episodes"))
    episodes = v.groupBy(F.floor(F.col("id") / 5).alias("id")).agg(F.collect_list(F.col("id") * 2).alias("items"))
    found = context.hierarchical(topics, facts, episodes, v, one)
    return retrieval.top(found, 20).select("id", F.round("score", 6).alias("score"))


@query(
    "C1",
    f"""
WITH n AS (SELECT x.id, row_number() OVER (ORDER BY {_COS} DESC, x.id) AS place FROM vectors x, vectors y WHERE y.id = 0 AND {_COS} >= .25),
w AS (SELECT id, row_number() OVER (ORDER BY {_RANK}, day DESC, id) AS place FROM texts WHERE contains(lower(title), 'en') OR contains(lower(summary), 'en') OR contains(lower(raw_content), 'en'))
SELECT id, 'vector' AS part, place FROM n WHERE place <= 20 UNION ALL SELECT id, 'text', place FROM w WHERE place <= 15 AND id NOT IN (SELECT id FROM n WHERE place <= 20)""",
)
def dossier(t: Tables) -> DataFrame:
    v = t.vectors()
    return context.dossier(retrieval.nearest(v, v.filter("id = 0"), 20, 0.25), _text_hits(t, "en", 15))


def _text_hits(t: Tables, needle: str, k: int) -> DataFrame:
    from ..schema import IMPORTANCE_ORDER

    hits = t.texts().filter(text.like_any(["title", "summary", "raw_content"], needle))
    return rollups.top_per_group(hits.withColumn("page", F.lit(1)), "page", [ordinal("importance", IMPORTANCE_ORDER), F.desc("day"), F.col("id")], k).withColumnRenamed("rank", "place")


@query(
    "C2 C19",
    f"""
WITH w AS (SELECT id FROM (SELECT id, row_number() OVER (ORDER BY {_RANK}, day DESC, id) AS place FROM texts WHERE contains(lower(title), 'de') OR contains(lower(summary), 'de') OR contains(lower(raw_content), 'de')) WHERE place <= 50),
i AS (SELECT * FROM texts WHERE contains(lower(project), 'de') OR id IN (SELECT id FROM w))
SELECT 'person' AS kind, who AS name, count(*) AS n FROM (SELECT 'c' || id % 7 AS who FROM i UNION ALL SELECT 'd' || id % 5 FROM i) GROUP BY 2 UNION ALL SELECT 'source', source, count(*) FROM i GROUP BY 2
UNION ALL SELECT 'decision', d, count(*) FROM (SELECT unnest(list_filter(string_split(substring(raw_content, 1, 120), chr(10)), lambda x: x <> '')) AS d FROM i) GROUP BY 2 UNION ALL SELECT 'item', CASE WHEN contains(lower(project), 'de') THEN 'project' ELSE 'text' END, count(*) FROM i GROUP BY 2""",
)
def project_brief(t: Tables) -> DataFrame:
    """A project's own items and what the text search finds, with the people, sources
    and decisions in them."""
    k = F.col("id").cast("long")
    people = F.array(F.concat(F.lit("c"), (k % 7).cast("string")), F.concat(F.lit("d"), (k % 5).cast("string")))
    with_lists = lambda rows: rows.withColumn("contacts", people).withColumn("decisions", F.filter(F.split(F.substring("raw_content", 1, 120), "\n"), lambda x: x != ""))
    return context.project_brief(with_lists(t.texts().filter(F.lower("project").contains("de"))), with_lists(_text_hits(t, "de", 50)))


# Chat -----------------------------------------------------------------------------

_SAID = "Is Supplier#000000003 late, and what of Supplier#000000012 and 1-URGENT?"
_TOPICS = f"""longest AS (SELECT s_suppkey AS id, s_name AS name, row_number() OVER (ORDER BY length(s_name) DESC, s_suppkey) AS r FROM supplier),
ent AS (SELECT id, name, row_number() OVER (ORDER BY length(name) DESC, id) AS place FROM longest WHERE r <= 200 AND contains(lower('{_SAID}'), lower(name))),
pro AS (SELECT project AS name, row_number() OVER (ORDER BY project) AS place FROM (SELECT DISTINCT o_orderpriority AS project FROM orders WHERE o_orderstatus = 'O') WHERE contains(lower('{_SAID}'), lower(project)))"""


def _threads(t: Tables) -> DataFrame:
    return t.read("orders").select(F.col("o_orderkey").cast("string").alias("title"), F.col("o_orderpriority").alias("project"), F.when(F.col("o_orderstatus") == "O", "active").otherwise("closed").alias("status"), F.col("o_orderdate").alias("latest"))


def _people(t: Tables) -> DataFrame:
    return t.read("supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.lit(False).alias("dismissed"))


@query("C17", f"WITH {_TOPICS} SELECT 'entity' AS kind, name, id, place FROM ent WHERE place <= 5 UNION ALL SELECT 'project', name, NULL, place FROM pro")
def topics(t: Tables) -> DataFrame:
    return context.topics(_people(t), _threads(t), _SAID)


@query(
    "C17",
    f"""WITH {_EDGES}, {_TOPICS}, s AS (SELECT a, b, n FROM edges UNION ALL SELECT b, a, n FROM edges)
(SELECT 1 AS place, 'What about ' || s_name || '?' AS question FROM s JOIN supplier ON s_suppkey = b WHERE a = (SELECT id FROM ent WHERE place = 1) ORDER BY n DESC, b LIMIT 1)
UNION ALL (SELECT 2, 'How does this affect ' || o_orderpriority || '?' FROM orders WHERE o_orderstatus = 'O' AND o_orderpriority <> (SELECT name FROM pro WHERE place = 1) GROUP BY o_orderpriority ORDER BY max(o_orderdate) DESC, o_orderpriority LIMIT 1)
UNION ALL (SELECT 3, 'What should I do about ' || o_orderkey || '?' FROM orders WHERE o_orderstatus = 'O' AND o_orderdate < {_O} - INTERVAL 7 DAY ORDER BY o_orderdate, o_orderkey::VARCHAR LIMIT 1)""",
)
def follow_up_questions(t: Tables) -> DataFrame:
    edges = graph.cooccurrence_edges(t.meetings())
    return context.follow_up_questions(context.topics(_people(t), _threads(t), _SAID), _people(t), edges, _threads(t), ORDERS_NOW)


@query(
    "C15",
    f"""WITH {_TOPICS}
SELECT 'prediction' AS part, id::VARCHAR AS ref, row_number() OVER (ORDER BY due_date, id) AS place FROM commitments WHERE state = 'detected' AND due_date <= {_O}
UNION ALL SELECT 'person', name, place FROM ent WHERE place <= 5
UNION ALL SELECT 'message', ref, place FROM (SELECT conv_id || '/' || turn AS ref, row_number() OVER (ORDER BY turn DESC) AS place FROM conversations WHERE conv_id = 8) WHERE place <= 20
UNION ALL SELECT 'search', id::VARCHAR, place FROM (SELECT id, row_number() OVER (ORDER BY {_RANK}, day DESC, id) AS place FROM texts WHERE contains(lower(title), 'en') OR contains(lower(summary), 'en') OR contains(lower(raw_content), 'en')) WHERE place <= 8
UNION ALL SELECT 'action', event_id::VARCHAR, row_number() OVER (ORDER BY ts, event_id) FROM events WHERE event_type = 'signup'""",
)
def chat_context(t: Tables) -> DataFrame:
    """What a chat turn is given: what is due, who is named, what was said and found."""
    due = t.commitments().filter("state = 'detected'").select("id", F.col("due_date").alias("check_by"))
    messages = t.messages().filter("session_id = 8").select(F.concat_ws("/", "session_id", "position").alias("ref"), F.col("position").alias("at"))
    actions = t.read("events").filter("event_type = 'signup'").select(F.col("event_id").alias("id"), F.col("ts").alias("at"))
    named = context.topics(_people(t), _threads(t), _SAID).filter("kind = 'entity'")
    return context.chat_context(due, named, messages, _text_hits(t, "en", 8), actions, ORDERS_NOW)


@query("C15 C18", f"SELECT conv_id, turn, CASE {{intent}} ELSE 'question' END AS intent FROM (SELECT conv_id, turn, trim(lower(CASE turn % 5 WHEN 0 THEN 'find ' WHEN 1 THEN 'draft an email ' WHEN 2 THEN 'why is ' WHEN 3 THEN 'actually ' ELSE '' END || text)) AS m FROM conversations WHERE role = 'user')".replace("{intent}", " ".join(f"WHEN regexp_matches(m, '{p.replace(chr(39), chr(39) * 2)}') THEN '{v}'" for v, p in text.INTENTS) + f" WHEN regexp_matches(m, '{text.TROUBLE}') AND length(m) > 30 THEN 'investigation'"))
def intent_classify(t: Tables) -> DataFrame:
    k = F.col("turn") % 5
    said = F.when(k == 0, "Find ").when(k == 1, "Draft an email ").when(k == 2, "Why is ").when(k == 3, "Actually ").otherwise("")
    return t.read("conversations").filter("role = 'user'").select("conv_id", "turn", text.intent(F.concat(said, F.col("text"))).alias("intent"))


# Texts ----------------------------------------------------------------------------

@query("S7", "SELECT doc_id AS id, k AS place, md5(substring(text, 1 + 3500 * k, 4000)) AS chunk FROM (SELECT doc_id, text, unnest(range(len(range(1, greatest(1, length(text) - 500)::BIGINT + 1, 3500)))) AS k FROM documents)")
def text_chunks(t: Tables) -> DataFrame:
    own = t.read("documents").select(F.col("doc_id").alias("id"), F.posexplode(text.chunks(F.col("text"))).alias("place", "chunk"))
    return own.select("id", F.col("place").cast("long").alias("place"), F.md5(F.col("chunk").cast("binary")).alias("chunk"))


@query(
    "2.11",
    """WITH m AS (SELECT string_agg(lower(text), ' ' ORDER BY turn) AS m FROM conversations WHERE conv_id = 8),
d AS (SELECT doc_id AS id, len(list_filter(list_distinct(list_filter(string_split(regexp_replace(lower(split_part(text, chr(10), 1)), '[^a-z0-9 ]', '', 'g'), ' '), lambda w: length(w) > 3)), lambda w: contains(m, w))) AS hits FROM documents, m)
SELECT id, CASE WHEN hits >= 3 THEN 1.0::DOUBLE ELSE .7::DOUBLE END AS relevance FROM d WHERE hits >= 2""",
)
def text_links(t: Tables) -> DataFrame:
    """Texts whose title words a conversation holds (text linking of the scalar functions)."""
    said = t.messages().filter("session_id = 8").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "text"))), lambda x: x["text"]), " ").alias("message"))
    return retrieval.title_links(t.read("documents").select(F.col("doc_id").alias("id"), F.substring_index("text", "\n", 1).alias("title")), said)


@query("P12 S4", "SELECT event_id AS id, CASE WHEN event_type = 'error' THEN 'true' END AS noise, json_extract_string(props, '$.k') AS k FROM events")
def json_set(t: Tables) -> DataFrame:
    """A field set within JSON text where a row is noise, the others kept."""
    e = t.read("events")
    own = e.withColumn("props", F.when(F.col("event_type") == "error", text.set_field(F.col("props"), "noise", "true")).otherwise(F.col("props")))
    return own.select(F.col("event_id").alias("id"), F.get_json_object("props", "$.noise").alias("noise"), F.get_json_object("props", "$.k").alias("k"))


_TAGGED = "doc_id AS id, text || CASE doc_id % 8 WHEN 0 THEN ' a Term  Sheet and an LOI' WHEN 1 THEN ' letter of intent; the loi' WHEN 2 THEN ' GP & LP, cash flow, ROI' WHEN 3 THEN ' roi of Series B equity' ELSE '' END AS x FROM documents"


@query("2.11", "SELECT id, array_to_string(list_distinct(list_filter([" + ", ".join(f"CASE WHEN regexp_matches(x, '{p}') THEN {i}::INTEGER END" for i, (p, tag) in enumerate(text.DOMAIN_TERMS)) + f"], lambda v: v IS NOT NULL)).list_transform(lambda v: ([{', '.join(repr(tag) for _, tag in text.DOMAIN_TERMS)}])[v + 1]).list_distinct().list_sort(), ',') AS tags FROM (SELECT {_TAGGED})")
def domain_tags(t: Tables) -> DataFrame:
    k = F.col("doc_id") % 8
    more = F.when(k == 0, " a Term  Sheet and an LOI").when(k == 1, " letter of intent; the loi").when(k == 2, " GP & LP, cash flow, ROI").when(k == 3, " roi of Series B equity").otherwise("")
    return t.read("documents").select(F.col("doc_id").alias("id"), F.array_join(F.array_sort(text.domain_terms(F.concat("text", more))), ",").alias("tags"))


@query(
    "2.11",
    """SELECT doc_id AS id, CASE WHEN doc_id % 9 = 0 OR doc_id % 7 = 1 THEN 'code' WHEN doc_id % 7 = 2 THEN 'html' WHEN doc_id % 9 = 1 OR doc_id % 7 = 3 THEN 'svg' ELSE 'document' END AS kind FROM documents
WHERE NOT contains(text, 'import ') AND NOT contains(text, 'function ')""",
)
def artifact_kinds(t: Tables) -> DataFrame:
    k = F.col("doc_id")
    mark = F.when(k % 7 == 1, "import x").when(k % 7 == 2, "<!DOCTYPE html>").when(k % 7 == 3, "<svg>").otherwise("")
    own = t.read("documents").filter(~F.col("text").contains("import ") & ~F.col("text").contains("function "))
    return own.select(k.alias("id"), text.artifact_type(F.when(k % 9 == 0, "py").when(k % 9 == 1, "svg"), F.concat(mark, F.lit("\n"), "text")).alias("kind"))
