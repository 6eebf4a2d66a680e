"""Queries of data quality, text, and the selections of context."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..functions.time import since
from ..operators import quality, rollups
from ..sources import files
from ..sources.fixtures import NOW, Tables
from .catalog import query

_T = f"TIMESTAMP '{NOW}'"


def _list(values: list[str]) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


_AUTO = "|".join(f"(?:{p})" for p in quality.AUTOMATED).replace("'", "''")
_NOISE = f"""
WITH m AS (SELECT conv_id, turn, lower(role || '@x.org') AS f, lower(CASE WHEN turn = 0 THEN 'weekly digest ' || conv_id WHEN turn = 2 THEN 'special offer, unsubscribe' ELSE '' END) AS s, lower(coalesce(text, '')) AS b FROM conversations),
h AS (SELECT *, s || ' ' || b AS w, len(list_filter({_list(quality.COLD_SIGNALS)}, lambda p: contains(s || ' ' || b, p))) AS hits,
  len(list_filter({_list(["system@", *quality.BLOCKED_SENDERS])}, lambda p: contains(f, p))) > 0 AS blocked FROM m),
k AS (SELECT *, CASE WHEN blocked THEN 'blocked_domain' WHEN regexp_matches(s, '{_AUTO}') OR regexp_matches(substring(b, 1, 500), '{_AUTO}') THEN 'automated_report'
  WHEN hits >= 3 OR (hits = 2 AND len(string_split_regex(w, '\\s+')) < 200) THEN 'cold_email' END AS noise_type FROM h)
SELECT conv_id, turn, noise_type, CASE noise_type WHEN 'blocked_domain' THEN 1.0::DOUBLE WHEN 'automated_report' THEN .9 WHEN 'cold_email' THEN round(least(.6 + .1 * hits, .95), 6) END AS noise_confidence FROM k"""


def _noise(t: Tables) -> DataFrame:
    turn = F.col("turn")
    subject = F.when(turn == 0, F.concat(F.lit("Weekly digest "), F.col("conv_id").cast("string"))).when(turn == 2, "Special offer, unsubscribe").otherwise("")
    mails = t.read("conversations").withColumn("sender", F.concat("role", F.lit("@x.org"))).withColumn("subject", subject)
    return quality.classify_noise(mails, "sender", "subject", "text", ["system@", *quality.BLOCKED_SENDERS])


@query("Q1 Q2 Q5", _NOISE)
def noise_classify(t: Tables) -> DataFrame:
    return _noise(t).select("conv_id", "turn", "noise_type", "noise_confidence")


@query("Q3", "SELECT m.entity_id, count(*) AS mentions FROM mentions m LEFT JOIN knowledge k ON k.id = m.item_id AND importance IN ('low', 'normal') WHERE role = 'signup' GROUP BY 1 HAVING count(*) = count(k.id)")
def quarantine(t: Tables) -> DataFrame:
    noise = t.knowledge().filter("importance IN ('low', 'normal')").select(F.col("id").alias("item_id"))
    return quality.quarantined(t.mentions().filter("role = 'signup'"), noise)


@query("Q6", "SELECT item_id AS quote_id, doc_id FROM benchmark b JOIN documents d ON contains(lower(d.text), substring(lower(b.text), 1, 40)) AND length(b.text) >= 40")
def provenance_quote_check(t: Tables) -> DataFrame:
    quotes = t.read("benchmark").select(F.col("item_id").alias("quote_id"), F.col("text").alias("quote"))
    return quality.quotes_anywhere(quotes, t.read("documents"))


_G = "CASE WHEN length(x) >= 2 THEN list_distinct([substring(x, i, 2) for i in range(1, length(x))]) ELSE [] END"


@query(
    "Q8 Q9",
    f"""WITH n AS (SELECT p_partkey AS id, p_size AS project, trim(regexp_replace(lower(p_name || ' ' || p_type), '[^a-z0-9 ]', '', 'g')) AS x FROM part), g AS (SELECT id, project, {_G} AS g FROM n),
c AS (SELECT id, project, list_sort(g) AS g FROM g WHERE len(g) > 0), k AS (SELECT project, g, min(id) AS class_id, count(*) AS n FROM c GROUP BY 1, 2),
s AS (SELECT a.project, a.g, sum(b.n) - 1 AS links FROM k a JOIN k b ON a.project = b.project AND round(2.0::DOUBLE * len(list_intersect(a.g, b.g)) / (len(a.g) + len(b.g)), 6) > .85 GROUP BY 1, 2)
SELECT id, class_id, links::BIGINT AS links FROM c JOIN k ON c.project = k.project AND c.g = k.g JOIN s ON c.project = s.project AND c.g = s.g""",
)
def dice_near_dups(t: Tables) -> DataFrame:
    """Each part with its class of equal bigrams and the number of its near duplicates."""
    rows = t.read("part").select(F.col("p_partkey").alias("id"), F.col("p_size").alias("project"), F.concat_ws(" ", "p_name", "p_type").alias("text"))
    return quality.near_duplicate_texts(rows)


@query("Q10 J13", "SELECT ref, id FROM (SELECT md5(split_part(text, chr(10), 1)) AS ref, doc_id AS id, row_number() OVER (PARTITION BY md5(split_part(text, chr(10), 1)) ORDER BY length(text) DESC, doc_id) AS place FROM documents) WHERE place = 1")
def dedup_longest(t: Tables) -> DataFrame:
    rows = t.read("documents").select(F.col("doc_id").alias("id"), F.md5(F.substring_index("text", "\n", 1).cast("binary")).alias("ref"), F.length("text").alias("n"))
    return quality.keep_longest(rows, "ref", F.col("n")).select("ref", "id")


@query("Q11 Q26 P6", f"SELECT id FROM knowledge k WHERE importance = 'low' AND source_date < {_T} - INTERVAL 20 DAY AND source = 'view' AND id NOT IN (SELECT item_id FROM mentions WHERE role = 'view' AND entity_id < 50)")
def archive_stale_anti(t: Tables) -> DataFrame:
    items = t.knowledge().withColumn("raw_content", F.when(F.col("source") != "view", "kept"))
    used = t.mentions().filter("role = 'view' and entity_id < 50").select(F.col("item_id").alias("id"))
    return quality.archivable(items, used, NOW, 20).select("id")


@query("Q13", f"SELECT entity_id, count(DISTINCT project) AS n_projects, string_agg(DISTINCT project, ',' ORDER BY project) AS projects FROM knowledge WHERE source_date >= {_T} - INTERVAL 7 DAY GROUP BY 1 HAVING count(DISTINCT project) > 1")
def project_conflicts(t: Tables) -> DataFrame:
    return quality.project_conflicts(t.knowledge(), NOW)


@query(
    "Q16 J12",
    """SELECT a.id, count(DISTINCT b.source) AS sources FROM knowledge a JOIN knowledge b ON a.entity_id = b.entity_id AND a.project = b.project AND a.source <> b.source
AND abs(a.source_date::DATE - b.source_date::DATE) < 30 GROUP BY 1 HAVING count(DISTINCT b.source) >= 3""",
)
def corroboration_promote(t: Tables) -> DataFrame:
    return quality.corroborated(t.knowledge())


@query("Q17 P7", "SELECT id FROM (SELECT id, importance, row_number() OVER (ORDER BY source_date::DATE DESC, source_date DESC, id) AS place FROM knowledge WHERE importance IN ('critical', 'high')) WHERE place > 500 AND importance = 'high'")
def context_budget(t: Tables) -> DataFrame:
    return quality.context_budget(t.knowledge())


@query("Q19 J14", "SELECT e.event_id AS id, event_type AS project, k.source AS right_project FROM events e JOIN knowledge k ON k.id = e.event_id + 1 WHERE event_type <> k.source")
def consistency_mismatch(t: Tables) -> DataFrame:
    rows = t.read("events").select(F.col("event_id").alias("id"), (F.col("event_id") + 1).alias("source_id"), F.col("event_type").alias("project"))
    items = t.knowledge().select("id", F.col("source").alias("project"))
    return quality.project_mismatch(rows, items)


@query("Q19 J16", "SELECT event_id AS id FROM events WHERE event_id + 7 NOT IN (SELECT id FROM knowledge)")
def orphaned_rows(t: Tables) -> DataFrame:
    rows = t.read("events").select(F.col("event_id").alias("id"), (F.col("event_id") + 7).alias("source_id"))
    return quality.orphans(rows, t.knowledge()).select("id")


@query("Q19 T38", "SELECT entity_id, project, count(*) AS n FROM knowledge GROUP BY ALL HAVING count(*) >= 2")
def verified_projects(t: Tables) -> DataFrame:
    return quality.verified_pairs(t.knowledge())


@query(
    "Q25",
    """WITH f AS (SELECT p_partkey AS id, p_brand AS project, p_type AS kind, p_name AS text, list_distinct(string_split_regex(lower(p_name), '\\s+')) AS w FROM part),
m AS (SELECT a.id, b.id AS b FROM f a JOIN f b ON a.project = b.project AND a.kind = b.kind AND a.text <> b.text AND a.id < b.id AND len(list_intersect(a.w, b.w)) / greatest(len(a.w), len(b.w))::DOUBLE > .4)
SELECT id, max(b) AS by FROM m GROUP BY 1""",
)
def fact_supersession(t: Tables) -> DataFrame:
    facts = t.read("part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("project"), F.col("p_type").alias("kind"), F.col("p_name").alias("text"), F.col("p_partkey").alias("at"))
    return quality.superseded_facts(facts, 0.4)


@query("Q12", "WITH r AS (SELECT entity_id, max(mention_date) AS last FROM mentions WHERE role = 'signup' GROUP BY 1) SELECT entity_id, count(*) AS items FROM knowledge JOIN r USING (entity_id) WHERE source_date < last GROUP BY 1")
def relabel_contradictions(t: Tables) -> DataFrame:
    relabels = t.mentions().filter("role = 'signup'").select("entity_id", F.col("mention_date").alias("at"))
    return quality.relabel_contradictions(t.knowledge(), relabels)


@query("Q27", "WITH n AS (SELECT p_brand AS name, p_partkey AS id FROM part), g AS (SELECT lower(trim(name)) AS key, count(*) AS n, max(id) AS id, sum(id)::BIGINT AS total FROM n GROUP BY 1) SELECT key, id, n, total FROM g")
def theme_merge(t: Tables) -> DataFrame:
    themes = t.read("part").select(F.concat(F.lit(" "), F.upper("p_brand")).alias("name"), F.col("p_partkey").alias("id"), F.array("p_partkey").alias("members"))
    return quality.merge_themes(themes).select("key", "id", F.size("members").cast("long").alias("n"), F.aggregate("members", F.lit(0).cast("long"), lambda s, x: s + x).alias("total"))


@query("Q24 C7", f"SELECT entity_id, count(*) AS items FROM knowledge k JOIN entities e ON e.id = entity_id WHERE source_date >= {_T} - INTERVAL 30 DAY AND NOT dismissed GROUP BY 1 HAVING count(*) >= 3 ORDER BY 2 DESC, 1 LIMIT 16")
def page_candidates(t: Tables) -> DataFrame:
    known = t.entities().filter(~F.col("dismissed")).select(F.col("id").alias("entity_id"))
    n = t.knowledge().filter(since("source_date", NOW, 30)).join(known, "entity_id", "left_semi").groupBy("entity_id").agg(F.count("*").alias("items"))
    return n.filter("items >= 3").orderBy(F.desc("items"), "entity_id").limit(16)


@query("Q28", f"SELECT count(*) AS n FROM knowledge WHERE source_date < {_T} - INTERVAL 14 DAY AND importance <> 'critical'")
def stale_count(t: Tables) -> DataFrame:
    return t.knowledge().filter(~since("source_date", NOW, 14) & (F.col("importance") != "critical")).agg(F.count("*").alias("n"))


_CLAIM = r"[0-9]|[A-Z][a-z]+ [A-Z]|(?:signed|sent|launched|agreed|confirmed|pending|overdue|blocked|completed)"
_BARE = r"regexp_replace({x}, '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g')"
_CLAIMS = f"""claims AS (SELECT id, substring(line, 1, 300) AS claim FROM (SELECT id, {_BARE.format(x=r"regexp_replace(line, '^[#*>\s-]+', '')")} AS line FROM (SELECT doc_id AS id, unnest(string_split(text, chr(10))) AS line FROM documents) WHERE length({_BARE.format(x="line")}) > 20)
  WHERE line <> '' AND NOT starts_with(line, '---') AND regexp_matches(line, '{_CLAIM}'))"""


@query("Q22", f"WITH {_CLAIMS} SELECT doc_id AS id, count(claim) AS claims FROM documents LEFT JOIN claims ON id = doc_id GROUP BY ALL")
def claim_counts(t: Tables) -> DataFrame:
    return t.read("documents").select(F.col("doc_id").alias("id"), F.size(quality.claims(F.col("text"))).cast("long").alias("claims"))


@query("Q22", f"WITH {_CLAIMS}, r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY md5('7:' || claim)) AS place FROM (SELECT DISTINCT * FROM claims)) SELECT * FROM r WHERE place <= 8")
def sampled_claims(t: Tables) -> DataFrame:
    """Up to eight claims of each page, drawn by a seed."""
    return quality.sampled_claims(t.read("documents").select(F.col("doc_id").alias("id"), "text"), 8, 7)


_INTENT = " ".join(f"WHEN regexp_matches(m, '{p.replace(chr(39), chr(39) * 2)}') THEN '{v}'" for v, p in text.INTENTS)


@query(
    "G1 G2 G3",
    """WITH c AS (SELECT c_custkey AS id, 'Dr. ' || c_name || ' Jr. <' || c_name || CASE c_custkey % 2 WHEN 0 THEN '@gmail.com>' ELSE '@firm.example>' END AS h FROM customer)
SELECT id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(trim(regexp_extract(h, '^(.+?)\\s*<(.+?)>$', 1))), '\\b(jr|sr|ii|iii|iv|esq|phd|md|dds)\\b\\.?', '', 'g'), '\\b[a-z]\\.\\s*', '', 'g'), '[^a-z\\s-]', '', 'g'), '\\s+', ' ', 'g')) AS name,
lower(regexp_extract(h, '^(.+?)\\s*<(.+?)>$', 2)) AS mail, CASE WHEN id % 2 = 1 THEN 'firm.example' END AS domain FROM c""",
)
def name_normal_forms(t: Tables) -> DataFrame:
    host = F.when(F.col("c_custkey") % 2 == 0, "@gmail.com>").otherwise("@firm.example>")
    header = F.concat(F.lit("Dr. "), F.col("c_name"), F.lit(" Jr. <"), F.col("c_name"), host)
    own = t.read("customer").select(F.col("c_custkey").alias("id"), header.alias("h"))
    mail = text.header_mail(F.col("h"))
    return own.select("id", text.normalize_name(text.header_name(F.col("h"))).alias("name"), mail.alias("mail"), text.mail_domain(mail).alias("domain"))


@query(
    "S11 W7",
    """WITH b AS (SELECT conv_id, turn, role, text, CASE WHEN role = lag(role) OVER (PARTITION BY conv_id ORDER BY turn) THEN 0 ELSE 1 END AS s FROM conversations)
SELECT conv_id AS transcript_id, sum(s)::BIGINT AS blocks FROM b GROUP BY 1""",
)
def speaker_blocks(t: Tables) -> DataFrame:
    own = t.read("conversations").select(F.col("conv_id").alias("transcript_id"), F.col("turn").alias("position"), F.col("role").alias("speaker"), "text")
    return files.speaker_blocks(own).select("transcript_id", "blocks")


@query("S8 J1", "SELECT conv_id AS thread_id, count(*) AS messages, arg_min(role, turn) AS first_sender, arg_max(role, turn) AS last_sender FROM conversations GROUP BY 1")
def mail_threads(t: Tables) -> DataFrame:
    mails = t.read("conversations").select(F.col("conv_id").alias("thread_id"), F.col("turn").alias("at"), F.col("role").alias("sender"), F.lit("").alias("subject"), F.col("text").alias("body"))
    return files.mail_threads(mails).select("thread_id", "messages", "first_sender", "last_sender")


@query("P11 S4", "SELECT event_id AS id, json_extract_string(props, '$.k')::BIGINT AS k FROM events WHERE json_extract_string(props, '$.k')::BIGINT >= 50")
def json_predicate(t: Tables) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("long")
    return t.read("events").filter(k >= 50).select(F.col("event_id").alias("id"), k.alias("k"))


@query("P14 P15 P3 P13", "SELECT p_brand AS brand, regexp_replace(lower(p_type), '[^a-z]', '', 'g') AS kind, count(*) AS n FROM part WHERE lower(p_type) LIKE 's%' AND p_name NOT LIKE '%@%' GROUP BY ALL")
def normalized_filter(t: Tables) -> DataFrame:
    own = t.read("part").filter(F.lower("p_type").startswith("s") & ~F.col("p_name").contains("@"))
    return own.groupBy(F.col("p_brand").alias("brand"), text.letters_only(F.col("p_type")).alias("kind")).agg(F.count("*").alias("n"))


@query("P22 P21 P24", "SELECT e.id, count(m.item_id) AS later FROM entities e LEFT JOIN mentions m ON m.entity_id = e.id AND m.mention_date > coalesce((SELECT max(mention_date) FROM mentions x WHERE x.entity_id = e.id AND x.role = 'signup'), TIMESTAMP '2000-01-01') GROUP BY 1")
def mentions_after_signup(t: Tables) -> DataFrame:
    m = t.mentions()
    mark = m.filter("role = 'signup'").groupBy("entity_id").agg(F.max("mention_date").alias("mark"))
    late = m.join(mark, "entity_id", "left").filter(F.col("mention_date") > F.coalesce("mark", F.lit("2000-01-01 00:00:00").cast("timestamp_ntz")))
    n = late.groupBy("entity_id").agg(F.count("*").alias("later"))
    return t.entities().join(n, F.col("id") == F.col("entity_id"), "left").select("id", F.coalesce("later", F.lit(0)).alias("later"))


@query("S1 W12 P19", "SELECT id, source, substring(source || ':' || project, 1, 6) AS preview FROM knowledge ORDER BY source_date DESC, id LIMIT 25")
def newest_items(t: Tables) -> DataFrame:
    return t.knowledge().orderBy(F.desc("source_date"), "id").limit(25).select("id", "source", F.substring(F.concat_ws(":", "source", "project"), 1, 6).alias("preview"))


@query("C8 C9 J2", "SELECT entity_id, count(*) FILTER (direction = 'inbound') AS inbound, count(*) FILTER (direction = 'outbound') AS outbound, count(DISTINCT project) AS projects FROM mentions m JOIN knowledge k ON k.id = m.item_id JOIN entities e ON e.id = m.entity_id WHERE NOT dismissed GROUP BY 1".replace("SELECT entity_id", "SELECT m.entity_id"))
def entity_evidence(t: Tables) -> DataFrame:
    known = t.entities().filter(~F.col("dismissed")).select(F.col("id").alias("entity_id"))
    items = t.knowledge().select(F.col("id").alias("item_id"), "project")
    own = t.mentions().join(known, "entity_id").join(items, "item_id")
    return own.groupBy("entity_id").agg(F.count_if(F.col("direction") == "inbound").alias("inbound"), F.count_if(F.col("direction") == "outbound").alias("outbound"), F.countDistinct("project").alias("projects"))


@query("C25 J20", "SELECT conv_id, turn, place FROM (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS place FROM conversations) WHERE place <= 5")
def sidebar_latest(t: Tables) -> DataFrame:
    own = rollups.top_per_group(t.read("conversations"), "conv_id", [F.desc("turn")], 5)
    return own.select("conv_id", "turn", F.col("rank").alias("place"))


@query("C18", "SELECT id, CASE WHEN name = 'user_1' THEN 0 WHEN starts_with(name, 'user_1') THEN 1 ELSE 2 END AS tier FROM entities WHERE contains(name, 'user_1')")
def ranked_lookup(t: Tables) -> DataFrame:
    n = F.lower("name")
    return t.entities().filter(n.contains("user_1")).select("id", F.when(n == "user_1", 0).when(n.startswith("user_1"), 1).otherwise(2).alias("tier"))


@query("S10", "SELECT event_id AS id FROM (SELECT *, count(*) OVER (PARTITION BY user_id, event_type) AS c FROM events) WHERE c <= 5")
def calendar_without_series(t: Tables) -> DataFrame:
    own = t.read("events").select(F.col("event_id").alias("id"), F.concat_ws("/", "user_id", "event_type").alias("recurring_id"), F.lit(False).alias("all_day"), F.col("event_type").alias("title"))
    return files.calendar_events(own).select("id")


@query(
    "Z2",
    "SELECT date_trunc('hour', ts) AS hour, event_type AS role, count(*) AS n FROM events GROUP BY ALL",
)
def hourly_activity(t: Tables) -> DataFrame:
    own = t.read("events").groupBy(F.window("ts", "1 hour").alias("w"), F.col("event_type").alias("role")).agg(F.count("*").alias("n"))
    return own.select(F.col("w.start").alias("hour"), "role", "n")


@query(
    "Z10",
    """WITH d AS (SELECT user_id AS entity_id, ts, unnest(generate_series(0, 6)) AS k FROM events)
SELECT date_trunc('day', ts) - to_days(k::INTEGER) AS day, entity_id, count(*) AS n FROM d GROUP BY ALL""",
)
def rolling_week_activity(t: Tables) -> DataFrame:
    own = t.read("events").groupBy(F.window("ts", "7 days", "1 day", "0 days").alias("w"), F.col("user_id").alias("entity_id")).agg(F.count("*").alias("n"))
    return own.select(F.col("w.start").alias("day"), "entity_id", "n")


@query(
    "Z10 W7",
    """WITH b AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 12 HOUR THEN 0 ELSE 1 END AS s FROM events), i AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY ts, s) AS k FROM b)
SELECT user_id, min(ts) AS begin, count(*) AS n FROM i GROUP BY user_id, k""",
)
def activity_sessions(t: Tables) -> DataFrame:
    own = t.read("events").groupBy(F.session_window("ts", "12 hours").alias("w"), "user_id").agg(F.count("*").alias("n"))
    return own.select("user_id", F.col("w.start").alias("begin"), "n")
