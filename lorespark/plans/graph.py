"""Queries over entities and items as graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import graph
from ..sources.fixtures import Tables
from .catalog import query

_ALL = "edges AS (SELECT a.entity_id AS a, b.entity_id AS b, count(*) AS n FROM members a JOIN members b ON a.item_id = b.item_id AND a.entity_id < b.entity_id GROUP BY 1, 2)"


@query("G7 G8 J8", f"WITH {_ALL} SELECT a, b, n, least(1.0::DOUBLE, round(.5 + .1 * (n - 1), 6)::DOUBLE) AS confidence FROM edges")
def cooccurrence_edges(t: Tables) -> DataFrame:
    return graph.cooccurrence_edges(t.meetings())


@query("J6 W13 G14", f"WITH {_ALL}, s AS (SELECT a, b, n FROM edges UNION ALL SELECT b, a, n FROM edges) SELECT a AS entity_id, b AS neighbour, n, rank FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY n DESC, b) AS rank FROM s) WHERE rank <= 10")
def neighbors_topk(t: Tables) -> DataFrame:
    met = t.meetings()
    return graph.top_neighbours(graph.cooccurrence_edges(met), 10, 2 * met.count()).withColumn("rank", F.col("rank").cast("long"))


@query(
    "G17",
    """
WITH c AS (SELECT entity_id FROM part_members GROUP BY 1 HAVING count(*) > .3 * (SELECT count(DISTINCT item_id) FROM part_members)),
k AS (SELECT * FROM part_members WHERE entity_id NOT IN (SELECT entity_id FROM c)), z AS (SELECT item_id, count(*) AS size FROM k GROUP BY 1),
p AS (SELECT a.item_id AS item_a, b.item_id AS item_b, count(*) AS shared FROM k a JOIN k b ON a.entity_id = b.entity_id AND a.item_id < b.item_id GROUP BY 1, 2 HAVING count(*) >= 2)
SELECT item_a, item_b, shared, round(shared / greatest(x.size, y.size), 2) AS confidence FROM p JOIN z x ON x.item_id = item_a JOIN z y ON y.item_id = item_b""",
)
def shared_contact_pairs(t: Tables) -> DataFrame:
    return graph.shared_contacts(t.part_members())


@query("G19 W4", "SELECT entity_id, id AS source_id, nxt AS target_id FROM (SELECT *, lead(id) OVER (PARTITION BY entity_id ORDER BY source_date, id) AS nxt FROM knowledge) WHERE nxt IS NOT NULL")
def follow_up_chain(t: Tables) -> DataFrame:
    return graph.follow_ups(t.knowledge(), "entity_id", "source_date")


_COS = "list_sum([x.embedding[i] * y.embedding[i] for i in range(1, 65)]) / (sqrt(list_sum([v * v for v in x.embedding])) * sqrt(list_sum([v * v for v in y.embedding])))"


@query("G20 R6 G22", f"SELECT * FROM (SELECT x.id AS a, y.id AS b, round({_COS}, 6) AS score FROM vectors x JOIN vectors y ON x.project = y.project AND x.id < y.id) WHERE score > .25")
def related_pairs(t: Tables) -> DataFrame:
    return graph.related(t.vectors(), 0.25)


@query("G21", f"SELECT * FROM (SELECT x.id, y.id AS old_id, round({_COS}, 6) AS score, .8::DOUBLE AS confidence FROM vectors x JOIN vectors y ON x.project = y.project AND x.id > y.id AND x.id % 4 = y.id % 4) WHERE score > .2")
def supersedes_pairs(t: Tables) -> DataFrame:
    items = t.vectors().select("id", "project", F.col("id").alias("at"), F.array((F.col("id") % 4).cast("string")).alias("contacts"), "embedding")
    return graph.supersedes(items, 0.2)


@query(
    "G23",
    """
WITH e AS (SELECT DISTINCT l_orderkey AS a, -l_suppkey - 1 AS b FROM lineitem), s AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
one AS (SELECT DISTINCT b AS node FROM s WHERE a = 7 AND b <> 7), two AS (SELECT DISTINCT s.b AS node FROM s JOIN one ON s.a = one.node WHERE s.b <> 7 AND s.b NOT IN (SELECT node FROM one))
SELECT 7::BIGINT AS node, 0 AS depth UNION ALL SELECT node, 1 FROM one UNION ALL SELECT node, 2 FROM two""",
)
def bfs_depth2(t: Tables) -> DataFrame:
    edges = t.read("lineitem").select(F.col("l_orderkey").alias("a"), (-F.col("l_suppkey") - 1).alias("b"), F.lit(1).alias("n")).distinct()
    start = t.read("lineitem").sparkSession.range(7, 8).select(F.col("id").alias("node"))
    return graph.neighbourhood(edges, start, 2)


@query(
    "G26 J8",
    """WITH RECURSIVE e AS (SELECT DISTINCT x.id AS a, y.id AS b FROM vectors x JOIN vectors y ON x.project = y.project AND x.id < y.id AND """ + _COS + """ > .3),
s AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r(node, root) AS (SELECT a, a FROM s UNION SELECT s.b, r.root FROM r JOIN s ON s.a = r.node)
SELECT node, min(root) AS component FROM r GROUP BY 1""",
)
def similar_components(t: Tables) -> DataFrame:
    return graph.components(graph.related(t.vectors(), 0.3))


@query(
    "G25 G26",
    """
WITH m AS (SELECT * FROM part_members), o AS (SELECT o_orderkey AS id, o_orderpriority AS project, o_orderstatus AS source, o_orderdate::DATE AS day FROM orders),
p AS (SELECT a.item_id AS a, b.item_id AS b, count(*) AS shared FROM m a JOIN m b ON a.entity_id = b.entity_id AND a.item_id < b.item_id GROUP BY 1, 2 HAVING count(*) >= 2),
q AS (SELECT a, b, shared, round(.4::DOUBLE * least(shared / 3.0::DOUBLE, 1.0) + CASE WHEN x.project = y.project THEN .25 ELSE 0 END
  + CASE WHEN abs(x.day - y.day) <= 2 THEN .2 WHEN abs(x.day - y.day) <= 7 THEN .15 WHEN abs(x.day - y.day) <= 14 THEN .08 ELSE 0 END + CASE WHEN x.source <> y.source THEN .15 ELSE 0 END, 6) AS score
  FROM p JOIN o x ON x.id = a JOIN o y ON y.id = b)
SELECT a, b, shared, score FROM q WHERE score >= .55""",
)
def thread_candidates(t: Tables) -> DataFrame:
    items = t.read("orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("project"), F.col("o_orderstatus").alias("source"), F.to_date("o_orderdate").alias("day"))
    return graph.thread_candidates(t.part_members(), items)


@query(
    "G28",
    """
SELECT episode, count(*) AS items FROM (SELECT CASE WHEN id % 3 = 0 THEN 'thread:' || (id % 90) WHEN source = 'src7' THEN 'day:' || day
  WHEN project <> 'es' THEN 'week:' || project || ':' || (day - dayofweek(day)::INTEGER)::DATE ELSE 'item:' || id END AS episode FROM texts) GROUP BY 1""",
)
def episode_grouping(t: Tables) -> DataFrame:
    items = t.texts().select("id", F.when(F.col("source") == "src7", "calendar").otherwise(F.col("source")).alias("source"), F.when(F.col("id") % 3 == 0, (F.col("id") % 90).cast("string")).alias("thread"), "day", F.when(F.col("project") != "es", F.col("project")).alias("project"))
    return graph.episodes(items).groupBy("episode").agg(F.count("*").alias("items"))


@query("G9 G10", "WITH k AS (SELECT s_suppkey AS old_id, min(s_suppkey) OVER (PARTITION BY s_nationkey) AS new_id FROM supplier) SELECT DISTINCT item_id, coalesce(new_id, entity_id) AS entity_id FROM members LEFT JOIN k ON old_id = entity_id")
def merged_members(t: Tables) -> DataFrame:
    same = t.read("supplier").select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").cast("string").alias("email"))
    return graph.merge_entities(t.members(), graph.mail_duplicates(same))


@query("Q21", f"WITH {_ALL}, kept AS (SELECT * FROM members WHERE entity_id % 10 <> 3), p AS (SELECT DISTINCT a.entity_id AS a, b.entity_id AS b FROM kept a JOIN kept b ON a.item_id = b.item_id AND a.entity_id < b.entity_id) SELECT a, b FROM (SELECT a, b FROM edges EXCEPT SELECT a, b FROM p)")
def phantom_edges_audit(t: Tables) -> DataFrame:
    """Edges that no item supports any more, here since some entities' mentions are gone."""
    return graph.phantom_edges(graph.cooccurrence_edges(t.meetings()), t.members().filter("entity_id % 10 <> 3")).select("a", "b")


@query("G29")
def kmeans_themes(t: Tables) -> DataFrame:
    return graph.kmeans(t.vectors(), 5)
