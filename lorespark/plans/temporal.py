"""Queries of the graph over time, of expansion along it, and of daily rollups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import activity, graph, retrieval, rollups, versions
from ..session import scratch
from ..sources.fixtures import NOW, ORDERS_NOW, Tables
from . import activity as _activity  # noqa: F401  registers what is compared with
from .catalog import CATALOG, query

_T, _O = f"TIMESTAMP '{NOW}'", f"TIMESTAMP '{ORDERS_NOW}'"
_EDGES = "edges AS (SELECT a.entity_id AS a, b.entity_id AS b, count(*) AS n, least(1.0::DOUBLE, round(.5 + .1 * (count(*) - 1), 6)::DOUBLE) AS confidence FROM members a JOIN members b ON a.item_id = b.item_id AND a.entity_id < b.entity_id GROUP BY 1, 2)"
#: When the graph was built, entities were dismissed, and others merged.
BUILT, DISMISSED, MERGED = "2024-01-01 00:00:00", "2024-01-10 00:00:00", "2024-01-20 00:00:00"


def _mapping(t: Tables) -> DataFrame:
    """Suppliers of one nation are one, but for the dismissed."""
    own = t.read("supplier").filter("s_suppkey % 11 <> 4").select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").cast("string").alias("email"))
    return graph.mail_duplicates(own)


def _history(t: Tables) -> DataFrame:
    path = scratch(t.spark, "edges")  # written once: what follows reads them several times
    graph.cooccurrence_edges(t.meetings()).write.parquet(path)
    start = versions.opened(t.spark.read.schema("a long, b long, n long, confidence double").parquet(path), BUILT)
    gone = t.read("supplier").filter("s_suppkey % 11 = 4").select(F.col("s_suppkey").alias("node"))
    return versions.merge(versions.dismiss(start, gone, DISMISSED), _mapping(t), MERGED)


_HISTORY = f"""{_EDGES},
map AS (SELECT * FROM (SELECT s_suppkey AS old_id, min(s_suppkey) OVER (PARTITION BY s_nationkey) AS new_id FROM supplier WHERE s_suppkey % 11 <> 4) WHERE old_id <> new_id),
left_ AS (SELECT * FROM edges WHERE a % 11 <> 4 AND b % 11 <> 4),
ends AS (SELECT e.*, coalesce(x.new_id, a) AS x, coalesce(y.new_id, b) AS y, x.new_id IS NOT NULL OR y.new_id IS NOT NULL AS moved FROM left_ e LEFT JOIN map x ON x.old_id = a LEFT JOIN map y ON y.old_id = b),
come AS (SELECT least(x, y) AS a, greatest(x, y) AS b, sum(n) AS more, count(*) AS times, max(confidence) AS surest FROM ends WHERE moved AND x <> y GROUP BY 1, 2),
stay AS (SELECT a, b, n, confidence FROM ends WHERE NOT moved),
merged AS (SELECT coalesce(c.a, s.a) AS a, coalesce(c.b, s.b) AS b, (coalesce(n, 0) + coalesce(more, 0))::BIGINT AS n,
  CASE WHEN more IS NULL THEN confidence ELSE round(least(1.0, coalesce(confidence, surest) + .1::DOUBLE * CASE WHEN n IS NULL THEN times - 1 ELSE times END), 6) END AS confidence FROM come c FULL JOIN stay s ON c.a = s.a AND c.b = s.b)"""


@query(
    "G9 G10 G11 Q25 C21",
    f"""WITH {_HISTORY} SELECT 'built' AS read_at, a, b, n, confidence FROM edges UNION ALL SELECT 'dismissed', a, b, n, confidence FROM left_ UNION ALL SELECT 'merged', a, b, n, confidence FROM merged""",
)
def edges_over_time(t: Tables) -> DataFrame:
    """The edges as of three times: built, after a dismissal, after a merge."""
    times = (("built", "2024-01-05 00:00:00"), ("dismissed", "2024-01-15 00:00:00"), ("merged", NOW))
    held = F.array(*(F.when(versions.holds(when), F.lit(name)) for name, when in times))
    return _history(t).select(F.explode(F.array_compact(held)).alias("read_at"), "a", "b", "n", "confidence")


@query(
    "G9",
    f"""
WITH map AS (SELECT * FROM (SELECT s_suppkey AS old_id, min(s_suppkey) OVER (PARTITION BY s_nationkey) AS new_id FROM supplier WHERE s_suppkey % 11 <> 4) WHERE old_id <> new_id)
SELECT coalesce(new_id, s_suppkey) AS entity_id, 'supplier ' || s_suppkey AS alias FROM supplier LEFT JOIN map ON old_id = s_suppkey UNION SELECT new_id, s_name FROM map JOIN supplier ON s_suppkey = old_id""",
)
def merged_aliases(t: Tables) -> DataFrame:
    s = t.read("supplier")
    return versions.merge_aliases(s.select(F.col("s_suppkey").alias("entity_id"), F.concat(F.lit("supplier "), F.col("s_suppkey").cast("string")).alias("alias")), s.select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name")), _mapping(t))


_REACHED = """step0 AS (SELECT 0::BIGINT AS node, 0 AS depth, 1.0::DOUBLE AS confidence)""" + "".join(
    f""",
seen{d} AS ({" UNION ALL ".join(f"SELECT * FROM step{i}" for i in range(d))}),
step{d} AS (SELECT w.b AS node, {d} AS depth, max(s.confidence * w.confidence) AS confidence FROM step{d - 1} s JOIN ways w ON w.a = s.node WHERE w.b NOT IN (SELECT node FROM seen{d}) GROUP BY 1)"""
    for d in range(1, 5)
)


@query(
    "G23",
    f"""
WITH lines AS (SELECT DISTINCT l_partkey AS p, l_suppkey AS s, 1.0::DOUBLE - l_discount AS sure FROM lineitem WHERE l_orderkey % 25 = 0), one AS (SELECT p AS a, -s - 1 AS b, max(sure) AS confidence FROM lines GROUP BY 1, 2),
ways AS (SELECT a, b, confidence FROM one UNION ALL SELECT b, a, confidence FROM one), start AS (SELECT max(a) AS node FROM one),
{_REACHED.replace("0::BIGINT AS node", "(SELECT node FROM start) AS node")}
SELECT node, depth, round(confidence, 9) AS confidence FROM ({" UNION ALL ".join(f"SELECT * FROM step{i}" for i in range(5))})""",
)
def reached_by_confidence(t: Tables) -> DataFrame:
    """Four steps out from a part, by the surest paths."""
    lines = t.read("lineitem").filter("l_orderkey % 25 = 0").select(F.col("l_partkey").alias("a"), (-F.col("l_suppkey") - 1).alias("b"), (1.0 - F.col("l_discount")).alias("sure"))
    edges = lines.groupBy("a", "b").agg(F.max("sure").alias("confidence"))
    found = graph.confident_neighbourhood(edges, edges.agg(F.max("a").alias("node")), 4)
    return found.select("node", "depth", F.round("confidence", 9).alias("confidence"))


_HOPS = """e AS (SELECT a.entity_id AS a, b.entity_id AS b, count(*) AS n FROM members a JOIN members b ON a.item_id = b.item_id AND a.entity_id < b.entity_id GROUP BY 1, 2),
one AS (SELECT *, CASE WHEN a IN (3, 4) THEN b ELSE a END AS far FROM e WHERE a IN (3, 4) OR b IN (3, 4) ORDER BY n DESC, a, b LIMIT 30),
h1 AS (SELECT far AS entity_id, max(n) AS n FROM one WHERE far NOT IN (3, 4) GROUP BY 1),
two AS (SELECT *, CASE WHEN a IN (SELECT entity_id FROM h1) THEN b ELSE a END AS far FROM e WHERE a IN (SELECT entity_id FROM h1) OR b IN (SELECT entity_id FROM h1) ORDER BY n DESC, a, b LIMIT 20),
h2 AS (SELECT far AS entity_id, max(n) AS n FROM two WHERE far NOT IN (3, 4) AND far NOT IN (SELECT entity_id FROM h1) GROUP BY 1),
r AS (SELECT unnest([3, 4]) AS entity_id, 0 AS hop, .9::DOUBLE AS score UNION ALL SELECT entity_id, 1, .6::DOUBLE * n / greatest(max(n) OVER (), 1) FROM h1 UNION ALL SELECT entity_id, 2, .3::DOUBLE * n / greatest(max(n) OVER (), 1) FROM h2),
named AS (SELECT item_id AS id, arg_min(score, hop * 10 - score) AS score FROM members JOIN r USING (entity_id) GROUP BY 1),
threads AS (SELECT o_custkey % 40 AS thread_id, o_orderkey AS id FROM orders WHERE o_orderkey % 30 = 0 UNION ALL SELECT 100 + o_custkey % 25, o_orderkey FROM orders WHERE o_orderkey % 45 = 0),
near AS (SELECT DISTINCT thread_id FROM threads JOIN named USING (id)), sib AS (SELECT id, count(DISTINCT thread_id) AS n FROM threads JOIN near USING (thread_id) GROUP BY 1),
boosted AS (SELECT coalesce(m.id, s.id) AS id, least(1.0, coalesce(score + .15::DOUBLE * coalesce(n, 0), .55::DOUBLE + .15::DOUBLE * (n - 1))) AS score FROM named m FULL JOIN sib s ON m.id = s.id)"""


@query(
    "R14 J7",
    f"""WITH {_HOPS} SELECT b.id, round(score / (1 + greatest((epoch_us({_O}) - epoch_us(o_orderdate)) / 86400000000.0, 0) * .05::DOUBLE), 6) AS score
FROM boosted b JOIN orders ON o_orderkey = b.id WHERE o_orderdate >= TIMESTAMP '2001-01-01 00:00:00' ORDER BY score / (1 + greatest((epoch_us({_O}) - epoch_us(o_orderdate)) / 86400000000.0, 0) * .05::DOUBLE) DESC, b.id LIMIT 40""",
)
def graph_two_hops(t: Tables) -> DataFrame:
    """Two hops out of suppliers 3 and 4, with the siblings in threads, weighted by age."""
    members, orders = t.members(), t.read("orders")
    seeds = t.spark.range(3, 5).select(F.col("id").alias("entity_id"))
    order = F.col("o_orderkey").alias("id")
    threads = orders.filter("o_orderkey % 30 = 0").select((F.col("o_custkey") % 40).alias("thread_id"), order).unionByName(orders.filter("o_orderkey % 45 = 0").select((100 + F.col("o_custkey") % 25).alias("thread_id"), order))
    items = orders.select(order, F.col("o_orderdate").cast("timestamp_ntz").alias("source_date"))
    found = retrieval.graph_expansion(members, graph.cooccurrence_edges(members), seeds, threads, items, ORDERS_NOW, 40, since="2001-01-01 00:00:00")
    return found.select("id", F.round("score", 6).alias("score"))


_CLUSTERS = """
WITH RECURSIVE m AS (SELECT * FROM part_members), o AS (SELECT o_orderkey AS id, o_orderpriority AS project, o_orderstatus AS source, o_orderdate::DATE AS day FROM orders),
p AS (SELECT a.item_id AS a, b.item_id AS b, count(*) AS shared FROM m a JOIN m b ON a.entity_id = b.entity_id AND a.item_id < b.item_id GROUP BY 1, 2 HAVING count(*) >= 2),
q AS (SELECT a, b, shared, round(.4::DOUBLE * least(shared / 3.0::DOUBLE, 1.0) + CASE WHEN x.project = y.project THEN .25 ELSE 0 END
  + CASE WHEN abs(x.day - y.day) <= 2 THEN .2 WHEN abs(x.day - y.day) <= 7 THEN .15 WHEN abs(x.day - y.day) <= 14 THEN .08 ELSE 0 END + CASE WHEN x.source <> y.source THEN .15 ELSE 0 END, 6) AS score
  FROM p JOIN o x ON x.id = a JOIN o y ON y.id = b),
c AS (SELECT a, b, shared FROM q WHERE score >= .55), s AS (SELECT a, b FROM c UNION SELECT b, a FROM c),
r(node, root) AS (SELECT a, a FROM s UNION SELECT s.b, r.root FROM r JOIN s ON s.a = r.node),
t AS (SELECT node, min(root) AS component FROM r GROUP BY 1),
k AS (SELECT component, count(*) AS items, count(DISTINCT source) AS sources FROM t JOIN o ON o.id = node GROUP BY 1)
"""


def _candidates(t: Tables) -> tuple[DataFrame, DataFrame]:
    items = t.read("orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("project"), F.col("o_orderstatus").alias("source"), F.to_date("o_orderdate").alias("day"))
    return graph.thread_candidates(t.part_members(), items), items


@query("G26 G27", _CLUSTERS + "SELECT component, items, sources, round(.3::DOUBLE * items + .2::DOUBLE * sources, 6) AS score FROM k WHERE items >= 3 OR component IN (SELECT t.component FROM c JOIN t ON c.a = t.node WHERE shared >= 3)")
def thread_clusters(t: Tables) -> DataFrame:
    """Clusters of items of one story that are large or sure enough, with their scores."""
    return graph.thread_clusters(*_candidates(t))


@query("Z4 G26", _CLUSTERS + "SELECT node, component FROM t")
def growing_components(t: Tables) -> DataFrame:
    """The clusters' components, with the pairs taken up in two batches."""
    path = scratch(t.spark, "pairs")  # each batch reads its pairs several times
    _candidates(t)[0].select("a", "b").write.parquet(path)
    pairs = t.spark.read.schema("a long, b long").parquet(path)
    state = versions.GrowingComponents(t.spark, scratch(t.spark, "components"))
    for k in range(2):
        state.add(pairs.filter((F.col("a") + F.col("b")) % 2 == k))
    return state.read()


@query("T2 W3 Z10", CATALOG["momentum"].sql)
def momentum_from_days(t: Tables) -> DataFrame:
    """Momentum from the day table instead of the mentions."""
    return activity.trends(rollups.weekly_from_days(rollups.daily(t.mentions()), NOW, ("entity_id",)), ("entity_id",))


@query("T3 W2 Z10", CATALOG["predictor_anomalies"].sql)
def predictor_from_days(t: Tables) -> DataFrame:
    """Baselines and anomalies from the day table."""
    return activity.judged(rollups.baseline_from_days(rollups.daily(t.mentions()), NOW), NOW)


@query("Z10", f"SELECT entity_id, count(*) AS mentions, count(DISTINCT item_id) AS items, count(DISTINCT mention_date::DATE) AS days FROM mentions WHERE mention_date >= {_T} - INTERVAL 7 DAY AND mention_date < {_T} GROUP BY 1")
def week_from_days(t: Tables) -> DataFrame:
    """The last seven days' mentions and distinct items, merged from days (the sketches are
    exact for as few as here)."""
    return rollups.window_from_days(rollups.daily(t.mentions()), NOW, 7, ("entity_id",))
