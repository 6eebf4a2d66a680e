"""Queries of search and ranking."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..operators import graph, retrieval
from ..sources.fixtures import NOW, Tables
from .catalog import query

_T = f"TIMESTAMP '{NOW}'"
K = 20
WORDS = "the thof then"
_TOKENS = "list_filter(string_split_regex(lower(title || ' ' || summary || ' ' || raw_content), '\\s+'), lambda w: w <> '')"
_TERM = "({tf} * 2.5::DOUBLE / ({tf} + 1.5::DOUBLE * (.25 + .75 * n / a)))"


def _tf(terms: list[str], table: str = "t") -> str:
    return " + ".join(_TERM.format(tf=f"len(list_filter(tokens, lambda w: w = '{w}'))") for w in terms)


def _keyword(terms: str) -> str:
    ws = terms.split()
    hit = " OR ".join(f"list_contains(tokens, '{w}')" for w in ws) + "".join(f" OR contains(lower(title), '{w}')" for w in ws)
    bonus = "".join(f" + CASE WHEN contains(lower(title), '{w}') THEN 3.0 ELSE 0.0 END" for w in ws)
    return f"""t AS (SELECT id, title, {_TOKENS} AS tokens FROM texts), v AS (SELECT *, len(tokens)::DOUBLE AS n, avg(len(tokens)) OVER () AS a FROM t),
kw AS (SELECT id, ({_tf(ws)}{bonus})::DOUBLE AS score FROM v WHERE {hit} ORDER BY score DESC, id LIMIT {K})"""


def _doc(t: Tables) -> F.Column:
    return F.concat_ws(" ", "title", "summary", "raw_content")


def keyword(t: Tables) -> DataFrame:
    return retrieval.keyword_search(t.texts(), WORDS, K, _doc(t))


@query("R1 R2 A23", f"WITH {_keyword(WORDS)} SELECT id, round(score, 6) AS score FROM kw")
def keyword_tfsat_search(t: Tables) -> DataFrame:
    return keyword(t).select("id", F.round("score", 6).alias("score"))


FTS = "the of"


def _fts(terms: str) -> str:
    ws = sorted(set(terms.split()))
    has = " AND ".join(f"list_contains(tokens, '{w}')" for w in ws)
    df = ", ".join(f"count(*) FILTER (list_contains(tokens, '{w}')) OVER () AS df{i}" for i, w in enumerate(ws))
    tf = lambda w: f"len(list_filter(tokens, lambda x: x = '{w}'))"
    score = " + ".join(f"greatest(ln((c - df{i} + .5::DOUBLE) / (df{i} + .5::DOUBLE)), 1e-6) * ({tf(w)} * 2.2::DOUBLE / ({tf(w)} + 1.2::DOUBLE * (.25 + .75 * n / a)))" for i, w in enumerate(ws))
    return f"""f AS (SELECT id, list_filter(string_split_regex(lower(raw_content), '[^a-z0-9]+'), lambda w: w <> '') AS tokens FROM texts),
g AS (SELECT *, len(tokens)::DOUBLE AS n, avg(len(tokens)) OVER () AS a, count(*) OVER () AS c, {df} FROM f),
ft AS (SELECT id, ({score})::DOUBLE AS score FROM g WHERE {has} ORDER BY score DESC, id LIMIT {K})"""


def fts(t: Tables) -> DataFrame:
    return retrieval.full_text_search(t.texts(), FTS, K, F.col("raw_content"))


@query("R4 R5 J17", f"WITH {_fts(FTS)} SELECT id, round(score, 6) AS score FROM ft")
def fts_bm25_search(t: Tables) -> DataFrame:
    return fts(t).select("id", F.round("score", 6).alias("score"))


_COS = "list_sum([x.embedding[i] * y.embedding[i] for i in range(1, 65)]) / (sqrt(list_sum([v * v for v in x.embedding])) * sqrt(list_sum([v * v for v in y.embedding])))"
_KNN = f"sem AS (SELECT x.id, {_COS} AS score FROM vectors x, vectors y WHERE y.id = 0 ORDER BY round(score, 9) DESC, x.id LIMIT {K})"


@query("R6 R8", f"SELECT x.id, round({_COS}, 6) AS score FROM vectors x, vectors y WHERE y.id = 0 AND {_COS} >= .2 ORDER BY {_COS} DESC, x.id LIMIT {K}")
def knn_cosine(t: Tables) -> DataFrame:
    v = t.vectors()
    return retrieval.nearest(v, v.filter("id = 0"), K, 0.2).select("id", F.round("score", 6).alias("score"))


@query("R11", f"SELECT x.id, round({_COS}, 6) AS score FROM vectors x, vectors y WHERE y.id = 42 AND x.id <> 42 AND {_COS} >= .1 ORDER BY {_COS} DESC, x.id LIMIT {K}")
def similar_items(t: Tables) -> DataFrame:
    return retrieval.similar_items(t.vectors(), 42, K, 0.1).select("id", F.round("score", 6).alias("score"))


@query("R9 W10 R10 J19", f"WITH s AS (SELECT x.id // 4 AS parent, {_COS} AS score FROM vectors x, vectors y WHERE y.id = 0) SELECT parent AS id, round(max(score), 6) AS score FROM s GROUP BY 1 ORDER BY max(score) DESC, 1 LIMIT {K}")
def chunk_knn(t: Tables) -> DataFrame:
    v = t.vectors()
    every = retrieval.similarities(v, v.filter("id = 0"))
    return retrieval.best_chunk(every.select(F.floor(F.col("id") / 4).alias("parent"), "score"), K).select("id", F.round("score", 6).alias("score"))


@query("R7", f"SELECT id, round(1 / (1 + greatest((epoch_us({_T}) - epoch_us(source_date)) / 86400000000.0, 0) * .05::DOUBLE), 6) AS weight FROM knowledge")
def recency_weighted(t: Tables) -> DataFrame:
    return t.knowledge().select("id", F.round(retrieval.recency(F.col("source_date"), NOW), 6).alias("weight"))


@query(
    "R15 R16",
    f"""
WITH n AS (SELECT *, (epoch_us({_T}) - epoch_us(source_date)) / 86400000000.0 AS d FROM knowledge WHERE source_date >= TIMESTAMP '2024-01-21 00:00:00' ORDER BY source_date DESC, id LIMIT 40)
SELECT id, round(least(1.0, CASE WHEN d <= 7 THEN .9::DOUBLE ELSE greatest(.1::DOUBLE, 1 - d / 90) END * CASE importance WHEN 'critical' THEN 1.5::DOUBLE WHEN 'high' THEN 1.2::DOUBLE ELSE 1.0 END), 6) AS score FROM n ORDER BY score DESC, id LIMIT {K}""",
)
def temporal_search(t: Tables) -> DataFrame:
    bound = text.temporal_since("what happened last week", datetime.fromisoformat(NOW))
    return retrieval.temporal_search(t.knowledge(), str(bound), NOW, K).select("id", F.round("score", 6).alias("score"))


@query(
    "R12 R13 J21",
    f"""
WITH m AS (SELECT id FROM entities WHERE contains('notes on user_77 and friends', lower(name))),
n AS (SELECT * FROM knowledge WHERE entity_id IN (SELECT id FROM m) ORDER BY source_date DESC, id LIMIT 40)
SELECT id, round(CASE importance WHEN 'critical' THEN 1.0::DOUBLE WHEN 'high' THEN .95::DOUBLE ELSE .85::DOUBLE END / (1 + greatest((epoch_us({_T}) - epoch_us(source_date)) / 86400000000.0, 0) * .05::DOUBLE), 6) AS score
FROM n ORDER BY score DESC, id LIMIT {K}""",
)
def entity_search(t: Tables) -> DataFrame:
    matched = retrieval.match_entities(t.entities(), "notes on user_77 and friends").select(F.col("id").alias("entity_id"))
    return retrieval.entity_search(t.knowledge(), t.mentions(), matched, NOW, K).select("id", F.round("score", 6).alias("score"))


_GRAPH = f"""e AS (SELECT a.entity_id AS a, b.entity_id AS b, count(*) AS n FROM members a JOIN members b ON a.item_id = b.item_id AND a.entity_id < b.entity_id GROUP BY 1, 2),
s AS (SELECT a, b, n FROM e UNION ALL SELECT b, a, n FROM e),
h AS (SELECT b, max(n) AS n FROM s WHERE a IN (3, 4) AND b NOT IN (3, 4) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 30),
c AS (SELECT b AS entity_id, .6::DOUBLE * n / greatest(max(n) OVER (), 1) AS score FROM h UNION ALL SELECT unnest([3, 4]), .9::DOUBLE),
gr AS (SELECT item_id AS id, max(score) AS score FROM members JOIN c USING (entity_id) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT {K})"""


def graph_rank(t: Tables) -> DataFrame:
    members = t.members()
    seeds = members.sparkSession.range(3, 5).select(F.col("id").alias("entity_id"))
    return retrieval.graph_search(members, graph.cooccurrence_edges(members), seeds, K)


@query("R14 J7", f"WITH {_GRAPH} SELECT id, round(score, 6) AS score FROM gr")
def graph_hop_search(t: Tables) -> DataFrame:
    return graph_rank(t).select("id", F.round("score", 6).alias("score"))


_PARTS = """every AS (SELECT id, score, 'semantic' AS s, .45::DOUBLE AS w FROM sem UNION ALL SELECT id, score, 'keyword', .15 FROM kw UNION ALL SELECT id, score, 'graph', .2 FROM gr UNION ALL SELECT id, score, 'fts', .2 FROM ft),
parts AS (SELECT id, s, w * score / max(score) OVER (PARTITION BY s) AS part FROM every),
fused AS (SELECT id, sum(part) AS score, string_agg(DISTINCT s, ',' ORDER BY s) AS strategies FROM parts GROUP BY 1)"""


def _hybrid(t: Tables) -> DataFrame:
    v = t.vectors()
    return retrieval.hybrid(keyword(t), retrieval.nearest(v, v.filter("id = 0"), K, -1.0), graph_rank(t), fts(t), K)


@query("R18 J18 W11", f"WITH {_keyword(WORDS)}, {_fts(FTS)}, {_KNN}, {_GRAPH}, {_PARTS} SELECT id, round(score, 6) AS score, strategies FROM fused ORDER BY fused.score DESC, id LIMIT {K}")
def hybrid_fusion(t: Tables) -> DataFrame:
    return _hybrid(t).select("id", F.round("score", 6).alias("score"), "strategies")


@query("R21", f"WITH {_keyword(WORDS)}, {_fts(FTS)}, {_KNN}, {_GRAPH}, {_PARTS}, r AS (SELECT * FROM fused ORDER BY score DESC, id LIMIT {K}) SELECT count(*) AS results, round(least(1.0::DOUBLE, .4::DOUBLE * least(count(*) / 10.0::DOUBLE, 1.0) + .6::DOUBLE * avg(score)), 6) AS confidence FROM r")
def search_confidence(t: Tables) -> DataFrame:
    return retrieval.confidence(_hybrid(t))


@query(
    "R22",
    f"""
WITH m AS (SELECT id FROM entities WHERE contains('notes on user_77 and friends', lower(name))),
n AS (SELECT * FROM knowledge WHERE entity_id IN (SELECT id FROM m) ORDER BY source_date DESC, id LIMIT 40),
s AS (SELECT source_date FROM n ORDER BY CASE importance WHEN 'critical' THEN 1.0::DOUBLE WHEN 'high' THEN .95::DOUBLE ELSE .85::DOUBLE END / (1 + greatest((epoch_us({_T}) - epoch_us(source_date)) / 86400000000.0, 0) * .05::DOUBLE) DESC, id LIMIT {K})
SELECT CASE WHEN count(*) FILTER (source_date > {_T} - INTERVAL 7 DAY) > count(*) / 2.0 THEN 'fresh' WHEN count(*) FILTER (source_date < {_T} - INTERVAL 30 DAY) > count(*) / 2.0 THEN 'stale' ELSE 'mixed' END AS label, count(*) AS results FROM s""",
)
def search_recency_label(t: Tables) -> DataFrame:
    """The label of a search's results."""
    matched = retrieval.match_entities(t.entities(), "notes on user_77 and friends").select(F.col("id").alias("entity_id"))
    found = retrieval.entity_search(t.knowledge(), t.mentions(), matched, NOW, K).join(t.knowledge().select("id", "source_date"), "id")
    return retrieval.recency_label(found, NOW)


@query("R19", f"WITH {_keyword(WORDS)}, {_fts(FTS)} SELECT id, round(score, 6) AS score FROM kw UNION ALL SELECT id, round(score * .8::DOUBLE, 6) FROM ft WHERE id NOT IN (SELECT id FROM kw)")
def blended_search(t: Tables) -> DataFrame:
    return retrieval.blend_unseen(keyword(t), fts(t), 0.8).select("id", F.round("score", 6).alias("score"))


@query("R20 W9", "SELECT ref, id FROM (SELECT k % 50 AS ref, id, row_number() OVER (PARTITION BY k % 50 ORDER BY value DESC, id) AS place FROM knowledge) WHERE place = 1")
def dedup_by_reference(t: Tables) -> DataFrame:
    return retrieval.dedup_by_ref(t.knowledge().select("id", F.col("value").alias("score"), (F.col("k") % 50).alias("ref")), "ref").select("ref", "id")


@query("R3 P2 R26 P18", "SELECT id, importance FROM texts WHERE (contains(lower(title), 'thorn') OR contains(lower(summary), 'thorn') OR contains(lower(raw_content), 'thorn')) AND project = 'en' ORDER BY CASE importance WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'normal' THEN 2 WHEN 'low' THEN 3 WHEN 'noise' THEN 4 ELSE 5 END, day DESC, id LIMIT 20")
def text_like_search(t: Tables) -> DataFrame:
    from ..functions.time import ordinal
    from ..schema import IMPORTANCE_ORDER

    found = t.texts().filter(text.like_any(["title", "summary", "raw_content"], "thorn") & (F.col("project") == "en"))
    return found.orderBy(ordinal("importance", IMPORTANCE_ORDER), F.desc("day"), "id").limit(20).select("id", "importance")


