"""Queries of searches that read an index: terms, and vectors by coarse centroids."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import postings, retrieval, vectors
from ..operators.postings import TermIndex, shared_index
from ..operators.vectors import VectorIndex
from ..session import is_scratch, scratch
from ..sources.fixtures import TEXT_NOW, Tables
from .catalog import query

K = 20
_FIELDS = ["title", "summary", "contacts", "tags", "raw_content"]


def _items(t: Tables) -> DataFrame:
    """Texts with the contact and the tags that their rows name."""
    contact = F.concat(F.lit("user_"), (F.col("id") % 50).cast("string"))
    return t.texts().select("id", "title", "summary", contact.alias("contacts"), F.concat_ws(" ", "project", "source").alias("tags"), "raw_content", "project", "source", F.col("day").cast("timestamp_ntz").alias("source_date"))


_ITEMS = "items AS (SELECT id, title, summary, 'user_' || (id % 50) AS contacts, concat_ws(' ', project, source) AS tags, raw_content, project, source, day::TIMESTAMP AS source_date FROM texts)"


def words_index(t: Tables) -> TermIndex:
    return shared_index(t.spark, f"words {t.sf_dir}", lambda: _items(t), _FIELDS, ["project", "source", "source_date"])


def letters_index(t: Tables) -> TermIndex:
    return shared_index(t.spark, f"letters {t.sf_dir}", lambda: _items(t).select("id", "raw_content", "project", "source", "source_date"), ["raw_content"], ["project", "source", "source_date"], postings.letters)


_AGE = f"(1 / (1 + greatest((epoch_us(TIMESTAMP '{TEXT_NOW}') - epoch_us(source_date)) / 86400000000.0, 0) * .05::DOUBLE))"
# What a term in a field adds.
BONUSES = {"title": 3.0, "contacts": 2.0, "tags": 1.5, "raw_content": 1.0}
WORDS = "thof user_7 en then"


def _keyword_sql(terms: str) -> str:
    ws = terms.split()
    tf = lambda w: f"len(list_filter(tokens, lambda x: x = '{w}'))"
    score = " + ".join(f"{tf(w)} * 2.5::DOUBLE / ({tf(w)} + 1.5::DOUBLE * (.25 + .75 * n / a))" for w in ws)
    more = "".join(f" + CASE WHEN contains(lower({field}), '{w}') THEN {points} ELSE 0 END" for w in ws for field, points in (("title", "3.0"), ("contacts", "2.0"), ("tags", "1.5"), ("raw_content", "1.0")))
    return f"""{_ITEMS},
cut AS (SELECT *, list_filter(string_split_regex(lower(concat_ws(' ', title, summary, contacts, tags, raw_content)), '\\s+'), lambda w: w <> '') AS tokens FROM items),
sized AS (SELECT *, len(tokens)::DOUBLE AS n, avg(len(tokens)) OVER () AS a FROM cut),
kw AS (SELECT id, ({score}{more}) * {_AGE} AS score FROM sized WHERE {score}{more} > 0 ORDER BY score DESC, id LIMIT {K})"""


@query("R1 R2 A23", f"WITH {_keyword_sql(WORDS)} SELECT id, round(score, 6) AS score FROM kw")
def indexed_keyword_search(t: Tables) -> DataFrame:
    """Terms in the whole text, with bonuses for fields and weighted by age."""
    return words_index(t).keyword_search(WORDS, K, BONUSES, TEXT_NOW, "source_date").select("id", F.round("score", 6).alias("score"))


FTS = "the of and"


def _fts_sql(terms: str, most: int, name: str) -> str:
    ws = sorted(set(terms.split()))
    has = " AND ".join(f"list_contains(tokens, '{w}')" for w in ws)
    df = ", ".join(f"count(*) FILTER (list_contains(tokens, '{w}')) OVER () AS df{i}" for i, w in enumerate(ws))
    tf = lambda w: f"len(list_filter(tokens, lambda x: x = '{w}'))"
    score = " + ".join(f"greatest(ln((c - df{i} + .5::DOUBLE) / (df{i} + .5::DOUBLE)), 1e-6) * ({tf(w)} * 2.2::DOUBLE / ({tf(w)} + 1.2::DOUBLE * (.25 + .75 * n / a)))" for i, w in enumerate(ws))
    return f"""{_ITEMS},
split AS (SELECT *, list_filter(string_split_regex(lower(raw_content), '[^a-z0-9]+'), lambda w: w <> '') AS tokens FROM items),
counted AS (SELECT *, len(tokens)::DOUBLE AS n, avg(len(tokens)) OVER () AS a, count(*) OVER () AS c, {df} FROM split),
{name} AS (SELECT id, project, source, source_date, ({score})::DOUBLE AS score FROM counted WHERE {has} ORDER BY score DESC, id LIMIT {most})"""


@query("R4 J17", f"WITH {_fts_sql(FTS, K, 'ft')} SELECT id, round(score, 6) AS score FROM ft")
def indexed_full_text_search(t: Tables) -> DataFrame:
    return letters_index(t).full_text_search(FTS, K).select("id", F.round("score", 6).alias("score"))


_STRATEGY = f"""{_fts_sql(FTS, 3 * K, 'best')},
kept AS (SELECT * FROM best WHERE project = 'en' AND source_date >= TIMESTAMP '2023-11-01 00:00:00'),
fs AS (SELECT id, score / max(score) OVER () * {_AGE} AS score FROM kept ORDER BY score DESC, id LIMIT {K})"""


@query("R5", f"WITH {_STRATEGY} SELECT id, round(score, 6) AS score FROM fs")
def indexed_full_text_strategy(t: Tables) -> DataFrame:
    """With filters after the ranking, the best made 1, weighted by age."""
    keep = (F.col("project") == "en") & (F.col("source_date") >= F.lit("2023-11-01 00:00:00").cast("timestamp_ntz"))
    return letters_index(t).full_text_strategy(FTS, K, keep, TEXT_NOW, "source_date").select("id", F.round("score", 6).alias("score"))


_VECTORS: dict[tuple, VectorIndex] = {}


def vector_index(t: Tables) -> VectorIndex:
    key = t.spark.sparkContext.applicationId, t.sf_dir
    if key not in _VECTORS or not is_scratch(_VECTORS[key].path):
        _VECTORS[key] = VectorIndex(t.spark, scratch(t.spark, "vectors"), ("project",)).build(t.vectors())
    return _VECTORS[key]


def _of(t: Tables, item: int) -> list[float]:
    return list(t.vectors().filter(F.col("id") == item).first().embedding)


_COS = "list_sum([x.embedding[i] * y.embedding[i] for i in range(1, 65)]) / (sqrt(list_sum([v * v for v in x.embedding])) * sqrt(list_sum([v * v for v in y.embedding])))"


@query("R8 R11", f"SELECT x.id, round({_COS}, 6) AS score FROM vectors x, vectors y WHERE y.id = 3 AND {_COS} >= .1 ORDER BY {_COS} DESC, x.id LIMIT {K}")
def indexed_nearest(t: Tables) -> DataFrame:
    """The nearest of all, exactly, from the lists that may hold them."""
    return vector_index(t).nearest(_of(t, 3), K, 0.1).select("id", F.round("score", 6).alias("score"))


@query(
    "R8",
    f"""
WITH s AS (SELECT y.id AS query, x.id, {_COS} AS score FROM vectors x, vectors y WHERE y.id % 20 = 0)
SELECT query, id, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, id) AS rank FROM s) WHERE rank <= 10""",
)
def indexed_nearest_many(t: Tables) -> DataFrame:
    """The ten nearest of all vectors, for every vector whose id is divisible by 20."""
    found = vector_index(t).nearest_many(t.vectors().filter("id % 20 = 0"), 10)
    return found.select("query", "id", F.round("score", 6).alias("score"), "rank")


@query("R8", "SELECT count(*) AS queries, true AS enough FROM vectors WHERE id % 20 = 0")
def indexed_recall(t: Tables) -> DataFrame:
    """Whether probing four fifths of the lists finds nine tenths of the ten nearest (these
    vectors point anywhere; of clustered ones a few lists do)."""
    index, asked = vector_index(t), t.vectors().filter("id % 20 = 0")
    probes = -(-4 * len(index.centres) // 5)
    return vectors.recall(index.search_many(asked, 10, probes), index.nearest_many(asked, 10)).select("queries", (F.col("recall") >= 0.9).alias("enough"))


_DATED = f"dated AS (SELECT id, TIMESTAMP '{TEXT_NOW}' - to_days((id % 90)::INTEGER) AS source_date FROM vectors)"


@query(
    "R9 R10 W10 J19",
    f"""
WITH {_DATED}, s AS (SELECT x.id, {_COS} AS score FROM vectors x, vectors y WHERE y.id = 3),
direct AS (SELECT id, score FROM s WHERE id % 4 = 0 AND score >= .05 ORDER BY score DESC, id LIMIT {2 * K}),
chunks AS (SELECT id - id % 4 AS id, max(score) AS score FROM s WHERE id % 4 <> 0 AND score >= .05 GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT {2 * K}),
merged AS (SELECT id, max(score) AS score, count(*) = 2 AND max(score) > max(d) OR count(d) = 0 AS by_chunk FROM (SELECT id, score, score AS d FROM direct UNION ALL SELECT id, score, NULL FROM chunks) GROUP BY 1)
SELECT id, round(score * {_AGE}, 6) AS score, by_chunk FROM merged JOIN dated USING (id) WHERE source_date >= TIMESTAMP '2023-12-01 00:00:00' ORDER BY score * {_AGE} DESC, id LIMIT {K}""",
)
def indexed_semantic_strategy(t: Tables) -> DataFrame:
    """Direct hits and the best chunks of their parents, the higher of both, since a day,
    weighted by age.  Of four vectors the first stands for an item, the others for its chunks."""
    scored = vector_index(t).within(_of(t, 3), 0.05).select("id", "score")
    direct = retrieval.top(scored.filter("id % 4 = 0"), 2 * K)
    chunks = retrieval.best_chunk(scored.filter("id % 4 <> 0").select((F.col("id") - F.col("id") % 4).alias("parent"), "score"), 2 * K)
    dated = t.vectors().select("id", (F.lit(TEXT_NOW).cast("timestamp_ntz") - F.make_dt_interval((F.col("id") % 90).cast("int"))).alias("source_date"))
    return retrieval.semantic_strategy(direct, chunks, dated, K, "2023-12-01 00:00:00", TEXT_NOW).select("id", F.round("score", 6).alias("score"), "by_chunk")


@query("G20 G22", f"SELECT * FROM (SELECT x.id AS a, y.id AS b, round({_COS}, 6) AS score FROM vectors x JOIN vectors y ON x.project = y.project AND x.id < y.id) WHERE score > .3")
def alike_pairs(t: Tables) -> DataFrame:
    """Pairs of a project, left out by angles to pivots before any product."""
    return vectors.alike(t.vectors(), 0.3)


@query(
    "G22",
    f"""
WITH p AS (SELECT x.project, x.id AS a, y.id AS b, round({_COS}, 6) AS score FROM vectors x JOIN vectors y ON x.project = y.project AND x.id < y.id),
r AS (SELECT *, row_number() OVER (PARTITION BY project ORDER BY score DESC, a, b) AS place FROM p WHERE score > .2)
SELECT project, a, b, score, place FROM r WHERE place <= 20""",
)
def contradiction_candidates(t: Tables) -> DataFrame:
    """The 20 most alike pairs of each project."""
    pairs = vectors.alike(t.vectors(), 0.2).join(t.vectors().select(F.col("id").alias("a"), "project"), "a")
    place = F.row_number().over(Window.partitionBy("project").orderBy(F.desc("score"), "a", "b"))
    return pairs.withColumn("place", place.cast("long")).filter("place <= 20").select("project", "a", "b", "score", "place")
