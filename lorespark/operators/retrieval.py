"""Ranking of items for a query: term, full-text, vector, graph and time scores,
and their fusion.  A ranking is (id, score)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import tf_saturation, words
from ..functions.time import at, days_between
from ..functions.vector import cosine

K1, B = 1.5, 0.75
FTS_K1, FTS_B = 1.2, 0.75


def recency(date: Column, as_of: str, bias: float = 0.05) -> Column:
    """1 / (1 + days * bias); 1 without a date or bias."""
    if bias <= 0:
        return F.lit(1.0)
    days = F.greatest(days_between(at(as_of), date), F.lit(0.0))
    return F.when(date.isNull(), 1.0).otherwise(1 / (1 + days * bias))


def top(scored: DataFrame, k: int, score: str = "score", tie: str = "id") -> DataFrame:
    """The k best; ties by id, so results can be repeated."""
    return scored.orderBy(F.desc(score), tie).limit(k)


def keyword_search(items: DataFrame, query: str, k: int, text: Column, title: str = "title") -> DataFrame:
    """Saturated term frequencies over a document, plus 3 for each term in the title."""
    terms = query.lower().split()
    docs = items.withColumn("_tokens", words(text))
    average = docs.agg(F.avg(F.size("_tokens")).alias("_average"))
    bonus = F.lit(0.0)
    for term in terms:
        bonus = bonus + F.when(F.lower(title).contains(term), 3.0).otherwise(0.0)
    hit = F.arrays_overlap("_tokens", F.array(*map(F.lit, terms))) | (bonus > 0)
    scored = docs.filter(hit).crossJoin(F.broadcast(average)).withColumn("score", tf_saturation(F.col("_tokens"), terms, F.col("_average"), K1, B) + bonus)
    return top(scored.filter("score > 0").select("id", "score"), k)


def full_text_search(items: DataFrame, query: str, k: int, text: Column) -> DataFrame:
    """All terms must occur; inverse document frequency times saturation."""
    terms = sorted({t for t in query.lower().split() if t})
    tokens = F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda w: w != "")
    docs = items.select("id", tokens.alias("_tokens"))
    has = [F.array_contains("_tokens", t).cast("int") for t in terms]
    stats = docs.agg(F.count("*").alias("_n"), F.avg(F.size("_tokens")).alias("_average"), *(F.sum(h).alias(f"_df{i}") for i, h in enumerate(has)))
    every = F.lit(True)
    for t in terms:
        every = every & F.array_contains("_tokens", t)
    score = F.lit(0.0)
    for i, t in enumerate(terms):
        idf = F.greatest(F.log((F.col("_n") - F.col(f"_df{i}") + 0.5) / (F.col(f"_df{i}") + 0.5)), F.lit(1e-6))
        score = score + idf * tf_saturation(F.col("_tokens"), [t], F.col("_average"), FTS_K1, FTS_B)
    return top(docs.filter(every).crossJoin(F.broadcast(stats)).select("id", score.alias("score")), k)  # stats is one row


def similarities(vectors: DataFrame, query: DataFrame) -> DataFrame:
    """The cosine of every vector with the one of ``query`` (one row)."""
    one = F.broadcast(query.select(F.col("embedding").alias("_query")).limit(1))
    return vectors.crossJoin(one).select("id", cosine(F.col("embedding"), F.col("_query")).alias("score"))


def nearest(vectors: DataFrame, query: DataFrame, k: int, threshold: float) -> DataFrame:
    """The k vectors of the greatest cosine, of those at least at the threshold."""
    return top(similarities(vectors, query).filter(F.col("score") >= threshold), k)


def similar_items(vectors: DataFrame, item: int, k: int, threshold: float) -> DataFrame:
    """Neighbours of a stored item, itself aside."""
    return nearest(vectors.filter(F.col("id") != item), vectors.filter(F.col("id") == item), k, threshold)


def best_chunk(chunk_scores: DataFrame, k: int) -> DataFrame:
    """Each parent's best chunk."""
    return top(chunk_scores.groupBy("parent").agg(F.max("score").alias("score")).withColumnRenamed("parent", "id"), k)


def semantic_strategy(direct: DataFrame, chunks: DataFrame, items: DataFrame, k: int, since: str | None, as_of: str, bias: float = 0.05) -> DataFrame:
    """Direct hits and parents of hit chunks (both id, score), the higher score of both,
    since a day, weighted by age; ``by_chunk`` where the chunk's counts."""
    merged = direct.select("id", F.col("score").alias("own")).join(chunks.select("id", F.col("score").alias("chunk")), "id", "full_outer")
    dated = items.select("id", "source_date")
    if since is not None:
        dated = dated.filter(F.col("source_date") >= at(since))
    by_chunk = F.col("own").isNull() | F.coalesce(F.col("chunk") > F.col("own"), F.lit(False))
    score = F.greatest("own", "chunk") * recency(F.col("source_date"), as_of, bias)
    return top(merged.join(dated, "id").select("id", score.alias("score"), by_chunk.alias("by_chunk")), k)


def temporal_search(items: DataFrame, since: str, as_of: str, k: int) -> DataFrame:
    """Newest first; .9 within a week, then falling to .1, more for importance."""
    days = days_between(at(as_of), F.col("source_date"))
    base = F.when(days <= 7, 0.9).otherwise(F.greatest(F.lit(0.1), 1 - days / 90))
    weight = F.when(F.col("importance") == "critical", 1.5).when(F.col("importance") == "high", 1.2).otherwise(1.0)
    newest = items.filter(F.col("source_date") >= at(since)).orderBy(F.desc("source_date"), "id").limit(2 * k)
    return top(newest.select("id", F.least(F.lit(1.0), base * weight).alias("score")), k)


def entity_search(items: DataFrame, mentions: DataFrame, matched: DataFrame, as_of: str, k: int, bias: float = 0.05) -> DataFrame:
    """Items that mention a matched entity (``entity_id``), by importance and age."""
    base = F.when(F.col("importance") == "critical", 1.0).when(F.col("importance") == "high", 0.95).otherwise(0.85)
    ids = mentions.join(matched, "entity_id", "left_semi").select(F.col("item_id").alias("id")).distinct()
    latest = items.join(ids, "id", "left_semi").orderBy(F.desc("source_date"), "id").limit(2 * k)
    return top(latest.select("id", (base * recency(F.col("source_date"), as_of, bias)).alias("score")), k)


def graph_search(members: DataFrame, edges: DataFrame, seeds: DataFrame, k: int, fan: int = 30) -> DataFrame:
    """Items of the seed entities (.9) and of their ``fan`` strongest neighbours
    (.6 times the edge's share of the strongest), the best score of each item.

    ``members``: item_id, entity_id; ``edges``: a, b, n; ``seeds``: entity_id."""
    both = edges.select("a", "b", "n").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"), "n"))
    near = both.join(seeds, F.col("a") == F.col("entity_id"), "left_semi").groupBy("b").agg(F.max("n").alias("n"))
    near = near.join(seeds, F.col("b") == F.col("entity_id"), "left_anti").orderBy(F.desc("n"), "b").limit(fan)
    strongest = near.agg(F.greatest(F.max("n"), F.lit(1)).alias("most"))
    hop = near.crossJoin(F.broadcast(strongest)).select(F.col("b").alias("entity_id"), (0.6 * F.col("n") / F.col("most")).alias("score"))
    scored = seeds.select("entity_id", F.lit(0.9).alias("score")).unionByName(hop)
    return top(members.join(scored, "entity_id").groupBy(F.col("item_id").alias("id")).agg(F.max("score").alias("score")), k)


def graph_expansion(members: DataFrame, edges: DataFrame, seeds: DataFrame, threads: DataFrame, items: DataFrame, as_of: str, k: int, fans: tuple[int, ...] = (30, 20), bases: tuple[float, ...] = (0.6, 0.3), since: str | None = None, bias: float = 0.05) -> DataFrame:
    """Items of the seeds (.9), then of a frontier that carries its scores outwards: each hop
    takes the strongest edges of the last one's entities, and gives the new entities their
    edge's share of the hop's strongest; an item has the score of the nearest hop that names
    it, the best there.  Siblings in threads are added, then age weighs.

    ``members``: item_id, entity_id; ``edges``: a, b, n; ``seeds``: entity_id; ``threads``:
    thread_id, id; ``items``: id, source_date.  A frontier has as many entities as its fan."""
    seen = seeds.select("entity_id").distinct()
    frontier, reached = seen, seen.select("entity_id", F.lit(0).alias("hop"), F.lit(0.9).alias("score"))
    for hop, (fan, base) in enumerate(zip(fans, bases, strict=True), 1):
        ends = lambda c: F.broadcast(frontier).select(F.col("entity_id").alias(c), F.lit(True).alias(f"at_{c}"))  # noqa: B023, E731
        touched = edges.select("a", "b", "n").join(ends("a"), "a", "left").join(ends("b"), "b", "left").filter("at_a OR at_b")
        strong = touched.orderBy(F.desc("n"), "a", "b").limit(fan)
        far = strong.select(F.when(F.col("at_a"), F.col("b")).otherwise(F.col("a")).alias("entity_id"), "n").join(F.broadcast(seen), "entity_id", "left_anti")
        new = far.groupBy("entity_id").agg(F.max("n").alias("n"))
        most = new.agg(F.greatest(F.max("n"), F.lit(1)).alias("most"))
        new = new.crossJoin(F.broadcast(most)).select("entity_id", F.lit(hop).alias("hop"), (base * F.col("n") / F.col("most")).alias("score"))  # one row
        frontier = new.select("entity_id")
        seen, reached = seen.unionByName(frontier), reached.unionByName(new)
    named = members.join(F.broadcast(reached), "entity_id").groupBy(F.col("item_id").alias("id")).agg(F.min(F.struct("hop", (-F.col("score")).alias("less"))).alias("m"))
    scored = thread_bonus(named.select("id", (-F.col("m.less")).alias("score")), threads)
    dated = items.select("id", "source_date") if since is None else items.select("id", "source_date").filter(F.col("source_date") >= at(since))
    return top(scored.join(dated, "id").select("id", (F.col("score") * recency(F.col("source_date"), as_of, bias)).alias("score")), k)


def thread_bonus(ranked: DataFrame, threads: DataFrame) -> DataFrame:
    """Siblings in the threads (``thread_id, id``) of ranked items: .15 more for
    each shared thread, .55 for a first one of an item that is new; at most 1."""
    near = threads.join(ranked.select("id"), "id", "left_semi").select("thread_id").distinct()
    shared = threads.join(near, "thread_id").groupBy("id").agg(F.countDistinct("thread_id").alias("n"))
    score = F.coalesce(F.col("score") + 0.15 * F.coalesce("n", F.lit(0)), 0.55 + 0.15 * (F.col("n") - 1))
    return ranked.join(shared, "id", "full_outer").select("id", F.least(F.lit(1.0), score).alias("score"))


def fuse(rankings: dict[str, DataFrame], weights: dict[str, float], k: int) -> DataFrame:
    """Each ranking over its own best, weighted and summed."""
    every = None
    for name, ranked in rankings.items():
        own = ranked.select("id", "score").withColumn("strategy", F.lit(name))
        every = own if every is None else every.unionByName(own)
    best = every.groupBy("strategy").agg(F.max("score").alias("best"))
    weight = F.lit(0.0)
    for name, w in weights.items():
        weight = F.when(F.col("strategy") == name, w).otherwise(weight)
    scaled = every.join(F.broadcast(best), "strategy").withColumn("part", weight * F.col("score") / F.nullif("best", F.lit(0.0)))  # best: a row a strategy
    return top(scaled.groupBy("id").agg(F.sum("part").alias("score"), F.array_join(F.sort_array(F.collect_set("strategy")), ",").alias("strategies")), k)


def hybrid(keyword: DataFrame, semantic: DataFrame | None, graph: DataFrame, fts: DataFrame, k: int) -> DataFrame:
    if semantic is None:
        return fuse({"keyword": keyword, "graph": graph, "fts": fts}, {"keyword": 0.25, "graph": 0.35, "fts": 0.40}, k)
    return fuse({"keyword": keyword, "semantic": semantic, "graph": graph, "fts": fts}, {"semantic": 0.45, "keyword": 0.15, "graph": 0.20, "fts": 0.20}, k)


def blend_unseen(ranked: DataFrame, more: DataFrame, factor: float) -> DataFrame:
    """Append what a second ranking has and the first lacks, at a discount."""
    return ranked.select("id", "score").unionByName(more.join(ranked, "id", "left_anti").select("id", (F.col("score") * factor).alias("score")))


def dedup_by_ref(ranked: DataFrame, ref: str = "source_ref") -> DataFrame:
    """The best row of each reference; rows without one stand for themselves."""
    key = F.coalesce(F.col(ref).cast("string"), F.concat(F.lit("id:"), F.col("id").cast("string")))
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("score"), "id"))
    return ranked.withColumn("_rank", rank).filter("_rank = 1").drop("_rank")


def confidence(ranked: DataFrame) -> DataFrame:
    """.4 for ten results and .6 times the mean score, at most 1."""
    value = F.least(F.lit(1.0), 0.4 * F.least(F.count("*") / 10, F.lit(1.0)) + 0.6 * F.coalesce(F.avg("score"), F.lit(0.0)))
    return ranked.agg(F.count("*").alias("results"), F.round(value, 6).alias("confidence"))


def recency_label(ranked: DataFrame, as_of: str) -> DataFrame:
    """fresh if over half are under 7 days old, stale if over half are over 30."""
    days = days_between(at(as_of), F.col("source_date"))
    n, young, old = F.count("*"), F.count_if(days < 7), F.count_if(days > 30)
    return ranked.agg(F.when(young > n / 2, "fresh").when(old > n / 2, "stale").otherwise("mixed").alias("label"), n.alias("results"))


def rerank(ranked: DataFrame, given: DataFrame) -> DataFrame:
    """Positions given from outside (``id, rank``) first, the rest in their order;
    ``place`` numbers the result."""
    position = F.row_number().over(Window.orderBy(F.desc("score"), "id"))  # a page of results
    own = ranked.withColumn("position", position).join(given, "id", "left")
    place = F.row_number().over(Window.orderBy(F.coalesce(F.col("rank"), F.col("position") + 1_000_000), "position"))
    return own.withColumn("place", place.cast("long")).drop("position", "rank")


def first_contact(entities: DataFrame, query: str) -> DataFrame:
    """The contact whose name stands first in the query, the longest of several there."""
    at = F.instr(F.lit(query.lower()), F.lower("name"))
    return entities.filter((F.length("name") > 0) & (at > 0)).orderBy(at, F.desc(F.length("name")), "id").limit(1)


def match_entities(entities: DataFrame, query: str) -> DataFrame:
    """Entities whose full name the query contains, or one of whose parts of three
    or more letters it has as a term."""
    terms = query.lower().split()
    parts = F.filter(F.split(F.lower("name"), " "), lambda p: F.length(p) >= 3)
    return entities.filter(F.lit(query.lower()).contains(F.lower("name")) | F.arrays_overlap(parts, F.array(*map(F.lit, terms))))


def passages(text: Column, needle: str, around: int = 250, most: int = 5) -> Column:
    """Windows of ``around`` characters on both sides of the first hits of a word (in any
    case), which don't overlap; windows may."""
    n = len(needle)
    parts = F.split(F.lower(text), "\\Q" + needle.lower() + "\\E", -1)
    step = lambda s, p: F.struct((s["at"] + F.length(p) + n).alias("at"), F.concat(s["found"], F.array(s["at"] + F.length(p))).alias("found"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("found"))
    hits = F.aggregate(F.slice(parts, 1, F.least(F.size(parts) - 1, F.lit(most))), start, step, lambda s: s["found"])

    def window(at: Column) -> Column:
        first = F.greatest(at - around, F.lit(0))
        return F.substring(text, first + 1, F.least(at + n + around, F.length(text)) - first)

    return F.when(F.size(parts) > 1, F.transform(hits, window)).otherwise(F.array().cast("array<string>"))


def head_and_tail(text: Column, whole: int = 1500, part: int = 800) -> Column:
    """A long text's begin and end, and how much is left out."""
    gap = F.concat(F.lit("...["), (F.length(text) - 2 * part).cast("string"), F.lit(" chars omitted]..."))
    return F.when(F.length(text) <= whole, text).otherwise(F.concat(F.substring(text, 1, part), gap, F.right(text, F.lit(part))))


def page(text: Column, offset: int, limit: int) -> Column:
    return F.substring(text, offset + 1, limit)


def artifact_search(artifacts: DataFrame, needle: str) -> DataFrame:
    """Of the latest versions, those with the words in title or content."""
    from ..functions.text import like_any

    return artifacts.filter(F.col("is_latest") & like_any(["title", "content"], needle))


def title_links(texts: DataFrame, message: DataFrame, least: int = 2, sure: int = 3) -> DataFrame:
    """(id, relevance) of texts (``id, title``) of which a message (one row, ``message``)
    holds two title words of over three letters; three make it sure."""
    ws = F.array_distinct(F.filter(F.split(F.regexp_replace(F.lower("title"), "[^a-z0-9 ]", ""), " "), lambda w: F.length(w) > 3))
    one = F.broadcast(message.select(F.lower("message").alias("_said")).limit(1))
    hits = F.size(F.filter(ws, lambda w: F.col("_said").contains(w)))
    return texts.crossJoin(one).withColumn("_hits", hits).filter(F.col("_hits") >= least).select("id", F.when(F.col("_hits") >= sure, 1.0).otherwise(0.7).alias("relevance"))  # one row
