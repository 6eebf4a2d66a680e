"""A partitioned vector index: lists by coarse centroid, probes, exact answers by bounds;
and joins of like vectors that leave out pairs by their angles to pivots.

Centroids are fitted on at most ``SAMPLE`` vectors (those of the smallest hashes), all
vectors are indexed.  A list knows the greatest angle of its vectors to its centroid, so
no vector of it is nearer to a query than the query's angle to the centroid less that:
lists beyond the k-th best found so far can't matter, and leaving them out is exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.vector import cosine
from .retrieval import top

#: Vectors that centroids are fitted on, at most; lists, at most; rounds of fitting.
SAMPLE, MOST_LISTS, ROUNDS = 20_000, 4096, 8
#: Vectors, or queries, of a block that is multiplied with another.
BLOCK = 4_000


def unit(rows: list) -> np.ndarray:
    x = np.array(rows, np.float64)
    length = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, length, out=np.zeros_like(x), where=length > 0)


def angles(cosines: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(cosines, -1, 1))


def fit_centroids(sample: np.ndarray, lists: int, seed: int = 7) -> np.ndarray:
    """Spherical k-means; an empty list keeps its centroid."""
    centres = sample[np.random.default_rng(seed).choice(len(sample), lists, replace=False)]
    for _ in range(ROUNDS):
        own = (sample @ centres.T).argmax(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, sample)
        some = np.linalg.norm(sums, axis=1) > 0
        centres = np.where(some[:, None], unit(sums), centres)
    return centres


def with_angles(vectors: DataFrame, pivots: np.ndarray, name: str = "angles") -> DataFrame:
    """The vectors that have a length, with their angles to all pivots."""
    shared = vectors.sparkSession.sparkContext.broadcast(pivots)  # at most MOST_LISTS vectors
    place = vectors.columns.index("embedding")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = unit(batch.column(place).to_pylist())
            found = angles(x @ shared.value.T)
            arrays = [*batch.columns, pa.array(list(found), pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(arrays, [*batch.schema.names, name])

    some = F.exists("embedding", lambda v: v != 0) & F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v))
    held = vectors.filter(F.col("embedding").isNotNull() & some)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in vectors.schema.fields)
    return held.mapInArrow(work, f"{fields}, {name} array<double>")


def sample_of(vectors: DataFrame, most: int) -> np.ndarray:
    some = F.exists("embedding", lambda v: v != 0) & F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v))
    rows = vectors.filter(F.col("embedding").isNotNull() & some).orderBy(F.xxhash64("id"), "id").select("embedding").limit(most).collect()
    return unit([r.embedding for r in rows]) if rows else np.zeros((0, 1))


class VectorIndex:
    """Vectors (``id``, ``embedding``, and the columns ``kept``) in folders by list."""

    def __init__(self, spark: SparkSession, path: str, kept: tuple[str, ...] = ()):
        self.spark, self.path, self.kept = spark, path.rstrip("/"), list(kept)
        self.centres, self.radii, self.sizes = np.zeros((0, 1)), np.zeros(0), np.zeros(0, int)

    def build(self, vectors: DataFrame, lists: int | None = None, sample: int = SAMPLE) -> VectorIndex:
        rows = vectors.select("id", "embedding", *self.kept)
        found = sample_of(rows, sample)
        n = min(MOST_LISTS, len(found), lists or max(1, int(rows.count() ** 0.5)))
        self.centres = fit_centroids(found, n) if n else found
        near = F.array_min("angles")
        listed = with_angles(rows, self.centres).select("id", "embedding", *self.kept, (F.array_position("angles", near) - 1).cast("int").alias("list"), near.alias("angle"))
        listed.hint("rebalance", "list").write.partitionBy("list").parquet(f"{self.path}/lists")
        return self._measure()

    def _measure(self) -> VectorIndex:
        self.radii, self.sizes = np.zeros(len(self.centres)), np.zeros(len(self.centres), int)
        if len(self.centres):
            for r in self.lists().groupBy("list").agg(F.max("angle").alias("most"), F.count("*").alias("n")).collect():  # a row a list
                self.radii[r.list], self.sizes[r.list] = r.most, r.n
        return self

    def lists(self, some: list[int] | None = None) -> DataFrame:
        """Vectors of some lists: the folders of others aren't read."""
        rows = self.spark.read.parquet(f"{self.path}/lists")
        return rows if some is None else rows.filter(F.col("list").isin(some))

    def _to_centres(self, query: list[float]) -> np.ndarray:
        return angles(unit([query]) @ self.centres.T)[0]

    def _scored(self, query: list[float], some: list[int]) -> DataFrame:
        said = F.array(*(F.lit(float(v)) for v in query))
        return self.lists(some).select("id", *self.kept, cosine(F.col("embedding"), said).alias("score"))

    def search(self, query: list[float], k: int, probes: int, threshold: float = -1.0) -> DataFrame:
        """The k nearest of the ``probes`` nearest lists, and of further lists while these
        hold fewer than k vectors."""
        order = np.argsort(self._to_centres(query), kind="stable")
        enough = int(np.searchsorted(np.cumsum(self.sizes[order]), k)) + 1
        return top(self._scored(query, order[: max(probes, enough)].tolist()).filter(F.col("score") >= threshold), k)

    def within(self, query: list[float], threshold: float) -> DataFrame:
        """All vectors of at least that cosine, from the lists that may have some."""
        away = self._to_centres(query) - self.radii
        some = np.flatnonzero(away <= np.arccos(np.clip(threshold, -1, 1)) + 1e-9).tolist()
        return self._scored(query, some).filter(F.col("score") >= threshold)

    def nearest(self, query: list[float], k: int, threshold: float = -1.0, probes: int = 4) -> DataFrame:
        """The k nearest of all: the k-th best of a few lists bounds which others count."""
        best = self.search(query, k, probes, threshold).agg(F.count("*").alias("n"), F.min("score").alias("least")).first()
        return top(self.within(query, max(threshold, best.least) if best.n == k else threshold), k)

    # Many queries ----------------------------------------------------------

    def _asked(self, queries: DataFrame) -> DataFrame:
        """(query, embedding, bounds): how near a vector of each list can be at best."""
        radii = F.array(*(F.lit(float(r)) for r in self.radii))
        asked = with_angles(queries.select("id", "embedding"), self.centres)
        return asked.select(F.col("id").alias("query"), "embedding", F.zip_with("angles", radii, lambda a, r: F.cos(F.greatest(a - r, F.lit(0.0)))).alias("bounds"), F.col("angles"))

    def _answer(self, asked: DataFrame, k: int) -> DataFrame:
        """The k best of each (query, list) of ``asked`` (query, embedding, list): blocks of
        a list against blocks of its queries."""
        asked = asked.withColumn("part", F.pmod(F.xxhash64("query"), F.lit(1 << 20)))
        load = asked.groupBy("list").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("parts"))
        blocks = F.array(*(F.lit(int(-(-n // BLOCK))) for n in self.sizes))
        mine = asked.join(load, "list").select("list", "query", "embedding", F.pmod("part", "parts").cast("int").alias("part"), F.explode(F.sequence(F.lit(0), F.element_at(blocks, F.col("list") + 1) - 1)).alias("block"))
        theirs = self.lists().join(load, "list").select("list", "id", "embedding", F.pmod(F.xxhash64("id"), F.element_at(blocks, F.col("list") + 1)).cast("int").alias("block"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
        key = ["list", "block", "part"]
        kinds = {f.name: f.dataType.simpleString() for f in [*asked.schema, *self.lists().schema]}
        found = mine.groupBy(*key).cogroup(theirs.groupBy(*key)).applyInPandas(_best_of(k), f"query {kinds['query']}, id {kinds['id']}, score double")
        return found

    def search_many(self, queries: DataFrame, k: int, probes: int) -> DataFrame:
        """(query, id, score, rank) of the k nearest in each query's ``probes`` nearest lists."""
        order = F.array_sort(F.transform("angles", lambda a, i: F.struct(a.alias("a"), i.alias("list"))))
        asked = self._asked(queries).select("query", "embedding", F.explode(F.slice(F.transform(order, lambda x: x["list"]), 1, probes)).alias("list"))
        return _ranked(self._answer(asked, k), k)

    def nearest_many(self, queries: DataFrame, k: int, probes: int = 2) -> DataFrame:
        """(query, id, score, rank) of the k nearest of all vectors: after a first search, a
        query goes on to just the lists whose bound reaches its k-th best."""
        first = self.search_many(queries, k, probes)
        least = first.groupBy("query").agg(F.when(F.count("*") == k, F.min("score")).otherwise(-1.0).alias("least"))
        asked = self._asked(queries).join(least, "query", "left").select("query", "embedding", F.posexplode("bounds").alias("list", "bound"), F.coalesce("least", F.lit(-1.0)).alias("least"))
        return _ranked(self._answer(asked.filter(F.col("bound") >= F.col("least") - 1e-9).select("query", "embedding", "list"), k), k)


def _ranked(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "id"))  # k rows a list and block at most
    return found.withColumn("rank", rank.cast("long")).filter(F.col("rank") <= k)


def _best_of(k: int):
    def work(queries: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        if not len(queries) or not len(rows):
            return pd.DataFrame({"query": queries["query"][:0], "id": rows["id"][:0], "score": np.zeros(0)})
        score = unit(queries["embedding"].to_list()) @ unit(rows["embedding"].to_list()).T
        n = min(k, len(rows))
        kept = np.sort(-score, axis=1)[:, n - 1]
        at = np.nonzero(score >= -kept[:, None] - 1e-12)  # ties of the last go on too
        return pd.DataFrame({"query": queries["query"].to_numpy()[at[0]], "id": rows["id"].to_numpy()[at[1]], "score": score[at]})

    return work


def recall(found: DataFrame, right: DataFrame) -> DataFrame:
    """``queries, recall``: the share of the right neighbours (query, id) that were found."""
    hit = right.select("query", "id").join(found.select("query", "id", F.lit(1).alias("hit")), ["query", "id"], "left")
    return hit.agg(F.countDistinct("query").alias("queries"), (F.count("hit") / F.count("*")).alias("recall"))


# Joins ------------------------------------------------------------------------

#: Vectors that others' angles are measured to; width of a shell around one.
PIVOTS, SHELL = 12, 0.1


def pivot_blocks(vectors: DataFrame) -> DataFrame:
    """(p, block, id, embedding, angles): vectors of a project (``p``) by their nearest pivot,
    its shell, and blocks of bounded size."""
    pivots = sample_of(vectors, PIVOTS)
    if not len(pivots):
        pivots = np.ones((1, 1))
    near = F.array_min("angles")
    placed = with_angles(vectors.select("id", "p", "embedding"), pivots).withColumn("cell", F.array_position("angles", near) * 100 + F.floor(near / SHELL))
    sizes = placed.groupBy("p", "cell").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("parts"))
    return placed.join(sizes, ["p", "cell"]).select("p", (F.col("cell") * (1 << 24) + F.pmod(F.xxhash64("id"), F.col("parts"))).alias("block"), "id", "embedding", "angles")


def block_pairs(blocks: DataFrame, threshold: float) -> DataFrame:
    """(p, i, j, n): the pairs of blocks that may hold a pair above the threshold, and how
    many pairs of vectors they have: by the triangle inequality, two vectors' angles to any
    pivot differ by no more than the angle between them."""
    each = blocks.groupBy("p", "block").agg(F.count("*").alias("n"), *(f(F.element_at("angles", F.lit(i + 1))).alias(f"{name}{i}") for i in range(PIVOTS) for f, name in ((F.min, "low"), (F.max, "high"))))
    each = each.select("p", "block", "n", *(F.array(*(F.col(f"{name}{i}") for i in range(PIVOTS))).alias(name) for name in ("low", "high")))
    other = each.select("p", F.col("block").alias("j"), F.col("n").alias("m"), F.col("low").alias("low_j"), F.col("high").alias("high_j"))
    met = each.withColumnRenamed("block", "i").join(other, "p").filter("i <= j")
    apart = F.array_max(F.zip_with(F.zip_with("low", "high_j", lambda a, b: a - b), F.zip_with("low_j", "high", lambda a, b: a - b), lambda a, b: F.greatest(a, b)))
    near = F.coalesce(apart, F.lit(0.0)) <= float(np.arccos(np.clip(threshold, -1, 1))) + 1e-9
    return met.filter(near).select("p", "i", "j", F.when(F.col("i") == F.col("j"), F.col("n") * (F.col("n") - 1) / 2).otherwise(F.col("n") * F.col("m")).cast("long").alias("n"))


def alike(vectors: DataFrame, threshold: float) -> DataFrame:
    """(a, b, score), a < b: pairs of one project (or of none) with a cosine above the
    threshold.  A vector goes to just the pairs of blocks that may hold some."""
    own = vectors.select("id", F.coalesce(F.col("project").cast("string"), F.lit("")).alias("p"), "embedding")
    blocks = pivot_blocks(own)
    pairs = block_pairs(blocks, threshold).select("p", "i", "j")
    ends = pairs.select("p", F.col("i").alias("block"), "i", "j").unionByName(pairs.filter("i < j").select("p", F.col("j").alias("block"), "i", "j"))
    sent = blocks.select("p", "block", "id", "embedding").join(ends, ["p", "block"])
    kind = vectors.schema["id"].dataType.simpleString()
    return sent.groupBy("p", "i", "j").applyInPandas(_products(threshold), f"a {kind}, b {kind}, score double")


def _products(threshold: float):
    def work(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("id")
        i, j = rows.i.iloc[0], rows.j.iloc[0]
        left, right = rows[rows.block == i], rows[rows.block == j]
        score = (unit(left.embedding.to_list()) @ unit(right.embedding.to_list()).T).round(6)
        x, y = left.id.to_numpy(), right.id.to_numpy()
        at = np.nonzero((score > threshold) & ((x[:, None] < y[None]) if i == j else np.ones_like(score, bool)))
        a, b = x[at[0]], y[at[1]]
        return pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b), "score": score[at]})

    return work
