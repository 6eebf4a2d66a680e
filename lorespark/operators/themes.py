"""Facts merged by likeness and gathered into themes."""

from __future__ import annotations

import math
import random
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vector import dot
from .graph import components

#: Members of a group that are clustered together; larger ones are cut first.
CELL = 5_000
#: Centroids that small themes are compared with at a time (64 kB to 1 MB a thousand).
CENTROIDS = 10_000

# A theme is split above, and absorbed below, so many members.
MOST, LEAST, NEAR = 20, 3, 0.5


def merged_facts(facts: DataFrame, alike: DataFrame) -> DataFrame:
    """Facts (``id, items``) joined over pairs of alike ones (``a, b``): the smallest id
    stands for a component, with the items of all."""
    part = components(alike)
    own = facts.join(part, F.col("id") == F.col("node"), "left").withColumn("id", F.coalesce("component", "id"))
    each = own.select("id", F.explode_outer("items").alias("item")).distinct()
    return each.groupBy("id").agg(F.sort_array(F.collect_list("item")).alias("items"))


def cosine_kmeans(vectors: np.ndarray, k: int, seed: int = 1, iterations: int = 20) -> np.ndarray:
    """Clusters of unit vectors by cosine, from ``k`` members drawn with a seed; as many
    clusters as vectors if these are no more than ``k``."""
    n = len(vectors)
    if n <= k:
        return np.arange(n)
    length = np.linalg.norm(vectors, axis=1, keepdims=True)
    unit = vectors / np.where(length > 0, length, 1)
    centres = unit[sorted(random.Random(seed).sample(range(n), k))]
    label = np.full(n, -1)
    for _ in range(iterations):
        new = (unit @ centres.T).round(9).argmax(axis=1)
        if (new == label).all():
            break
        label = new
        for c in range(k):
            if (label == c).any():
                mean = vectors[label == c].mean(axis=0)
                centres[c] = mean / (np.linalg.norm(mean) or 1)
    return label


def _clustered(size: str, least: int):
    """Clusters of each group that needs them, named after the group."""

    def work(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("id")
        wanted = math.ceil(len(rows) / 10) if size == "split" else max(1, min(math.ceil(len(rows) / 5), 5))
        with_vector = rows[rows.embedding.notna()]
        theme = rows.theme.astype(str)
        if len(with_vector) >= least:
            label = cosine_kmeans(np.stack(with_vector.embedding.to_list()).astype(float), wanted)
            theme.loc[with_vector.index] = [f"{t}:{size}{c}" for t, c in zip(with_vector.theme, label, strict=True)]
            theme.loc[rows.index.difference(with_vector.index)] = f"{rows.theme.iloc[0]}:{size}0"
        return pd.DataFrame({"id": rows.id, "theme": theme})

    return work


def _cells(facts: DataFrame) -> DataFrame:
    """Themes with more than ``CELL`` members, cut into smaller ones by the sides of
    seeded planes on which their vectors lie and then, where these agree, by id."""
    sizes = facts.groupBy("theme").agg(F.count("*").alias("n"))
    large = sizes.filter(F.col("n") > CELL)
    if not large.take(1):
        return facts
    width = facts.filter("embedding is not null").select(F.size("embedding").alias("d")).first()
    planes = np.random.default_rng(7).normal(size=(16, width.d if width else 1)).round(6).tolist()
    need = F.ceil(F.log2(F.col("n") / CELL)).cast("int") + 1
    side = F.concat(*(F.when(F.lit(i) >= need, "").otherwise((dot(F.col("embedding"), F.array(*map(F.lit, p))) > 0).cast("int").cast("string")) for i, p in enumerate(planes)))
    cut = facts.join(large, "theme").withColumn("theme", F.concat_ws("|", "theme", F.coalesce(side, F.lit("")))).drop("n")
    place = F.floor((F.row_number().over(Window.partitionBy("theme", F.pmod(F.xxhash64("id"), F.lit(64))).orderBy("id")) - 1) * 64 / CELL)
    cut = cut.withColumn("theme", F.concat_ws("|", "theme", place.cast("string")))
    return facts.join(large, "theme", "left_anti").unionByName(cut.select(*facts.columns))


def themes(facts: DataFrame) -> DataFrame:
    """(id, theme) of facts (``id, project, embedding``).

    Facts of a project are a theme; those of none are clustered, in as many as a fifth of
    them, five at most (or are one theme if fewer than three have vectors).  A theme of
    more than ``MOST`` is split into clusters of about ten (if four have vectors); one of
    fewer than ``LEAST`` joins the theme of at least ``LEAST`` whose centroid is nearest
    to its first member, if the cosine is above ``NEAR``.  Seeds are fixed and ties go by
    id or name; a theme too large for one task is cut into cells before it is split."""
    schema = "id long, theme string"
    own = facts.select(F.col("id").cast("long").alias("id"), F.col("project").cast("string").alias("theme"), "embedding")
    rest = own.filter("theme is null").withColumn("theme", F.lit("misc"))
    loose = _cells(rest).groupBy("theme").applyInPandas(_clustered("cluster", 3), schema)
    named = own.filter("theme is not null").unionByName(loose.join(own.select("id", "embedding"), "id").select("id", "theme", "embedding"))
    sized = named.withColumn("n", F.count("*").over(Window.partitionBy("theme")))
    large = _cells(sized.filter(F.col("n") > MOST).select("id", "theme", "embedding"))
    split = large.groupBy("theme").applyInPandas(_clustered("split", 4), schema)
    small = sized.filter(F.col("n") < LEAST)
    kept = sized.filter(F.col("n").between(LEAST, MOST)).select("id", "theme").unionByName(split)

    means = kept.join(own.select("id", "embedding"), "id").filter("embedding is not null")
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    means = means.groupBy("theme").agg(Summarizer.mean(array_to_vector("embedding")).alias("mean"), F.count("*").alias("n")).filter(F.col("n") >= LEAST)
    means = means.select("theme", vector_to_array("mean").alias("mean"))
    first = small.groupBy("theme").agg(F.min_by("embedding", "id").alias("embedding"))
    blocks = max(1, math.ceil(means.count() / CENTROIDS))
    best = first.select("theme", "embedding", F.lit(None).cast("string").alias("into"), F.lit(None).cast("double").alias("near"))
    for b in range(blocks):
        part = means.filter(F.pmod(F.xxhash64("theme"), F.lit(blocks)) == b).orderBy("theme").collect()
        if part:
            best = best.mapInArrow(_nearest(first.sparkSession.sparkContext.broadcast(([r.theme for r in part], np.array([r["mean"] for r in part])))), best.schema)
    moved = best.filter(F.col("near") > NEAR).select("theme", "into")
    joined = small.select("id", "theme").join(moved, "theme", "left").select("id", F.coalesce("into", "theme").alias("theme"))
    return kept.unionByName(joined)


def _nearest(centroids):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, means = centroids.value
        length = np.linalg.norm(means, axis=1, keepdims=True)
        unit = means / np.where(length > 0, length, 1)
        for batch in batches:
            into, near = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            for i, v in enumerate(batch.column(1).to_pylist()):
                size = np.linalg.norm(v) if v is not None else 0
                if size:
                    score = (unit @ (np.array(v, float) / size)).round(9)
                    k = int(score.argmax())
                    if near[i] is None or score[k] > near[i] or (score[k] == near[i] and names[k] < into[i]):
                        into[i], near[i] = names[k], float(score[k])
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(into, pa.string()), pa.array(near, pa.float64())], batch.schema.names)

    return work
