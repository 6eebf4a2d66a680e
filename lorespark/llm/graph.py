"""Connected components of an edge table, without bringing edges to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, materialize


def _print(links: DataFrame) -> tuple:
    """How many links there are and two sums of their hashes: equal for equal tables,
    from one pass without a shuffle of links."""
    wide = lambda c: F.sum(c.cast("decimal(38,0)"))
    return tuple(links.agg(F.count("*"), wide(F.xxhash64("u", "v")), wide(F.xxhash64("v", "u"))).first())


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, component`` of all nodes of the edges; a component is named by its
    smallest node.

    Alternates two contractions until nothing changes: every node links its
    larger neighbours to its smallest one, then its smaller neighbours to it.
    The rounds grow with the logarithm of the longest path.  Group minima are
    aggregated before they move, so a node that has very many edges is no burden.
    Edges with a null end are dropped; an empty table gives an empty result.
    """
    u, v = F.col(a), F.col(b)
    links = edges.filter(u.isNotNull() & v.isNotNull() & (u != v))
    links = materialize(links.select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).distinct(), "links")
    print_ = _print(links)
    while True:
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")).withColumnRenamed("u", "n")
        large = both.filter("v > u").join(least, F.col("u") == F.col("n")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        star = materialize(large.distinct(), "large")
        least = star.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "n")
        small = star.join(least, F.col("u") == F.col("n"))
        small = small.select("u", F.col("m").alias("v")).unionByName(small.filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v")))
        new = materialize(small.distinct(), "small")
        forget(links), forget(star)
        links = new
        last, print_ = print_, _print(links)
        if print_ == last:
            break
    return links.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(links.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
