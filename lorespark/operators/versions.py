"""Edges with validity intervals: versions are closed and opened, never overwritten, so the
graph can be read as of any time; and components that grow with new edges alone.

An edge version is (a, b, kind, n, confidence, valid_at, invalid_at), a < b; the present
one of a pair has no invalid_at."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.time import at
from . import graph

COLUMNS = ["a", "b", "kind", "n", "confidence", "valid_at", "invalid_at"]


def opened(edges: DataFrame, when: str) -> DataFrame:
    """First versions of edges (a, b, n, confidence)."""
    kind = F.col("kind") if "kind" in edges.columns else F.lit("co_occurs").alias("kind")
    return edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), kind, F.col("n").cast("long").alias("n"), "confidence", at(when).alias("valid_at"), F.lit(None).cast("timestamp_ntz").alias("invalid_at"))


def holds(when: str) -> Column:
    """Whether a version holds at a time, the moment of closing excluded."""
    return (F.col("valid_at") <= at(when)) & (F.col("invalid_at").isNull() | (F.col("invalid_at") > at(when)))


def as_of(edges: DataFrame, when: str) -> DataFrame:
    """The versions that hold at a time."""
    return edges.filter(holds(when))


def _touched(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Present versions with whether one of the nodes (``node``) is an end."""
    ends = nodes.select("node").distinct()
    one = edges.join(ends.select(F.col("node").alias("a"), F.lit(True).alias("at_a")), "a", "left")
    both = one.join(ends.select(F.col("node").alias("b"), F.lit(True).alias("at_b")), "b", "left")
    return both.select(*COLUMNS, (F.col("invalid_at").isNull() & (F.coalesce("at_a", F.lit(False)) | F.coalesce("at_b", F.lit(False)))).alias("touched"))


def _closed_if(rows: DataFrame, test: Column, when: str) -> DataFrame:
    return rows.withColumn("invalid_at", F.when(test, at(when)).otherwise(F.col("invalid_at"))).select(*COLUMNS)


def dismiss(edges: DataFrame, dismissed: DataFrame, when: str) -> DataFrame:
    """Close what touches dismissed entities (``node``); what was stays readable."""
    rows = _touched(edges, dismissed)
    return _closed_if(rows, F.col("touched"), when)


def merge(edges: DataFrame, mapping: DataFrame, when: str) -> DataFrame:
    """Entities become others (``old_id, new_id``): edges of the old ones are closed; what
    they become opens anew, loops aside, with counts added up, each edge that comes to one
    that is there making it surer by .1."""
    to = lambda c: mapping.select(F.col("old_id").alias(c), F.col("new_id").alias(f"{c}_new"))
    rows = _touched(edges, mapping.select(F.col("old_id").alias("node")))
    moved = rows.filter("touched").join(to("a"), "a", "left").join(to("b"), "b", "left")
    x, y = F.coalesce("a_new", "a"), F.coalesce("b_new", "b")
    moved = moved.select(F.least(x, y).alias("a"), F.greatest(x, y).alias("b"), "kind", "n", "confidence").filter("a <> b")
    come = moved.groupBy("a", "b", "kind").agg(F.sum("n").alias("more"), F.count("*").alias("times"), F.max("confidence").alias("surest"))
    there = rows.filter("invalid_at IS NULL AND NOT touched").join(come, ["a", "b", "kind"], "left_semi").select("a", "b", "kind", F.col("n").alias("had"), F.col("confidence").alias("sure"))
    new = come.join(there, ["a", "b", "kind"], "left")
    steps = F.when(F.col("had").isNull(), F.col("times") - 1).otherwise(F.col("times"))
    confidence = F.round(F.least(F.lit(1.0), F.coalesce("sure", "surest") + 0.1 * steps), 6)
    new = new.select("a", "b", "kind", (F.coalesce("had", F.lit(0)) + F.col("more")).alias("n"), confidence.alias("confidence"), at(when).alias("valid_at"), F.lit(None).cast("timestamp_ntz").alias("invalid_at"))
    grown = rows.join(there.select("a", "b", "kind", F.lit(True).alias("grown")), ["a", "b", "kind"], "left")
    closing = F.col("touched") | (F.coalesce("grown", F.lit(False)) & F.col("invalid_at").isNull())
    return _closed_if(grown, closing, when).unionByName(new)


def merge_aliases(aliases: DataFrame, entities: DataFrame, mapping: DataFrame) -> DataFrame:
    """Aliases (``entity_id, alias``) move to the new entity, and the old one's name becomes
    one more."""
    moved = aliases.join(mapping, F.col("entity_id") == F.col("old_id"), "left").select(F.coalesce("new_id", "entity_id").alias("entity_id"), "alias")
    names = mapping.join(entities, F.col("old_id") == F.col("id")).select(F.col("new_id").alias("entity_id"), F.col("name").alias("alias"))
    return moved.unionByName(names).distinct()


# Components that grow ------------------------------------------------------------


class GrowingComponents:
    """Components by smallest node, brought up to date with new edges alone.

    ``nodes``: every node, once, when it first came.  ``roots``: (component, root) of the
    components that have joined another, the only rows that a batch writes anew.  A batch's
    edges are contracted to the components of their ends, and just these are joined."""

    def __init__(self, spark: SparkSession, path: str, kind: str = "long"):
        self.spark, self.path, self.kind = spark, path.rstrip("/"), kind
        self.version = self._last()

    def _fs(self, path: str):
        hadoop = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return hadoop, hadoop.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _last(self) -> int:
        """The last finished batch: one whose roots are whole."""
        folder, fs = self._fs(f"{self.path}/roots")
        if not fs.exists(folder):
            return -1
        names = [s.getPath().getName() for s in fs.listStatus(folder)]
        return max((int(n) for n in names if n.isdigit() and fs.exists(self._fs(f"{self.path}/roots/{n}/_SUCCESS")[0])), default=-1)

    def _nodes(self) -> DataFrame:
        rows = [self.spark.createDataFrame([], f"node {self.kind}")]
        if self.version >= 0:
            paths = [f"{self.path}/nodes/{v}" for v in range(self.version + 1)]
            rows.append(self.spark.read.schema(f"node {self.kind}").parquet(*paths))
        return rows[-1]

    def _roots(self) -> DataFrame:
        schema = f"component {self.kind}, root {self.kind}"
        return self.spark.createDataFrame([], schema) if self.version < 0 else self.spark.read.schema(schema).parquet(f"{self.path}/roots/{self.version}")

    def read(self) -> DataFrame:
        """(node, component)."""
        return self._nodes().join(self._roots(), F.col("node") == F.col("component"), "left").select("node", F.coalesce("root", "node").alias("component"))

    def add(self, edges: DataFrame) -> GrowingComponents:
        """Take up a batch (a, b); one that is repeated changes nothing."""
        new = edges.filter("a IS NOT NULL AND b IS NOT NULL").select("a", "b").distinct()
        ends = new.select(F.col("a").alias("node")).unionByName(new.select(F.col("b").alias("node"))).distinct()
        roots, number = self._roots(), self.version + 1
        first = ends.join(self._nodes(), "node", "left_anti")
        first.write.mode("overwrite").parquet(f"{self.path}/nodes/{number}")
        root = lambda c: roots.select(F.col("component").alias(c), F.col("root").alias(f"{c}_root"))
        met = new.join(root("a"), "a", "left").join(root("b"), "b", "left").select(F.coalesce("a_root", "a").alias("a"), F.coalesce("b_root", "b").alias("b")).filter("a <> b").distinct()
        joined = graph.components(met).filter("node <> component")
        now = roots.join(joined.select(F.col("node").alias("root"), F.col("component").alias("next")), "root", "left").select("component", F.coalesce("next", "root").alias("root"))
        now = now.unionByName(joined.select(F.col("node").alias("component"), F.col("component").alias("root"))).distinct()
        now.write.mode("overwrite").parquet(f"{self.path}/roots/{number}")
        self.version = number
        return self
