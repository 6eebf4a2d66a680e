"""Sinks: a named result, a text document, a table brought up to date."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.rollups import upsert


def save_result(df: DataFrame, root: str, key: str, history: str | None = None) -> None:
    """Replace the result of a key; with ``history`` keep a copy under that name."""
    df.write.mode("overwrite").parquet(f"{root}/{key}")
    if history:
        df.write.mode("overwrite").parquet(f"{root}/{key}-history/{history}")


def load_result(spark: SparkSession, root: str, key: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{key}")


def save_text(lines: DataFrame, path: str, order: list[str]) -> None:
    """Lines of text (the column ``line``) as one document, in the order of the columns
    named.  One task writes it: it is for what people read, not for tables."""
    lines.repartition(1).sortWithinPartitions(*order).select("line").write.mode("overwrite").text(path)


def upsert_table(spark: SparkSession, path: str, new: DataFrame, keys: list[str], version: str) -> str:
    """Bring a Parquet table up to date by key; the new version is written beside
    the old one, which stays readable until its readers are done."""
    old = spark.read.parquet(path)
    target = f"{path.rstrip('/')}@{version}"
    upsert(old, new, keys).write.mode("errorifexists").parquet(target)
    return target
