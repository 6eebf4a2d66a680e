"""A corpus pipeline: classify, drop near copies, decontaminate, redact, encode.

Each stage is a function of (spark, docs, sf_dir) that returns a DataFrame; it is
written as Parquet and read again as the docs of the next.  All but the last
return the columns of documents.

Defined results, besides those of the operators that the stages call: a null or
empty text is judged by its features like any other (most are rejected as of low
quality), is linked with nothing, clean, without secrets, and has no tokens; nulls
in lang, source and n_chars are kept; a null doc_id is carried, and only rows that
repeat id and text count as one; an empty table goes through as such; further
columns of documents are left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import bpe_round_trip
from .classifier import classify
from .common import few_files, forget, materialize, prepare, table
from .decontaminate import find_leaks
from .jaccard import jaccard_representatives
from .secrets import find_secrets

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
_CARRIED = COLUMNS[1:]


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject."""
    scored = classify(docs, table(spark, sf_dir, "labels"), carry=_CARRIED)
    return scored.filter("predicted = 1").select(*COLUMNS)


def no_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that the n-gram Jaccard join links: the one of
    the smallest id (of rows that share that id and text, one)."""
    prepare(spark)
    return few_files(jaccard_representatives(docs).select(*COLUMNS))


def no_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item."""
    found = find_leaks(docs, table(spark, sf_dir, "benchmark"), carry=_CARRIED)
    return found.filter(F.size("leaks") == 0).select(*COLUMNS)


def no_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, each secret replaced by a mark."""
    clean = find_secrets(docs, carry=["lang", "source", "n_chars"], redacted=True)
    length = F.when(F.size("spans") > 0, F.length("redacted").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return clean.select("doc_id", F.col("redacted").alias("text"), "lang", "source", length.alias("n_chars"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts, and hashes of the ids and of the bytes decoded from them."""
    return bpe_round_trip(docs)


STAGES = [
    ("quality", good_quality),
    ("near_copies", no_near_copies),
    ("decontamination", no_benchmark),
    ("secrets", no_secrets),
    ("bpe", encoded),
]

#: No stage but the second has an exact form in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        done, docs = docs, materialize(stage(spark, docs, sf_dir), name)
        forget(done)
    return docs
