"""A Spark session with the settings that the operators expect."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def session(app: str = "lorespark", **conf: str) -> SparkSession:
    """UTC, adaptive execution with skew handling; ``conf`` (dots as ``__``) goes last."""
    builder = SparkSession.builder.appName(app)
    base = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
    }
    for k, v in {**base, **{k.replace("__", "."): v for k, v in conf.items()}}.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share (``spark.checkpoint.dir``).  Where none is
    set, a local one if all tasks run on this machine, else an error."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not named:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="lorespark-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(named)
    return named.rstrip("/")


#: Rows of a task whose work takes many times the memory of its rows.
DEALT = 500_000


def dealt(rows: DataFrame, count: int, *by: str) -> DataFrame:
    """The rows by keys in tasks of about ``DEALT`` of ``count`` rows.  A shuffle of its own
    accord goes by compressed bytes, and what a task makes of so many grows with the table."""
    return rows.repartition(max(rows.sparkSession.sparkContext.defaultParallelism, -(-count // DEALT)), *by)


_SCRATCH: set[str] = set()


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    path = f"{shared_dir(spark)}/lorespark-{uuid.uuid4().hex}-{name}"
    _SCRATCH.add(path)
    return path


def is_scratch(path: str) -> bool:
    """Whether a scratch path of this process still stands."""
    return path in _SCRATCH


def forget_scratch(spark: SparkSession) -> int:
    """Delete what this process has written below ``scratch`` paths, indexes included; to be
    called when the DataFrames that read it are done with.  The number of paths."""
    for path in _SCRATCH:
        folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
    n = len(_SCRATCH)
    _SCRATCH.clear()
    return n
