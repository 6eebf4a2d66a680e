"""Session set-up, shared storage and Arrow/numpy helpers of the operators."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

ROOT = str(Path(__file__).resolve().parents[2])

#: Rows of an Arrow batch, so that a batch of long texts stays small.
BATCH_ROWS = 512
#: Bytes that the numpy kernels take at a time (a longer text is taken alone).
CHUNK_BYTES = 1 << 19


def prepare(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package and keep Arrow batches small.

    Both are settings of the session, and both stay: the plans of the DataFrames
    that operators return read them when they run."""
    env = spark.sparkContext.environment
    path = env.get("PYTHONPATH", "")
    if ROOT not in path.split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *filter(None, [path])])
    if not 0 < int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share.  Where none is set, a local one if all
    tasks run on this machine, else an error: others couldn't read it."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="lorespark-"))
    return sc.getCheckpointDir().rstrip("/")


#: Files that a table is written as, at most: so many for each core, or one for so many
#: bytes of what it is made from.  A plan of many partitions would make each small table
#: thousands of files; tasks that are joined take their partitions one after the other.
FILES_A_CORE = 2
FILE_BYTES = 1 << 25


def few_files(df: DataFrame) -> DataFrame:
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    read = sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))
    return df.coalesce(min(1 << 20, max(int(FILES_A_CORE * df.sparkSession.sparkContext.defaultParallelism), read // FILE_BYTES)))


_WRITTEN: set[str] = set()


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage, and
    an executor lost later costs nothing that was computed before."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lorespark-{uuid.uuid4().hex}-{name}"
    _WRITTEN.add(path)
    few_files(df).write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Levels:
    """Tables of one schema in the shared folder, one for each level of an iteration;
    read one by one or together, with the level as a column."""

    def __init__(self, spark: SparkSession, schema: str, name: str, column: str = "depth"):
        self.spark, self.schema, self.column = spark, schema, column
        self.path = f"{shared_dir(spark)}/lorespark-{uuid.uuid4().hex}-{name}"
        _WRITTEN.add(self.path)

    def put(self, level: int, df: DataFrame) -> DataFrame:
        few_files(df).write.option("compression", "zstd").parquet(f"{self.path}/{self.column}={level}")
        return self.at(level)

    def split(self, df: DataFrame) -> None:
        """Write rows of all levels, by their own column."""
        few_files(df).write.option("compression", "zstd").partitionBy(self.column).parquet(self.path)

    def at(self, level: int) -> DataFrame:
        path = f"{self.path}/{self.column}={level}"
        hadoop = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        if not hadoop.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(path)

    def all(self) -> DataFrame:
        hadoop = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        if not hadoop.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
            return self.spark.createDataFrame([], f"{self.schema}, {self.column} int")
        return self.spark.read.schema(f"{self.schema}, {self.column} int").parquet(self.path)


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def forget(df: DataFrame) -> None:
    """Delete a table that ``materialize`` wrote in this process, once nothing reads it;
    anything else that ``df`` reads stays."""
    mine = {path.rsplit("/", 1)[1]: path for path in _WRITTEN}
    for top in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if path := mine.get(top.rsplit("/", 1)[1]):
            _delete(df.sparkSession, top)
            _WRITTEN.discard(path)


def forget_all(spark: SparkSession) -> int:
    """Delete all tables that operators of this process have left: those that the
    DataFrames which they returned still read.  To be called when these are done
    with; the number of tables."""
    for path in list(_WRITTEN):
        _delete(spark, path)
    n = len(_WRITTEN)
    _WRITTEN.clear()
    return n


def settled(df: DataFrame, name: str) -> DataFrame:
    """``df`` with an order of rows that a task which runs again finds again: as it
    is if its plan only reads files, else written first (rows that come out of a
    shuffle may come in another order the next time)."""
    nodes = re.findall(r"(?m)^[^A-Za-z]*(?:\(\d+\) )?(\w+)", df._jdf.queryExecution().executedPlan().toString())
    still = {"FileScan", "Scan", "Project", "Filter", "ColumnarToRow", "LocalTableScan", "WholeStageCodegen", "InputAdapter"}
    return df if set(nodes) <= still else materialize(df, name)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


# Arrow ---------------------------------------------------------------------


def strings(column: pa.Array) -> pa.Array:
    """A text column with null as the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return pc.fill_null(column.cast(pa.large_string()), "")


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text column and the offsets of its texts (null: empty)."""
    column = strings(column)
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def slices(offs: np.ndarray, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Runs of texts of at most ``most`` bytes together, or one longer text."""
    i, n = 0, len(offs) - 1
    while i < n:
        j = int(np.searchsorted(offs, offs[i] + most, "right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


# Words and hashes ----------------------------------------------------------

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_RNG = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MULT = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_MULT, -1, 1 << 64)
_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        size = max(n, CHUNK_BYTES + 2)
        have = np.empty(size, np.uint64)
        have[0] = 1
        have[1:] = np.uint64(base)
        np.multiply.accumulate(have, out=have)
        if n <= CHUNK_BYTES + 2:
            _POWERS[base] = have
    return have


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Sums whose differences identify any span of ``data``, bytes or hashes of words
    (see span_hash)."""
    n = len(data)
    sums = np.zeros(n + 1, np.uint64)
    values = _BYTE[data] if data.dtype == np.uint8 else mix(data) | np.uint64(1)
    np.cumsum(values * _powers(_MULT, n)[:n], out=sums[1:])
    return sums


def span_hash(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the spans: equal bytes give equal hashes wherever they lie."""
    inverse = _powers(_INVERSE, len(sums))
    return mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


def word_spans(data: np.ndarray, offs: np.ndarray, between: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and text numbers of the words ``[^\\x20\\x09-\\x0D]+``, or of the runs
    of other bytes than those marked in ``between``."""
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, none
    blank = between[data]
    before = np.empty(n, bool)
    before[0] = True
    before[1:] = blank[:-1]
    edges = offs[(offs > 0) & (offs < n)]
    before[edges] = True
    after = np.empty(n, bool)
    after[-1] = True
    after[:-1] = blank[1:]
    after[edges - 1] = True
    word = ~blank
    starts = np.flatnonzero(word & before)
    ends = np.flatnonzero(word & after) + 1
    return starts, ends, np.searchsorted(offs, starts, "right") - 1


def window_hash(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of ``n`` consecutive word hashes."""
    if len(words) < n:
        return np.zeros(0, np.uint64)
    total = np.zeros(len(words) - n + 1, np.uint64)
    weights = _powers(0xD6E8FEB86659FD93, n + 1)
    for j in range(n):
        total += words[j : len(words) - n + 1 + j] * weights[j + 1]
    return mix(total)


def ragged(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """``values[s : s + n]`` of all the (s, n), one after the other."""
    total = int(lengths.sum())
    if not total:
        return values[:0]
    ends = np.cumsum(lengths)
    index = np.arange(total) + np.repeat(starts - (ends - lengths), lengths)
    return values[index]
