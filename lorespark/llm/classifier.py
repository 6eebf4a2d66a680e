"""Quality classifier: votes of the nearest labelled documents.

A document is a vector of the shares of its hashed byte trigrams, weighted by
inverse document frequencies of the whole corpus, with a few bands of surface
measures (repeated words, symbols, capitals).  A truncated singular value
decomposition of labelled documents gives ``RANK`` latent dimensions.  The
labelled vectors are broadcast (at most ``SAMPLE`` rows, whatever the input);
every document gets its exact cosines with all of them, block by block, and its
``NEIGHBOURS`` nearest vote with their labels, weighted by similarity.

Only the fit is bounded: it takes the ``SAMPLE`` labelled rows with the smallest
hashes of their ids, of the rows whose crc32(doc_id) mod 5 isn't 0.  Labels,
lang, source and doc_id are no inputs of a score.

Defined results: a null or empty text, or one that shares no direction with a
labelled text, scores the share of label 1; without any label the score is 0.5;
a null doc_id is carried and held_out is null; repeated rows each give a row; an
empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import mix, prepare, slices, table, utf8
from .quality_rules import measures

SAMPLE = 4_000
RANK = 64
NEIGHBOURS = 15
THRESHOLD = 0.3
TRIGRAMS = 2_048
#: Texts that are dense at a time.
ROWS = 128
#: Bands of the surface measures.
BANDS = {
    "distinct": [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9],
    "repeat": [0.01, 0.05, 0.1, 0.2, 0.3, 0.5],
    "dup_line": [0.01, 0.1, 0.2, 0.3, 0.5],
    "symbol": [0.002, 0.01, 0.03, 0.06, 0.1, 0.2, 0.3],
    "upper": [0.03, 0.06, 0.1, 0.2, 0.4, 0.6],
    "length": [3, 4, 4.5, 5, 5.5, 6, 7, 8],
}
BAND_WEIGHT = 0.35
WIDTH = TRIGRAMS + sum(len(b) + 1 for b in BANDS.values())


def _chunks(offs: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of texts as ``slices`` gives them, of at most ``ROWS`` texts."""
    for i, j in slices(offs):
        for at in range(i, j, ROWS):
            yield at, min(at + ROWS, j)


def features(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Trigram counts and band indicators of each text."""
    n = len(offs) - 1
    out = np.zeros((n, WIDTH), np.float32)
    if len(data) >= 3:
        fold = data.astype(np.uint64)
        code = mix(fold[:-2] << np.uint64(16) | fold[1:-1] << np.uint64(8) | fold[2:]) % np.uint64(TRIGRAMS)
        doc = np.repeat(np.arange(n), np.diff(offs))
        whole = doc[:-2] == doc[2:]
        at = doc[:-2][whole] * TRIGRAMS + code[whole].astype(np.int64)
        out[:, :TRIGRAMS] = np.bincount(at, minlength=n * TRIGRAMS).reshape(n, TRIGRAMS)
    m = measures(data, offs)
    words, chars, lines = (np.maximum(1, m[k]) for k in ("n_words", "word_chars", "n_lines"))
    values = {
        "distinct": m["n_distinct"] / words, "repeat": m["n_repeat_words"] / words, "dup_line": m["n_dup_lines"] / lines,
        "symbol": m["n_symbols"] / chars, "upper": m["n_upper"] / chars, "length": m["word_chars"] / words,
    }
    at, some = TRIGRAMS, m["n_words"] > 0
    for k, edges in BANDS.items():
        out[np.flatnonzero(some), at + np.searchsorted(edges, values[k][some], "right")] = 1
        at += len(edges) + 1
    return out


def weigh(x: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Features as the decomposition takes them: each part of one length."""
    x = x.copy()
    tri = x[:, :TRIGRAMS]
    np.log1p(tri, out=tri)
    tri *= idf
    norm = np.linalg.norm(tri, axis=1, keepdims=True)
    np.divide(tri, norm, out=tri, where=norm > 0)
    x[:, TRIGRAMS:] *= BAND_WEIGHT
    return x


def _unit(x: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, norm, out=np.zeros_like(x), where=norm > 1e-9)


def _presence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total, n = np.zeros(TRIGRAMS, np.int64), 0
    for batch in batches:
        data, offs = utf8(batch.column(0))
        for i, j in _chunks(offs):
            own, at = data[offs[i] : offs[j]].astype(np.uint64), offs[i : j + 1] - offs[i]
            n += j - i
            if len(own) < 3:
                continue
            code = mix(own[:-2] << np.uint64(16) | own[1:-1] << np.uint64(8) | own[2:]) % np.uint64(TRIGRAMS)
            doc = np.repeat(np.arange(j - i), np.diff(at))
            whole = doc[:-2] == doc[2:]
            seen = np.zeros((j - i) * TRIGRAMS, bool)
            seen[doc[:-2][whole] * TRIGRAMS + code[whole].astype(np.int64)] = True
            total += seen.reshape(j - i, TRIGRAMS).sum(0)
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(TRIGRAMS + 1), pa.int32()), pa.array(np.append(total, n), pa.int64())], ["term", "n"])


def document_frequencies(texts: DataFrame) -> tuple[np.ndarray, int]:
    """In how many of all texts each hashed trigram occurs, and their number."""
    rows = texts.mapInArrow(_presence, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
    total = np.zeros(TRIGRAMS + 1, np.int64)
    for term, n in rows:
        total[term] = n
    return total[:TRIGRAMS], int(total[-1])


def _featurize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offs = utf8(batch.column(1))
        parts = [features(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]) for i, j in _chunks(offs)]
        blobs = [zstandard.compress(row.tobytes(), 1) for part in parts for row in part]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(blobs, pa.binary()), batch.column(2), batch.column(3)], ["label", "vector", "id", "print"])


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE) -> dict:
    """Frequencies, the latent directions, and the labelled vectors."""
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    usable = labels.filter(~held & F.col(label).isNotNull()).select("doc_id", F.col(label).cast("int").alias("label"))
    chosen = usable.orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(sample)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # at most ``sample`` ids
    # rows that repeat count once, so ids that stand once give at most ``sample``; of further texts of an id, the first by hash
    own = rows.select("label", "text", F.col("doc_id").cast("string").alias("id"), F.md5("text").alias("print"))
    once = own.mapInArrow(_featurize, "label int, vector binary, id string, print string").dropDuplicates(["id", "print", "label"])
    found = once.orderBy(F.xxhash64("id", "print"), "id", "print", "label").limit(sample).select("label", "vector").collect()
    frequency, n = document_frequencies(docs.select("text"))
    idf = np.log((1 + n) / (1 + frequency)).astype(np.float32) + 1
    if not found:
        return {"idf": idf, "axes": np.zeros((WIDTH, 1), np.float32), "vectors": np.zeros((0, 1), np.float32), "labels": np.zeros(0, np.float32), "prior": 0.5}
    found.sort(key=lambda r: (bytes(r.vector), r.label))
    y = np.array([r.label for r in found], np.float32)
    x = np.empty((len(found), WIDTH), np.float32)
    for i, r in enumerate(found):
        x[i] = np.frombuffer(zstandard.decompress(bytes(r.vector)), np.float32)
    del found
    x = weigh(x, idf)
    values, axes = np.linalg.eigh((x.T @ x).astype(np.float64))
    axes = axes[:, np.argsort(-values)[: min(RANK, len(x))]].astype(np.float32)
    return {"idf": idf, "axes": axes, "vectors": _unit(x @ axes), "labels": y, "prior": float(y.mean())}


def votes(x: np.ndarray, model: dict) -> np.ndarray:
    """Similarity-weighted share of label 1 among the nearest labelled vectors."""
    own = _unit(weigh(x, model["idf"]) @ model["axes"])
    y, n = model["labels"], len(model["labels"])
    out = np.full(len(own), model["prior"])
    for i in range(0, len(own) if n else 0, 512):
        near = own[i : i + 512] @ model["vectors"].T
        k = min(NEIGHBOURS, n)
        best = np.argpartition(-near, k - 1, axis=1)[:, :k]
        weight = np.maximum(np.take_along_axis(near, best, 1), 0).astype(np.float64) ** 4
        total = weight.sum(1)
        some = total > 0
        out[i : i + 512][some] = (weight * y[best]).sum(1)[some] / total[some]
    return np.clip(out, 0, 1)


def classify(docs: DataFrame, labels: DataFrame, label: str = "quality", carry: list[str] | None = None) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row, and the columns in ``carry``."""
    spark = prepare(docs.sparkSession)
    model = spark.sparkContext.broadcast(fit(docs, labels, label))
    rows = docs.select("doc_id", *(carry or []), F.col("text").alias("_scored"))
    width = len(rows.columns) - 1

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offs = utf8(batch.column(width))
            parts = [votes(features(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]), model.value) for i, j in _chunks(offs)]
            scores = pa.array(np.concatenate(parts) if parts else [], pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:width], scores], [*batch.schema.names[:width], "score"])

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:width])
    scored = rows.mapInArrow(score, f"{kept}, score double")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    return scored.withColumns({"held_out": held, "predicted": (F.col("score") >= THRESHOLD).cast("int")})


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.select("doc_id", "held_out", "score", "predicted")
