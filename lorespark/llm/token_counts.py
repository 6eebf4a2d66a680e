"""Token counts of whole texts by a sentencepiece model, without a shuffle of words.

A sentencepiece BPE never merges across a word start, so a text's count is the
sum over its segments (a run of blanks with the word after it, cut once more
before each line feed where no piece of the model holds one).  Two tiers give a
segment's length:

1. a compact table of the most frequent segments of the corpus, found by
   mergeable heavy-hitter sketches over all documents and broadcast (at most
   ``TABLE_WORDS`` entries, whatever the input);
2. for the rest, a cache in each Python worker in front of the library (of at most
   ``CACHE_WORDS`` segments of at most ``CACHED_CHARS`` characters; longer ones, such
   as texts without blanks, are encoded where they occur).

Only sketches of at most ``SKETCH_WORDS`` entries move between tasks.

Defined results: a null or empty text has 0 tokens; a null doc_id is carried;
repeated rows are counted each; an empty table gives an empty result; further
columns of the input are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import prepare, strings, table

MODEL = "piece_bpe_32k.model"
LIMIT = 4096
TABLE_WORDS = 32_768
SKETCH_WORDS = 4_096
CACHE_WORDS = 400_000
#: Longer segments are encoded each time: neither tier holds them, which bounds the bytes of both.
CACHED_CHARS = 64
#: Tasks that merge sketches.
MERGES = 16

_PARTS = re.compile(r" +[^ \n]*|\n[^ \n]*")


def _library(model: str) -> tuple:
    return sentencepiece.SentencePieceProcessor(model_file=model), {}


_STATE: dict[str, tuple] = {}


def worker_state(model: str) -> tuple:
    """The library and the cache of this Python worker; both outlive a task."""
    if model not in _STATE:
        processor, cache = _library(model)
        pieces = [processor.id_to_piece(i) for i in range(processor.get_piece_size())]
        crossing = [p for p in pieces if "▁" in p.lstrip("▁") or len(p) > 1 and "\n" in p]
        if crossing:
            raise ValueError(f"pieces of {model} cross segments: {crossing[:3]}")
        _STATE[model] = processor, cache
    return _STATE[model]


def segments(text: str) -> list[str]:
    """Keys whose lengths add up to the text's; see ``segment_lengths``."""
    if not text:
        return []
    if "▁" in text:
        text = text.replace("▁", " ")
    if text[0] == " " or "  " in text:
        return [s[1:] if s[0] == " " else s for s in _PARTS.findall(" " + text)]
    return text.replace("\n", " \n").split(" ")


def segment_lengths(processor, keys: list[str]) -> list[int]:
    """A key stands after one blank, the empty key for that blank alone; one that
    begins with a line feed stands after no blank."""
    lengths = map(len, processor.encode(keys, num_threads=1))
    return [1 if not k else n - (k[0] == "\n") for k, n in zip(keys, lengths, strict=True)]


def _pack(counts: Counter) -> bytes:
    top = counts.most_common(SKETCH_WORDS)
    text = "\0".join(k for k, _ in top).encode()
    number = np.array([n for _, n in top], "<i8").tobytes()
    return zstandard.compress(len(top).to_bytes(4, "little") + number + text)


def _unpack(blob: bytes) -> list[tuple[str, int]]:
    raw = zstandard.decompress(blob)
    n = int.from_bytes(raw[:4], "little")
    if not n:
        return []
    keys = raw[4 + 8 * n :].decode().split("\0")
    return list(zip(keys, np.frombuffer(raw, "<i8", n, 4).tolist(), strict=True))


def _trim(counts: Counter) -> None:
    """Misra-Gries: what is taken off every counter bounds the error of any."""
    if len(counts) > 8 * SKETCH_WORDS:
        off = sorted(counts.values(), reverse=True)[4 * SKETCH_WORDS]
        for k in [k for k, v in counts.items() if v <= off]:
            del counts[k]
        for k in counts:
            counts[k] -= off


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: Counter = Counter()
    for batch in batches:
        for text in strings(batch.column(0)).to_pylist():
            counts.update(k for k in segments(text) if len(k) <= CACHED_CHARS and "\0" not in k)
            if len(counts) > 8 * SKETCH_WORDS:
                _trim(counts)
    yield pa.RecordBatch.from_arrays([pa.array([_pack(counts)], pa.binary())], ["sketch"])


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: Counter = Counter()
    for batch in batches:
        for blob in batch.column(0).to_pylist():
            for k, n in _unpack(blob):
                counts[k] += n
            _trim(counts)
    yield pa.RecordBatch.from_arrays([pa.array([_pack(counts)], pa.binary())], ["sketch"])


def frequent_segments(texts: DataFrame) -> list[str]:
    """The frequent segments of all texts: sketches merge in ``MERGES`` tasks, one
    by one and cut back each time, and the driver merges what these give."""
    sketches = texts.mapInArrow(_sketch, "sketch binary").repartition(MERGES).mapInArrow(_merge, "sketch binary")
    counts: Counter = Counter()
    for (blob,) in sketches.collect():
        for k, n in _unpack(blob):
            counts[k] += n
    return [k for k, _ in counts.most_common(TABLE_WORDS)]


def token_counts(docs: DataFrame, model: str | None = None, limit: int = LIMIT) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` of every row of ``docs``."""
    spark = prepare(docs.sparkSession)
    model = model or public_tokenizers.path(MODEL)
    frequent = frequent_segments(docs.select("text"))
    lengths = segment_lengths(_library(model)[0], frequent) if frequent else []
    shared = spark.sparkContext.broadcast(("\0".join(frequent), np.array(lengths, np.uint16), len(frequent)))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, numbers, n = shared.value
        known = dict(zip(keys.split("\0"), numbers.tolist(), strict=True)) if n else {}
        processor, cache = worker_state(model)
        for batch in batches:
            texts = [segments(t) for t in strings(batch.column(1)).to_pylist()]
            missing = {k for t in texts for k in t if k not in known and k not in cache}
            if len(cache) + len(missing) > CACHE_WORDS:
                cache.clear()
                missing = {k for t in texts for k in t if k not in known}
            fresh = list(missing)
            found = dict(zip(fresh, segment_lengths(processor, fresh), strict=True))
            cache.update((k, n) for k, n in found.items() if len(k) <= CACHED_CHARS)
            if len(cache) < len(known):
                own = known | cache | found
                totals = [sum(map(own.__getitem__, t)) for t in texts]
            else:
                totals = [sum([known[k] if k in known else cache[k] if k in cache else found[k] for k in t]) for t in texts]
            arrays = [batch.column(0), batch.column(2), pa.array(totals, pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_bytes", "n_tokens"])

    n_bytes = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes")
    rows = docs.select("doc_id", "text", n_bytes)
    counted = rows.mapInArrow(count, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))
