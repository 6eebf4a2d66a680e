"""Byte-level BPE encoding and decoding by one global shuffle of distinct words.

1. Each batch of documents is cut into pre-tokens with their positions; within
   the batch a position holds the number of its word in the batch's dictionary.
   The dictionaries go, by word hash, to ``buckets`` (as packed words); their number
   follows the bytes of the documents, so a bucket's share stays the same.
2. A bucket encodes each distinct word once and sends the ids back to the
   batches that asked.
3. A batch joins the ids to its positions, which gives every document's ids in
   order; decoding joins the ids to the token-byte table (one row a rank, so
   bounded by the vocabulary).

Words travel packed, so a word that fills the corpus is one entry a batch, and
what moves is a fraction of the input.

Defined results: a null or empty text has no ids; a null doc_id is carried;
repeated rows each give a row; an empty table gives an empty result; further
columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
import tiktoken
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import partitions, prepare, ragged, settled, strings, table

RANKS = "byte_bpe_50k.tiktoken"
#: Characters, and number, of the documents that share a dictionary.
BATCH_CHARS, BATCH_TEXTS = 1 << 23, 60_000
#: Bytes of documents for which there is a bucket.  More than ``MOST_BUCKETS`` would
#: give a batch more buckets than it has words; a bucket then reads more, as a stream.
BUCKET_BYTES = 1 << 24
MOST_BUCKETS = 1 << 16
#: Bytes of words that a bucket remembers; what is forgotten is encoded again.
KNOWN_BYTES = 64 << 20

_SCHEMA = "batch long, bucket int, info binary, payload binary"
_ENCODERS: dict[tuple, tuple] = {}


def encoder(path: str, pattern: str) -> tuple[tiktoken.Encoding, np.ndarray, np.ndarray]:
    """The encoder, and the token-byte table as bytes and offsets."""
    key = path, pattern
    if key not in _ENCODERS:
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        encoding = tiktoken.Encoding("lorespark", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        rows: list[bytes] = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            rows[rank] = token
        offsets = np.zeros(len(rows) + 1, np.int64)
        np.cumsum([len(r) for r in rows], out=offsets[1:])
        _ENCODERS[key] = encoding, np.frombuffer(b"".join(rows), np.uint8), offsets
    return _ENCODERS[key]


def _planes(a: np.ndarray) -> bytes:
    """Unsigned numbers as compressed byte planes."""
    raw = a.astype("<u4").view(np.uint8).reshape(-1, 4).T
    return zstandard.compress(np.ascontiguousarray(raw).tobytes(), 3)


def _unplanes(blob: bytes) -> np.ndarray:
    raw = np.frombuffer(zstandard.decompress(blob), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(raw.T).view("<u4").ravel()


def _frame(parts: list[bytes]) -> bytes:
    return b"".join(len(p).to_bytes(8, "little") + p for p in parts)


def _unframe(blob: bytes) -> list[bytes]:
    parts, at = [], 0
    while at < len(blob):
        n = int.from_bytes(blob[at : at + 8], "little")
        parts.append(blob[at + 8 : at + 8 + n])
        at += 8 + n
    return parts


def _code(flat: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """How often each word occurs, and the positions: 0 for a word's first
    occurrence (words are numbered in that order), else 1 plus its rank by use."""
    uses = np.bincount(flat, minlength=n)
    rank = np.empty(n, np.int64)
    rank[np.argsort(-uses, kind="stable")] = np.arange(n)
    first = np.ones(len(flat), bool)
    first[1:] = np.diff(np.maximum.accumulate(flat)) > 0 if len(flat) else True
    return uses, np.where(first, 0, rank[flat] + 1)


def _decode(uses: np.ndarray, codes: np.ndarray) -> np.ndarray:
    order = np.argsort(-uses.astype(np.int64), kind="stable")
    flat = np.empty(len(codes), np.int64)
    first = codes == 0
    flat[first] = np.arange(len(uses))
    flat[~first] = order[codes[~first].astype(np.int64) - 1]
    return flat


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int32(), pa.binary(), pa.binary()]
    names = ["batch", "bucket", "info", "payload"]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def _cut(batches: Iterator[pa.RecordBatch], pattern: str, buckets: int, id_type: pa.DataType) -> Iterator[pa.RecordBatch]:
    find = regex.compile(pattern).findall
    number = TaskContext.get().partitionId() << 32
    ids: list = []
    words: defaultdict = defaultdict()
    words.default_factory = words.__len__
    positions: list[np.ndarray] = []
    size = 0

    def batch_rows() -> list[tuple]:
        counts = np.array([len(p) for p in positions], np.uint32)
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, pa.schema([("doc_id", id_type)])) as out:
            out.write_batch(pa.RecordBatch.from_arrays([pa.array(ids, id_type)], ["doc_id"]))
        flat = np.concatenate(positions).astype(np.int64) if positions else np.zeros(0, np.int64)
        raw = [w.encode() for w in words]
        home = np.array([zlib.crc32(w) % buckets for w in raw], np.int64)
        uses, codes = _code(flat, len(raw))
        info = _frame([sink.getvalue().to_pybytes(), _planes(counts), _planes(uses), _planes(home)])
        rows = [(number, -1 - number % buckets, info, _planes(codes))]
        order = np.argsort(home, kind="stable")
        cuts = np.flatnonzero(np.diff(home[order], prepend=-1))  # none where no text has a word
        for a, b in zip(cuts, [*cuts[1:], len(order)][: len(cuts)], strict=True):
            own = order[a:b]
            payload = zstandard.compress(b"".join(raw[i] for i in own), 3)
            rows.append((number, int(home[own[0]]), _planes(np.array([len(raw[i]) for i in own])), payload))
        return rows

    for batch in batches:
        for doc, text in zip(batch.column(0).to_pylist(), strings(batch.column(1)).to_pylist(), strict=True):
            found = find(text)
            ids.append(doc)
            positions.append(np.fromiter(map(words.__getitem__, found), np.uint32, len(found)))
            size += len(text)
            if size >= BATCH_CHARS or len(ids) >= BATCH_TEXTS:
                yield _rows(batch_rows())
                number += 1
                ids.clear(), words.clear(), positions.clear()
                size = 0
    if ids:
        yield _rows(batch_rows())


def _encode(batches: Iterator[pa.RecordBatch], path: str, pattern: str) -> Iterator[pa.RecordBatch]:
    encoding, _, _ = encoder(path, pattern)
    known: dict[bytes, list[int]] = {}
    size = 0
    for batch in batches:
        for number, bucket, info, payload in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if bucket < 0:
                yield _rows([(number, bucket, info, payload)])
                continue
            raw, at, ids = zstandard.decompress(payload), 0, []
            for n in _unplanes(info).tolist():
                word = raw[at : at + n]
                at += n
                got = known.get(word)
                if got is None:
                    got = encoding._encode_single_piece(word)
                    size += 200 + 10 * n
                    if size > KNOWN_BYTES:
                        known.clear()
                        size = 0
                    known[word] = got
                ids.append(got)
            sizes = np.array([len(x) for x in ids], np.uint32)
            flat = np.fromiter((i for x in ids for i in x), np.uint32, int(sizes.sum()))
            yield _rows([(number, bucket, _planes(sizes), _planes(flat))])


def _assemble(batches: Iterator[pa.RecordBatch], path: str, pattern: str, buckets: int, keep: bool) -> Iterator[pa.RecordBatch]:
    _, table_bytes, table_offsets = encoder(path, pattern)
    table_lengths = np.diff(table_offsets)

    def batch_result(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        (_, info, payload), *rest = rows
        head, counts, uses, home = _unframe(info)
        doc_ids = pa.ipc.open_stream(head).read_all().column(0).combine_chunks()
        counts, flat = _unplanes(counts).astype(np.int64), _decode(_unplanes(uses), _unplanes(payload))
        home = _unplanes(home)
        order = np.argsort(home, kind="stable")
        cuts = np.searchsorted(home[order], np.arange(buckets + 1))
        parts = [(order[cuts[b] : cuts[b + 1]], _unplanes(i), _unplanes(p)) for b, i, p in rest]
        n = len(home)
        starts, lengths, total = np.zeros(n, np.int64), np.zeros(n, np.int64), 0
        for own, sizes, ids in parts:
            lengths[own] = sizes
            starts[own] = total + np.cumsum(sizes, dtype=np.int64) - sizes
            total += len(ids)
        word_ids = np.concatenate([ids for *_, ids in parts]) if parts else np.zeros(0, "<u4")
        out: dict[str, list] = {"n_tokens": [], "ids_sha256": [], "decoded_sha256": [], "ids": [], "decoded": []}
        at = 0
        for n in counts.tolist():
            own = flat[at : at + n]
            at += n
            ids = ragged(word_ids, starts[own], lengths[own])
            raw = ragged(table_bytes, table_offsets[ids], table_lengths[ids]).tobytes()
            out["n_tokens"].append(len(ids))
            out["ids_sha256"].append(hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest())
            out["decoded_sha256"].append(hashlib.sha256(raw).hexdigest())
            if keep:
                out["ids"].append(ids.astype(np.int32))
                out["decoded"].append(raw)
        arrays = [doc_ids, pa.array(out["n_tokens"], pa.int64()), pa.array(out["ids_sha256"], pa.string()), pa.array(out["decoded_sha256"], pa.string())]
        names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
        if keep:
            arrays += [pa.array(out["ids"], pa.list_(pa.int32())), pa.array(out["decoded"], pa.binary())]
            names += ["ids", "decoded"]
        yield pa.RecordBatch.from_arrays(arrays, names)

    last, rows = None, []
    for batch in batches:
        for number, bucket, info, payload in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if number != last and rows:
                yield from batch_result(rows)
                rows = []
            last = number
            rows.append((bucket, info, payload))
    if rows:
        yield from batch_result(rows)


def bpe_round_trip(docs: DataFrame, ranks: str | None = None, pattern: str | None = None, keep: bool = False) -> DataFrame:
    """Encode every text and decode the ids again.

    Returns ``doc_id, n_tokens, ids_sha256, decoded_sha256``; with ``keep`` also
    the ``ids`` and the ``decoded`` bytes themselves.
    """
    spark = prepare(docs.sparkSession)
    path, pattern = ranks or public_tokenizers.path(RANKS), pattern or public_tokenizers.PATTERN
    rows = settled(docs.select("doc_id", "text"), "settled")  # documents are numbered by their order in a task
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = min(MOST_BUCKETS, max(partitions(spark), size // BUCKET_BYTES))
    kind = rows.schema["doc_id"].dataType
    id_type = to_arrow_type(kind)
    cut = rows.mapInArrow(lambda b: _cut(b, pattern, buckets, id_type), _SCHEMA)
    encoded = cut.repartition(buckets, F.pmod("bucket", F.lit(buckets))).mapInArrow(lambda b: _encode(b, path, pattern), _SCHEMA)
    ordered = encoded.repartition(buckets, "batch").sortWithinPartitions("batch", "bucket")
    schema = f"doc_id {kind.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded binary" * keep
    return ordered.mapInArrow(lambda b: _assemble(b, path, pattern, buckets, keep), schema)


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_round_trip(table(spark, sf_dir, "documents"))
