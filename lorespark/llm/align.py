"""Alignment of two tokenizers over whole texts, by shared cuts of packed bitsets.

A is a byte-level BPE (tokenizers), B a BPE with byte fallback (sentencepiece); both
encode a blank and the text.  Where tokens of both end at the same byte there is a cut;
what lies between two cuts is a group.

1. Documents are worked on in batches of some MB.  Both tokenizers cut before a blank or a
   line feed that follows something else, so a batch is a bag of segments, and each
   distinct one is encoded once.  A bit for each byte marks
   where tokens end, one set for A and one for B; AND gives the cuts, the popcount of the
   words before a cut the number of tokens there, and so the token ranges of the groups
   and the links.  A text with a segment whose tokens don't spell it is one segment as a
   whole; if that doesn't help, it has no tokens.
2. A batch sends each distinct pair of ids once with its count.  Counts add up over the
   corpus by partial aggregation: there are never more pairs than the product of both
   vocabularies, whatever the input.  Nothing is broadcast.
3. Totals join back to the batches' pairs, and a batch adds them up for its documents.

A link is a pair of token occurrences, one of A and one of B, whose byte ranges end
together; so each group holds one, its last tokens.

Defined results: a null or empty text, and one whose tokens don't spell it (such as one
that holds U+2581), has zeros and an empty digest; a null doc_id is carried; repeated
rows each give a row and count each; an empty table gives an empty result; further
columns are ignored.
"""

from __future__ import annotations

import hashlib
import os
import re
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from tokenizers import Tokenizer

from .common import materialize, partitions, prepare, ragged, strings, table, utf8
from .packed import frame, planes, unframe, unplanes

TOKENIZER_A, TOKENIZER_B = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Characters, and texts, of a batch.
BATCH_CHARS, BATCH_TEXTS = 1 << 22, 60_000
#: Bytes of segments that are encoded together.
TOGETHER = 1 << 16
#: Pairs of a batch that leave a task together.
OUT_PAIRS = 1 << 16

_TABLE = "batch long, pair long, n long, payload binary"
_SPLIT = re.compile(r"(?<=\S)(?=[ \n])").split
#: White space but blanks and line feeds, two of these, and the mark that is put before them:
#: a text without any of this is split in a faster way.
_ODD = [*filter(str.isspace, map(chr, [*range(9, 10), *range(11, 32), 133, 160, *range(0x1680, 0x3001)])), "\0", "  ", "\n\n", " \n", "\n "]


def segments(spaced: str) -> list[str]:
    """Parts of " " + text at whose ends both tokenizers cut: before a blank or a line
    feed that follows something else than white space."""
    if any(c in spaced for c in _ODD):
        return _SPLIT(spaced)
    return spaced.replace(" ", "\0 ").replace("\n", "\0\n").split("\0")[1:]


def byte_level_letters() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: printable bytes
    stand for themselves, the others for the letters from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


@dataclass
class Vocabulary:
    """Bytes of every id, flat and by offset, and the ids in decimal with what follows."""

    flat: np.ndarray
    offsets: np.ndarray
    lengths: np.ndarray
    digits: np.ndarray

    @classmethod
    def of(cls, tokens: list[bytes], inner: str, last: str) -> Vocabulary:
        offsets = np.zeros(len(tokens) + 1, np.int64)
        np.cumsum([len(t) for t in tokens], out=offsets[1:])
        digits = np.array([[f"{i}{c}".encode() for i in range(len(tokens))] for c in (inner, last)])
        return cls(np.frombuffer(b"".join(tokens), np.uint8), offsets, np.diff(offsets), digits)


@dataclass
class Aligned:
    """Segments with what their tokens say: flat, and by offset of each segment.

    ``right`` marks those that their tokens spell; of the others nothing is held."""

    right: np.ndarray
    n_a: np.ndarray
    n_b: np.ndarray
    said: np.ndarray  # decimal ids with what follows, group by group
    said_at: np.ndarray
    links: np.ndarray  # B id << 32 | A id
    links_at: np.ndarray

    def join(self, other: Aligned) -> Aligned:
        both = lambda k: np.concatenate([getattr(self, k), getattr(other, k)])
        at = lambda k: np.append(getattr(self, k), getattr(self, k)[-1] + getattr(other, k)[1:])
        return Aligned(both("right"), both("n_a"), both("n_b"), both("said"), at("said_at"), both("links"), at("links_at"))


def _sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums of runs of so many values."""
    total = np.append(0, np.cumsum(values))
    ends = np.cumsum(counts)
    return total[ends] - total[ends - counts]


class Pair:
    """Both tokenizers of a worker."""

    def __init__(self, a: str, b: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        self.a, self.b = Tokenizer.from_file(a), sentencepiece.SentencePieceProcessor(model_file=b)
        self.a.encode_special_tokens = True
        letters = byte_level_letters()
        tokens = [self.a.id_to_token(i) or "" for i in range(self.a.get_vocab_size())]
        self.words_a = Vocabulary.of([bytes(letters[c] for c in t) if all(c in letters for c in t) else t.encode() for t in tokens], ",", "|")
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        if any("▁" in p.lstrip("▁") or len(p) > 1 and "\n" in p for p in pieces):
            raise ValueError(f"pieces of {b} cross segments")
        one = lambda i, p: bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode()
        self.words_b = Vocabulary.of([one(i, p) for i, p in enumerate(pieces)], ",", ";")
        width = max(self.words_a.digits.itemsize, self.words_b.digits.itemsize)
        self.words_a.digits, self.words_b.digits = (w.digits.astype(f"S{width}") for w in (self.words_a, self.words_b))
        self.blank = [self.b.piece_to_id("▁")]

    def ids_a(self, parts: list[str]) -> list[list[int]]:
        return [x.ids for x in self.a.encode_batch_fast(parts, add_special_tokens=False)]

    def ids_b(self, parts: list[str]) -> list[list[int]]:
        """The model puts a blank first: for a segment that begins with one it stands for it,
        for others it is taken off again."""
        bare = [p[1:] if p[:1] == " " else p for p in parts]
        found = self.b.encode(bare, num_threads=1)
        return [self.blank if not s else x if p[0] == " " else x[1:] for p, s, x in zip(parts, bare, found, strict=True)]

    @staticmethod
    def flat(encode: Callable[[list[str]], list[list[int]]], words: Vocabulary, parts: list[str], sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of each segment by number, and all their ids.  Segments that end in no
        white space are encoded many together, as they would be in a text, and told apart
        by the bytes of their tokens; where that fails they are encoded one by one."""
        counts, ids = [], []

        def put(found: list[list[int]]) -> None:
            counts.append(np.fromiter(map(len, found), np.int64, len(found)))
            ids.append(np.fromiter(chain.from_iterable(found), np.int64, int(counts[-1].sum())))

        at = 0
        while at < len(parts):
            if parts[at][-1:].isspace() or sizes[at] > TOGETHER:
                put(encode([parts[at]]))
                at += 1
                continue
            end, size = at, 0
            while end < len(parts) and size + sizes[end] <= TOGETHER and not parts[end][-1:].isspace():
                size += int(sizes[end])
                end += 1
            own = np.array(encode(["".join(parts[at:end])])[0], np.int64)
            token_ends, part_ends = np.cumsum(words.lengths[own]), np.cumsum(sizes[at:end])
            place = np.searchsorted(token_ends, part_ends)
            if len(own) and token_ends[-1] == part_ends[-1] and (token_ends[place] == part_ends).all():
                counts.append(np.diff(place, prepend=-1))
                ids.append(own)
            else:
                put(encode(parts[at:end]))
            at = end
        return np.concatenate(counts or [np.zeros(0, np.int64)]), np.concatenate(ids or [np.zeros(0, np.int64)])

    def align(self, parts: list[str]) -> Aligned:
        """Encode segments and align the tokens of those that they spell."""
        data, offs = utf8(pa.array(parts, pa.large_string()))
        sizes = np.diff(offs)
        tokens = [(words, *self.flat(encode, words, parts, sizes)) for encode, words in ((self.ids_a, self.words_a), (self.ids_b, self.words_b))]
        right = sizes > 0
        for words, counts, ids in tokens:
            right &= _sums(words.lengths[ids], counts) == sizes
        for words, counts, ids in tokens:  # of those of the right length, the bytes
            own = ids[np.repeat(right, counts)]
            spelt = ragged(words.flat, words.offsets[own], words.lengths[own]) == ragged(data, offs[:-1][right], sizes[right])
            right[right] = _sums(spelt, sizes[right]) == sizes[right]
        (n_a, ids_a), (n_b, ids_b) = ((np.where(right, counts, 0), ids[np.repeat(right, counts)]) for _, counts, ids in tokens)
        said, links, groups = self._groups(ids_a, ids_b)
        ends = np.append(0, np.cumsum(n_a))
        return Aligned(right, n_a, n_b, said, np.append(0, np.cumsum(n_a + n_b)), links, np.searchsorted(groups, ends, "right") * (ends > 0))

    def _groups(self, ids_a: np.ndarray, ids_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The digits of all tokens group by group, the links, and the tokens of A up to
        the end of each group."""
        if not len(ids_a):
            return self.words_a.digits[0, :0], ids_a, ids_a
        cuts, rank_a, rank_b = shared_cuts(np.cumsum(self.words_a.lengths[ids_a]), np.cumsum(self.words_b.lengths[ids_b]))
        group_a, group_b = (np.repeat(np.arange(len(cuts)), np.diff(rank, prepend=0)) for rank in (rank_a, rank_b))
        last_a, last_b = np.zeros(len(ids_a), int), np.zeros(len(ids_b), int)
        last_a[rank_a - 1] = last_b[rank_b - 1] = 1
        said = np.empty(len(ids_a) + len(ids_b), self.words_a.digits.dtype)
        said[np.arange(len(ids_a)) + np.append(0, rank_b)[group_a]] = self.words_a.digits[last_a, ids_a]
        said[np.arange(len(ids_b)) + rank_a[group_b]] = self.words_b.digits[last_b, ids_b]
        return said, ids_b[rank_b - 1] << 32 | ids_a[rank_a - 1], rank_a


def _bitset(ends: np.ndarray, n: int) -> np.ndarray:
    """Bits 1 to n of packed 64-bit words, set where a token ends."""
    marks = np.zeros((n // 64 + 1) * 64, bool)
    marks[ends] = True
    return np.packbits(marks, bitorder="little").view(np.uint64)


def _rank(words: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How many bits are set up to each place, itself included."""
    before = np.append(0, np.cumsum(np.bitwise_count(words), dtype=np.int64))
    mask = np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(63) - (at & 63).astype(np.uint64))
    return before[at >> 6] + np.bitwise_count(words[at >> 6] & mask)


def shared_cuts(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where tokens of both end (ascending ends of the same total), and how many tokens of
    A and of B end up to there."""
    n = int(ends_a[-1])
    a, b = _bitset(ends_a, n), _bitset(ends_b, n)
    cuts = np.flatnonzero(np.unpackbits((a & b).view(np.uint8), bitorder="little"))
    return cuts, _rank(a, cuts), _rank(b, cuts)


_PAIRS: dict[tuple[str, str], Pair] = {}


def _worker(a: str, b: str) -> Pair:
    if (a, b) not in _PAIRS:
        _PAIRS[a, b] = Pair(a, b)
    return _PAIRS[a, b]


def _ipc(ids: list, kind: pa.DataType) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, pa.schema([("doc_id", kind)])) as out:
        out.write_batch(pa.RecordBatch.from_arrays([pa.array(ids, kind)], ["doc_id"]))
    return sink.getvalue().to_pybytes()


def _table(batch: int, pairs: np.ndarray, n: np.ndarray, payload: bytes | None) -> pa.RecordBatch:
    size = len(pairs) or 1
    arrays = [pa.array(np.full(size, batch)), pa.array(pairs, pa.int64()) if len(pairs) else pa.nulls(1, pa.int64()), pa.array(n, pa.int64()) if len(pairs) else pa.nulls(1, pa.int64())]
    return pa.RecordBatch.from_arrays([*arrays, pa.array([payload] * size, pa.binary())], ["batch", "pair", "n", "payload"])


def _batch_rows(number: int, ids: list, texts: list[str], pair: Pair, kind: pa.DataType, keep: bool) -> Iterator[pa.RecordBatch]:
    """A row with what a batch's documents hold, and one for each distinct pair."""
    parts = [segments(" " + t) if t else [] for t in texts]
    counts = np.fromiter(map(len, parts), np.int64, len(parts))
    coded = pa.array(chain.from_iterable(parts), pa.large_string()).dictionary_encode()
    del parts
    used, distinct = coded.indices.to_numpy().astype(np.int64), coded.dictionary.to_pylist()
    found = pair.align(distinct)
    doc = np.repeat(np.arange(len(texts)), counts)
    if not found.right.all():  # such texts are one segment, or nothing
        odd = np.unique(doc[~found.right[used]])
        whole = pair.align([" " + texts[d] for d in odd.tolist()])
        found = found.join(whole)
        keep_ = ~np.isin(doc, odd)
        fine = np.flatnonzero(whole.right)
        used, doc = np.append(used[keep_], len(distinct) + fine), np.append(doc[keep_], odd[fine])
        order = np.argsort(doc, kind="stable")
        used, doc = used[order], doc[order]
        counts = np.bincount(doc, minlength=len(texts))
    n_links = np.diff(found.links_at)
    totals = np.stack([_sums(x[used], counts) for x in (found.n_a, found.n_b, n_links)], axis=1)
    sizes = np.diff(found.said_at)[used]
    ends = np.append(0, np.cumsum(_sums(sizes, counts)))
    text = ragged(found.said, found.said_at[:-1][used], sizes)
    said = [text[a:b].tobytes().translate(None, b"\0")[:-1] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
    del text
    digests = b"".join(hashlib.sha256(x).digest() if x else bytes(32) for x in said)
    used = used[np.lexsort((used, doc))]
    times = np.bincount(used, minlength=len(n_links))
    pairs, place = np.unique(found.links, return_inverse=True)
    n = np.bincount(place, np.repeat(times, n_links), len(pairs)).astype(np.int64)
    steps = np.diff(used, prepend=0) & 0xFFFFFFFF
    payload = frame(_ipc(ids, kind), planes(totals.ravel()), digests, planes(counts), planes(steps), planes(n_links), planes(place), zstandard.compress(frame(*said), 3) if keep else b"")
    yield _table(number, pairs[:0], n[:0], payload)
    for i in range(0, len(pairs), OUT_PAIRS):
        yield _table(number, pairs[i : i + OUT_PAIRS], n[i : i + OUT_PAIRS], None)


def _encode(batches: Iterator[pa.RecordBatch], a: str, b: str, kind: pa.DataType, keep: bool) -> Iterator[pa.RecordBatch]:
    pair = _worker(a, b)
    number = uuid.uuid4().int >> 66  # a task may take several partitions; what it writes is written once
    ids, texts, size = [], [], 0
    for batch in batches:
        for doc, text in zip(batch.column(0).to_pylist(), strings(batch.column(1)).to_pylist(), strict=True):
            ids.append(doc)
            texts.append(text)
            size += len(text)
            if size >= BATCH_CHARS or len(ids) >= BATCH_TEXTS:
                yield from _batch_rows(number, ids, texts, pair, kind, keep)
                number += 1
                ids, texts, size = [], [], 0
    if ids:
        yield from _batch_rows(number, ids, texts, pair, kind, keep)


def _add_up(batches: Iterator[pa.RecordBatch], keep: bool) -> Iterator[pa.RecordBatch]:
    """Batches come together, the row of the documents first, then pairs in order."""
    payload, parts = None, []

    def result() -> pa.RecordBatch:
        ids, totals, digests, counts, steps, n_links, place, said = unframe(payload)
        doc_ids = pa.ipc.open_stream(ids).read_all().column(0).combine_chunks()
        totals = unplanes(totals).astype(np.int64).reshape(-1, 3)
        used = np.cumsum(unplanes(steps).astype(np.uint32), dtype=np.uint32).astype(np.int64)
        corpus, best = (np.concatenate([p[i] for p in parts]) if parts else np.zeros(0, np.int64) for i in (0, 1))
        place, n_links = unplanes(place).astype(np.int64), unplanes(n_links).astype(np.int64)
        ends = np.append(0, np.cumsum(n_links))
        cuts = np.append(0, np.cumsum(unplanes(counts).astype(np.int64)))
        out = []
        for values in (best, corpus):
            by_link = np.append(0, np.cumsum(values[place].astype(np.int64)))
            by_segment = np.append(0, np.cumsum((by_link[ends[1:]] - by_link[ends[:-1]])[used]))
            out.append(by_segment[cuts[1:]] - by_segment[cuts[:-1]])
        hashes = ["" if not t else digests[32 * i : 32 * i + 32].hex() for i, t in enumerate(totals[:, 0].tolist())]
        arrays = [doc_ids, *(pa.array(totals[:, i]) for i in (0, 1, 2, 2)), *map(pa.array, out), pa.array(hashes, pa.string())]
        names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
        if keep:
            arrays.append(pa.array([s.decode() for s in unframe(zstandard.decompress(said))], pa.string()))
            names.append("groups")
        return pa.RecordBatch.from_arrays(arrays, names)

    for batch in batches:
        blobs = batch.column(2)
        heads = np.flatnonzero(blobs.is_valid().to_numpy(zero_copy_only=False)).tolist()
        for i, j in zip([None, *heads], [*heads, len(blobs)], strict=True):
            if i is not None:
                if payload is not None:
                    yield result()
                payload, parts = blobs[i].as_py(), []
            begin = 0 if i is None else i + 1
            if j > begin:
                rows = batch.slice(begin, j - begin)
                parts.append((rows.column(0).to_numpy(zero_copy_only=False), rows.column(1).to_numpy(zero_copy_only=False)))
    if payload is not None:
        yield result()


def link_counts(encoded: DataFrame) -> DataFrame:
    """``pair, total, best`` of all pairs of the batches."""
    pairs = encoded.filter("pair IS NOT NULL").groupBy("pair").agg(F.sum("n").alias("total"))
    pairs = materialize(pairs.withColumn("b", F.shiftright("pair", 32)), "pairs")
    highest = pairs.groupBy("b").agg(F.max("total").alias("most"))
    return pairs.join(highest, "b").select("pair", "total", (F.col("total") == F.col("most")).alias("best"))


def align_tokenizers(docs: DataFrame, a: str | None = None, b: str | None = None, keep: bool = False) -> tuple[DataFrame, DataFrame]:
    """The alignment of every text of ``docs`` and the corpus's links.

    Returns ``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256``
    (with ``keep`` also ``groups``, as ``a1,a2|b1;a3|b2,b3``), and ``a_id, b_id, n,
    best``: how often each pair is linked, and whether no other does so more often for
    its B id.
    """
    spark = prepare(docs.sparkSession)
    a, b = a or public_tokenizers.path(TOKENIZER_A), b or public_tokenizers.path(TOKENIZER_B)
    rows = docs.select("doc_id", "text")
    kind = rows.schema["doc_id"].dataType
    id_type = to_arrow_type(kind)
    encoded = materialize(rows.mapInArrow(lambda x: _encode(x, a, b, id_type, keep), _TABLE), "aligned")
    counts = link_counts(encoded)
    own = encoded.filter("payload IS NOT NULL").select("batch", F.lit(None).cast("long").alias("pair"), F.lit(None).cast("long").alias("total"), F.lit(None).cast("boolean").alias("best"), "payload")
    asked = encoded.filter("pair IS NOT NULL").select("batch", "pair").join(counts, "pair").select("batch", "pair", "total", "best", F.lit(None).cast("binary").alias("payload"))
    dealt = max(partitions(spark), own.count() // 4)
    together = own.unionByName(asked).repartition(dealt, "batch").sortWithinPartitions("batch", F.asc_nulls_first("pair")).select("total", "best", "payload")
    schema = f"doc_id {kind.simpleString()}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string" + ", groups string" * keep
    links = counts.select((F.col("pair").bitwiseAND(0xFFFFFFFF)).cast("int").alias("a_id"), F.shiftright("pair", 32).cast("int").alias("b_id"), F.col("total").alias("n"), "best")
    return together.mapInArrow(lambda x: _add_up(x, keep), schema), links


def op11_align_tokenizers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align_tokenizers(table(spark, sf_dir, "documents"))[0]
