"""Benchmark decontamination: q-gram lemma filtering and banded alignment.

Documents and benchmark items are compared lower-cased (A-Z), runs of blanks as
one space, as bytes.  An item is cut into pieces of ``PIECE`` bytes that overlap
by half (a shorter item is one piece).  A document contains a piece if some
region of it is within ``BUDGET`` percent of the piece's length in edits; by the
q-gram lemma the two then share at least L - q + 1 - q * e of their q-grams, and
these lie in diagonals at most e apart.

Every q-gram of every document is looked up among those of the pieces.  Hits are
ordered by piece and diagonal and counted over every band of e + 1 diagonals (the
bands overlap, one starts at each diagonal); bands that reach the bound, counting
each place of the piece once, are verified by an alignment within the band.
A document with a verified piece is contaminated by its item.  Where a text's
q-grams are so common among the pieces that it has over ``HITS`` hits, it is taken
in overlapping stretches, and of each stretch only the pieces of which it has
enough places go on.

The lemma says nothing of items under ``LEAST`` bytes: these are contained where
they stand exactly, their first and last word (of letters, digits and bytes over 127)
as whole words, whatever stands around; an item without words stands between blanks.

Documents don't move.  A task holds ``HOLD_BYTES`` of texts and takes them past
the blocks of the benchmark (``BLOCK_BYTES`` each, one index at a time).  A
benchmark of more than ``PASS_BYTES`` is broadcast in parts, in as many passes.

Defined results: a null or empty text is clean; an item without words (or a null
one) matches nothing; repeated items or rows are each reported; ids of items may
be of any type, a null one is reported as such; a null doc_id is carried; an empty
table of documents gives an empty result, an empty benchmark leaves all clean;
further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import _SPACE, lower_ascii, materialize, prefix_hash, prepare, ragged, slices, span_hash, table, utf8, window_hash, word_spans

Q = 8
PIECE = 128
BUDGET = 10
LEAST = 32
BLOCK_BYTES = 1 << 20
PASS_BYTES = 64 << 20
HOLD_BYTES = 16 << 20
#: Hits that are ordered together, and bytes of a stretch of a text that has more.
HITS = 1 << 20
STRETCH = 2048
#: Bands that are verified together.
CANDIDATES = 4096

_BITS = 22
_NO_WORD = np.ones(256, bool)
_NO_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
_FACTOR = np.uint64(0x9E3779B97F4A7C15)
_SHIFT = np.uint64(40)


def normal(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Texts as they are compared; blanks at a text's begin go."""
    if not len(data):
        return data, offs
    blank = _SPACE[data]
    before = np.empty(len(data), bool)
    before[0] = True
    before[1:] = blank[:-1]
    before[offs[(offs > 0) & (offs < len(data))]] = True
    keep = ~(blank & before)
    at = np.zeros(len(data) + 1, np.int64)
    np.cumsum(keep, out=at[1:])
    return np.where(blank, np.uint8(32), lower_ascii(data))[keep], at[offs]


def grams(data: np.ndarray) -> np.ndarray:
    """The q-grams of the bytes, as numbers."""
    data = np.ascontiguousarray(data)
    return np.ndarray((len(data) - Q + 1,), "<u8", data, 0, (1,)) if len(data) >= Q else np.zeros(0, "<u8")


def normal_item(text: str | None) -> bytes:
    raw = np.frombuffer((text or "").encode(), np.uint8)
    own, _ = normal(raw, np.array([0, len(raw)]))
    return own.tobytes().strip(b" ")


class Pieces:
    """The pieces of a block of items (number, normal bytes), and the places of their
    q-grams; of short items, by what bounds their words, the hashes of these by their
    number, with the bytes before the first word."""

    def __init__(self, items: list[tuple[int, bytes]]) -> None:
        self.items: list[int] = []
        self.pieces: list[np.ndarray] = []
        self.short: dict[bool, dict[int, dict[int, list[tuple[int, bytes, int]]]]] = {False: {}, True: {}}
        for item, text in items:
            own = np.frombuffer(text, np.uint8)
            if 0 < len(own) < LEAST:
                bare = bool(_NO_WORD[own].all())
                starts, ends, _ = word_spans(own, np.array([0, len(own)]), _SPACE if bare else _NO_WORD)
                key = int(window_hash(span_hash(prefix_hash(own), starts, ends), len(starts))[0])
                self.short[bare].setdefault(len(starts), {}).setdefault(key, []).append((item, text, int(starts[0])))
            if len(own) < LEAST:
                continue
            last = max(0, len(own) - PIECE)
            for at in [*range(0, last, PIECE // 2), last]:
                self.items.append(item)
                self.pieces.append(own[at : at + PIECE])
        lengths = np.array([len(p) for p in self.pieces], np.int64)
        self.lengths, self.edits = lengths, lengths * BUDGET // 100
        self.least = np.maximum(1, lengths - Q + 1 - Q * self.edits)
        every = np.concatenate([np.zeros(0, "<u8"), *map(grams, self.pieces)])
        owner = np.repeat(np.arange(len(lengths)), np.maximum(0, lengths - Q + 1))
        place = np.concatenate([np.zeros(0, np.int64), *(np.arange(len(p) - Q + 1) for p in self.pieces)])
        order = np.argsort(every, kind="stable")
        self.grams, begins = np.unique(every[order], return_index=True)
        self.begins, self.counts = begins, np.diff(np.append(begins, len(every)))
        self.owner, self.place = owner[order], place[order]
        self.seen = np.zeros(1 << _BITS, bool)
        self.seen[self.grams * _FACTOR >> np.uint64(64 - _BITS)] = True

    def shared(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position, number among the pieces' q-grams) of all shared q-grams."""
        own = grams(data)
        at = np.flatnonzero(self.seen[own * _FACTOR >> np.uint64(64 - _BITS)])
        value = own[at]
        k = np.minimum(np.searchsorted(self.grams, value), len(self.grams) - 1)
        exact = self.grams[k] == value
        at, k = at[exact], k[exact]
        doc = np.searchsorted(offs, at, "right") - 1
        within = at + Q <= offs[doc + 1]
        return at[within], k[within]

    def hits(self, at: np.ndarray, k: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(position, piece, place in the piece) of the shared q-grams, at most about
        ``HITS`` at a time; a piece that some region fits is whole in some part."""
        n = self.counts[k]
        if n.sum() <= HITS:
            yield np.repeat(at, n), ragged(self.owner, self.begins[k], n), ragged(self.place, self.begins[k], n)
            return
        step = STRETCH - PIECE - 2 * (PIECE * BUDGET // 100) - Q
        for first in range(int(at[0]), int(at[-1]) + 1, step):
            a, b = np.searchsorted(at, [first, first + STRETCH])
            if a == b:
                continue
            kinds, which = np.unique(k[a:b], return_inverse=True)
            n = self.counts[kinds]
            owner, place = ragged(self.owner, self.begins[kinds], n), ragged(self.place, self.begins[kinds], n)
            kind = np.repeat(np.arange(len(kinds)), n)
            # a place of a piece has one q-gram, so this counts its places in the stretch
            left = (np.bincount(owner, minlength=len(self.least)) >= self.least)[owner]
            owner, place, kind = owner[left], place[left], kind[left]
            uses = np.bincount(which, minlength=len(kinds))
            load = np.cumsum(np.bincount(owner, uses[kind], minlength=len(self.least))) // HITS
            for part in np.unique(load[owner]).tolist():
                own = load[owner] == part
                o, p, g = owner[own], place[own], kind[own]
                n = np.bincount(g, minlength=len(kinds))
                begins = np.cumsum(n) - n
                yield np.repeat(at[a:b], n[which]), ragged(o, begins[which], n[which]), ragged(p, begins[which], n[which])


def align(pieces: np.ndarray, texts: np.ndarray, edits: int) -> tuple[np.ndarray, np.ndarray]:
    """(edits, end) of the best alignment of each whole piece (a row of n bytes) with a
    part of its text (a row of n + width) whose diagonals lie in ``width``; rows that
    already need more than ``edits`` are given up and keep a larger number."""
    n, width = pieces.shape[1], texts.shape[1] - pieces.shape[1]
    step = np.arange(width, dtype=np.int16)
    least, best = np.full(len(pieces), edits + 1, np.int64), np.zeros(len(pieces), np.int64)
    rows = np.arange(len(pieces))
    cost = np.zeros((len(pieces), width), np.int16)
    for i in range(n):
        new = cost + (texts[:, i : i + width] != pieces[:, i, None])
        np.minimum(new[:, :-1], cost[:, 1:] + 1, out=new[:, :-1])
        cost = np.minimum.accumulate(new - step, axis=1) + step
        if i % 8 == 7 or i == n - 1:
            left = cost.min(axis=1) <= edits
            if not left.all():
                rows, cost, pieces, texts = rows[left], cost[left], pieces[left], texts[left]
            if not len(rows):
                return least, best
    least[rows], best[rows] = cost.min(axis=1), n + cost.argmin(axis=1)
    return least, best


def exact_items(data: np.ndarray, offs: np.ndarray, block: Pieces) -> Iterator[tuple[int, int, int, int]]:
    """(text, item, start, 0) of the short items that stand as whole words."""
    known = set()
    for bare, by_number in block.short.items():
        if not by_number or not len(data):
            continue
        starts, ends, doc = word_spans(data, offs, _SPACE if bare else _NO_WORD)
        words = span_hash(prefix_hash(data), starts, ends)
        for n, wanted in by_number.items():
            if len(words) < n:
                continue
            runs = window_hash(words, n)
            for i in np.flatnonzero(np.isin(runs, np.array(list(wanted), np.uint64)) & (doc[: len(runs)] == doc[n - 1 :])).tolist():
                for item, text, before in wanted[int(runs[i])]:
                    at = int(starts[i]) - before
                    own = data[max(at, offs[doc[i]]) : min(at + len(text), offs[doc[i] + 1])].tobytes()
                    if own == text and (int(doc[i]), item) not in known:
                        known.add((int(doc[i]), item))
                        yield int(doc[i]), item, int(at - offs[doc[i]]), 0


def leaks(data: np.ndarray, offs: np.ndarray, block: Pieces) -> list[tuple[int, int, int, int]]:
    """(text, item, start, edits) of the items of which the texts contain a piece; one
    place is enough for a text and item."""
    found = list(exact_items(data, offs, block))
    if not len(block.pieces) or len(data) < Q:
        return found
    known = np.zeros(0, np.int64)
    of_item = np.array(block.items, np.int64)
    many = int(of_item.max()) + 1
    for at, piece, place in block.hits(*block.shared(data, offs)):
        diagonal = at - place + PIECE
        key = (piece.astype(np.uint64) << _SHIFT) | diagonal.astype(np.uint64)
        order = np.argsort(key)
        key, at, piece, place, diagonal = key[order], at[order], piece[order], place[order], diagonal[order]
        end = np.searchsorted(key, key + block.edits[piece].astype(np.uint64), "right")
        likely = np.flatnonzero(end - np.arange(len(key)) >= block.least[piece])
        likely = likely[np.diff(key[likely], prepend=key[likely[:1]] + np.uint64(1)) != 0]  # one band from a diagonal
        for begin in range(0, len(likely), CANDIDATES):
            i = likely[begin : begin + CANDIDATES]
            doc = np.searchsorted(offs, at[i], "right") - 1
            i = i[~np.isin(doc * many + of_item[piece[i]], known)]
            held = end[i] - i
            pairs = np.unique(np.repeat(np.arange(len(i)), held) * PIECE + ragged(place, i, held))
            i = i[np.bincount(pairs // PIECE, minlength=len(i)) >= block.least[piece[i]]]
            for size in np.unique(block.lengths[piece[i]]).tolist():
                own = i[block.lengths[piece[i]] == size]
                doc, edits = np.searchsorted(offs, at[own], "right") - 1, size * BUDGET // 100
                first = diagonal[own] - PIECE - edits
                where = first[:, None] + np.arange(size + 3 * edits + 1)
                inside = (where >= offs[doc][:, None]) & (where < offs[doc + 1][:, None])
                texts = np.where(inside, data[np.clip(where, 0, len(data) - 1)], np.int16(256))  # matches nothing outside
                need, stop = align(np.stack([block.pieces[p] for p in piece[own].tolist()]).astype(np.int16), texts, edits)
                for k in np.flatnonzero(need <= edits).tolist():
                    name = int(doc[k]) * many + block.items[piece[own[k]]]
                    if name not in known:
                        known = np.append(known, name)
                        found.append((int(doc[k]), block.items[piece[own[k]]], max(0, int(first[k] + stop[k] - size - offs[doc[k]])), int(need[k])))
    return found


def blocks_of(items: list[tuple[int, bytes]]) -> list[list[tuple[int, bytes]]]:
    out: list[list[tuple[int, bytes]]] = [[]]
    size = 0
    for item in items:
        if size >= BLOCK_BYTES:
            out.append([])
            size = 0
        out[-1].append(item)
        size += len(item[1])
    return out


def find_leaks(docs: DataFrame, benchmark: DataFrame, carry: list[str] | None = None) -> DataFrame:
    """``doc_id, leaks`` of every row (``item_id``, place in the normal text and
    edits of each item found), and the columns in ``carry``."""
    spark = prepare(docs.sparkSession)
    items = benchmark.select("item_id", "text")
    kind = items.schema["item_id"].dataType
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    passes = size // PASS_BYTES + 1
    kept = f"array<struct<item_id: {kind.simpleString()}, start: bigint, distance: int>>"
    rows = docs.select("doc_id", *(carry or []), F.col("text").alias("_read"), F.lit(None).cast(kept).alias("leaks"))
    width = len(rows.columns) - 2
    schema = rows.schema
    for number in range(passes):
        own = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(passes)) == number).collect()
        own = sorted(map(tuple, own), key=repr)
        block = spark.sparkContext.broadcast(([i for i, _ in own], blocks_of([(k, normal_item(t)) for k, (_, t) in enumerate(own)])))
        if number:
            rows = materialize(rows, "leaks")
        rows = rows.mapInArrow(_scan(block, width, to_arrow_type(kind)), schema)
    return rows.drop("_read").withColumn("leaks", F.coalesce("leaks", F.array().cast(schema["leaks"].dataType)))


def _scan(shared, width: int, id_type: pa.DataType):
    kind = pa.list_(pa.struct([("item_id", id_type), ("start", pa.int64()), ("distance", pa.int32())]))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, blocks = shared.value
        only = Pieces(blocks[0]) if len(blocks) == 1 else None
        held: list[pa.RecordBatch] = []
        size = 0

        def solve() -> Iterator[pa.RecordBatch]:
            found = [[x or [] for x in batch.column(width + 1).to_pylist()] for batch in held]
            for block in blocks:
                pieces = only or Pieces(block)
                for own, batch in zip(found, held, strict=True):
                    data, offs = utf8(batch.column(width))
                    for i, j in slices(offs):
                        for doc, item, start, edits in leaks(*normal(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]), pieces):
                            own[i + doc].append({"item_id": ids[item], "start": start, "distance": edits})
            for own, batch in zip(found, held, strict=True):
                yield pa.RecordBatch.from_arrays([*batch.columns[: width + 1], pa.array(own, kind)], batch.schema.names)
            held.clear()

        for batch in batches:
            held.append(batch)
            size += batch.nbytes
            if size >= HOLD_BYTES or only:
                yield from solve()
                size = 0
        if held:
            yield from solve()

    return work


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    ids = F.array_sort(F.array_distinct(F.transform("leaks", lambda x: x["item_id"])))
    return found.select("doc_id", (F.size("leaks") > 0).alias("contaminated"), F.size(ids).cast("long").alias("n_items"), F.array_join(ids.cast("array<string>"), ",").alias("item_ids"))
