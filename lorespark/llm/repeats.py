"""Removal of repeated strings: depth-limited radix sort of suffixes.

A byte goes if a string of ``WINDOW`` bytes that covers it also starts anywhere
else.  Suffixes are ordered by most-significant-digit passes, only through
``WINDOW`` bytes; groups that are equal then are exactly the repeated windows.
The same passes, with words as the letters, find the passages of ``PASSAGE`` words
and more that also stand in another text.

First digit.  Of the grams (``GRAM`` bytes, ``PASSAGE_GRAM`` words) inside a window,
the one with the smallest hash (the last such) is its anchor: it depends on the
window's content alone, so equal windows have equal anchors at equal places.  The
corpus is dealt by anchor, about one in 150 bytes and one in 20 words, packed by
batches; anchors that occur once end there.
Further digits.  The stretches around the anchors that are left are grouped by a
hash (identical ones at once); the letters themselves move only where an anchor has
different ones.  A group of more than
``GROUP`` different stretches is split: its windows are halved by the anchor's place
in them, and what all windows of a half have around the anchor is the next digit.
That goes on until groups are small or the digit is the whole window, so a passage
that fills the corpus never meets in one task.  Within a small group the windows go
through passes of ``DIGIT`` bytes, each dropping what is alone.

Identity is by content: a text is its MD5, digits are 64-bit hashes.  Copies of
a text are one text; all of it goes if it has ``WINDOW`` bytes and a copy.

Defined results: a null or empty text has no bytes and loses none; a null doc_id
is carried; repeated rows are copies and each give a row; an empty table gives
an empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import forget, materialize, mix, partitions, prefix_hash, prepare, settled, slices, span_hash, table, utf8, window_hash, word_spans
from .packed import MOVE, ascending, bits, by_group, frame, how_many_ranges, in_parts, moves, own_range, planes, range_cuts, unascending, unbits, unframe, unplanes

WINDOW = 400
GRAM = 100
DIGIT = 100
#: Words of a passage, of its grams and of its digits.
PASSAGE = 51
PASSAGE_GRAM = 12
PASSAGE_DIGIT = 13
GROUP = 5_000
#: Stretches that are sorted together in memory.
BLOCK = 3_000
#: Bytes of text in a batch whose anchors travel together.
BATCH_BYTES = 1 << 23

_PLACE = np.uint64((1 << 22) - 1)


class Letters(NamedTuple):
    """What a window is made of: bytes (kind 0) or words (kind 1)."""

    kind: int
    window: int
    gram: int
    digit: int


def _sliding_min(a: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` consecutive values."""
    n = len(a) - width + 1
    pad = -len(a) % width
    top = np.iinfo(a.dtype).max
    blocks = np.concatenate([a, np.full(pad, top, a.dtype)]).reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def anchors(hashes: np.ndarray, offs: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, ...]:
    """(hash, text number, place, first start, last start) of the anchors of all
    windows, from the hashes of all grams; places and starts count from the text's
    begin.  The texts have less than 2^22 letters, or are one (whose windows are then
    taken in parts)."""
    n = int(offs[-1])
    if n < window:
        return tuple(np.zeros(0, t) for t in (np.uint64, np.int64, np.int64, np.int64, np.int64))
    most = int(_PLACE)
    if n > most:
        found, step = [], most - window
        for a in range(0, n - window + 1, step):
            b = min(n, a + step + window - 1)
            h, t, p, s0, s1 = anchors(hashes[a : b - gram + 1], np.array([0, b - a]), window, gram)
            found.append((h, t, p + a, s0 + a, s1 + a))
        return tuple(map(np.concatenate, zip(*found, strict=True)))
    packed = (hashes & ~_PLACE) | (_PLACE - np.arange(n - gram + 1, dtype=np.uint64))
    least = _sliding_min(packed, window - gram + 1)
    place = (_PLACE - (least & _PLACE)).astype(np.int64)
    starts = np.arange(len(place))
    text = np.searchsorted(offs, starts, "right") - 1
    fits = starts + window <= offs[text + 1]
    place, starts, text = place[fits], starts[fits], text[fits]
    if not len(starts):
        return anchors(hashes, np.zeros(1, np.int64), window, gram)
    first = np.ones(len(starts), bool)
    first[1:] = (place[1:] != place[:-1]) | (text[1:] != text[:-1])
    first = np.flatnonzero(first)
    last = np.append(first[1:], len(starts)) - 1
    base = offs[text[first]]
    return hashes[place[first]], text[first], place[first] - base, starts[first] - base, starts[last] - base


def byte_anchors(data: np.ndarray, offs: np.ndarray, window: int = WINDOW, gram: int = GRAM, sums: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    at = np.arange(max(0, len(data) - gram + 1))
    return anchors(span_hash(prefix_hash(data) if sums is None else sums, at, at + gram), offs, window, gram)


def _words(data: np.ndarray, offs: np.ndarray, sums: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The words' hashes, and the offsets of the texts in them."""
    starts, ends, text = word_spans(data, offs)
    return span_hash(prefix_hash(data) if sums is None else sums, starts, ends), np.searchsorted(text, np.arange(len(offs)))


def word_anchors(data: np.ndarray, offs: np.ndarray, window: int = PASSAGE, gram: int = PASSAGE_GRAM, sums: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    words, of_text = _words(data, offs, sums)
    h, *rest = anchors(window_hash(words, gram), of_text, window, gram)
    return mix(h ^ np.uint64(gram)), *rest


def _find(ranges: int, window: int, gram: int):
    """Anchors of batches of texts by hash range: each anchor once a batch, with an
    occurrence (text and place; of a word anchor the text alone) and whether there are
    others; and a row with all of the batch's anchors."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        held: list[list[np.ndarray]] = []
        keys: list[bytes] = []
        size = 0

        def rows() -> list[tuple]:
            h, doc, kind, p, s0, s1 = (np.concatenate(c) for c in zip(*held, strict=True))
            order = np.argsort(h, kind="stable")
            h, doc, kind, p, s0, s1 = (x[order] for x in (h, doc, kind, p, s0, s1))
            own = frame(b"".join(keys), ascending(h), *map(planes, (doc, kind, p, p - s0, s1 - s0)))
            out = [(number, own_range(number, ranges), own)]
            if len(h):
                text = np.frombuffer(b"".join(keys), "<u8").reshape(-1, 2)[doc, 0]
                seen = mix(text ^ np.where(kind == 1, np.uint64(0), mix(p.astype(np.uint64)))) & np.uint64(0xFFFFFFFF)
                begins = np.flatnonzero(np.diff(h, prepend=h[0] + np.uint64(1)))
                low, high = np.minimum.reduceat(seen, begins), np.maximum.reduceat(seen, begins)
                each = h[begins]
                out += [(number, r, frame(ascending(each[a:b]), planes(low[a:b]), bits(low[a:b] != high[a:b]))) for r, a, b in range_cuts(each, 64, ranges)]
            return out

        for batch in batches:
            data, offs = utf8(batch.column(1))
            names = batch.column(0).to_pylist()
            for i, j in slices(offs):
                part = data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
                sums = prefix_hash(part[0])
                for kind, found in enumerate((byte_anchors(*part, window, gram, sums), word_anchors(*part, sums=sums))):
                    h, t, p, s0, s1 = found
                    held.append([h, t + len(keys), np.full(len(h), kind), p, s0, s1])
                keys += names[i:j]
                size += int(offs[j] - offs[i])
                if size >= BATCH_BYTES or len(keys) >= 60_000:
                    yield moves(rows())
                    number += 1
                    size = 0
                    held.clear(), keys.clear()
        if keys:
            yield moves(rows())

    return work


def _common(ranges: int):
    """Of each range, which anchors occur more than once, back to each batch."""

    def load(blob: bytes) -> tuple[np.ndarray, ...]:
        h, low, many = unframe(blob)
        h = unascending(h)
        return h, unplanes(low), unbits(many, len(h))

    def solve(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        for place, parts in in_parts(rows, 64, ranges, load):
            h, low, many = (np.concatenate(c) for c in zip(*parts, strict=True))
            out = np.empty(len(h), bool)
            if len(h):
                order = np.argsort(h, kind="stable")
                begins = np.flatnonzero(np.diff(h[order], prepend=h[order[0]] + np.uint64(1)))
                own = low[order]
                common = (np.minimum.reduceat(own, begins) != np.maximum.reduceat(own, begins)) | np.logical_or.reduceat(many[order], begins)
                out[order] = np.repeat(common, np.diff(np.append(begins, len(h))))
            at = 0
            for (number, *_), (each, *_) in zip(rows, parts, strict=True):
                yield moves([(number, place, frame(len(each).to_bytes(8, "little"), bits(out[at : at + len(each)])))])
                at += len(each)

    return lambda batches: by_group(batches, 1, solve)


_ANCHOR = [("w", pa.int32()), ("h", pa.int64()), ("p", pa.int32()), ("s0", pa.int32()), ("s1", pa.int32())]


def _pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The common anchors of each text that has any."""

    def solve(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        (*_, own), *rest = rows
        keys, h, *others = unframe(own)
        h = unascending(h)
        doc, kind, p, before, after = (unplanes(x).astype(np.int64) for x in others)
        if not len(h):
            return
        each = [unbits(b, int.from_bytes(n, "little")) for n, b in (unframe(x) for *_, x in rest)]
        begins = np.flatnonzero(np.diff(h, prepend=h[0] + np.uint64(1)))
        left = np.repeat(np.concatenate(each), np.diff(np.append(begins, len(h))))
        order = np.flatnonzero(left)
        order = order[np.argsort(doc[order], kind="stable")]
        texts, first = np.unique(doc[order], return_index=True)
        s0 = (p - before)[order]
        columns = [kind[order], h[order].view(np.int64), p[order], s0, s0 + after[order]]
        found = pa.StructArray.from_arrays([pa.array(c, k) for c, (_, k) in zip(columns, _ANCHOR, strict=True)], [n for n, _ in _ANCHOR])
        lists = pa.ListArray.from_arrays(pa.array(np.append(first, len(order)), pa.int32()), found)
        yield pa.RecordBatch.from_arrays([pa.array([keys[16 * t : 16 * t + 16] for t in texts.tolist()], pa.binary()), lists], ["k", "anchors"])

    yield from by_group(batches, 0, solve)


_NEAR = "key binary, w int, h long, fh long, p int, before int, count int"


def _letters(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def _prints(window: int):
    """The stretch around each anchor (the letters of all windows that have it) as a
    hash, with the anchor's place in it; equal stretches have equal ones."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offs = _letters(batch.column(1))
            lists = batch.column(2)
            ends = lists.offsets.to_numpy()
            flat = lists.values.slice(ends[0], ends[-1] - ends[0]).flatten()
            w, h, p, s0, s1 = (x.to_numpy(zero_copy_only=False).astype(np.int64) for x in flat)
            bounds = ends - ends[0]
            doc = np.repeat(np.arange(len(batch)), np.diff(bounds))
            fh = np.zeros(len(h), np.uint64)
            for i, j in slices(offs):
                part, cuts = data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
                sums = prefix_hash(part)
                words, of_text = _words(part, cuts, sums)
                own = np.arange(bounds[i], bounds[j])
                for kind, (up_to, starts, size) in enumerate(((sums, cuts, window), (prefix_hash(words), of_text, PASSAGE))):
                    k = own[w[own] == kind]
                    base = starts[doc[k] - i]
                    fh[k] = span_hash(up_to, base + s0[k], base + s1[k] + size)
            before = p - s0
            fh = mix(fh ^ mix((2 * before + w).astype(np.uint64)))
            columns = [pa.array(w, pa.int32()), pa.array(h), pa.array(fh.view(np.int64)), *(pa.array(x, pa.int32()) for x in (p, before, s1 - s0 + 1))]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(doc)), *columns], ["key", "w", "h", "fh", "p", "before", "count"])

    return work


def _stretches(window: int):
    """The letters of the stretches that are wanted of each text."""
    names = [x.split()[0] for x in _STRETCH.split(", ")]
    kinds = [pa.int32(), *[pa.int64()] * 4, *[pa.int32()] * 4, pa.binary()]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            texts = batch.column(0).cast(pa.large_binary())
            for text, found in zip(texts, batch.column(1).to_pylist(), strict=True):
                raw = memoryview(text.as_buffer())
                words = None
                for a in found:
                    if a["w"] and words is None:
                        data = np.frombuffer(raw, np.uint8)
                        words = memoryview(_words(data, np.array([0, len(data)]))[0].astype("<u8").tobytes())
                    s0 = a["p"] - a["before"]
                    s1 = s0 + a["count"] - 1
                    letters = bytes(words[8 * s0 : 8 * (s1 + PASSAGE)] if a["w"] else raw[s0 : s1 + window])
                    last = PASSAGE - PASSAGE_GRAM if a["w"] else window - a["gram"]
                    out.append((a["w"], a["h"], a["fh"], a["h"], a["own"], 0, last, a["before"], a["count"], letters))
                    if len(out) >= 2000:
                        yield flush(out)
            if out:
                yield flush(out)

    def flush(out: list[tuple]) -> pa.RecordBatch:
        batch = pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*out, strict=True), kinds, strict=True)], names)
        out.clear()
        return batch

    return work


def _alike(keys: np.ndarray) -> np.ndarray:
    """Which keys are not alone."""
    order = np.argsort(keys)
    own = keys[order]
    same = own[1:] == own[:-1]
    out = np.zeros(len(keys), bool)
    out[order[1:][same]] = True
    out[order[:-1][same]] = True
    return out


def repeated_windows(rows: dict[str, np.ndarray], data: np.ndarray, letters: Letters) -> tuple[np.ndarray, np.ndarray]:
    """(row, start) of the windows that occur more than once (of words: in more than
    one text): the radix passes."""
    count = rows["count"]
    ends = np.cumsum(count)
    row = np.repeat(np.arange(len(count)), count)
    start = np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - count, count)
    place = (rows["before"][row] - start).astype(np.uint64)
    at, key = rows["base"][row] + start, mix(rows["g"][row] ^ mix(place))
    sums = prefix_hash(data)
    for d in range(0, letters.window, letters.digit):
        left = np.flatnonzero(_alike(key))
        row, start, at, key = row[left], start[left], at[left], key[left]
        if not len(key):
            return row, start
        key = mix(key ^ span_hash(sums, at + d, at + min(d + letters.digit, letters.window)))
    left = np.flatnonzero(_alike(key))
    row, start, key = row[left], start[left], key[left]
    if letters.kind and len(key):
        order = np.argsort(key, kind="stable")
        own, begins = rows["own"][row[order]], np.flatnonzero(np.diff(key[order], prepend=key[order[0]] + np.uint64(1)))
        apart = np.repeat(np.minimum.reduceat(own, begins) != np.maximum.reduceat(own, begins), np.diff(np.append(begins, len(key))))
        row, start = row[order[apart]], start[order[apart]]
    return row, start


def _runs(row: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, first start, last start) of runs of consecutive starts."""
    if not len(row):
        return row, start, start
    order = np.lexsort((start, row))
    row, start = row[order], start[order]
    first = np.ones(len(row), bool)
    first[1:] = (row[1:] != row[:-1]) | (start[1:] != start[:-1] + 1)
    first = np.flatnonzero(first)
    last = np.append(first[1:], len(row)) - 1
    return row[first], start[first], start[last]


def _columns(batch: pa.RecordBatch, letters: Letters) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """The number columns and the letters of the stretches of one kind in a batch."""
    own = batch.filter(pa.compute.equal(batch.column(batch.schema.get_field_index("w")), letters.kind))
    rows = {k: own.column(own.schema.get_field_index(k)).to_numpy(zero_copy_only=False).astype(np.int64) for k in ("h", "fh", "g", "own", "a", "b", "before", "count")}
    rows["g"] = rows["g"].view(np.uint64)
    if not len(own):
        return rows | {"base": np.zeros(0, np.int64)}, np.zeros(0, np.uint8)
    data, offs = _letters(own.column(own.schema.get_field_index("letters")))
    each = 8 if letters.kind else 1
    rows["base"] = offs[:-1] // each
    return rows, data.view("<u8") if letters.kind else data


_STRETCH = "w int, h long, fh long, g long, own long, a int, b int, before int, count int, letters binary"


def _split(alphabets: list[Letters]):
    """Each stretch's windows in two halves by the anchor's place in them; the digit of a
    half is what all its windows have around the anchor."""
    names = [x.split()[0] for x in _STRETCH.split(", ")]
    kinds = [pa.int32(), *[pa.int64()] * 4, *[pa.int32()] * 4, pa.binary()]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, len(batch), 1000):
                for letters in alphabets:
                    rows, data = _columns(batch.slice(i, 1000), letters)
                    if not len(rows["h"]):
                        continue
                    sums, each = prefix_hash(data), 8 if letters.kind else 1
                    raw, middle = memoryview(data.tobytes()), (rows["a"] + rows["b"]) // 2
                    for a, b in ((rows["a"], middle), (middle + 1, rows["b"])):
                        low, high = np.maximum(a, rows["before"] - rows["count"] + 1), np.minimum(b, rows["before"])
                        left = np.flatnonzero((low <= high) & (a <= b))
                        if not len(left):
                            continue
                        a_, b_, low, high = a[left], b[left], low[left], high[left]
                        base = rows["base"][left] + rows["before"][left] - high
                        digit = span_hash(sums, base + high - a_, base + high + letters.window - b_)
                        g = mix(digit ^ mix((a_ * 1000 + b_ * 2 + letters.kind).astype(np.uint64))).view(np.int64)
                        count = high - low + 1
                        cut = [bytes(raw[each * s : each * (s + n - 1 + letters.window)]) for s, n in zip(base.tolist(), count.tolist(), strict=True)]
                        columns = [np.full(len(left), letters.kind), rows["h"][left], rows["fh"][left], g, rows["own"][left], a_, b_, high, count, cut]
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    return work


def _sort(alphabets: list[Letters]):
    """Radix passes over the rows of a partition, which come ordered by group."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            held.append(batch)
            size += len(batch)
            if size < BLOCK:
                continue
            both = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            begins = np.flatnonzero(np.diff(both.column(both.schema.get_field_index("g")).to_numpy(zero_copy_only=False))) + 1
            done = int(begins[-1]) if len(begins) else 0
            if done:
                yield from solve(both.slice(0, done))
            held = [both.slice(done)]
            size = len(both) - done
        if size:
            yield from solve(pa.Table.from_batches(held).combine_chunks().to_batches()[0])

    def solve(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for letters in alphabets:
            rows, data = _columns(batch, letters)
            row, start = repeated_windows(rows, data, letters)
            row, first, last = _runs(row, start)
            columns = [rows["h"][row], rows["fh"][row], first - rows["before"][row], last - rows["before"][row]]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.int32(), pa.int32()), strict=True)], ["h", "fh", "first", "last"])

    return work


def _merged(first: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The spans with those that touch made one."""
    order = np.argsort(first, kind="stable")
    first, end = first[order], np.maximum.accumulate(end[order]) if len(end) else end
    begins = np.flatnonzero(np.concatenate([np.ones(min(1, len(first)), bool), first[1:] > end[:-1]]))
    return first[begins], end[np.append(begins[1:], len(first)) - 1] if len(first) else end


def _cut(window: int):
    """Remove the spans of each text; what is left as a hash, or whole with ``keep``."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {"n_removed": [], "n_spans": [], "n_passages": [], "kept_sha256": [], "kept": [], "removed": []}
            lists = batch.column(2)
            ends = lists.offsets.to_numpy()
            w, first, last = (x.to_numpy(zero_copy_only=False).astype(np.int64) for x in lists.values.slice(ends[0], ends[-1] - ends[0]).flatten())
            for text, i, j in zip(batch.column(1).cast(pa.large_binary()).to_pylist(), ends[:-1] - ends[0], ends[1:] - ends[0], strict=True):
                of_words = w[i:j] == 1
                begin, end = _merged(first[i:j][~of_words], last[i:j][~of_words] + window)
                merged, parts, at = list(zip(begin.tolist(), end.tolist(), strict=True)), [], 0
                for a, b in merged:
                    parts.append(text[at:a])
                    at = b
                left = b"".join([*parts, text[at:]])
                out["n_removed"].append(len(text) - len(left))
                out["n_spans"].append(len(merged))
                out["n_passages"].append(len(_merged(first[i:j][of_words], last[i:j][of_words] + PASSAGE)[0]))
                out["kept_sha256"].append(hashlib.sha256(left).hexdigest())
                out["kept"].append(left)
                out["removed"].append([{"start": a, "end": b} for a, b in merged])
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(v, k) for v, k in zip(out.values(), kinds, strict=True))], ["key", *out])

    return work


def common_anchors(texts: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """``k, anchors`` (``key`` of a text, ``w, h, p, s0, s1``) of the rows of ``texts``
    with anchors that occur elsewhere."""
    rows = settled(texts.select("key", "text"), "settled")  # batches are numbered by their order in a task
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = partitions(texts.sparkSession)
    ranges = how_many_ranges(size, n)
    dealt = rows.mapInArrow(_find(ranges, window, gram), MOVE)
    counted = dealt.repartition(ranges, "range").sortWithinPartitions("range").mapInArrow(_common(ranges), MOVE)
    anchor = ", ".join(f"{n}: {'bigint' if k == pa.int64() else 'int'}" for n, k in _ANCHOR)
    return counted.repartition(ranges, "batch").sortWithinPartitions("batch", "range").mapInArrow(_pick, f"k binary, anchors array<struct<{anchor}>>")


def repeated_runs(stretches: DataFrame, alphabets: list[Letters]) -> tuple[DataFrame, list[DataFrame]]:
    """``h, fh, first, last``: runs of windows that repeat among different stretches; and
    the tables to forget when these have been read."""
    n = partitions(stretches.sparkSession)
    left, runs, tables = stretches, None, []
    while True:
        sizes = left.groupBy("g").agg(F.count("*").alias("n"), (F.max("a") == F.max("b")).alias("whole"), (F.min("own") != F.max("own")).alias("apart")).filter("n > 1")
        few = left.join(sizes.filter(f"n <= {GROUP} and not whole").select("g"), "g").select(*stretches.columns)
        done = few.repartition(n, "g").sortWithinPartitions("g").mapInArrow(_sort(alphabets), "h long, fh long, first int, last int")
        # groups whose digit is the whole window
        place = (-F.col("before")).alias("first"), (-F.col("before")).alias("last")
        done = done.unionByName(left.join(sizes.filter("whole").select("g", "apart"), "g").filter("w = 0 or apart").select("h", "fh", *place))
        runs = done if runs is None else runs.unionByName(done)
        many = sizes.filter(f"n > {GROUP} and not whole").select("g")
        if not many.take(1):
            return runs, tables
        left = materialize(left.join(many, "g").select(*stretches.columns).mapInArrow(_split(alphabets), _STRETCH), "halves")
        tables.append(left)


def repeated_spans(texts: DataFrame, window: int = WINDOW, gram: int = GRAM) -> tuple[DataFrame, list[DataFrame]]:
    """``key, text, spans``: of different texts (``key, doc_id, text``; the rows of
    a key have one text), those with repeated windows and the runs of these; and
    the tables to forget when that has been read."""
    alphabets = [Letters(0, window, gram, DIGIT), Letters(1, PASSAGE, PASSAGE_GRAM, PASSAGE_DIGIT)]
    mine = common_anchors(texts, window, gram).groupBy("k").agg(F.first("anchors").alias("anchors"))
    ids = texts.groupBy("key", "doc_id").count()
    one = ids.groupBy("key").agg(F.min("doc_id").alias("rep"), (F.max("count") > 1).alias("again"))
    mine = mine.join(one, F.col("key") == F.col("k")).drop("key")
    whole = texts.join(mine, (F.col("key") == F.col("k")) & F.col("doc_id").eqNullSafe(F.col("rep"))).select("key", F.col("text").cast("binary").alias("text"), "anchors", "again")
    whole = materialize(whole, "texts")
    if whole.filter("again").select(F.lit(1)).take(1):
        # texts that repeat with one id, of which the join takes every row
        once = materialize(whole.filter("again").dropDuplicates(["key"]), "once")
        whole = whole.filter("not again").unionByName(once)
    whole = whole.drop("again")

    near = materialize(whole.mapInArrow(_prints(window), _NEAR), "near")
    occurrence = F.when(F.col("w") == 1, F.xxhash64("key")).otherwise(F.xxhash64("key", "p"))
    group = near.groupBy("h", "fh").agg(*(F.first(c).alias(c) for c in ("w", "before", "count")), F.min(occurrence).alias("own"), F.max(occurrence).alias("other"), F.min(F.struct("key", "p")).alias("at"))
    # a stretch that several texts have is nobody's own
    group = group.withColumn("copied", F.col("own") != F.col("other")).withColumn("own", F.when(F.col("copied"), F.xxhash64("h", "fh")).otherwise(F.col("own"))).drop("other")
    group = materialize(group, "groups")
    all_of = group.filter("copied").select("h", "fh", (-F.col("before")).alias("first"), (F.col("count") - 1 - F.col("before")).alias("last"))
    # the letters are needed only where an anchor has different stretches
    varied = group.groupBy("h").count().filter("count > 1").select("h")
    wanted = group.join(varied, "h").select(F.col("at.key").alias("k"), F.struct("w", "h", "fh", F.col("at.p").alias("p"), "before", "count", "own", F.lit(gram).alias("gram")).alias("x"))
    wanted = wanted.groupBy("k").agg(F.collect_list("x").alias("wanted"))
    stretches = materialize(whole.join(wanted, F.col("key") == F.col("k")).select("text", "wanted").mapInArrow(_stretches(window), _STRETCH), "stretches")
    runs, halves = repeated_runs(stretches, alphabets)
    spans = runs.unionByName(all_of).groupBy("h", "fh").agg(F.collect_list(F.struct("first", "last")).alias("runs"))
    spans = materialize(spans, "spans")  # the join splits a stretch that is very frequent
    for done in (stretches, *halves):
        forget(done)
    placed = near.select("key", "w", "h", "fh", "p").join(spans, ["h", "fh"])
    placed = placed.select("key", F.transform("runs", lambda r: F.struct("w", (r["first"] + F.col("p")).alias("first"), (r["last"] + F.col("p")).alias("last"))).alias("runs"))
    placed = placed.groupBy("key").agg(F.flatten(F.collect_list("runs")).alias("spans"))
    return whole.select("key", "text").join(placed, "key"), [whole, near, group, spans]


def remove_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, keep: bool = False) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` of every row, and
    ``n_passages``, the number of its longest runs of ``PASSAGE`` words and more that
    also stand in another row's text (which are not removed for that); with ``keep``
    also the remaining bytes (``kept``) and the removed spans."""
    prepare(docs.sparkSession)
    text = F.coalesce("text", F.lit(""))
    texts = docs.select("doc_id", text.alias("text")).withColumn("key", F.unhex(F.md5(F.col("text").cast("binary"))))
    passage = F.col("text").rlike(rf"^(?:[\x20\x09-\x0D]*+[^\x20\x09-\x0D]++){{{PASSAGE}}}")
    rows = texts.select("doc_id", "key", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2(F.col("text").cast("binary"), 256).alias("sha"), passage.alias("passage"), *([F.col("text").cast("binary").alias("whole")] if keep else []))
    copied = rows.groupBy("key").count().filter("count > 1").select("key", F.lit(True).alias("copied"))
    found, tables = repeated_spans(texts, window, gram)
    cut = found.mapInArrow(_cut(window), "key binary, n_removed long, n_spans long, n_passages long, kept_sha256 string, kept binary, removed array<struct<start: bigint, end: bigint>>")
    cut = materialize(cut if keep else cut.drop("kept", "removed"), "cut")
    for done in tables:
        forget(done)
    copy = F.col("copied").isNotNull()
    pick = lambda a, b, c: F.when(copy & (F.col("n_bytes") >= window), a).otherwise(F.coalesce(b, c))
    joined = rows.join(copied, "key", "left").join(cut, "key", "left")
    nothing = hashlib.sha256(b"").hexdigest()
    more = [
        pick(F.lit(b""), F.col("kept"), F.col("whole")).alias("kept"),
        pick(F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n_bytes").alias("end"))), F.col("removed"), F.array().cast("array<struct<start: bigint, end: bigint>>")).alias("removed"),
    ] if keep else []
    return joined.select(
        "doc_id", "n_bytes",
        pick(F.col("n_bytes"), F.col("n_removed"), F.lit(0)).cast("long").alias("n_removed"),
        pick(F.lit(1), F.col("n_spans"), F.lit(0)).cast("long").alias("n_spans"),
        pick(F.lit(nothing), F.col("kept_sha256"), F.col("sha")).alias("kept_sha256"),
        F.when(copy & F.col("passage"), 1).otherwise(F.coalesce("n_passages", F.lit(0))).cast("long").alias("n_passages"), *more,
    )


def op3_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))


#: The same by a hash of every window.
OP3_SQL = r"""
WITH bytes AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
places AS (SELECT doc_id, h, unnest(range(0, length(h) // 2 - 399)) AS i FROM bytes),
windows AS (SELECT doc_id, i, md5(substring(h, 2 * i + 1, 800)) AS k FROM places),
again AS (SELECT k FROM windows GROUP BY k HAVING count(*) > 1),
hits AS (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 400 THEN 0 ELSE 1 END AS b FROM windows WHERE k IN (SELECT k FROM again)),
runs AS (SELECT doc_id, run, min(i) AS a, max(i) + 400 AS z FROM (SELECT *, sum(b) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM hits) GROUP BY ALL),
gaps AS (SELECT doc_id, coalesce(lag(z) OVER w, 0) AS a, a AS z FROM runs WINDOW w AS (PARTITION BY doc_id ORDER BY a)
         UNION ALL SELECT b.doc_id, coalesce(max(z), 0), any_value(length(h) // 2) FROM bytes b LEFT JOIN runs USING (doc_id) GROUP BY b.doc_id),
kept AS (SELECT doc_id, string_agg(substring(h, 2 * a + 1, 2 * (z - a)), '' ORDER BY a, z) AS left_ FROM gaps JOIN bytes USING (doc_id) GROUP BY doc_id),
gone AS (SELECT doc_id, sum(z - a) AS removed, count(*) AS spans FROM runs GROUP BY doc_id),
words AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
strings AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 50], ' ')) AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 49)) AS i FROM words)),
elsewhere AS (SELECT k FROM strings GROUP BY k HAVING count(DISTINCT doc_id) > 1),
begins AS (SELECT doc_id, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 51 THEN 0 ELSE 1 END AS b FROM strings WHERE k IN (SELECT k FROM elsewhere)),
passages AS (SELECT doc_id, sum(b)::BIGINT AS n FROM begins GROUP BY doc_id)
SELECT doc_id, length(h) // 2 AS n_bytes, coalesce(removed, 0)::BIGINT AS n_removed, coalesce(spans, 0) AS n_spans, sha256(from_hex(left_)) AS kept_sha256, coalesce(n, 0) AS n_passages
FROM bytes JOIN kept USING (doc_id) LEFT JOIN gone USING (doc_id) LEFT JOIN passages USING (doc_id)
"""
