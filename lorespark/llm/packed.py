"""Numbers packed into rows that travel between batches and ranges of hashes.

A batch of documents (some MB of text) sends to each range one row with what it
holds there, sorted and compressed; a range works on its rows together and sends
one row back to each.  A hash that fills the corpus is one entry of each batch.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import zstandard

#: ``range`` is negative in a batch's own row, which comes back to it unchanged.
MOVE = "batch long, range int, payload binary"


#: The most ranges, packed bytes of a range that are worked on together, and the most
#: parts of a range.
MOST_RANGES = 1 << 16
SOLVE_BYTES = 64 << 20
PARTS = 1 << 15


def frame(*parts: bytes) -> bytes:
    return b"".join(len(p).to_bytes(8, "little") + p for p in parts)


def unframe(blob: bytes) -> list[bytes]:
    out, at = [], 0
    while at < len(blob):
        n = int.from_bytes(blob[at : at + 8], "little")
        out.append(blob[at + 8 : at + 8 + n])
        at += 8 + n
    return out


def planes(a: np.ndarray) -> bytes:
    """Unsigned numbers as compressed byte planes."""
    raw = a.astype("<u8").view(np.uint8).reshape(-1, 8).T
    return zstandard.compress(np.ascontiguousarray(raw).tobytes(), 1)


def unplanes(blob: bytes) -> np.ndarray:
    raw = np.frombuffer(zstandard.decompress(blob), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(raw.T).view("<u8").ravel()


def ascending(a: np.ndarray) -> bytes:
    """Sorted numbers, as differences."""
    return planes(np.diff(a, prepend=np.uint64(0)))


def unascending(blob: bytes) -> np.ndarray:
    return np.cumsum(unplanes(blob), dtype=np.uint64)


def bits(a: np.ndarray) -> bytes:
    return zstandard.compress(np.packbits(a).tobytes(), 1)


def unbits(blob: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(zstandard.decompress(blob), np.uint8), count=n).astype(bool)


def moves(rows: list[tuple]) -> pa.RecordBatch:
    arrays = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.binary()), strict=True)]
    return pa.RecordBatch.from_arrays(arrays, ["batch", "range", "payload"])


def own_range(number: int, ranges: int) -> int:
    """Where a batch's own row is dealt: spread like the rest, and negative."""
    return -1 - number % ranges


def how_many_ranges(size: int, partitions: int) -> int:
    """Ranges for so many bytes of text: one for 8 MB, but no more than leave a batch some
    dozens of entries for each; a range that gets more than ``SOLVE_BYTES`` for that is
    worked on in parts."""
    return min(MOST_RANGES, max(partitions, size >> 23))


@cache
def _begins(width: int, ranges: int) -> np.ndarray:
    return np.array([(r << width) // ranges for r in range(ranges)], np.uint64)


def range_cuts(sorted_hashes: np.ndarray, width: int, ranges: int) -> Iterator[tuple[int, int, int]]:
    """(range, begin, end) of the ranges that the hashes of ``width`` bits fall into."""
    cuts = np.append(np.searchsorted(sorted_hashes, _begins(width, ranges)), len(sorted_hashes))
    for r in np.flatnonzero(np.diff(cuts)).tolist():
        yield r, int(cuts[r]), int(cuts[r + 1])


def in_parts(rows: list[tuple], width: int, ranges: int, load: Callable[[bytes], tuple]) -> Iterator[tuple[int, list[tuple]]]:
    """(place, arrays of each row) of a range's rows, the whole or parts of it by hash
    that fit in memory; ``load`` gives a row's arrays, the sorted hashes first."""
    parts = -(-sum(len(p) for *_, p in rows) // SOLVE_BYTES)
    first = rows[0][1]
    if parts <= 1:
        yield first * PARTS, [load(p) for *_, p in rows]
        return
    low, high = (first << width) // ranges, ((first + 1) << width) // ranges
    ends = [low + (high - low) * k // parts for k in range(1, parts)]
    for k in range(parts):
        own = []
        for *_, p in rows:
            arrays = load(p)
            cuts = [0, *np.searchsorted(arrays[0], np.array(ends, np.uint64)).tolist(), len(arrays[0])]
            own.append(tuple(x[cuts[k] : cuts[k + 1]] for x in arrays))
        yield first * PARTS + k, own


def by_group(batches: Iterator[pa.RecordBatch], column: int, solve: Callable[[list[tuple]], Iterator[pa.RecordBatch]]) -> Iterator[pa.RecordBatch]:
    """``solve`` of the rows of each value of a column, which come together.  Rows of
    negative ranges go through alone when grouped by range."""
    last, rows = None, []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if column == 1 and row[1] < 0:
                yield moves([row])
                continue
            if row[column] != last and rows:
                yield from solve(rows)
                rows = []
            last = row[column]
            rows.append(row)
    if rows:
        yield from solve(rows)
