"""Whole texts of an Arrow batch as numpy arrays: words, their hashes and the documents they belong to."""

from __future__ import annotations

import ctypes
import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes hashed at a time, so that working arrays stay in the cache; a longer word is hashed whole.
SLICE_BYTES = 1 << 18
_BASE = 0x9E3779B97F4A7C15 | 1
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE_CODES = np.random.default_rng(20240607).integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LOWER_CODES = _BYTE_CODES[_LOWER]


def mix(values: np.ndarray) -> np.ndarray:
    """Scramble 64-bit values one to one."""
    values = values ^ (values >> np.uint64(30))
    values = values * np.uint64(0xBF58476D1CE4E5B9)
    values = values ^ (values >> np.uint64(27))
    values = values * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_POWERS: list[np.ndarray] = []


def _power_tables(n: int) -> list[np.ndarray]:
    if not _POWERS or len(_POWERS[0]) < n:
        _POWERS[:] = [_powers(_BASE, n), _powers(pow(_BASE, -1, 2**64), n)]
    return _POWERS


def binary_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a binary column and the offsets of its rows; null rows are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def word_spans(data: np.ndarray, offsets: np.ndarray, between: np.ndarray = _BLANK) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and the words before each document (one more entry than documents).

    Words are ``[^\\x20\\x09-\\x0D]+``, or runs of bytes other than those that the table ``between`` marks.
    """
    if not len(data):
        return np.empty(0, np.int64), np.empty(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = ~between[data]
    starts, ends = inside.copy(), inside.copy()
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    starts[1:] &= ~inside[:-1] | edge[1:-1]
    ends[:-1] &= ~inside[1:] | edge[1:-1]
    first = np.flatnonzero(starts)
    return first, np.flatnonzero(ends) + 1, np.searchsorted(first, offsets)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = True) -> np.ndarray:
    """A 64-bit hash of each span of bytes (ascending, not overlapping), A-Z lower-cased first if asked."""
    out, codes, i = np.empty(len(starts), np.uint64), _LOWER_CODES if lower else _BYTE_CODES, 0
    while i < len(starts):
        a = starts[i]
        j = max(i + 1, int(np.searchsorted(ends, a + SLICE_BYTES, "right")))
        b = ends[j - 1]
        power, inverse = _power_tables(int(max(SLICE_BYTES, b - a)))
        terms = codes[data[a:b]] * power[:b - a]
        sums = np.add.accumulate(terms)
        s, e = starts[i:j] - a, ends[i:j] - 1 - a
        out[i:j] = (sums[e] - sums[s] + terms[s]) * inverse[s] + (ends[i:j] - starts[i:j]).astype(np.uint64)
        i = j
    return mix(out)


def sliced(batches: Iterator[pa.RecordBatch], column: str, most: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """The batches cut so that each holds at most ``most`` bytes of ``column``, or one row."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        total = np.add.accumulate(sizes.astype(np.int64))
        at = 0
        while at < batch.num_rows:
            base = total[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(total, base + most, "right")))
            yield batch.slice(at, to - at)
            at = to
    release()


def release() -> None:
    """Give freed memory back to the system: workers stay alive between stages beside the JVM."""
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
        if trim:
            trim(0)


class SpanNumbers:
    """Numbers of spans of bytes: short ones from arrays that hold their bytes, the others from a mapping.

    A slot of the arrays holds the bytes and length of one span of at most 15 bytes, so a match is exact; a later span takes a
    slot over. ``resolve`` gives the numbers of a list of spans.
    """

    _KEEP = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)

    def __init__(self, resolve: Callable[[list[bytes]], list[int]], slot_bits: int) -> None:
        self.resolve, self.shift = resolve, np.uint64(64 - slot_bits)
        self.head, self.tail, self.number = (np.zeros(1 << slot_bits, kind) for kind in (np.uint64, np.uint64, np.int32))

    def of(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The number of each span of ``data``."""
        if not len(starts):
            return np.zeros(0, np.int64)
        raw = data.tobytes() + bytes(24)
        words = np.ndarray(len(raw) - 16, np.dtype("<u8"), raw, 0, (1,))
        lengths = ends - starts
        head = words[starts] & self._KEEP[np.minimum(lengths, 8)]
        tail = words[np.minimum(starts + 8, len(data))] & self._KEEP[np.clip(lengths - 8, 0, 7)] | np.minimum(lengths, 255).astype(np.uint64) << np.uint64(56)
        slot = (mix(head ^ tail * np.uint64(_BASE)) >> self.shift).astype(np.int64)
        out = self.number[slot].astype(np.int64)
        missed = np.flatnonzero((self.head[slot] != head) | (self.tail[slot] != tail) | (lengths > 15))
        out[missed] = self.resolve(list(map(raw.__getitem__, map(slice, starts[missed].tolist(), ends[missed].tolist()))))
        short = missed[lengths[missed] <= 15]
        at = slot[short]
        self.head[at], self.tail[at], self.number[at] = head[short], tail[short], out[short]
        return out
