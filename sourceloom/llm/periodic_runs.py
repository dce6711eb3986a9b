"""Periodic runs of words: stretches that repeat themselves at least four times in a row.

The words of a text are met from left to right, and each one's earlier occurrences lengthen the match of the lag at which they lie: a
sparse dynamic program over diagonals (position, position - lag). A diagonal that ends with a match of three periods or more is a run.

A single word of running text has too many earlier occurrences, so lags from 2**k to 2**(k+1) - 1 are met in steps of 2**k words: a match
of three such periods holds a whole block of 2**k words that begins at a multiple of 2**k, and that block's earlier occurrences at
these lags are the diagonals it lengthens, at most n of them altogether on a level. Where a diagonal begins and ends, the match is
carried on word by word, by halving steps. Texts in which no four words in a row come back often enough for a level skip it. All texts
of an Arrow batch are worked on at once. Words and blocks are compared by 64-bit hashes.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from sourceloom.llm.textarrays import binary_buffers, mix, sliced, span_hashes, word_spans
from sourceloom.session import prepare

#: Periods that a run must hold, and its least length in words.
PERIODS, LEAST = 4, 6
RUNS = "array<struct<start: bigint, length: bigint, period: bigint>>"
_BASE = 0xD6E8FEB86659FD93



@functools.lru_cache(1)
def _power_tables(n: int) -> list[np.ndarray]:
    """The first ``n`` powers of the base and of its inverse modulo 2**64."""
    factors = np.full((2, n), [[_BASE], [pow(_BASE, -1, 2**64)]], np.uint64)
    factors[:, 0] = 1
    return list(np.multiply.accumulate(factors, axis=1))


def _stretches(marks: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Begins and ends of the stretches of at least ``least`` marks in a row."""
    edges = np.flatnonzero(np.diff(np.concatenate([[False], marks, [False]]).view(np.int8)))
    begins, ends = edges[::2], edges[1::2]
    long = ends - begins >= least
    return begins[long], ends[long]


def _needed(period: np.ndarray | int):
    """The least match on a run's diagonal."""
    return np.maximum(LEAST, PERIODS * period) - period


class _Texts:
    """The words of several texts as one array of codes, with hashes of any stretch of them."""

    def __init__(self, codes: np.ndarray, first: np.ndarray) -> None:
        self.codes, self.first = codes, first
        sizes = np.diff(first)
        self.begin, self.end = np.repeat(first[:-1], sizes), np.repeat(first[1:], sizes)
        self.power, self.inverse = _power_tables(max(1 << 20, len(codes) + 1))
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.add.accumulate(codes * self.power[:len(codes)])])

    def hashes(self, at: np.ndarray, length: int) -> np.ndarray:
        return (self.sums[at + length] - self.sums[at]) * self.inverse[at]

    def returns(self, length: int) -> np.ndarray:
        """The distance from each stretch of ``length`` words back to the one before that equals it, within a text."""
        at = np.flatnonzero(np.arange(len(self.codes)) + length <= self.end)
        key = mix(self.hashes(at, length) + mix(self.begin[at].astype(np.uint64)))
        order = np.argsort(key, kind="stable")
        same = key[order[1:]] == key[order[:-1]]
        out = np.full(len(self.codes), np.iinfo(np.int64).max)
        out[at[order[1:][same]]] = (at[order[1:]] - at[order[:-1]])[same]
        return out


def _short(texts: _Texts, lag: int) -> list[np.ndarray]:
    """Runs of one small lag: its diagonal is met word by word."""
    codes = texts.codes
    equal = (codes[lag:] == codes[:-lag]) & (np.arange(len(codes) - lag) >= texts.begin[lag:])
    begins, ends = _stretches(equal, int(_needed(lag)))
    return [begins, ends - begins + lag, np.full(len(begins), lag)]


def _level(texts: _Texts, k: int, at: np.ndarray) -> list[np.ndarray]:
    """Runs whose period lies from 2**k to 2**(k+1) - 1, in the texts that the word positions ``at`` make up."""
    step = 1 << k
    at = at[at + step <= texts.end[at]]
    key = mix(texts.hashes(at, step) + mix(texts.begin[at].astype(np.uint64)))
    block = np.unique(key, return_inverse=True)[1].astype(np.int64)
    width = len(texts.codes) + 1
    order = np.sort(block * width + at)
    met = (at - texts.begin[at]) % step == 0
    position, base = at[met], block[met] * width
    low = np.searchsorted(order, base + np.maximum(position - 2 * step + 1, texts.begin[position]))
    high = np.searchsorted(order, base + position - step, "right")
    count = np.maximum(high - low, 0)
    earlier = order[np.repeat(low, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)] % width
    position = np.repeat(position, count)
    lag = position - earlier
    order = np.lexsort((position, lag))
    position, lag = position[order], lag[order]
    # a diagonal goes on while the next block occurs at the same lag
    new = np.concatenate([[True], (np.diff(lag) != 0) | (np.diff(position) != step)]) if len(lag) else np.zeros(0, bool)
    begin, lag = position[new], lag[new]
    end = position[np.concatenate([np.flatnonzero(new)[1:] - 1, [len(position) - 1]])] + step if len(lag) else begin
    hopeful = end - begin + 2 * step > _needed(lag)
    begin, end, lag = begin[hopeful], end[hopeful], lag[hopeful]
    first, last = texts.begin[begin], texts.end[begin]
    for width in (1 << j for j in reversed(range(k))):
        to = begin - width
        inside = np.flatnonzero(to - lag >= first)
        goes = inside[texts.hashes(to[inside], width) == texts.hashes(to[inside] - lag[inside], width)]
        begin[goes] -= width
        inside = np.flatnonzero(end + width <= last)
        goes = inside[texts.hashes(end[inside], width) == texts.hashes(end[inside] - lag[inside], width)]
        end[goes] += width
    long = end - begin >= _needed(lag)
    return [(begin - lag)[long], (end - begin + lag)[long], lag[long]]


def word_runs(codes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, lengths and smallest periods of all runs by start and period. ``codes`` are the words of all texts, one after the
    other, of which text t has those from ``first[t]`` to ``first[t + 1]``; no run crosses texts."""
    texts = _Texts(codes, first)
    sizes = np.diff(first)
    longest = int(sizes.max(initial=0))
    found = [_short(texts, lag) for lag in (1, 2, 3) if longest >= max(LEAST, PERIODS * lag)]
    if longest >= 4 * PERIODS:
        returned = texts.returns(4)
        for k in range(2, (longest // PERIODS).bit_length()):
            begins, _ = _stretches(returned < 2 << k, (PERIODS - 1 << k) - 3)
            if len(begins):
                own = np.unique(texts.begin[begins])
                own = own[texts.end[own] - own >= PERIODS << k]
                at = np.concatenate([np.arange(b, texts.end[b]) for b in own]) if len(own) else own
                found.append(_level(texts, k, at))
    if not found:
        return (np.zeros(0, np.int64),) * 3
    start, length, period = (np.concatenate(parts) for parts in zip(*found))
    # a stretch that also has a smaller period ends where that one's diagonal does
    order = np.lexsort((period, length, start))
    start, length, period = start[order], length[order], period[order]
    kept = np.concatenate([[True], (np.diff(start) != 0) | (np.diff(length) != 0)]) if len(start) else np.zeros(0, bool)
    start, length, period = start[kept], length[kept], period[kept]
    order = np.lexsort((period, start))
    return start[order], length[order], period[order]


def _found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in sliced(batches, "text"):
        data, offsets = binary_buffers(batch.column("text"))
        begins, ends, first = word_spans(data, offsets)
        start, length, period = word_runs(span_hashes(data, begins, ends, lower=False), first)
        at = np.searchsorted(start, first)
        own = np.repeat(np.arange(batch.num_rows), np.diff(at))
        runs = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.StructArray.from_arrays(
            [pa.array(start - first[own]), pa.array(length), pa.array(period)], ["start", "length", "period"]))
        # words after the first period of a run go, the others are joined by one space
        depth = np.zeros(len(begins) + 1, np.int64)
        np.add.at(depth, start + period, 1)
        np.add.at(depth, start + length, -1)
        kept = np.flatnonzero(np.cumsum(depth)[:-1] == 0)
        word, last = np.searchsorted(kept, first), np.zeros(len(kept), bool)
        last[word[1:][np.diff(word) > 0] - 1] = True
        taken = np.zeros(len(data) + 1, np.int8)
        taken[begins[kept]] += 1
        until = ends[kept] + ~last  # with the blank after the word, but for a text's last one
        np.add.at(taken, until, -1)
        taken = np.cumsum(taken[:-1], dtype=np.int8).view(bool)
        plain = data.copy()
        plain[ends[kept[~last]]] = 0x20
        total = np.concatenate([[0], np.cumsum(taken)])[offsets]
        out = plain[taken]
        collapsed = pa.LargeBinaryArray.from_buffers(pa.large_binary(), batch.num_rows, [None, pa.py_buffer(total.astype(np.int64)), pa.py_buffer(out)])
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), runs, collapsed.cast(pa.binary())], ["doc_id", "runs", "collapsed"])


def periodic_runs(docs: DataFrame) -> DataFrame:
    """(doc_id, runs, collapsed) of each row of ``docs`` (doc_id, text; other columns are not looked at).

    Words are ``[^\\x20\\x09-\\x0D]+`` of the whole text. A run is a stretch of words with smallest period q, so that words q apart
    are equal, of at least LEAST words and PERIODS times q, that no word beside it extends. ``runs`` holds them by start (the number
    of its first word, from 0) and period; ``collapsed`` is the binary text of the words that no run holds after its first q words,
    joined by one space. A null or empty text has no run and an empty text; null ids and repeated rows are kept as they are, runs
    may overlap, and an empty table gives none. No row meets another, so nothing is shuffled.
    """
    prepare(docs.sparkSession)
    return docs.selectExpr("cast(doc_id as bigint) as doc_id", "cast(text as binary) as text").mapInArrow(_found, f"doc_id long, runs {RUNS}, collapsed binary")
