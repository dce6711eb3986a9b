"""Quality classifier: histogram gradient-boosted trees over document statistics, flattened into arrays for numpy.

Statistics are measured in one pass over the whole texts. The trees are grown on a bounded sample of labelled rows, whose
statistics are cut into bins by quantiles, so a split is a scan over sums of gradients per bin. All trees lie in five flat arrays,
and a batch of documents walks all of them at once, one level a step.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sourceloom.llm.textarrays import binary_buffers, mix, sliced, span_hashes, word_spans
from sourceloom.session import prepare, stored

#: Labelled rows the trees are grown on, those with the least hashes of their ids.
SAMPLE = 20_000
TREES, DEPTH, BINS, RATE, RIDGE, LEAST_WEIGHT = 80, 4, 64, 0.15, 1.0, 5.0
#: Kinds of bytes whose shares are statistics: lower and upper case, digits, non-ASCII, blanks, line ends, points and commas,
#: exclamation and question marks, bars and brackets, other signs.
_KINDS = np.full(256, 9, np.uint8)
_KINDS[97:123], _KINDS[65:91], _KINDS[48:58], _KINDS[128:] = 0, 1, 2, 3
_KINDS[[32, 9]], _KINDS[[10, 13]] = 4, 5
for _signs, _kind in ((b".,;:", 6), (b"!?", 7), (b"|<>[]{}()", 8)):
    _KINDS[list(_signs)] = _kind
NAMES = ("log_words", "word_bytes", "distinct_words", "top_word", "distinct_triples", "repeated_lines", "words_a_line",
         "lower", "upper", "digits", "non_ascii", "blanks", "line_ends", "points", "marks", "bars", "signs", "sign_words", "shouted_words")


def _distinct(values: np.ndarray) -> tuple[float, float]:
    """Shares of distinct values, and of the most frequent one."""
    if not len(values):
        return 1.0, 0.0
    ordered = np.sort(values)
    edges = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1], [True]]))
    return (len(edges) - 1) / len(values), np.diff(edges).max() / len(values)


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of NAMES for each document; a text without words has zeros but for the shares of bytes."""
    n = len(offsets) - 1
    sizes = np.diff(offsets)
    of = np.repeat(np.arange(n), sizes)
    kinds = _KINDS[data]
    shares = np.bincount(of * 10 + kinds, minlength=10 * n).reshape(n, 10) / np.maximum(1, sizes)[:, None]
    starts, ends, first = word_spans(data, offsets)
    words = span_hashes(data, starts, ends)
    last = kinds[ends - 1] if len(ends) else np.zeros(0, np.uint8)
    odd = np.concatenate([[0], np.cumsum((last == 9) | (last == 8))])
    head = kinds[starts] if len(starts) else np.zeros(0, np.uint8)
    second = kinds[np.minimum(starts + 1, ends - 1)] if len(starts) else head
    shout = np.concatenate([[0], np.cumsum((head == 1) & (second == 1))])
    lines = np.flatnonzero(data == 10)
    triples = mix(mix(words[:-2] * np.uint64(3) + words[1:-1]) * np.uint64(3) + words[2:]) if len(words) > 2 else words[:0]
    line_of = np.searchsorted(lines, starts)
    out = np.zeros((n, len(NAMES)))
    for i in range(n):
        lo, hi = first[i], first[i + 1]
        if hi == lo:
            continue
        count = hi - lo
        distinct, top = _distinct(words[lo:hi])
        edges = np.concatenate([[0], np.flatnonzero(np.diff(line_of[lo:hi])) + 1])
        out[i, :7] = (np.log1p(count), (ends[lo:hi] - starts[lo:hi]).mean(), distinct, top, _distinct(triples[lo:max(lo, hi - 2)])[0],
                      1 - _distinct(np.add.reduceat(mix(words[lo:hi]), edges))[0], count / len(edges))
        out[i, 17:] = (odd[hi] - odd[lo]) / count, (shout[hi] - shout[lo]) / count
    out[:, 7:17] = shares
    return out


@dataclass
class Trees:
    """Flat trees: roots, and for each node its statistic, threshold (at most: left), children and value; leaves lead to themselves."""

    base: float
    roots: np.ndarray
    statistic: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 of each row."""
        at = np.tile(self.roots, (len(x), 1))
        row = np.arange(len(x))[:, None]
        for _ in range(DEPTH):
            at = np.where(x[row, self.statistic[at]] <= self.threshold[at], self.left[at], self.right[at])
        return 1 / (1 + np.exp(-(self.base + self.value[at].sum(axis=1))))


def grow(x: np.ndarray, y: np.ndarray) -> Trees:
    """Boosted trees for labels 0 and 1; without both labels a constant, 0.5 without any."""
    rate = (y.sum() + 1) / (len(y) + 2)
    base = float(np.log(rate / (1 - rate)))
    nodes: list[list[float]] = []
    roots = []
    if len(y) and 0 < y.sum() < len(y):
        cuts = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
        binned = np.stack([np.searchsorted(c, v) for c, v in zip(cuts, x.T)], axis=1)
        offset = np.arange(x.shape[1]) * BINS
        margin = np.full(len(y), base)
        for _ in range(TREES):
            p = 1 / (1 + np.exp(-margin))
            gradient, weight = y - p, p * (1 - p)
            roots.append(len(nodes))
            nodes.append([])
            open_ = [(roots[-1], np.arange(len(y)), 0)]
            while open_:
                node, rows, depth = open_.pop()
                g, h = gradient[rows].sum(), weight[rows].sum()
                best = None
                if depth < DEPTH and h >= 2 * LEAST_WEIGHT:
                    cell = (binned[rows] + offset).ravel()
                    size = x.shape[1] * BINS
                    gl = np.bincount(cell, np.repeat(gradient[rows], x.shape[1]), size).reshape(-1, BINS).cumsum(axis=1)
                    hl = np.bincount(cell, np.repeat(weight[rows], x.shape[1]), size).reshape(-1, BINS).cumsum(axis=1)
                    gain = gl ** 2 / (hl + RIDGE) + (g - gl) ** 2 / (h - hl + RIDGE) - g ** 2 / (h + RIDGE)
                    gain[(hl < LEAST_WEIGHT) | (h - hl < LEAST_WEIGHT)] = 0
                    f, b = divmod(int(gain.argmax()), BINS)
                    if gain[f, b] > 1e-6 and b < len(cuts[f]):
                        best = f, b
                if best is None:
                    step = RATE * g / (h + RIDGE)
                    nodes[node] = [0, 0.0, node, node, step]
                    margin[rows] += step
                else:
                    f, b = best
                    nodes[node] = [f, cuts[f][b], len(nodes), len(nodes) + 1, 0.0]
                    side = binned[rows, f] <= b
                    open_ += [(len(nodes), rows[side], depth + 1), (len(nodes) + 1, rows[~side], depth + 1)]
                    nodes.extend([[], []])
    flat = np.array(nodes or [[0, 0, 0, 0, 0]], float)
    return Trees(base, np.array(roots or [0]), flat[:, 0].astype(int), flat[:, 1], flat[:, 2].astype(int), flat[:, 3].astype(int), flat[:, 4])


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether a row is kept from learning: crc32 of its id as text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def quality_scores(docs: DataFrame, labels: DataFrame, label: str = "quality") -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of ``docs`` (doc_id, text); ``labels`` has doc_id and ``label`` 0 or 1.

    Labels of held-out rows and null labels are not learned from; at most SAMPLE other ids are, each with its greatest label and its
    row of least measures. Null texts count as empty and get a
    score like any other. Rows keep their number whatever ids repeat or are null; a null id is never held out. Without labels of
    both kinds every score is the share of label 1, or 0.5. An empty table gives no rows. Nothing but the text enters a score.
    """
    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text", 2 << 20):
            found = statistics(*binary_buffers(batch.column("text")))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([r.tobytes() for r in found.astype(np.float32)], pa.binary())], ["doc_id", "measures"])

    prepare(docs.sparkSession)
    texts = docs.select("doc_id", F.col("text").cast("binary").alias("text"))
    rows = stored(texts.mapInArrow(measured, "doc_id long, measures binary"), "measures")
    known = labels.select("doc_id", F.col(label).alias("label")).where("label in (0, 1) and doc_id is not null").where(~held_out())
    known = known.groupBy("doc_id").agg(F.max("label").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE)
    learned = rows.join(F.broadcast(known), "doc_id").groupBy("doc_id", "label").agg(F.min("measures").alias("measures")).toPandas().sort_values("doc_id")
    x = np.frombuffer(b"".join(learned["measures"]), np.float32).reshape(-1, len(NAMES))
    trees = grow(x.astype(float), learned["label"].to_numpy(float))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.frombuffer(b"".join(batch.column("measures").to_pylist()), np.float32).reshape(-1, len(NAMES)).astype(float)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(trees.score(x), pa.float64())], ["doc_id", "score"])

    out = rows.mapInArrow(scored, "doc_id long, score double")
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
