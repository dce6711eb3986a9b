"""Toxicity by a classifier chain of linear models.

Categories are graded by how much of a labelled text's vocabulary is typical of toxic texts. The chain predicts them in order;
each later model sees the earlier categories' probabilities beside the terms. While it learns, those are out-of-fold predictions,
made by models that did not see the row, neither to be fitted nor to choose terms, so that it meets in training the kind of
probabilities it meets in use. Terms are words and beginnings of words: all whose counts over the labelled sample differ
significantly between toxic and other texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sourceloom.llm.textarrays import binary_buffers, mix, sliced, span_hashes, word_spans
from sourceloom.session import discard, prepare, stored

#: Labelled ids the chain learns from, those with the least hashes; each counts with one row.
SAMPLE = 20_000
#: Least documents of a term; standard deviations from its expected toxic documents at which it is used; share of toxic documents
#: from which it counts as typical.
LEAST, SIGNIFICANT, TYPICAL = 3, 3.0, 0.8
FOLDS, RIDGE, STEPS = 5, 0.3, 25
#: Probability of the last category from which a text is rejected.
REJECT = 0.3
#: Categories in the order of the chain: typical terms that a toxic text has at least; the last one is the label itself.
CATEGORIES = (("abusive", 1), ("repeated", 3), ("toxic", 0))
#: Columns of documents and toxic documents by fold.
COUNTS = [f"{kind}{k}" for kind in "nt" for k in range(FOLDS)]
#: Bytes of the beginnings that are terms.
BEGINNINGS = (4, 6)
_BETWEEN = np.ones(256, bool)
_BETWEEN[65:91] = _BETWEEN[97:123] = _BETWEEN[128:] = False


def terms_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all terms of all documents, and the document of each."""
    starts, ends, first = word_spans(data, offsets, _BETWEEN)
    of = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    found = [span_hashes(data, starts, ends)]
    for length in BEGINNINGS:
        found.append(mix(span_hashes(data, starts, np.minimum(ends, starts + length)) + np.uint64(length)))
    return np.concatenate(found), np.tile(of, len(found))


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, label, terms, uses): the distinct terms of labelled documents, packed, and how often each is used."""
    for batch in sliced(batches, "text", 2 << 20):
        term, of = terms_of(*binary_buffers(batch.column("text")))
        order = np.lexsort((term, of))
        term, of = term[order], of[order]
        new = np.flatnonzero(np.concatenate([[True], (term[1:] != term[:-1]) | (of[1:] != of[:-1])])[:len(term)])
        uses, term = np.diff(np.append(new, len(term))).astype(np.int32), term[new]
        edges = np.searchsorted(of[new], np.arange(batch.num_rows + 1)).tolist()
        packed = [(term[a:b].tobytes(), uses[a:b].tobytes()) for a, b in zip(edges, edges[1:])]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), *[pa.array(c, pa.binary()) for c in list(zip(*packed)) or [(), ()]]], ["doc_id", "label", "terms", "uses"])


def _unpacked(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The row, term and uses of each entry of a batch of packed features."""
    terms, uses = batch.column("terms").to_pylist(), batch.column("uses").to_pylist()
    row = np.repeat(np.arange(len(terms)), [len(t) // 8 for t in terms])
    return row, np.frombuffer(b"".join(terms), np.int64), np.frombuffer(b"".join(uses), np.int32)


def _term_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents and toxic documents of each term, in all and in each fold, summed by batch."""
    for batch in batches:
        row, term, _ = _unpacked(batch)
        label, fold = batch.column("label").to_numpy()[row].astype(np.int64), batch.column("fold").to_numpy()[row]
        terms, at = np.unique(term, return_inverse=True)
        cell = at * FOLDS + fold
        n, t = np.bincount(cell, minlength=len(terms) * FOLDS), np.bincount(cell, label, len(terms) * FOLDS).astype(np.int64)
        columns = [*n.reshape(-1, FOLDS).T, *t.reshape(-1, FOLDS).T]
        yield pa.RecordBatch.from_arrays([pa.array(terms), *map(pa.array, columns)], ["term", *COUNTS])


@dataclass
class Features:
    """Rows of a sparse matrix of 0 and 1, and some dense columns, the last of which is 1."""

    row: np.ndarray
    column: np.ndarray
    width: int
    dense: np.ndarray

    def times(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, w[self.column], len(self.dense)) + self.dense @ w[self.width:]

    def back(self, r: np.ndarray) -> np.ndarray:
        return np.concatenate([np.bincount(self.column, r[self.row], self.width), r @ self.dense])

    def some(self, rows: np.ndarray, columns: np.ndarray) -> Features:
        """The marked rows, with the marked columns only; columns keep their numbers."""
        number = np.cumsum(rows) - 1
        kept = rows[self.row] & columns[self.column]
        return Features(number[self.row[kept]], self.column[kept], self.width, self.dense[rows])


def _probability(score: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(score, -30, 30)))


def _fit(x: Features, y: np.ndarray, start: np.ndarray | None = None) -> np.ndarray:
    """Weights of a ridge logistic regression by Newton's method, its steps by conjugate gradients, from near-by weights if there
    are any; the constant bears no penalty."""
    w = np.zeros(x.width + x.dense.shape[1])
    share = (y.sum() + 0.5) / (len(y) + 1)
    w[-1] = np.log(share / (1 - share)) if len(y) else -30
    if not len(y) or y.min() == y.max():
        return w
    if start is not None:
        w = start.copy()
    penalty = np.full(len(w), RIDGE)
    penalty[-1] = 1e-6
    for _ in range(STEPS):
        p = _probability(x.times(w))
        curve = np.maximum(p * (1 - p), 1e-4)
        gradient = x.back(y - p) - penalty * w
        scale = 1 / (np.concatenate([np.bincount(x.column, curve[x.row], x.width), curve @ x.dense ** 2]) + penalty)
        step, rest = np.zeros(len(w)), gradient
        way = scale * rest
        size = rest @ way
        for _ in range(200):
            if size <= 1e-4 * (gradient @ (scale * gradient)):
                break
            bent = x.back(curve * x.times(way)) + penalty * way
            far = size / (way @ bent)
            step, rest = step + far * way, rest - far * bent
            ahead = scale * rest
            size, last = rest @ ahead, size
            way = ahead + size / last * way
        w += step
        if np.abs(step).max() < 1e-3:
            break
    return w


@dataclass
class Chain:
    """Terms by hash, ascending, and the weights of the models in order: of the terms, the earlier probabilities and a constant."""

    terms: np.ndarray
    weights: list[np.ndarray]

    def score(self, row: np.ndarray, column: np.ndarray, n: int) -> np.ndarray:
        """Probabilities of all categories of ``n`` rows, given the rows and columns at which terms are present."""
        earlier: list[np.ndarray] = []
        for w in self.weights:
            earlier.append(_probability(Features(row, column, len(self.terms), np.column_stack([*earlier, np.ones(n)])).times(w)))
        return np.column_stack(earlier)

    def of(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Probabilities of all categories of texts."""
        term, of = terms_of(data, offsets)
        values, n, width = term.view(np.int64), len(offsets) - 1, max(1, len(self.terms))
        at = np.minimum(np.searchsorted(self.terms, values), max(0, len(self.terms) - 1))
        hit = self.terms[at] == values if len(self.terms) else np.zeros(len(values), bool)
        pairs = np.unique(of[hit] * width + at[hit])
        return self.score(pairs // width, pairs % width, n)


def chosen(n: np.ndarray, toxic: np.ndarray, rows: int, bad: int) -> tuple[np.ndarray, np.ndarray]:
    """Which terms are used, and which are typical, by the documents and toxic documents that have them, of ``rows`` and ``bad``."""
    share = max(bad, 0.5) / max(rows, 1)
    surprise = np.abs(toxic - n * share) / np.sqrt(np.maximum(n * share * (1 - min(share, 0.999)), 1e-9))
    used = (n >= LEAST) & (surprise >= SIGNIFICANT)
    return used, used & ((toxic + 0.5) / (n + 1) >= TYPICAL)


def learn(row: np.ndarray, column: np.ndarray, uses: np.ndarray, terms: np.ndarray, y: np.ndarray, folds: np.ndarray) -> Chain:
    """A chain for the labels ``y`` of rows that have the terms ``column`` so many times; ``folds`` numbers the rows."""
    everyone = np.ones(len(y), bool)

    def prepared(rows: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """The columns to use and the targets of all categories, as the given rows alone show them."""
        mine = rows[row]
        n, toxic = np.bincount(column[mine], minlength=len(terms)), np.bincount(column[mine], y[row[mine]], len(terms))
        used, typical = chosen(n, toxic, int(rows.sum()), int(y[rows].sum()))
        found = np.bincount(row, uses * typical[column], len(y))
        return used, [y * (found >= least) for _, least in CATEGORIES]

    used, targets = prepared(everyone)
    others = [(folds != k, *prepared(folds != k)) for k in range(FOLDS)]
    weights: list[np.ndarray] = []
    earlier: list[np.ndarray] = []
    for c in range(len(CATEGORIES)):
        x = Features(row, column, len(terms), np.column_stack([*earlier, np.ones(len(y))]))
        weights.append(_fit(x.some(everyone, used), targets[c]))
        out = np.zeros(len(y))
        for rows, columns, goals in others:
            if not rows.all():
                near = weights[-1] * np.append(columns, np.ones(c + 1, bool))
                out[~rows] = _probability(x.some(~rows, columns).times(_fit(x.some(rows, columns), goals[c][rows], near)))
        earlier.append(out)
    return Chain(terms[used], [np.concatenate([w[:len(terms)][used], w[len(terms):]]) for w in weights])


def toxicity_chain(docs: DataFrame, labels: DataFrame, label: str = "toxic") -> Chain:
    """The chain that the labelled rows of ``docs`` (doc_id, text) teach; ``labels`` has doc_id and ``label`` 0 or 1.

    Null labels and ids are not learned from; an id with several labels has the greatest. Of an id's rows that with the least
    hash of its terms counts. The driver sees the significant terms of at most SAMPLE rows.
    """
    prepare(docs.sparkSession)
    known = labels.select("doc_id", F.col(label).cast("int").alias("label")).where("label in (0, 1) and doc_id is not null")
    known = stored(known.groupBy("doc_id").agg(F.max("label").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE), "labelled")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).join(F.broadcast(known), "doc_id")
    found = texts.mapInArrow(_featured, "doc_id long, label int, terms binary, uses binary")
    row = F.struct(F.xxhash64("terms", "uses").alias("hash"), "terms", "uses")
    found = found.groupBy("doc_id", "label").agg(F.min(row).alias("row")).select(
        "doc_id", "label", F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(FOLDS)).cast("int").alias("fold"), "row.terms", "row.uses")
    rows = stored(found, "features")
    people = rows.select("doc_id", "label", "fold").toPandas().sort_values("doc_id", ignore_index=True)
    sizes = [(int((people["fold"] == k).sum()), int(people["label"][people["fold"] == k].sum())) for k in range(FOLDS)]
    counted = rows.mapInArrow(_term_counts, ", ".join(["term long", *[f"{c} long" for c in COUNTS]])).groupBy("term").agg(*[F.sum(c).alias(c) for c in COUNTS])

    def significant(folds: list[int]) -> Column:
        """Whether a term is used by what the given folds show."""
        n, t = (sum((F.col(f"{kind}{k}") for k in folds), F.lit(0)) for kind in "nt")
        share = max(sum(sizes[k][1] for k in folds), 0.5) / max(sum(sizes[k][0] for k in folds), 1)
        return (n >= LEAST) & (F.abs(t - n * share) / F.sqrt(F.greatest(n * share * (1 - min(share, 0.999)), F.lit(1e-9))) >= SIGNIFICANT - 1e-6)

    # terms that some model may take; which one takes which is decided with the sample at hand
    test = significant(list(range(FOLDS)))
    for k in range(FOLDS):
        test = test | significant([f for f in range(FOLDS) if f != k])
    terms = np.sort(counted.where(test).select("term").toPandas()["term"].to_numpy(np.int64))

    def chosen_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, term, uses = _unpacked(batch)
            at = np.minimum(np.searchsorted(terms, term), max(0, len(terms) - 1))
            kept = np.flatnonzero(terms[at] == term) if len(terms) else np.zeros(0, np.int64)
            edges = np.searchsorted(row[kept], np.arange(batch.num_rows + 1)).tolist()
            packed = [(at[kept[a:b]].astype(np.int32).tobytes(), uses[kept[a:b]].tobytes()) for a, b in zip(edges, edges[1:])]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(c, pa.binary()) for c in list(zip(*packed)) or [(), ()]]], ["doc_id", "terms", "uses"])

    sample = rows.mapInArrow(chosen_terms, "doc_id long, terms binary, uses binary").toPandas().sort_values("doc_id", ignore_index=True)
    discard(known, rows)
    row = np.repeat(np.arange(len(sample)), [len(t) // 4 for t in sample["terms"]]).astype(np.int64)
    column, uses = (np.frombuffer(b"".join(sample[c]), np.int32).astype(np.int64) for c in ("terms", "uses"))
    return learn(row, column, uses, terms, people["label"].to_numpy(np.int64), people["fold"].to_numpy(np.int64))


def toxicity(docs: DataFrame, labels: DataFrame, label: str = "toxic") -> DataFrame:
    """(doc_id, p_abusive, p_repeated, p_toxic, rejected) of every row of ``docs`` (doc_id, text), by ``toxicity_chain`` over its labelled rows.

    Whole texts are read; null and empty ones have no terms and the probability of such texts. Without labels of both kinds all
    probabilities are the label's smoothed share, or 0 without any, in which case nothing is rejected. Rows keep their number
    whatever ids repeat or are null; other columns are not read. An empty table gives no rows.
    """
    chain = toxicity_chain(docs, labels, label)
    names = [f"p_{name}" for name, _ in CATEGORIES]

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text", 2 << 20):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *map(pa.array, chain.of(*binary_buffers(batch.column("text"))).T)], ["doc_id", *names])

    texts = docs.select("doc_id", F.col("text").cast("binary").alias("text"))
    out = texts.mapInArrow(scored, ", ".join(["doc_id long", *[f"{n} double" for n in names]]))
    return out.withColumn("rejected", F.col(names[-1]) > REJECT)


def without_toxic(docs: DataFrame, labels: DataFrame, label: str = "toxic") -> DataFrame:
    """The rows of ``docs`` that ``toxicity`` does not reject, with all their columns, whatever their names; each text is judged where
    it is read and nothing is shuffled."""
    chain = toxicity_chain(docs, labels, label)
    names, at = docs.columns, docs.columns.index("text")

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part = pa.RecordBatch.from_arrays([pa.array(np.arange(batch.num_rows)), batch.column(at).cast(pa.binary())], ["row", "text"])
            bad = [chain.of(*binary_buffers(piece.column("text")))[:, -1] > REJECT for piece in sliced(iter([part]), "text", 2 << 20)]
            yield batch.filter(pa.array(~np.concatenate([*bad, np.zeros(0, bool)])))

    return docs.toDF(*[f"c{i}" for i in range(len(names))]).mapInArrow(kept, ", ".join(f"c{i} {kind}" for i, (_, kind) in enumerate(docs.dtypes))).toDF(*names)
