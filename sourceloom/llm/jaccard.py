"""N-gram Jaccard join as an exact metric-space join: rings, pivots with Voronoi windows, and regions joined recursively.

Jaccard distance is a metric, but unrelated documents are all at distance 1 of any pivot, so pivots alone cannot part a corpus.
The space is therefore cut in two steps that lose no pair:

* *Far apart.* The distance to the empty set, taken as the number of differing shingles, is a document's size. It gives rings;
  a document in the window at a ring's inner edge is replicated into the ring below, so every link meets in the ring of its
  smaller end. In a ring two linked sets differ in at most k shingles. The shingle space is cut into k + 1 + k / SPARE ranges; a
  pair of linked sets agrees wholly on some range that is not among the k / SPARE smallest of either. Equal (ring, range, content) is a
  region.
* *Close together.* Two sets of a ring differ in at least as many shingles as ranges, so one byte a range tells most members of
  a region apart. The regions' remaining neighbours form families, which are joined whole while they fit a task. A larger family
  chooses pivots, every set goes to its nearest pivot's Voronoi region and, by the triangle inequality, to each pivot at most
  2 * radius farther than that one. This is repeated until regions fit a task; a region that pivots do not part is joined in
  pairs of blocks. In a task all sets are compared exactly.

Ranges that only one set has are passed over with the help of a filter of fixed size, so that few of them are shuffled twice.
Shingles are 64-bit hashes of lower-cased words, and a distinct set is named by a 64-bit hash of its shingles.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b
from math import ceil, log2

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from sourceloom.llm.components import components
from sourceloom.llm.textarrays import binary_buffers, mix, sliced, span_hashes, word_spans
from sourceloom.session import discard, prepare, stored

#: One range in so many is spare: as many of a set's smallest ones are left out.
SPARE = 3
#: Outer edge of a ring over its inner edge.
RING_RATIO = 1.6
#: A task compares at most so many sets with so many shingles in all; larger regions are parted.
LEAF_SETS, LEAF_SHINGLES = 1024, 500_000
#: Regions with more members or bytes of them are families as they are.
SKETCHED, SKETCH_BYTES = 2048, 8 << 20
#: Pivots of a region that is parted, and members whose distances to them one task measures.
PIVOTS, CHUNK = 16, 512
#: Most bits of the filters for values to find again; they never grow with the corpus beyond this.
FILTER_BITS = 1 << 25


def shingle_sets(data: np.ndarray, offsets: np.ndarray, words: int) -> list[np.ndarray]:
    """The distinct shingle hashes of each document, sorted; shorter texts have their whole sequence as the one shingle."""
    starts, ends, first = word_spans(data, offsets)
    hashes = span_hashes(data, starts, ends)
    count = max(0, len(hashes) - words + 1)
    joined = np.full(count, words, np.uint64)
    for k in range(words):
        joined = mix(joined + hashes[k:k + count]) * np.uint64(0x9E3779B97F4A7C15)
    sets = []
    for lo, hi in zip(first[:-1], first[1:]):
        if hi - lo >= words:
            found = np.sort(joined[lo:hi - words + 1])
            sets.append(found[np.concatenate([[True], found[1:] != found[:-1]])])
        elif hi > lo:
            short = np.array([hi - lo], np.uint64)
            for k in range(lo, hi):
                short = mix(short + hashes[k:k + 1])
            sets.append(short)
        else:
            sets.append(np.empty(0, np.uint64))
    return sets


def set_name(shingles: np.ndarray) -> int:
    """The 64-bit name of a set."""
    return int.from_bytes(blake2b(shingles.tobytes(), digest_size=8).digest(), "little", signed=True)


class Rings:
    """Where sets of a size meet, for links of at least ``percent`` per cent similarity."""

    def __init__(self, percent: int) -> None:
        self.percent, self.outer = percent, []
        edge = 1
        while edge < 1 << 40:
            self.outer.append(max(edge, int(edge * RING_RATIO)))
            edge = self.outer[-1] + 1

    def of(self, size: int) -> list[int]:
        """The own ring and those below whose sets can still be linked with so large a set."""
        ring = int(np.searchsorted(self.outer, size))
        rings = [ring]
        while ring and self.percent * size <= 100 * self.outer[ring - 1]:
            ring -= 1
            rings.append(ring)
        return rings

    def regions(self, shingles: np.ndarray) -> list[tuple[int, np.ndarray, np.ndarray]]:
        """By ring: its number, hashes of (ring, range, content) of the ranges a set is compared by, and a byte of each range's."""
        sums = np.concatenate([np.zeros(1, np.uint64), np.add.accumulate(mix(shingles + np.uint64(7)))])
        out = []
        for ring in self.of(len(shingles)):
            apart = self.outer[ring] * (100 - self.percent) // self.percent
            ranges = apart + 1 + apart // SPARE
            cuts = np.arange(1, ranges, dtype=np.uint64) * np.uint64((2**64 - 1) // ranges)
            edges = np.concatenate([[0], np.searchsorted(shingles, cuts), [len(shingles)]])
            content = mix(mix(np.arange(ranges, dtype=np.uint64) + np.uint64(ring << 32)) ^ (sums[edges[1:]] - sums[edges[:-1]]))
            kept = np.argsort(np.diff(edges), kind="stable")[apart // SPARE:]
            out.append((ring, content[kept], content.astype(np.uint8)))
        return out


def _named(words: int, carried: tuple[str, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text", 1 << 20):
            sets = shingle_sets(*binary_buffers(batch.column("text")), words)
            yield pa.RecordBatch.from_arrays([*map(batch.column, carried), pa.array([len(s) for s in sets], pa.int64()),
                                              pa.array([set_name(s) if len(s) else None for s in sets], pa.int64())], [*carried, "n_shingles", "node"])
    return run


def _regions(words: int, percent: int):
    rings = Rings(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text", 1 << 20):
            sets = shingle_sets(*binary_buffers(batch.column("text")), words)
            found = [r for s in sets if len(s) for _, r, _ in rings.regions(s)]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([*found, np.empty(0, np.uint64)]).view(np.int64))], ["region"])
    return run


class Marks:
    """A filter of fixed size: values that were put in are always found again, few others are."""

    def __init__(self, values: DataFrame, count: int) -> None:
        self.bits = min(FILTER_BITS, 1 << max(10, ceil(log2(16 * count + 1))))
        name = F.col(values.columns[0])
        spread = [F.pmod(F.shiftrightunsigned(name, 17 * k), F.lit(self.bits)) for k in range(3)]
        cells = (values.select(F.explode(F.array(*spread)).alias("at")).groupBy(F.expr("at div 32").alias("cell"))
                 .agg(F.bit_or(F.expr("shiftleft(1L, cast(at % 32 as int))")).alias("bits")).toPandas())
        table = np.zeros(self.bits // 32, np.int64)
        table[cells["cell"].to_numpy(np.int64)] = cells["bits"].to_numpy(np.int64)
        self.shared = values.sparkSession.sparkContext.broadcast(table)

    def hit(self, values: np.ndarray) -> np.ndarray:
        """Which of 64-bit values may have been put in."""
        found = np.ones(len(values), bool)
        for k in range(3):
            at = (values.view(np.uint64) >> np.uint64(17 * k)).view(np.int64) % self.bits
            found &= (self.shared.value[at // 32] >> (at % 32)) & 1 == 1
        return found


def _members(words: int, percent: int, marks: Marks):
    rings = Rings(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text", 1 << 20):
            out = []
            for s in shingle_sets(*binary_buffers(batch.column("text")), words):
                for ring, regions, sketch in rings.regions(s) if len(s) else []:
                    kept = regions[marks.hit(regions)]
                    if len(kept):
                        out.append((set_name(s), ring, len(s), sketch.tobytes(), kept.view(np.int64)))
            columns = list(zip(*out)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.int64()),
                                              pa.array(columns[3], pa.binary()), pa.array(list(columns[4]), pa.list_(pa.int64()))],
                                             ["node", "ring", "size", "sketch", "regions"])
    return run


def _sets_of(texts: DataFrame, nodes: DataFrame, count: int, words: int) -> DataFrame:
    """(node, size, shingles) of the named sets, read again from the texts."""
    marks = Marks(nodes, count)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text", 1 << 20):
            sets = [s for s in shingle_sets(*binary_buffers(batch.column("text")), words) if len(s)]
            names = np.array([set_name(s) for s in sets], np.int64)
            kept = [(int(names[i]), sets[i]) for i in np.flatnonzero(marks.hit(names))]
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in kept], pa.int64()), pa.array([len(s) for _, s in kept], pa.int64()),
                                              pa.array([s.tobytes() for _, s in kept], pa.binary())], ["node", "size", "shingles"])

    read = texts.select("text").mapInArrow(run, "node long, size long, shingles binary")
    return read.join(nodes, "node", "left_semi").groupBy("node").agg(F.first("size").alias("size"), F.first("shingles").alias("shingles"))


def _neighbours(percent: int):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        """The members of a region that their sketches leave as possible links, as a forest."""
        nodes, sizes = group["node"].to_numpy(np.int64), group["size"].to_numpy(np.int64)
        sketch = np.frombuffer(b"".join(group["sketch"]), np.uint8).reshape(len(nodes), -1)
        label = np.arange(len(nodes))
        for i in range(1, len(nodes)):
            apart = (sketch[:i] != sketch[i]).sum(axis=1)
            met = np.unique(label[:i][apart * (100 + percent) <= (100 - percent) * (sizes[:i] + sizes[i])])
            if len(met):
                label[np.isin(label, met)] = met[0]
                label[i] = met[0]
        return pd.DataFrame({"a": nodes, "b": nodes[label]})[label != np.arange(len(nodes))]
    return run


def overlaps(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Intersection sizes of all pairs of sets, and the set sizes, exactly."""
    sizes = np.array([len(s) for s in sets], np.int64)
    row = np.repeat(np.arange(len(sets)), sizes)
    values, column = np.unique(np.concatenate([*sets, np.empty(0, np.uint64)]), return_inverse=True)
    common = np.bincount(column, minlength=len(values)) > 1
    keep = common[column]
    row, column = row[keep], (np.cumsum(common) - 1)[column[keep]]
    shared, width = np.zeros((len(sets), len(sets)), np.float32), max(64, (4 << 20) // max(1, len(sets)))
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    for at in range(0, int(common.sum()), width):
        lo, hi = np.searchsorted(column, [at, at + width])
        present = np.zeros((len(sets), min(width, int(common.sum()) - at)), np.float32)
        present[row[lo:hi], column[lo:hi] - at] = 1
        shared += present @ present.T
    np.fill_diagonal(shared, sizes)
    return shared.astype(np.int32), sizes.astype(np.int32)


def _joined(percent: int):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        """The linked sets of a task as a forest: each set with the smallest set it reaches here."""
        nodes = group["node"].to_numpy(np.int64)
        both, sizes = overlaps([np.frombuffer(x, np.uint64) for x in group["shingles"]])
        linked = (100 + percent) * both.astype(np.int64) >= percent * (sizes[:, None] + sizes[None, :])
        label = nodes.copy()
        while True:
            now = np.array([label[linked[i]].min() for i in range(len(nodes))])
            now = np.minimum(now, label)
            if (now == label).all():
                break
            label = now
        return pd.DataFrame({"a": nodes, "b": label})[label != nodes]
    return run


def _assigned(radius: float):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        """Members with their nearest pivot, and with every pivot that lies within its window."""
        sets = [np.frombuffer(x, np.uint64) for x in group["shingles"]]
        both, sizes = overlaps(sets)
        pivot = group["pivot"].to_numpy(bool)
        distance = 1 - both / (sizes[:, None] + sizes[None, :] - both)
        distance = distance[~pivot][:, pivot]
        window = distance <= distance.min(axis=1, keepdims=True) + 2 * radius + 1e-9
        at, to = np.nonzero(window)
        nodes, pivots = group["node"].to_numpy(np.int64)[~pivot], group["node"].to_numpy(np.int64)[pivot]
        return pd.DataFrame({"region": group["region"].iloc[0], "node": nodes[at], "to": pivots[to]})
    return run


def _unique(members: DataFrame) -> DataFrame:
    """One region of each collection of members."""
    marks = members.groupBy("region").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("node")).alias("x"),
                                          F.bit_xor(F.xxhash64("node", F.lit(1))).alias("y"))
    return members.join(marks.where("n > 1").groupBy("n", "x", "y").agg(F.min("region").alias("region")), "region", "left_semi")


def _measured(members: DataFrame, sizes: DataFrame) -> DataFrame:
    """Members with the number of sets and shingles of their region, and whether it fits a task."""
    with_size = members.join(sizes, "node")
    fits = with_size.groupBy("region").agg(F.count("*").alias("n"), F.sum("size").alias("shingles"))
    fits = fits.withColumn("fits", F.expr(f"n <= {LEAF_SETS} and shingles <= {LEAF_SHINGLES}"))
    return members.join(fits, "region")


def _blocks(members: DataFrame) -> DataFrame:
    """Pairs of blocks of regions that pivots don't part: every pair of members meets in a task."""
    count = F.ceil(F.greatest(F.col("n") * 2 / LEAF_SETS, F.col("shingles") * 2 / LEAF_SHINGLES)).cast("long")
    placed = members.withColumn("blocks", count).withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")))
    placed = placed.withColumn("other", F.explode(F.expr("sequence(0L, blocks - 1)")))
    return placed.select(F.xxhash64("region", F.least("own", "other"), F.greatest("own", "other")).alias("region"), "node")


def _leaves(large: DataFrame, sets: DataFrame, sizes: DataFrame, radius: float) -> DataFrame:
    """Regions that fit a task and hold every link of the given ones: parted by pivots, recursively, or by pairs of blocks."""
    leaves = None

    def add(more: DataFrame) -> None:
        nonlocal leaves
        more = more.select("region", "node")
        leaves = more if leaves is None else leaves.union(more)

    while True:
        measured = stored(_measured(_unique(large), sizes), "regions")
        add(measured.where("fits"))
        open_ = measured.where("not fits")
        if open_.isEmpty():
            return leaves
        rank = F.row_number().over(W.partitionBy("region").orderBy(F.xxhash64("node", "region"), "node"))
        chunks = F.ceil(F.greatest(F.col("n") / CHUNK, F.col("shingles") / LEAF_SHINGLES)).cast("long")
        pivots = open_.withColumn("rank", rank).where(F.col("rank") <= PIVOTS).withColumn("chunk", F.explode(F.sequence(F.lit(0), chunks - 1)))
        dealt = (open_.select("region", "node", F.pmod(F.xxhash64("node"), chunks).alias("chunk"), F.lit(False).alias("pivot"))
                 .union(pivots.select("region", "node", "chunk", F.lit(True))))
        cells = stored(dealt.join(sets, "node").groupBy("region", "chunk").applyInPandas(_assigned(radius), "region long, node long, to long"), "cells")
        sums = cells.groupBy("region", "to").agg(F.count("*").alias("k")).groupBy("region").agg(F.max("k").alias("most"), F.sum("k").alias("all"))
        parted = open_.select("region", "n").distinct().join(sums, "region").where("most <= 0.7 * n and all <= 3 * n").select("region")
        parted = stored(parted, "parted")
        add(_blocks(open_.join(parted, "region", "left_anti")))
        large = cells.join(parted, "region", "left_semi").select(F.xxhash64("region", "to").alias("region"), "node")


def _linked(docs: DataFrame, words: int, percent: int, *also: str) -> tuple[DataFrame, DataFrame]:
    """The rows of ``docs`` as (doc_id, columns ``also``, n_shingles, node), and (node, component) of the nodes with a link."""
    prepare(docs.sparkSession)
    texts = docs.select("doc_id", *also, F.col("text").cast("binary").alias("text"))
    carried = ("doc_id", *also)
    kinds = dict(texts.dtypes)
    rows = stored(texts.mapInArrow(_named(words, carried), ", ".join([*[f"{c} {kinds[c]}" for c in carried], "n_shingles long", "node long"])), "rows")
    shared = texts.select("text").mapInArrow(_regions(words, percent), "region long").groupBy("region").count().where("count > 1").select("region")
    shared = stored(shared, "shared")
    marks = Marks(shared, shared.count())
    near = stored(texts.select("text").mapInArrow(_members(words, percent, marks), "node long, ring int, size long, sketch binary, regions array<long>"), "near")
    members = near.select("node", "ring", F.explode("regions").alias("region")).join(shared, "region", "left_semi").distinct()
    members = stored(_unique(members), "members")
    discard(shared)
    counts = members.groupBy("region").agg(F.count("*").alias("n"), F.min("node").alias("head"))
    counted = members.join(counts, "region")
    sketches = near.groupBy("node", "ring").agg(F.first("size").alias("size"), F.first("sketch").alias("sketch"))
    small = counted.where(F.col("n") <= SKETCHED).join(sketches, ["node", "ring"])
    tight = small.where(F.length("sketch") * F.col("n") <= SKETCH_BYTES).select("region", "node", "size", "sketch")
    tight = tight.groupBy("region").applyInPandas(_neighbours(percent), "a long, b long")
    wide = small.where(F.length("sketch") * F.col("n") > SKETCH_BYTES).select("node", "head").union(counted.where(F.col("n") > SKETCHED).select("node", "head"))
    touching = stored(components(tight.union(wide).where("a <> b").distinct()), "touching")
    discard(members, near)

    families = touching.select("node", F.col("component").alias("region"))
    families = stored(families.union(families.select(F.col("region").alias("node"), "region").distinct()), "families")
    nodes = families.select("node")
    sets = stored(_sets_of(texts, nodes, nodes.count(), words), "shingles")
    close = _leaves(families.select("region", "node"), sets, sets.select("node", "size"), 1 - percent / 100)
    links = stored(close.join(sets, "node").groupBy("region").applyInPandas(_joined(percent), "a long, b long").distinct(), "links")
    groups = stored(components(links), "groups")
    discard(touching, families, sets, links)
    return rows, groups


def jaccard_groups(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of ``docs`` (doc_id, text): the groups that links of texts form.

    Two texts are linked when 100 * shared shingles >= percent * all their shingles. component_id is the smallest doc_id of the
    group. Null and empty texts, and texts without words, have 0 shingles and are groups of their own. Repeated rows and equal
    ids keep their rows. Rows with a null doc_id take part; a group of none but them has a null component_id. Other columns are
    not read. Equal texts are compared once, whatever their number.
    """
    rows, groups = _linked(docs, words, percent)
    named = rows.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("first"))
    named = named.join(groups, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = named.groupBy("component").agg(F.min("first").alias("component_id"))
    placed = named.select("node", "component").join(least, "component").select("node", "component_id")
    out = rows.select("doc_id", "n_shingles", "node").join(placed, "node", "left")
    return out.select("doc_id", "n_shingles", F.expr("if(node is null, doc_id, component_id)").alias("component_id"))


def near_kept(docs: DataFrame, key: str, words: int = 5, percent: int = 80) -> DataFrame:
    """The ``key``, a column that tells the rows of ``docs`` (doc_id, text) apart, of one row of each group of ``jaccard_groups``.

    That with the smallest doc_id stays, null last, then that with the smallest key. Rows without shingles are groups of their own.
    """
    rows, groups = _linked(docs, words, percent, key)
    order = F.struct(F.col("doc_id").isNull().alias("u"), F.col("doc_id").alias("d"), F.col(key).alias("k"))
    named = rows.where("node is not null").groupBy("node").agg(F.min(order).alias("first")).join(groups, "node", "left")
    best = named.groupBy(F.coalesce("component", "node").alias("component")).agg(F.min("first").alias("best"))
    return best.select(F.col("best.k").alias(key)).union(rows.where("node is null").select(key))
