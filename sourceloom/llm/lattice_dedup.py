"""Near duplicates among embeddings by lattice hashing.

Every table projects a vector onto random directions and rounds each eight of them to the nearest point of the E8 lattice. A vector
lies in the cell of those points and also visits the nearest of the neighbouring cells (each point has 240 neighbours); two vectors are candidates where one visits the cell in
which the other lies, and they are linked after their cosine has been computed in double precision.

A large group of near copies would fill one cell of every table. So the means of the most crowded cells of the first table become
centres of balls: everything within half the linking angle of a centre is linked with everything else there, and by the triangle
inequality most other vectors are linked with a whole ball or with nothing in it. Only the vectors in between are compared with a
ball's members one by one, and only vectors outside all balls go through the tables. Comparisons are between blocks of vectors: they
give the number of links of each vector and enough links to connect what hangs together, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, product

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sourceloom.llm.components import components
from sourceloom.llm.textarrays import mix
from sourceloom.session import prepare, stored

#: Hash tables, blocks of eight directions in each, cells a vector visits there, and the width of a lattice step on the unit sphere.
#: Two vectors at a cosine of 0.93 meet with a probability of 0.97, at 0.96 of 0.9999, two random ones with one of 1 in 50,000.
TABLES, BLOCKS, VISITS, WIDTH = 12, 4, 5, 2.75
#: Rows from which on a cell is crowded, and the share of all rows it must hold, so that there are at most as many centres.
CROWD, CENTRES = 32, 1024
#: Vectors of a block and pairs whose shared cells are looked up at a time.
BLOCK, PAIRS = 512, 1 << 14
_BASE = 0x9E3779B97F4A7C15
#: Room for rounding in what is concluded from angles.
ROOM = 1e-7


def _neighbours() -> np.ndarray:
    """The 240 shortest vectors of E8: two coordinates of one, or eight halves with an even number of minus signs."""
    whole = [[s * (k == i) + t * (k == j) for k in range(8)] for i, j in combinations(range(8), 2) for s in (1, -1) for t in (1, -1)]
    return np.array(whole + [[s / 2 for s in signs] for signs in product((1, -1), repeat=8) if signs.count(-1) % 2 == 0])


NEIGHBOURS = _neighbours()


def _even(z: np.ndarray) -> np.ndarray:
    """The nearest integer points with an even sum: where rounding gives an odd one, the worst rounded coordinate goes the other way."""
    out = np.rint(z)
    odd = np.flatnonzero(out.sum(axis=1) % 2)
    worst = np.abs(z[odd] - out[odd]).argmax(axis=1)
    out[odd, worst] += np.where(z[odd, worst] >= out[odd, worst], 1, -1)
    return out


def nearest_points(z: np.ndarray) -> np.ndarray:
    """The nearest E8 lattice point of each row of ``z``: the better of the even integer points and those moved by a half."""
    a, b = _even(z), _even(z - 0.5) + 0.5
    nearer = ((z - a) ** 2).sum(axis=1) <= ((z - b) ** 2).sum(axis=1)
    return np.where(nearer[:, None], a, b)


def units(vectors: list[bytes], dims: int) -> np.ndarray:
    """Packed single or double precision vectors as rows of length one, in double precision."""
    if not vectors:
        return np.zeros((0, dims))
    x = np.frombuffer(b"".join(vectors), np.float64 if len(vectors[0]) == 8 * dims else np.float32).reshape(-1, dims).astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


class Lattice:
    """The hash tables for vectors of ``dims`` components."""

    def __init__(self, dims: int) -> None:
        rng = np.random.default_rng(20240811)
        self.directions, self.shifts = rng.normal(size=(TABLES, BLOCKS, dims, 8)) / WIDTH, rng.random((TABLES, BLOCKS, 8))

    def cells(self, x: np.ndarray, labels: np.ndarray, tables: int = TABLES) -> np.ndarray:
        """Cell keys (vector, table, visit); the first visit is the vector's own cell, the others follow by distance."""
        out, every = np.empty((len(x), tables, VISITS), np.int64), np.arange(len(x))[:, None]
        base = mix(labels.astype(np.int64).view(np.uint64) + np.uint64(_BASE))
        for t in range(tables):
            keys, costs = mix(base + np.uint64(t))[:, None], np.zeros((len(x), 1))
            for b in range(BLOCKS):
                z = x @ self.directions[t, b] + self.shifts[t, b]
                own = nearest_points(z)
                farther = 2 - 2 * (z - own) @ NEIGHBOURS.T
                near = np.argpartition(farther, VISITS - 2, axis=1)[:, :VISITS - 1]
                moves = np.concatenate([np.zeros((len(x), 1, 8)), NEIGHBOURS[near]], axis=1)
                point = np.zeros((len(x), VISITS), np.uint64)
                for k in range(8):
                    point = mix(point ^ (2 * (own[:, None, k] + moves[:, :, k])).astype(np.int64).view(np.uint64))
                cost = np.concatenate([np.zeros((len(x), 1)), farther[every, near]], axis=1)
                # the cheapest ways to go on from the cheapest ways so far; staying costs nothing
                costs = (costs[:, :, None] + cost[:, None]).reshape(len(x), -1)
                keys = mix(keys[:, :, None] * np.uint64(_BASE) + point[:, None]).reshape(len(x), -1)
                best = np.argsort(costs, axis=1, kind="stable")[:, :VISITS]
                costs, keys = costs[every, best], keys[every, best]
            out[:, t] = keys.view(np.int64)
        return out


def _packed(dims: int, kind: type):
    """Vectors that take part: (row, label, vector)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, labels, out = [], [], []
            for row, label, vector in zip(*(batch.column(c).to_pylist() for c in ("row", "label", "embedding"))):
                if label is None or not vector or None in vector:
                    continue
                x = np.zeros(dims, kind)
                x[:len(vector)] = vector
                if np.isfinite(x).all() and x.any():
                    rows.append(row)
                    labels.append(label)
                    out.append(x.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(labels, pa.int64()), pa.array(out, pa.binary())], ["row", "label", "vector"])
    return run


def spanning(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest node that each of ``n`` nodes is connected with through the links a-b."""
    label = np.arange(n)
    while len(a):
        one, two = label[a], label[b]
        differ = one != two
        a, b, one, two = a[differ], b[differ], one[differ], two[differ]
        np.minimum.at(label, np.maximum(one, two), np.minimum(one, two))
        while (label != label[label]).any():
            label = label[label]
    return label


def _tally(rows: np.ndarray, links: np.ndarray, to: np.ndarray) -> pa.RecordBatch:
    some = (links > 0) | (to != rows)
    return pa.RecordBatch.from_arrays([pa.array(rows[some]), pa.array(links[some]), pa.array(to[some])], ["row", "links", "node"])


TALLY = "row long, links long, node long"


def _compared(dims: int, cosine: float):
    """Links between the visitors and the residents of a cell that no earlier shared cell has counted."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                pair = {c: batch.column(c)[at] for c in batch.schema.names}
                ours, theirs = (np.array(pair[c].as_py(), np.int64) for c in ("visitors", "residents"))
                x, y = units(pair["visiting"].as_py(), dims), units(pair["residing"].as_py(), dims)
                i, j = np.nonzero(x @ y.T >= cosine)
                differ = ours[i] != theirs[j]
                i, j = i[differ], j[differ]
                if not len(i):
                    continue
                x, y = (np.frombuffer(b"".join(pair[c].as_py()), np.int64).reshape(-1, TABLES, VISITS) for c in ("visited", "lain"))
                counted = []
                for k in range(0, len(i), PAIRS):
                    a, b = i[k:k + PAIRS], j[k:k + PAIRS]
                    there, here = (x[a] == y[b][:, :, :1]).any(axis=2), (y[b] == x[a][:, :, :1]).any(axis=2)
                    smaller = ours[a] < theirs[b]
                    events = np.stack([np.where(smaller[:, None], there, here), np.where(smaller[:, None], here, there)], axis=2).reshape(len(a), -1)
                    # two vectors of one cell meet there in both directions and count in the first
                    event = 2 * pair["tab"].as_py() + np.where(smaller, 0, 1)
                    counted.append(events.argmax(axis=1) == event)
                counted = np.concatenate(counted)
                i, j = i[counted], j[counted]
                rows = np.concatenate([ours, theirs])
                nodes, where = np.unique(rows, return_inverse=True)
                a, b = where[i], where[len(ours) + j]
                yield _tally(nodes, np.bincount(a, minlength=len(nodes)) + np.bincount(b, minlength=len(nodes)), nodes[spanning(len(nodes), a, b)])
    return run


def _members_compared(dims: int, cosine: float):
    """Links between some vectors and members of a ball that angles leave open. A vector that lies in another ball counts only its
    own links, as those members are compared with its ball in turn."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                pair = {c: batch.column(c)[at] for c in batch.schema.names}
                ours, theirs, loose = (np.array(pair[c].as_py()) for c in ("visitors", "residents", "loose"))
                i, j = np.nonzero(units(pair["visiting"].as_py(), dims) @ units(pair["residing"].as_py(), dims).T >= cosine)
                if len(i):
                    links = np.concatenate([np.bincount(i, minlength=len(ours)), np.bincount(j[loose[i]], minlength=len(theirs))])
                    rows = np.concatenate([ours, theirs])
                    yield _tally(rows, links, rows[spanning(len(rows), i, len(ours) + j)])
    return run


def _blocks(rows: DataFrame, keys: list[str], columns: dict[str, str]) -> DataFrame:
    """The rows of each key in blocks of about BLOCK, however many they are; ``columns`` are gathered under other names."""
    sizes = rows.groupBy(*keys).agg(F.ceil(F.count("*") / BLOCK).cast("long").alias("blocks"))
    dealt = rows.join(sizes, keys).withColumn("salt", F.pmod(F.xxhash64("row", F.lit(3)), F.col("blocks")))
    return dealt.groupBy(*keys, "salt").agg(*[F.collect_list(c).alias(name) for c, name in columns.items()]).drop("salt")


def _centres(spark, rows: DataFrame, lattice: Lattice, dims: int, total: int, half: float) -> tuple[np.ndarray, np.ndarray]:
    """Labels and directions of the centres: at most CENTRES, whatever the number of rows, and none close to a more crowded one."""
    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, labels = units(batch.column("vector").to_pylist(), dims), batch.column("label").to_numpy()
            yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array(lattice.cells(x, labels, 1)[:, 0, 0]), pa.array(list(x), pa.list_(pa.float64()))], ["label", "cell", "x"])

    placed = rows.mapInArrow(cells, "label long, cell long, x array<double>")
    crowded = placed.groupBy("cell").count().where(F.col("count") >= max(CROWD, total // CENTRES + 1)).select("cell")
    means = placed.join(F.broadcast(crowded), "cell").groupBy("cell").agg(
        F.first("label").alias("label"), F.count("*").alias("n"), vector_to_array(Summarizer.mean(array_to_vector("x"))).alias("mean"))
    labels, centres = [], []
    for found in sorted(means.collect(), key=lambda r: (-r.n, r.cell)):
        mean = np.array(found["mean"])
        length = np.sqrt((mean * mean).sum())
        if length and not any(k == found.label and c @ mean / length > np.cos(half / 2) for k, c in zip(labels, centres)):
            labels.append(found.label)
            centres.append(mean / length)
    return np.array(labels, np.int64), np.array(centres).reshape(-1, dims)


def near_vectors(vectors: DataFrame, cosine: float = 0.93) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of each row of ``vectors`` (vec_id, embedding, label; other columns are not looked at).

    Rows of one label are linked when the cosine of their embeddings, in double precision, is at least ``cosine`` (above zero); no
    pair below it is linked. Pairs within a ball or with one side in it are all found, others with the tables' probability. n_links counts other rows,
    rows of a repeated id included; component_id is the smallest id reachable by links, itself included; kept tells whether that is
    the row's own id. Vectors that are null, empty, zero or hold null or non-finite components, and rows without a label, are linked
    with nothing; shorter vectors are padded with zeros. Rows with a null id are linked as others; they are kept if no id is reachable.
    An empty table gives none. The driver sees at most CENTRES vectors.
    """
    spark = prepare(vectors.sparkSession)
    half = float(np.arccos(cosine)) / 2
    kind = np.float32 if dict(vectors.dtypes)["embedding"] == "array<float>" else np.float64
    numbered = stored(vectors.select("vec_id", "embedding", F.col("label").cast("long").alias("label")).withColumn("row", F.monotonically_increasing_id()), "vectors")
    dims = max(numbered.agg(F.max(F.size("embedding"))).first()[0] or 0, 1)
    lattice = Lattice(dims)
    rows = stored(numbered.where("label is not null and size(embedding) > 0").select("row", "label", "embedding")
                  .mapInArrow(_packed(dims, kind), "row long, label long, vector binary"), "packed")
    labels, centres = _centres(spark, rows, lattice, dims, rows.count(), half)

    def assigned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            angle, ball = np.full(batch.num_rows, np.pi), np.full(batch.num_rows, -1, np.int32)
            if len(centres) and batch.num_rows:
                other = batch.column("label").to_numpy()[:, None] != labels
                angles = np.where(other, np.pi, np.arccos(np.clip(units(batch.column("vector").to_pylist(), dims) @ centres.T, -1, 1)))
                angle = angles.min(axis=1)
                ball = np.where(angle < half - ROOM, angles.argmin(axis=1), -1).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("row", "label", "vector")), pa.array(ball), pa.array(angle)], ["row", "label", "vector", "ball", "angle"])

    rows = stored(rows.mapInArrow(assigned, "row long, label long, vector binary, ball int, angle double"), "assigned")
    balls = rows.where("ball >= 0").groupBy("ball").agg(F.count("*").alias("n"), F.max("angle").alias("radius"), F.min("row").alias("node")).collect()
    size, first, radius = np.zeros(len(centres), np.int64), np.zeros(len(centres), np.int64), np.full(len(centres), -np.inf)
    for found in balls:
        size[found.ball], first[found.ball], radius[found.ball] = found.n, found.node, found.radius

    def around(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The balls that each vector lies in, is wholly linked with (sure) or may be linked with."""
        for batch in batches:
            if not batch.num_rows:
                continue
            own, angles = batch.column("ball").to_numpy(), np.arccos(np.clip(units(batch.column("vector").to_pylist(), dims) @ centres.T, -1, 1))
            inside = own[:, None] == np.arange(len(centres))
            sure = ~inside & (angles + radius < 2 * half - ROOM)
            near = inside | ((angles - radius < 2 * half + ROOM) & (batch.column("label").to_numpy()[:, None] == labels) & (size > 0))
            at, ball = np.nonzero(near)
            sure = sure[at, ball]
            yield pa.RecordBatch.from_arrays([batch.column("row").take(pa.array(at)), pa.array(ball.astype(np.int32)), pa.array(own[at]), pa.array(sure),
                                              pa.array(np.where(inside[at, ball], size[ball] - 1, np.where(sure, size[ball], 0))), pa.array(first[ball])],
                                             ["row", "ball", "own", "sure", "links", "node"])

    tallies = []
    if len(balls):
        met = stored(rows.mapInArrow(around, "row long, ball int, own int, sure boolean, links long, node long"), "balls-met")
        tallies.append(met.where("sure or ball = own").select("row", "links", "node"))
        # what lies in no ball and is linked with a whole one is a link of each of its members
        visits = met.where("sure and own < 0").groupBy("ball").agg(F.count("*").alias("links"))
        tallies.append(rows.where("ball >= 0").join(F.broadcast(visits), "ball").select("row", "links", F.col("row").alias("node")))
        unsure = met.where("not sure and ball <> own").select("row", F.col("ball").alias("other"))
        visitors = rows.join(unsure, "row").select(F.col("other").alias("ball"), "row", "vector", (F.col("ball") < 0).alias("loose"))
        pairs = _blocks(visitors, ["ball"], {"row": "visitors", "vector": "visiting", "loose": "loose"}).join(
            _blocks(rows.where("ball >= 0"), ["ball"], {"row": "residents", "vector": "residing"}), "ball")
        tallies.append(pairs.mapInArrow(_members_compared(dims, cosine), TALLY))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = lattice.cells(units(batch.column("vector").to_pylist(), dims), batch.column("label").to_numpy())
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("vector"), pa.array([c.tobytes() for c in cells], pa.binary())], ["row", "vector", "cells"])

    def visited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = np.frombuffer(b"".join(batch.column("cells").to_pylist()), np.int64)
            visit = np.tile(np.arange(TABLES * VISITS), batch.num_rows)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(batch.column("row").to_numpy(), TABLES * VISITS)), pa.array((visit // VISITS).astype(np.int32)),
                                              pa.array(cells), pa.array(visit % VISITS == 0)], ["row", "tab", "cell", "own"])

    loose = stored(rows.where("ball < 0").select("row", "label", "vector").mapInArrow(hashed, "row long, vector binary, cells binary"), "hashed")
    visits, keys = loose.select("row", "cells").mapInArrow(visited, "row long, tab int, cell long, own boolean"), ["tab", "cell"]
    shared = visits.groupBy(*keys).agg(F.count("*").alias("n"), F.count_if("own").alias("lying")).where("n > 1 and lying > 0").select(*keys)
    met = stored(visits.join(shared, keys).join(loose, "row"), "met")
    pairs = _blocks(met, keys, {"row": "visitors", "vector": "visiting", "cells": "visited"}).join(
        _blocks(met.where("own"), keys, {"row": "residents", "vector": "residing", "cells": "lain"}), keys)
    tallies.append(pairs.mapInArrow(_compared(dims, cosine), TALLY))

    tally = tallies[0]
    for more in tallies[1:]:
        tally = tally.unionByName(more)
    tally = stored(tally, "links")
    counts = tally.groupBy("row").agg(F.sum("links").alias("links"))
    groups = components(tally.where("row <> node").select(F.col("row").alias("a"), F.col("node").alias("b")).distinct())
    grouped = numbered.select("vec_id", "row").join(counts, "row", "left").join(groups.withColumnRenamed("node", "row"), "row", "left")
    grouped = grouped.withColumn("component", F.coalesce("component", "row"))
    ids = grouped.where("links > 0").groupBy("component").agg(F.min("vec_id").alias("component_id"))
    out = grouped.join(ids, "component", "left").withColumn("component_id", F.when(F.col("links") > 0, F.col("component_id")).otherwise(F.col("vec_id")))
    return out.select("vec_id", F.coalesce("links", F.lit(0)).alias("n_links"), "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"))
