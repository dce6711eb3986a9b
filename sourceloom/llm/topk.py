"""Exact top-k by inner product with a pivot-distance index.

Vectors are keyed by their nearest pivot and by the annulus around it in which they lie. An annulus bounds the inner product of a
query with everything in it: by the triangle inequality through the pivot's distance, and by Cauchy-Schwarz. A query first meets
the annulus that promises most; its k-th score there stops all annuli whose bound is lower, and only the others are expanded.
The directory of annuli has a fixed size; the vectors of one are dealt out to blocks, however many they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from sourceloom.session import prepare, stored

#: Pivots, annuli of each, and the vectors the pivots are chosen from.
PIVOTS, ANNULI, SAMPLE = 32, 8, 2048
#: Vectors and queries of a block.
BLOCK, QUERIES = 2048, 256


def _integers(scale: float, dims: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, out = [], []
            for vec_id, vector in zip(batch.column("vec_id").to_pylist(), batch.column("embedding").to_pylist()):
                if vec_id is None or vector is None or None in vector:
                    continue
                values = np.floor(scale * np.array(vector, np.float64))
                if np.isfinite(values).all():
                    ids.append(vec_id)
                    out.append(np.pad(values, (0, dims - len(values))).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(out, pa.binary())], ["vec_id", "vector"])
    return run


def _sample(plain: DataFrame) -> DataFrame:
    """The SAMPLE rows with the least (hash of the id, id, row). They are found among hashes and numbers, so that no task hands on
    SAMPLE whole vectors to have all but a few dropped."""
    order = F.struct(F.xxhash64("vec_id").alias("hash"), "vec_id", "row")
    last = plain.select(order.alias("at")).orderBy("at").limit(SAMPLE).agg(F.max("at").alias("at")).first()["at"]
    if last is None:
        return plain.limit(0)
    return plain.where(order <= F.struct(*[F.lit(v).cast("long") for v in last]))


def _matrix(rows, dims: int) -> np.ndarray:
    return np.frombuffer(b"".join(rows), np.float64).reshape(-1, dims)


def _placed(pivots: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        square = (pivots ** 2).sum(axis=1)
        for batch in batches:
            x = _matrix(batch.column("vector").to_pylist(), pivots.shape[1])
            norm = (x ** 2).sum(axis=1)
            distance = np.sqrt(np.maximum(0, norm[:, None] - 2 * x @ pivots.T + square))
            pivot = distance.argmin(axis=1)
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("vec_id"), batch.column("vector"), pa.array(pivot, pa.int32()),
                                              pa.array(distance[np.arange(len(x)), pivot]), pa.array(np.sqrt(norm))], ["row", "vec_id", "vector", "pivot", "distance", "norm"])
    return run


def choose_pivots(sample: np.ndarray, count: int) -> np.ndarray:
    """Means of ``count`` groups of the sample: farthest points first, then a few rounds of re-centring."""
    chosen = [0]
    nearest = ((sample - sample[0]) ** 2).sum(axis=1)
    while len(chosen) < min(count, len(sample)) and nearest.max() > 0:
        chosen.append(int(nearest.argmax()))
        nearest = np.minimum(nearest, ((sample - sample[chosen[-1]]) ** 2).sum(axis=1))
    pivots = sample[chosen].copy()
    for _ in range(8):
        own = (((pivots ** 2).sum(axis=1)) - 2 * sample @ pivots.T).argmin(axis=1)
        for p in range(len(pivots)):
            if (own == p).any():
                pivots[p] = sample[own == p].mean(axis=0)
    return pivots


def bounds(q: np.ndarray, cells: pd.DataFrame, pivots: np.ndarray) -> np.ndarray:
    """What the inner product of each query with anything in each cell can be at most, with room for rounding."""
    p = pivots[cells["pivot"]]
    low, high, longest = (cells[c].to_numpy() for c in ("low", "high", "longest"))
    norm = (q ** 2).sum(axis=1)[:, None]
    product = q @ p.T
    away = np.sqrt(np.maximum(0, norm - 2 * product + (p ** 2).sum(axis=1)))
    gap = np.maximum(0, np.maximum(away - high, low - away))
    bound = np.minimum(product + np.sqrt(norm) * high, (norm + longest ** 2 - gap ** 2) / 2)
    return bound + 1e-6 * (1 + norm + longest ** 2)


def _best(scores: np.ndarray, ids: np.ndarray, own: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and columns of the k best scores of each query, ties to smaller ids (``ids`` ascend), without its own id."""
    scores = np.where(ids[None, :] == own[:, None], -np.inf, scores)
    if scores.shape[1] > k:
        least = -np.partition(-scores, k - 1, axis=1)[:, k - 1]
        row, column = np.nonzero((scores >= least[:, None]) & (scores > -np.inf))
    else:
        row, column = np.nonzero(scores > -np.inf)
    order = np.lexsort((column, -scores[row, column], row))
    row, column = row[order], column[order]
    nth = np.arange(len(row)) - np.searchsorted(row, row)
    return row[nth < k], column[nth < k]


def _blocks(group: pd.DataFrame) -> pd.DataFrame:
    group = group.sort_values("vec_id")
    return pd.DataFrame({"cell": [group["cell"].iloc[0]], "salt": [group["salt"].iloc[0]], "ids": [group["vec_id"].to_numpy(np.int64).tobytes()],
                         "vectors": [b"".join(group["vector"])]})


def top_k(vectors: DataFrame, k: int = 20, scale: float = 64, query_step: int = 20) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k best rows of ``vectors`` (vec_id, embedding) for each query.

    Components become floor(scale * x). Queries are the rows whose id is divisible by ``query_step``; a query meets every row but
    those of its own id; query rows of one id share its ranks. Scores are inner products, ties go to the smaller id, and repeated ids keep their rows. Vectors that are
    null, hold null or a non-finite component, or have a null id take no part; shorter vectors are padded with zeros. Scores are
    exact while squared norms stay below 2**53. With fewer rows than k all are given; an empty table gives none. Pivots come from
    the SAMPLE vectors with the least hashes, the only rows the driver sees; the result does not depend on them.
    """
    spark = prepare(vectors.sparkSession)
    dims = vectors.agg(F.max(F.size("embedding"))).first()[0] or 0
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    if dims <= 0:
        return empty
    plain = vectors.select("vec_id", "embedding").mapInArrow(_integers(scale, dims), "vec_id long, vector binary")
    plain = stored(plain.withColumn("row", F.monotonically_increasing_id()), "vectors")  # numbered once, as it is stored
    sample = _sample(plain).select("vector").toPandas()
    if sample.empty:
        return empty
    pivots = choose_pivots(_matrix(sample["vector"], dims), PIVOTS)
    placed = plain.mapInArrow(_placed(pivots), "row long, vec_id long, vector binary, pivot int, distance double, norm double")
    reach = F.broadcast(placed.groupBy("pivot").agg(F.max("distance").alias("reach")))
    annulus = F.least(F.floor(F.try_divide(F.col("distance") * ANNULI, F.col("reach"))), F.lit(ANNULI - 1))
    placed = stored(placed.join(reach, "pivot").withColumn("cell", F.col("pivot") * ANNULI + F.coalesce(annulus, F.lit(0)).cast("int")), "placed")
    cells = placed.groupBy("cell", "pivot").agg(F.count("*").alias("n"), F.min("distance").alias("low"), F.max("distance").alias("high"), F.max("norm").alias("longest"))
    cells = cells.toPandas().sort_values("cell", ignore_index=True)
    cells["salts"] = -(-cells["n"] // BLOCK)
    salts = dict(zip(cells["cell"].tolist(), cells["salts"].tolist()))
    dealt = F.element_at(F.create_map(*[F.lit(x) for pair in salts.items() for x in pair]), F.col("cell"))
    blocks = stored(placed.withColumn("salt", F.pmod(F.xxhash64("row", F.lit(7)), dealt).cast("int")).select("cell", "salt", "vec_id", "vector")
                    .groupBy("cell", "salt").applyInPandas(_blocks, "cell int, salt int, ids binary, vectors binary"), "blocks")

    def first_cell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            q = _matrix(batch.column("vector").to_pylist(), dims)
            best = bounds(q, cells, pivots)
            best[:, cells["n"].to_numpy() <= k] -= 1e300
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("vec_id"), batch.column("vector"), pa.array(cells["cell"].to_numpy()[best.argmax(axis=1)], pa.int32())],
                                             ["row", "vec_id", "vector", "cell"])

    def floor_scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                own, q = np.frombuffer(row["queries"], np.int64), _matrix([row["packed"]], dims)
                ids, x = np.frombuffer(row["ids"] or b"", np.int64), _matrix([row["vectors"] or b""], dims)  # null where the cell has no such block
                scores = q @ x.T
                at, column = _best(scores, ids, own, k)
                full = np.bincount(at, minlength=len(own)) == k
                last = np.where(full, np.inf, -np.inf)
                np.minimum.at(last, at, scores[at, column])
                yield pa.RecordBatch.from_arrays([pa.array([row["block"]], pa.int64()), pa.array([row["queries"]], pa.binary()), pa.array([row["packed"]], pa.binary()),
                                                  pa.array([last.tobytes()], pa.binary())], ["block", "queries", "packed", "floors"])

    def expanded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                q, least = _matrix([row["packed"]], dims), np.frombuffer(row["floors"], np.float64)
                open_ = bounds(q, cells, pivots) >= least[:, None]
                for c in np.flatnonzero(open_.any(axis=0)):
                    some = open_[:, c]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([cells["cell"][c]], pa.int32()), pa.array([cells["salts"][c]], pa.int32()), pa.array([np.frombuffer(row["queries"], np.int64)[some].tobytes()], pa.binary()),
                         pa.array([q[some].tobytes()], pa.binary()), pa.array([least[some].tobytes()], pa.binary())], ["cell", "salts", "queries", "packed", "floors"])

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                own, least = np.frombuffer(row["queries"], np.int64), np.frombuffer(row["floors"], np.float64)
                ids = np.frombuffer(row["ids"], np.int64)
                scores = _matrix([row["packed"]], dims) @ _matrix([row["vectors"]], dims).T
                at, column = _best(scores, ids, own, k)
                found = scores[at, column]
                kept = found >= least[at]
                yield pa.RecordBatch.from_arrays([pa.array(own[at[kept]]), pa.array(ids[column[kept]]), pa.array(found[kept].astype(np.int64))], ["query_id", "vec_id", "score"])

    def packed(rows: DataFrame) -> DataFrame:
        """Queries of one cell in blocks of QUERIES."""
        count = F.broadcast(rows.groupBy("cell").agg(F.ceil(F.count("*") / QUERIES).cast("long").alias("parts")))
        spread = rows.join(count, "cell").withColumn("salt", F.pmod(F.xxhash64("row"), F.col("parts")).cast("int"))
        grouped = spread.select("cell", "salt", "vec_id", "vector").groupBy("cell", "salt").applyInPandas(_blocks, "cell int, salt int, ids binary, vectors binary")
        return grouped.select("cell", (F.col("cell") * F.lit(1 << 32) + F.col("salt")).alias("block"), F.col("ids").alias("queries"), F.col("vectors").alias("packed"))

    asked = plain.where(F.col("vec_id") % query_step == 0).mapInArrow(first_cell, "row long, vec_id long, vector binary, cell int")
    # sizes are guessed from files: cells and blocks of a query are many times what they are made of, and must never go through the driver
    first = packed(asked).hint("merge").join(blocks.where("salt = 0"), "cell", "left").select("block", "queries", "packed", "ids", "vectors")
    floors = stored(first.mapInArrow(floor_scores, "block long, queries binary, packed binary, floors binary"), "floors")
    pairs = floors.mapInArrow(expanded, "cell int, salts int, queries binary, packed binary, floors binary")
    pairs = pairs.withColumn("salt", F.explode(F.expr("sequence(0, salts - 1)"))).hint("merge").join(blocks, ["cell", "salt"])
    found = pairs.select("queries", "packed", "floors", "ids", "vectors").mapInArrow(scored, "query_id long, vec_id long, score long")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
