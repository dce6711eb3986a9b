"""Token ids in binary files: frequency-ranked ids in byte-aligned variable-length code, control bytes apart from data bytes.

The most frequent id gets number 0. A number takes one to four data bytes; two bits of a control byte hold how many, four numbers
to a control byte. A decoder needs no branches: a table of 256 rows gives the lengths that a control byte stands for. Blocks of
whole documents are rows of Parquet files, so that Spark's writers place them on any store and a lost task leaves nothing behind;
each holds the ids of its documents, their lengths, and both streams.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from sourceloom.llm.byte_bpe import spread
from sourceloom.llm.textarrays import SpanNumbers, binary_buffers, sliced, word_spans
from sourceloom.session import prepare, scratch_path, stored

#: Ids of a block, beyond which its last document isn't continued by another one.
BLOCK_IDS = 1 << 18
#: Distinct words a worker keeps; beyond them its cache starts anew.
CACHE_WORDS = 1_000_000
#: Words the tokenizer gets at a time.
BATCH_WORDS = 4000
#: The lengths that a control byte stands for.
LENGTHS = (np.arange(256)[:, None] >> np.array([0, 2, 4, 6]) & 3) + 1
_BLOCK = "part int, block int, doc_ids array<long>, counts array<long>, control binary, data binary"


def pack(numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Control bytes and data bytes of unsigned 32-bit numbers."""
    size = 1 + (numbers >= 1 << 8).astype(np.int64) + (numbers >= 1 << 16) + (numbers >= 1 << 24)
    codes = np.zeros(-(-len(numbers) // 4) * 4, np.uint8)
    codes[:len(numbers)] = size - 1
    codes = codes.reshape(-1, 4)
    control = codes[:, 0] | codes[:, 1] << 2 | codes[:, 2] << 4 | codes[:, 3] << 6
    four = numbers.astype("<u4").view(np.uint8).reshape(-1, 4)
    return control, four[np.arange(4) < size[:, None]]


def unpack(control: np.ndarray, data: np.ndarray, count: int) -> np.ndarray:
    """The numbers again."""
    size = LENGTHS[control].ravel()[:count]
    four = np.zeros((count, 4), np.uint8)
    four[np.arange(4) < size[:, None]] = data
    return four.view("<u4").ravel()


class _Words(dict):
    """Numbers of words; new ones are encoded by the tokenizer, many at a time."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a worker for each core
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.ids, self.ends = array("I"), array("q", [0])
        added = [(i, t) for i, t in self.tokenizer.get_added_tokens_decoder().items() if t.special]
        self.plain = not any(t.normalized or t.single_word or t.lstrip or t.rstrip for _, t in added)
        self.special = {t.content.encode(): k for k, (_, t) in enumerate(added)}  # their numbers, which no word has
        for i, _ in added:
            self.ids.append(i)
            self.ends.append(len(self.ids))
        self.literal = re.compile(b"|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) or b"(?!)")

        self.numbers = SpanNumbers(self.numbers_of, 21)

    def numbers_of(self, words: list[bytes]) -> list[int]:
        self.learn(words)
        return list(map(self.__getitem__, words))

    def learn(self, words: list[bytes]) -> None:
        new = list(set(words).difference(self))
        for at in range(0, len(new), BATCH_WORDS):
            batch = new[at:at + BATCH_WORDS]
            found = [e.ids for e in self.tokenizer.encode_batch_fast([w.decode(errors="replace") for w in batch], add_special_tokens=False)]
            self.update(zip(batch, range(len(self.ends) - 1, len(self.ends) - 1 + len(batch))))
            self.ends.extend((np.cumsum(list(map(len, found))) + len(self.ids)).tolist())
            self.ids.extend(chain.from_iterable(found))


_CACHES: dict[str, _Words] = {}


#: ASCII letters, digits and other signs but the quote: where two of these kinds meet, the tokenizer always parts a word.
_KIND = np.zeros(256, np.uint8)
_KIND[33:127], _KIND[39] = 3, 0
_KIND[48:58] = 2
_KIND[65:91] = _KIND[97:123] = 1


def _pieces(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The bytes with A-Z lower-cased where no combining sign can follow, starts and ends of the parts of words, parts before each document."""
    starts, ends, _ = word_spans(data, offsets)
    upper = (data >= 65) & (data < 91)
    upper[:-1] &= data[1:] < 128
    kind = _KIND[data]
    cuts = np.flatnonzero((kind[1:] != kind[:-1]) & (kind[1:] > 0) & (kind[:-1] > 0)) + 1
    cuts = cuts[~np.isin(cuts, offsets)]
    starts, ends = np.sort(np.concatenate([starts, cuts])), np.sort(np.concatenate([ends, cuts]))
    return data + np.uint8(32) * upper, starts, ends, np.searchsorted(starts, offsets)


def _literals(data: np.ndarray, offsets: np.ndarray, cache: _Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and numbers of the special tokens that stand literally in the documents, the leftmost and longest ones."""
    raw, found = data.tobytes(), []
    if cache.literal.search(raw):
        for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
            found += [(*m.span(), cache.special[m.group()]) for m in cache.literal.finditer(raw, a, b)]
    starts, ends, numbers = np.array(found, np.int64).reshape(-1, 3).T
    return starts, ends, numbers


def _parted(starts: np.ndarray, ends: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of parts with the spans ``begin`` to ``end`` as parts of their own, and which parts those are."""
    edges = np.unique(np.concatenate([begin, end]))
    at = np.searchsorted(starts, edges) - 1
    cuts = edges[(at >= 0) & (edges < ends[at])]
    starts, ends = np.sort(np.concatenate([starts, cuts])), np.sort(np.concatenate([ends, cuts]))
    over = np.searchsorted(begin, starts, "right") - 1
    outside = (over < 0) | (starts >= end[over])
    starts, ends = np.concatenate([starts[outside], begin]), np.concatenate([ends[outside], end])
    order = np.argsort(starts, kind="stable")
    return starts[order], ends[order], (np.arange(len(starts)) >= int(outside.sum()))[order]


def word_ids(data: np.ndarray, offsets: np.ndarray, path: str, special: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all documents in a row and the number of ids before each, part of word by part of word.

    The tokenizer must lower-case, and split at white space and between letters, digits and other signs. With ``special``, special
    tokens that stand literally in a text are their ids, as the library has it by default; else they are ordinary text. Special
    tokens must be matched as they are: not after normalising, as whole words or with the white space around.
    """
    if path not in _CACHES or len(_CACHES[path]) > CACHE_WORDS:
        _CACHES[path] = _Words(path)
    cache = _CACHES[path]
    if special and not cache.plain:
        raise ValueError(f"{path} has special tokens that are not matched as they are")
    begin, end, numbers = _literals(data, offsets, cache) if special else [np.zeros(0, np.int64)] * 3
    data, starts, ends, before = _pieces(data, offsets)
    if len(begin):
        starts, ends, literal = _parted(starts, ends, begin, end)
        before = np.searchsorted(starts, offsets)
        which = np.zeros(len(starts), np.int64)
        which[literal] = numbers
        which[~literal] = cache.numbers.of(data, starts[~literal], ends[~literal])
    else:
        which = cache.numbers.of(data, starts, ends)
    bounds = np.frombuffer(cache.ends, np.int64)
    first = bounds[which]
    counts = bounds[which + 1] - first
    del bounds
    ids = np.frombuffer(cache.ids, np.uint32)[spread(counts, first)] if len(which) else np.zeros(0, np.uint32)
    return ids, np.concatenate([[0], np.cumsum(counts)])[before]


def _tokens(path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text", 4 << 20):
            ids, before = word_ids(*binary_buffers(batch.column("text")), path, special=True)
            ids = np.insert(ids, before[1:], end_id)
            before = before + np.arange(len(before))
            kind = np.uint16 if not len(ids) or ids.max() < 1 << 16 else np.uint32
            packed = [ids[a:b].astype(kind).tobytes() for a, b in zip(before[:-1], before[1:])]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(packed, pa.binary()), pa.array([np.dtype(kind).itemsize] * len(packed), pa.int32())],
                                             ["doc_id", "ids", "width"])
    return run


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How often each id occurs in a partition."""
    total = np.zeros(0, np.int64)
    for batch in sliced(batches, "ids"):
        for packed, width in zip(batch.column("ids"), batch.column("width")):
            found = np.bincount(np.frombuffer(packed.as_py(), f"<u{width.as_py()}"), minlength=len(total))
            found[:len(total)] += total
            total = found
    ids = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(total[ids], pa.int64())], ["id", "n"])


def _blocks(rank: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, block, held, docs, counts, size = TaskContext.get().partitionId(), 0, [], [], [], 0

        def closed() -> pa.RecordBatch:
            control, data = pack(rank[np.concatenate(held)])
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([block], pa.int32()), pa.array([docs], pa.list_(pa.int64())), pa.array([counts], pa.list_(pa.int64())),
                 pa.array([control.tobytes()], pa.binary()), pa.array([data.tobytes()], pa.binary())], ["part", "block", "doc_ids", "counts", "control", "data"])

        for batch in sliced(batches, "ids"):
            for doc_id, packed, width in zip(batch.column("doc_id"), batch.column("ids"), batch.column("width")):
                held.append(np.frombuffer(packed.as_py(), f"<u{width.as_py()}"))
                docs.append(doc_id.as_py())
                counts.append(len(held[-1]))
                size += counts[-1]
                if size >= BLOCK_IDS:
                    yield closed()
                    block, held, docs, counts, size = block + 1, [], [], [], 0
        if docs:
            yield closed()
    return run


def _compact(df: DataFrame, name: str) -> DataFrame:
    """``df`` written with the denser codec and read back."""
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def write_tokens(docs: DataFrame, tokenizer: str, end_id: int, folder_name: str = "tokens") -> tuple[DataFrame, DataFrame]:
    """Encode ``docs`` (doc_id, text) and write their ids in ascending doc_id order; returns the blocks read back and the id of each rank.

    ``tokenizer`` is a tokenizers file that every machine holds and that splits at white space; its special tokens are matched in the
    texts as the library does by default. Null and empty texts have only ``end_id``. Null ids come first; rows of one id stand next to each other, by their ids' bytes. An empty table gives no blocks.
    Ids are counted over all documents; the counts, one for each id of the vocabulary, are all that the driver holds.
    """
    spark = prepare(docs.sparkSession)
    texts = docs.select("doc_id", F.col("text").cast("binary").alias("text"))
    staged = _compact(texts.mapInArrow(_tokens(tokenizer, end_id), "doc_id long, ids binary, width int"), "ids")
    seen = staged.select("ids", "width").mapInArrow(_counted, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toPandas()
    seen = seen.sort_values(["n", "id"], ascending=[False, True], ignore_index=True)
    rank = np.zeros(int(seen["id"].max()) + 1 if len(seen) else 1, np.uint32)
    rank[seen["id"].to_numpy(np.int64)] = np.arange(len(seen))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = staged.repartitionByRange(n, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "ids")
    ranks = spark.createDataFrame(pd.DataFrame({"rank": seen.index.astype("int64"), "id": seen["id"].astype("int64")}), "rank long, id long")
    return _compact(ordered.mapInArrow(_blocks(rank), _BLOCK), folder_name), stored(ranks.coalesce(1), f"{folder_name}-ranks")


def read_tokens(blocks: DataFrame, ranks: DataFrame) -> DataFrame:
    """(part, block, doc_id, nth, before, ids) from blocks and ranks: packed unsigned 32-bit ids, the place of the document in its
    block, and the ids before it there. The ranks are at most one row for each id of the vocabulary."""
    table = ranks.toPandas().sort_values("rank")["id"].to_numpy(np.uint32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                bounds = np.concatenate([[0], np.cumsum(row["counts"])]).astype(np.int64)
                ids = table[unpack(np.frombuffer(row["control"], np.uint8), np.frombuffer(row["data"], np.uint8), bounds[-1])].astype("<u4")
                k = len(row["doc_ids"])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["part"]] * k, pa.int32()), pa.array([row["block"]] * k, pa.int32()), pa.array(row["doc_ids"], pa.int64()),
                     pa.array(np.arange(k), pa.int64()), pa.array(bounds[:-1]), pa.array([ids[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:])], pa.binary())],
                    ["part", "block", "doc_id", "nth", "before", "ids"])

    return blocks.mapInArrow(run, "part int, block int, doc_id long, nth long, before long, ids binary")


def token_directory(blocks: DataFrame, ranks: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document in the files; start counts the ids of all documents before it."""
    sizes = blocks.select("part", "block", F.expr("aggregate(counts, 0L, (a, x) -> a + x)").alias("n"))
    parts = sizes.groupBy("part").agg(F.sum("n").alias("n"))
    earlier = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("part_start"))
    here = W.partitionBy("part").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    placed = sizes.withColumn("block_start", F.coalesce(F.sum("n").over(here), F.lit(0))).join(parts, "part").select(
        "part", "block", (F.col("part_start") + F.col("block_start")).alias("base"))
    read = read_tokens(blocks, ranks).select("part", "block", "doc_id", "before", F.expr("cast(octet_length(ids) / 4 as bigint)").alias("n_tokens"),
                                            F.crc32("ids").alias("ids_crc32"))
    return read.join(placed, ["part", "block"]).select("doc_id", (F.col("base") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")
