"""Byte-level BPE: vectorised pre-tokenisation by a transition-function scan, cached pair merging, offsets for decoding.

The split pattern is a small automaton over classes of code points. Each code point stands for a function from states to states;
composing functions is associative, so states come from a blocked scan over the numbers of composed functions (their closure is
a small table). A token starts where a state and the next class say so. No regular expression runs on a text.
"""

from __future__ import annotations

import base64
import heapq
from array import array
from collections.abc import Iterator
from functools import lru_cache
from math import isqrt

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sourceloom.llm.textarrays import SpanNumbers, binary_buffers, mix, sliced
from sourceloom.session import prepare

#: Distinct pre-tokens a worker keeps; beyond them its cache starts anew.
CACHE_PIECES = 100_000
#: Most columns of the blocked scan; short texts have about as many as rows.
SCAN = 128
#: Bytes of pre-tokens that are merged many at a time, and how many; a pair that makes no token.
TOGETHER, TOGETHER_ROWS, NONE = 48, 8192, np.iinfo(np.int32).max
# The white space of the split pattern.
SPACES = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]

# Classes of code points. SPACE and BLANK are white space with something else right after it, RUN is other white space; SHORT
# letters end a contraction, LONG ones begin an ending of two letters.
LETTER, NUMBER, OTHER, RUN, SPACE, BLANK, QUOTE, SHORT, LONG, CLASSES = range(10)
# States: inside a run of letters, numbers, others or white space; after white space that ends a token; after a blank that
# joins what follows; after a quote that began a token; after a contraction; inside one of two letters.
IN_LETTER, IN_NUMBER, IN_OTHER, IN_RUN, CLOSED, AFTER_BLANK, AFTER_QUOTE, CONTRACTED, IN_LONG, STATES = range(10)


def _automaton() -> tuple[np.ndarray, np.ndarray]:
    """Next states and whether a token starts, by state and class; the classes follow once more for a document's first code point."""
    plain = [IN_LETTER, IN_NUMBER, IN_OTHER, IN_RUN, CLOSED, AFTER_BLANK, AFTER_QUOTE, IN_LETTER, IN_LETTER]
    to = np.tile(np.array(plain + plain, np.uint8), (STATES, 1))
    starts = np.ones(to.shape, bool)

    def joins(state: int, kind: int, then: int | None = None) -> None:
        starts[state, kind] = False
        if then is not None:
            to[state, kind] = then

    for kind in (LETTER, SHORT, LONG):
        joins(IN_LETTER, kind)
        joins(AFTER_BLANK, kind)
        joins(IN_LONG, kind, CONTRACTED)
    joins(AFTER_QUOTE, SHORT, CONTRACTED)
    joins(AFTER_QUOTE, LONG, IN_LONG)
    for state in (IN_NUMBER, AFTER_BLANK):
        joins(state, NUMBER)
    for state in (IN_OTHER, AFTER_BLANK, AFTER_QUOTE):
        joins(state, OTHER)
        joins(state, QUOTE, IN_OTHER)
    joins(IN_RUN, RUN)
    return to, starts


@lru_cache(1)
def _tables() -> dict:
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    kinds = np.full(0x110000, OTHER, np.uint8)
    for kind, pattern in ((LETTER, r"\p{L}"), (NUMBER, r"\p{N}")):
        kinds[np.frombuffer("".join(regex.findall(pattern, every)).encode("utf-32-le"), np.uint32)] = kind
    kinds[SPACES] = RUN
    to, starts = _automaton()
    functions = [tuple(range(STATES)), *dict.fromkeys(map(tuple, to.T.tolist()))]
    number, at = {f: i for i, f in enumerate(functions)}, 0
    generators = list(functions)
    while at < len(functions):
        for g in generators:
            made = tuple(g[s] for s in functions[at])
            if made not in number:
                number[made] = len(functions)
                functions.append(made)
        at += 1
    compose = np.array([[number[tuple(g[s] for s in f)] for g in functions] for f in functions], np.uint16)
    return {"kinds": kinds, "starts": starts, "function": np.array([number[tuple(f)] for f in to.T.tolist()], np.uint16),
            "compose": compose.ravel(), "count": len(functions), "apply": np.array(functions, np.uint8)}


def token_starts(points: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Where pre-tokens start: a flag per code point of the documents that begin at the positions ``first``."""
    if not len(points):
        return np.zeros(0, bool)
    t, n = _tables(), len(points)
    kind = t["kinds"][points]
    begins = np.zeros(n + 1, bool)
    begins[first] = True
    following = np.concatenate([points[1:], [0]]).astype(np.uint32)
    ends = begins[1:].copy()
    ends[-1] = True
    spaced = (kind == RUN) & ~ends & (np.concatenate([kind[1:], [RUN]]) != RUN)
    kind[spaced] = SPACE
    kind[spaced & (points == 0x20)] = BLANK
    kind[points == 0x27] = QUOTE
    for letter in "stmd":
        kind[points == ord(letter)] = SHORT
    for letter, second in ("re", "ve", "ll"):
        kind[(points == ord(letter)) & (following == ord(second)) & ~ends] = LONG
    symbol = kind + np.uint8(CLASSES) * begins[:n]
    width = min(SCAN, isqrt(n) + 1)
    rows = -(-n // width)
    own = np.zeros(rows * width, np.uint16)
    own[:n] = t["function"][symbol]
    own = np.ascontiguousarray(own.reshape(rows, width).T)
    count, compose = np.uint32(t["count"]), t["compose"]
    for k in range(1, width):
        own[k] = compose[own[k - 1] * count + own[k]]
    before, step = np.concatenate([[0], own[-1, :-1]]).astype(np.uint16), 1
    while step < rows:
        before[step:] = compose[before[:-step] * count + before[step:]]
        step *= 2
    entry = t["apply"][before, CONTRACTED]
    state = t["apply"][own, entry[None, :]].T.ravel()[:n]
    return t["starts"][np.concatenate([[CONTRACTED], state[:-1]]), symbol]


@lru_cache(4)
def ranks(path: str) -> dict[bytes, int]:
    """The merge ranks of a file of base64 tokens and their ids."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def merged(piece: bytes, rank: dict[bytes, int]) -> list[int]:
    """The ids of one pre-token: the adjacent pair of least rank, leftmost first, is joined until none has a rank."""
    if piece in rank:
        return [rank[piece]]
    n = len(piece)
    ends, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := rank.get(piece[i:i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, end = heapq.heappop(heap)
        middle = ends[i]
        if middle < 0 or middle >= n or ends[middle] != end:
            continue
        ends[i], ends[middle] = end, -1
        if end < n:
            before[end] = i
            if (r := rank.get(piece[i:ends[end]])) is not None:
                heapq.heappush(heap, (r, i, ends[end]))
        if (left := before[i]) >= 0 and (r := rank.get(piece[left:end])) is not None:
            heapq.heappush(heap, (r, left, end))
    out, i = [], 0
    while i < n:
        out.append(rank[piece[i:ends[i]]])
        i = ends[i]
    return out


class PairRanks:
    """The rank of the token that two adjacent tokens make, for arrays of pairs, from a hash table with open slots."""

    def __init__(self, rank: dict[bytes, int]) -> None:
        pairs = [(a << 32 | b, whole) for token, whole in rank.items() for k in range(1, len(token))
                 if (a := rank.get(token[:k])) is not None and (b := rank.get(token[k:])) is not None]
        keys, wholes = (np.array(c, np.int64) for c in zip(*pairs)) if pairs else (np.zeros(0, np.int64),) * 2
        bits = max(4, (4 * len(keys)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.wholes = np.full(1 << bits, -1), np.full(1 << bits, NONE, np.int32)
        slot = self._slot(keys)
        while len(keys):
            free = np.flatnonzero(self.keys[slot] < 0)
            free = free[np.unique(slot[free], return_index=True)[1]]
            self.keys[slot[free]], self.wholes[slot[free]] = keys[free], wholes[free]
            left = np.ones(len(keys), bool)
            left[free] = False
            keys, wholes, slot = keys[left], wholes[left], (slot[left] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (mix(keys.view(np.uint64)) >> self.shift).astype(np.int64)

    def of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The ranks of pairs of tokens, NONE where they make no token."""
        keys = a.astype(np.int64) << 32 | b
        slot = self._slot(keys)
        out, open_ = self.wholes[slot], np.flatnonzero((self.keys[slot] != keys) & (self.keys[slot] >= 0))
        out[self.keys[slot] != keys] = NONE
        while len(open_):
            slot[open_] = (slot[open_] + 1) & self.mask
            there = self.keys[slot[open_]]
            hit = there == keys[open_]
            out[open_[hit]] = self.wholes[slot[open_[hit]]]
            open_ = open_[~hit & (there >= 0)]
        return out


@lru_cache(4)
def pair_ranks(path: str) -> PairRanks:
    return PairRanks(ranks(path))


def merged_together(found: list[bytes], path: str) -> tuple[np.ndarray, np.ndarray]:
    """The ids of pre-tokens of at most TOGETHER bytes, one after the other, and how many each has.

    A row of a matrix holds the tokens of a pre-token, linked by the columns of the next and the last one. In each round every
    row joins its pair of least rank, the leftmost first, until none has one.
    """
    rank, table, n = ranks(path), pair_ranks(path), len(found)
    sizes = np.fromiter(map(len, found), np.int64, n)
    width = int(sizes.max(initial=1))
    inside = np.arange(width) < sizes[:, None]
    token = np.zeros((n, width + 1), np.int32)
    token[:, :width][inside] = np.array([rank.get(bytes([b]), 0) for b in range(256)], np.int32)[np.frombuffer(b"".join(found), np.uint8)]
    after = np.tile(np.arange(1, width + 2, dtype=np.int32), (n, 1))
    before = np.tile(np.arange(-1, width, dtype=np.int32), (n, 1))
    made = np.full((n, width + 1), NONE, np.int32)
    paired = inside[:, 1:]
    made[:, :width - 1][paired] = table.of(token[:, :width - 1][paired], token[:, 1:width][paired])
    whole = np.fromiter((rank.get(piece, -1) for piece in found), np.int64, n)
    alive = inside.copy()
    alive[whole >= 0, 1:] = False
    token[whole >= 0, 0] = whole[whole >= 0]
    row = np.flatnonzero((whole < 0) & (sizes > 1))
    while len(row):
        at = made[row].argmin(axis=1)
        best = made[row, at]
        going = best < NONE
        row, at, best = row[going], at[going], best[going]
        gone = after[row, at]
        following = after[row, gone]
        token[row, at], after[row, at], made[row, gone], alive[row, gone] = best, following, NONE, False
        more = following < sizes[row]
        before[row[more], following[more]] = at[more]
        new = np.full(len(row), NONE, np.int32)
        new[more] = table.of(best[more], token[row[more], following[more]])
        made[row, at] = new
        last = before[row, at]
        more = last >= 0
        made[row[more], last[more]] = table.of(token[row[more], last[more]], best[more])
    return token[:, :width][alive], alive.sum(axis=1)


class Pieces(dict):
    """Numbers of pre-tokens; new ones are merged and their ids are appended to ``ids``."""

    def __init__(self, path: str) -> None:
        super().__init__()
        self.path, self.rank, self.ids, self.ends = path, ranks(path), array("I"), array("q", [0])
        self.numbers = SpanNumbers(self.of_all, 19)

    def of_all(self, found: list[bytes]) -> list[int]:
        """The numbers of pre-tokens; the short ones that are new are merged together."""
        new = [piece for piece in dict.fromkeys(found) if 0 < len(piece) <= TOGETHER and piece not in self]
        new.sort(key=len)
        for at in range(0, len(new), TOGETHER_ROWS):
            some = new[at:at + TOGETHER_ROWS]
            ids, counts = merged_together(some, self.path)
            begin, end = len(self.ends) - 1, self.ends[-1]
            self.ids.frombytes(ids.astype(np.uint32).tobytes())
            self.ends.frombytes((np.cumsum(counts) + end).astype(np.int64).tobytes())
            self.update(zip(some, range(begin, begin + len(some))))
        return list(map(self.__getitem__, found))

    def __missing__(self, piece: bytes) -> int:
        self.ids.extend(merged(piece, self.rank))
        self.ends.append(len(self.ids))
        self[piece] = len(self.ends) - 2
        return self[piece]


_CACHES: dict[str, Pieces] = {}


def pieces(path: str) -> Pieces:
    """This worker's cache for a vocabulary."""
    if path not in _CACHES or len(_CACHES[path]) > CACHE_PIECES:
        _CACHES[path] = Pieces(path)
    return _CACHES[path]


def code_points(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets as bytes, offsets, code points and the number of code points before each document.

    Bytes that are not UTF-8 become U+FFFD.
    """
    try:
        text = data.tobytes().decode()
    except UnicodeDecodeError:
        texts = [data[a:b].tobytes().decode(errors="replace").encode() for a, b in zip(offsets[:-1], offsets[1:])]
        offsets = np.concatenate([[0], np.cumsum([len(x) for x in texts])])
        data = np.frombuffer(b"".join(texts), np.uint8)
        text = data.tobytes().decode()
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    heads = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    return data, offsets, points, heads[offsets]


def pretokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes, the byte positions where pre-tokens start, and the number of pre-tokens before each document."""
    data, offsets, points, first = code_points(data, offsets)
    starts = token_starts(points, first[:-1][first[:-1] < len(points)])
    at = np.flatnonzero((data & 0xC0) != 0x80)[starts]
    return data, at, np.searchsorted(at, offsets)


def spread(counts: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Positions first[i], first[i] + 1, ... for counts[i] entries, all in a row."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(first - ends + counts, counts)


def encoded(data: np.ndarray, offsets: np.ndarray, path: str) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all documents in a row, and the number of ids before each document."""
    data, at, before = pretokens(data, offsets)
    cache = pieces(path)
    which = cache.numbers.of(data, at, np.append(at[1:], len(data)))
    ends = np.array(cache.ends)
    counts = ends[which + 1] - ends[which]
    ids = np.array(cache.ids)[spread(counts, ends[which])]
    return ids, np.concatenate([[0], np.cumsum(counts)])[before]


@lru_cache(4)
def token_table(path: str) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all tokens by id in a row, and where each starts (one entry more than ids)."""
    tokens = {i: token for token, i in ranks(path).items()}
    row = [tokens.get(i, b"") for i in range(max(tokens) + 1)]
    return np.frombuffer(b"".join(row), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in row])])


def _encoder(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text", 1 << 20):
            ids, before = encoded(*binary_buffers(batch.column("text")), path)
            _, first = token_table(path)
            lengths = np.cumsum(first[ids + 1] - first[ids]) if len(ids) else np.zeros(0, np.int64)
            cut = [(a, b, lengths[a - 1] if a else 0) for a, b in zip(before[:-1], before[1:])]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([ids[a:b].tobytes() for a, b, _ in cut], pa.binary()),
                                              pa.array([(lengths[a:b] - base).astype(np.uint32).tobytes() for a, b, base in cut], pa.binary())],
                                             ["doc_id", "ids", "ends"])
    return run


def _decoder(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blob, first = token_table(path)
        for batch in sliced(batches, "ids", 1 << 20):
            out = []
            for packed, packed_ends in zip(batch.column("ids"), batch.column("ends")):
                ids, ends = np.frombuffer(packed.as_py() or b"", np.uint32), np.frombuffer(packed_ends.as_py() or b"", np.uint32).astype(np.int64)
                starts = np.concatenate([[0], ends[:-1]])[:len(ends)]
                out.append(blob[spread(ends - starts, first[ids])].tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("ids"), pa.array(out, pa.binary())], ["doc_id", "ids", "decoded"])
    return run


def _texts(docs: DataFrame) -> DataFrame:
    prepare(docs.sparkSession)
    return docs.select("doc_id", F.col("text").cast("binary").alias("text"))


def encode(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids, ends) of every row of ``docs`` (doc_id, text): packed unsigned 32-bit token ids, and the byte position after
    each token. Null and empty texts have none; bytes that are not UTF-8 count as U+FFFD. Rows keep their number whatever ids
    repeat or are null. ``path`` is a file of ranks that every machine holds. Other columns are not read."""
    return _texts(docs).mapInArrow(_encoder(path), "doc_id long, ids binary, ends binary")


def decode(tokens: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids, decoded) of rows that ``encode`` gave: the bytes of the tokens laid at their offsets."""
    prepare(tokens.sparkSession)
    return tokens.mapInArrow(_decoder(path), "doc_id long, ids binary, decoded binary")


def token_digests(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every row: texts encoded and decoded again, in one worker a task."""
    encoder, decoder = _encoder(path), _decoder(path)
    both = _texts(docs).mapInArrow(lambda batches: decoder(encoder(batches)), "doc_id long, ids binary, decoded binary")
    return both.select(
        "doc_id", F.expr("cast(octet_length(ids) / 4 as bigint)").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))
