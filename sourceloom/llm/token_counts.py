"""Edit-aware token counts: a segment tree over a document's pre-tokens; an edit re-encodes only what it touches.

Trees are a table: the leaves of one are runs of pre-tokens with their characters and tokens; inner nodes hold sums. An edit is found by walking
the character sums down, its leaves and some context are cut into pre-tokens again and encoded, and the sums on the way up are
corrected. The context on the right grows until the old and new cuts agree, so counts are those of the whole new text.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sourceloom.llm.byte_bpe import Pieces, pieces, pretokens, token_starts
from sourceloom.llm.textarrays import binary_buffers, sliced
from sourceloom.session import fresh_name, prepare, row_key, stored

#: Pre-tokens of a leaf; characters that a leaf must reach beyond an edit, and those looked at behind a region.
LEAF, CONTEXT, AHEAD = 32, 4, 2
#: Edits with at most so many characters between them touch the same region and are made as one.
GAP = 64

#: (first character, character after the last one, new text); ascending and apart.
Edit = tuple[int, int, str]


def piece_tokens(text: str, begins: np.ndarray, cache: Pieces) -> np.ndarray:
    """Tokens of each pre-token of a text."""
    bounds = [*begins.tolist(), len(text)]
    which = np.array([cache[text[a:b].encode()] for a, b in zip(bounds, bounds[1:])], np.int64)
    ends = np.array(cache.ends)
    return ends[which + 1] - ends[which]


def _cut(text: str, kept: int) -> tuple[np.ndarray, bool]:
    """Where pre-tokens begin before ``kept``, and whether one begins there."""
    flags = token_starts(np.frombuffer(text.encode("utf-32-le"), np.uint32), np.zeros(1, np.int64))
    return np.flatnonzero(flags[:kept]), kept == len(text) or bool(flags[kept])


class TokenTree:
    """Token counts of one text under edits."""

    def __init__(self, text: str, begins: np.ndarray, tokens: np.ndarray, cache: Pieces) -> None:
        edges = np.append(begins[::LEAF], len(text)) if len(begins) else np.zeros(1, np.int64)
        self._build(text, np.diff(edges), np.add.reduceat(tokens, np.arange(0, len(tokens), LEAF)) if len(begins) else edges[1:], cache)

    @classmethod
    def kept(cls, text: str, characters: np.ndarray, tokens: np.ndarray, cache: Pieces) -> TokenTree:
        """The tree of ``text`` whose leaves have these characters and tokens."""
        tree = cls.__new__(cls)
        tree._build(text, characters, tokens, cache)
        return tree

    def _build(self, text: str, characters: np.ndarray, tokens: np.ndarray, cache: Pieces) -> None:
        self.cache, self.encoded = cache, 0
        edges = [0, *np.cumsum(characters).tolist()] if len(characters) else [0, 0]
        self.leaves = [text[a:b] for a, b in zip(edges, edges[1:])]
        self.first = 1
        while self.first < len(self.leaves):
            self.first *= 2
        self.characters, self.tokens = np.zeros(2 * self.first, np.int64), np.zeros(2 * self.first, np.int64)
        for sums, given in ((self.characters, characters), (self.tokens, tokens)):
            sums[self.first:self.first + len(given)] = given
            level = self.first
            while level > 1:
                sums[level // 2:level] = sums[level:2 * level:2] + sums[level + 1:2 * level:2]
                level //= 2

    def sums(self) -> tuple[np.ndarray, np.ndarray]:
        """Characters and tokens of the leaves."""
        at = slice(self.first, self.first + len(self.leaves))
        return self.characters[at], self.tokens[at]

    def total(self) -> int:
        """Tokens of the whole text."""
        return int(self.tokens[1])

    def text(self) -> str:
        return "".join(self.leaves)

    def _find(self, position: int) -> tuple[int, int]:
        """The leaf that holds a character position, and the position in it; the last leaf for the end of the text."""
        if position >= self.characters[1]:
            return len(self.leaves) - 1, position - int(self.characters[1]) + len(self.leaves[-1])
        node = 1
        while node < self.first:
            node *= 2
            if position >= self.characters[node]:
                position -= int(self.characters[node])
                node += 1
        return node - self.first, position

    def _set(self, leaf: int, text: str, tokens: int) -> None:
        node = leaf + self.first
        by = len(text) - self.characters[node], tokens - self.tokens[node]
        self.leaves[leaf] = text
        while node:
            self.characters[node] += by[0]
            self.tokens[node] += by[1]
            node //= 2

    def edit(self, start: int, end: int, new: str) -> None:
        """Put ``new`` in place of the characters from ``start`` to ``end``."""
        low, before = self._find(start)
        high, after = self._find(end)
        while low and before < CONTEXT:
            low -= 1
            before += len(self.leaves[low])
        rest = len(self.leaves[high]) - after
        last = len(self.leaves) - 1
        while True:
            while high < last and rest < CONTEXT:
                high += 1
                rest += len(self.leaves[high])
            old = "".join(self.leaves[low:high + 1])
            region = old[:before] + new + old[len(old) - rest:]
            ahead, k = "", high + 1
            while k <= last and len(ahead) < AHEAD:
                ahead += self.leaves[k][:AHEAD]
                k += 1
            begins, closed = _cut(region + ahead, len(region))
            if closed or high == last:
                break
            high += 1
            rest += len(self.leaves[high])
        tokens = piece_tokens(region, begins, self.cache)
        self.encoded += len(begins)
        self._set(low, region, int(tokens.sum()))
        for leaf in range(low + 1, high + 1):
            self._set(leaf, "", 0)


def joined(text: str, edits: list[Edit]) -> list[Edit]:
    """The same edits with those close together as one."""
    out: list[list] = []
    for start, end, new in edits:
        if out and start - out[-1][1] <= GAP:
            out[-1][2] += [text[out[-1][1]:start], new]
            out[-1][1] = end
        else:
            out.append([start, end, [new]])
    return [(start, end, "".join(new)) for start, end, new in out]


def _trees(path: str, carried: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text", 2 << 20):
            data, at, before = pretokens(*binary_buffers(batch.column("text")))
            cache = pieces(path)
            which = cache.numbers.of(data, at, np.append(at[1:], len(data)))
            ends = np.array(cache.ends)
            tokens = np.concatenate([np.zeros(1, np.int64), np.cumsum(ends[which + 1] - ends[which])])
            place = np.append(np.cumsum((data & 0xC0) != 0x80)[at] - 1, int(((data & 0xC0) != 0x80).sum())) if len(at) else np.zeros(1, np.int64)
            rows = []
            for lo, hi in zip(before[:-1].tolist(), before[1:].tolist()):
                cuts = np.append(np.arange(lo, hi, LEAF), hi)
                rows.append((int(tokens[hi] - tokens[lo]), hi - lo, np.diff(place[cuts]).astype(np.int32).tobytes(), np.diff(tokens[cuts]).astype(np.int32).tobytes()))
            columns = list(zip(*rows)) or [()] * 4
            kinds = (pa.int64(), pa.int64(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([*map(batch.column, carried), *[pa.array(c, k) for c, k in zip(columns, kinds)]], [*carried, "n_tokens", "n_pretokens", "characters", "tokens"])
    return run


def token_trees(docs: DataFrame, path: str, also: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, the columns ``also``, n_tokens, n_pretokens, characters, tokens) of every row of ``docs`` (doc_id, text): the counts, and
    the packed 32-bit characters and tokens of the leaves of its tree, which ``apply_edits`` goes on from. Store them to keep them.
    """
    prepare(docs.sparkSession)
    carried, kinds = ["doc_id", *also], dict(docs.dtypes)
    texts = docs.select(*carried, F.col("text").cast("binary").alias("text"))
    return texts.mapInArrow(_trees(path, carried), ", ".join([*[f"{c} {kinds[c]}" for c in carried], "n_tokens long", "n_pretokens long", "characters binary", "tokens binary"]))


EDITS = "array<struct<start: int, stop: int, new: string>>"


def apply_edits(trees: DataFrame, edited: DataFrame, key: str, path: str) -> DataFrame:
    """(``key``, text, n_edits, n_encoded, n_tokens, characters, tokens) of the rows of ``edited`` (``key``, text, edits) after their edits.

    ``key`` tells rows apart; ``trees`` has the tree of each text before the edits, and those returned are the trees after them, so
    that edits can follow edits. Edits are ascending and apart. n_encoded counts the pre-tokens that had to be encoded. Only
    edited texts are read, and of those only the leaves that an edit touches are encoded.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = pieces(path)
        for batch in sliced(batches, "text", 2 << 20):
            rows = []
            for row in zip(*(batch.column(c).to_pylist() for c in ("text", "edits", "characters", "tokens"))):
                text, edits = (row[0] or b"").decode(), [(e["start"], e["stop"], e["new"]) for e in row[1] or []]
                tree = TokenTree.kept(text, np.frombuffer(row[2], np.int32), np.frombuffer(row[3], np.int32), cache)
                for start, end, new in reversed(joined(text, edits)):
                    tree.edit(start, end, new)
                rows.append((tree.text().encode(), len(edits), tree.encoded, tree.total(), *(sums.astype(np.int32).tobytes() for sums in tree.sums())))
            columns = list(zip(*rows)) or [()] * 6
            out = [pa.array(c, k) for c, k in zip(columns, (pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary()))]
            yield pa.RecordBatch.from_arrays([batch.column(key), *out], [key, "text", "n_edits", "n_encoded", "n_tokens", "characters", "tokens"])

    kind = dict(edited.dtypes)[key]
    rows = edited.select(key, F.col("text").cast("binary").alias("text"), "edits").join(trees.select(key, "characters", "tokens"), key)
    return rows.mapInArrow(run, f"{key} {kind}, text binary, n_edits long, n_encoded long, n_tokens long, characters binary, tokens binary")


def edits_found(docs: DataFrame, key: str, edits_of: Callable[[str], list[Edit]]) -> DataFrame:
    """(``key``, text, edits) of the rows of ``docs`` (``key``, text) for whose text ``edits_of`` gives any; null texts are empty."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text", 2 << 20):
            found = [edits_of((text or b"").decode()) for text in batch.column("text").to_pylist()]
            at = np.flatnonzero([bool(edits) for edits in found])
            flat = [edit for k in at for edit in found[k]]
            columns = list(zip(*flat)) or [()] * 3
            parts = [pa.array(c, k) for c, k in zip(columns, (pa.int32(), pa.int32(), pa.string()))]
            edges = np.append(0, np.cumsum([len(found[k]) for k in at])).astype(np.int32)
            edits = pa.ListArray.from_arrays(pa.array(edges), pa.StructArray.from_arrays(parts, ["start", "stop", "new"]))
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(pa.array(at)) for c in (key, "text")), edits], [key, "text", "edits"])

    kind = dict(docs.dtypes)[key]
    return docs.select(key, F.col("text").cast("binary").alias("text")).mapInArrow(run, f"{key} {kind}, text binary, edits {EDITS}")


def edited_counts(docs: DataFrame, path: str, edits_of: Callable[[str], list[Edit]]) -> DataFrame:
    """(doc_id, n_tokens, n_edits, n_tokens_edited, n_pretokens, n_encoded) of every row of ``docs`` (doc_id, text).

    ``edits_of`` gives the edits of a text, ascending and apart. Counts are those of the whole text before and after them,
    n_encoded the pre-tokens that the edits made necessary to encode, of n_pretokens in all. Null and empty texts have no tokens
    and no edits unless ``edits_of`` makes one for the empty text. Rows keep their number whatever ids repeat or are null.
    Trees are stored, and only texts with edits meet theirs again.
    """
    prepare(docs.sparkSession)
    key = fresh_name(docs, "row_key")
    keyed = row_key(docs, key)
    if keyed is None:
        keyed = stored(docs.select("doc_id", "text", F.monotonically_increasing_id().alias(key)), "numbered")
    trees = stored(token_trees(keyed, path, (key,)), "token-trees")
    changed = apply_edits(trees, edits_found(keyed, key, edits_of), key, path)
    changed = changed.select(key, "n_edits", "n_encoded", F.col("n_tokens").alias("n_tokens_edited"))
    counts = trees.select("doc_id", key, "n_tokens", "n_pretokens").join(changed, key, "left")
    return counts.select("doc_id", "n_tokens", F.coalesce("n_edits", F.lit(0)).alias("n_edits"), F.coalesce("n_tokens_edited", "n_tokens").alias("n_tokens_edited"), "n_pretokens",
                         F.coalesce("n_encoded", F.lit(0)).alias("n_encoded"))
