"""Phrase collocations from a weighted de Bruijn graph of words.

The longest grams are the edges of a graph whose nodes are the grams one word shorter; only they are counted over the corpus. A piece of
text that ends before a gram is full adds what is left of it, the correction for the piece's end. The count of a shorter phrase is then
the flow through it: the sum over the edges and corrections that begin with it. Where an edge carries all the flow of a node before or
behind it, the path is unary and compacted: the shorter phrase never occurs but inside the longer one and is not reported.

A phrase can only be frequent if all its pairs of neighbouring words are. So pairs are counted first, by hashes, and pieces also end
between words whose pair is not frequent. A filter of fixed size holds the frequent pairs and words; as it fills up, it lets more
pass, which costs time but changes nothing. Edges are packed in blocks, sorted, and merged group by group. Words are told apart by
64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b
from itertools import groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sourceloom.functions.ranking import top_per_group
from sourceloom.llm.jaccard import Marks
from sourceloom.llm.textarrays import binary_buffers, mix, sliced, span_hashes, word_spans
from sourceloom.session import discard, prepare, stored

#: Words of the longest phrase, least occurrences of a phrase, and phrases reported of a language.
LONGEST, LEAST, REPORTED = 5, 100, 2000
#: Bytes of text whose edges make up a group on average.
GROUP = 24 << 20
#: Bytes that end a piece, and those that only end a word.
PIECE_ENDS, BLANKS = b".,;:!?\n\x0b\x0c\r", b" \t"
_BETWEEN = np.zeros(256, bool)
_BETWEEN[list(PIECE_ENDS + BLANKS)] = True
_ENDS = np.zeros(256, bool)
_ENDS[list(PIECE_ENDS)] = True
_BASE = np.uint64(0x9E3779B97F4A7C15)


class _Words:
    """The words of a batch: hashes, languages, and which have a next one in their piece."""

    def __init__(self, batch: pa.RecordBatch) -> None:
        self.data, offsets = binary_buffers(batch.column("text"))
        self.begins, self.ends, first = word_spans(self.data, offsets, _BETWEEN)
        self.hashes = span_hashes(self.data, self.begins, self.ends)
        languages = batch.column("lang").dictionary_encode()
        self.languages = languages.dictionary
        codes = languages.indices.to_numpy().astype(np.int64)
        self.language = np.repeat(codes, np.diff(first))
        salts = [int.from_bytes(blake2b(name.encode(), digest_size=8).digest(), "little") for name in self.languages.to_pylist()]
        self.salt = np.array(salts, np.uint64)[self.language]
        piece = np.zeros(len(self.data) + 1, np.int64)
        np.cumsum(_ENDS[self.data], out=piece[1:])
        self.joined = np.zeros(len(self.hashes), bool)
        self.joined[:-1] = piece[self.begins[1:]] == piece[self.ends[:-1]]
        lasts = first[1:][np.diff(first) > 0] - 1
        self.joined[lasts] = False

    def keys(self) -> tuple[np.ndarray, np.ndarray]:
        """A key of each word and of each joined pair of words in their language."""
        pair = np.flatnonzero(self.joined)
        return mix(self.hashes ^ self.salt), mix(mix(self.hashes[pair] * _BASE + self.salt[pair]) + self.hashes[pair + 1])


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of words and of joined pairs in a batch, by key."""
    for batch in sliced(batches, "text", 4 << 20):
        keys, n = np.unique(np.concatenate(_Words(batch).keys()), return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n.astype(np.int32))], ["key", "n"])


def _runs(*columns: np.ndarray) -> np.ndarray:
    """Where a new combination of values begins in sorted columns."""
    new = np.zeros(len(columns[0]), bool)
    new[:1] = True
    for column in columns:
        new[1:] |= column[1:] != column[:-1]
    return np.flatnonzero(new)


def _edges(marks: Marks, longest: int, groups: int):
    """Counts of what begins at the words of a batch, packed in blocks by language, size and group: words (with their spelling), pairs,
    and edges of three words or more, or what a piece leaves of one; and of all words of a language (size 0)."""
    names = ["lang", "size", "part", "words", "n", "spelling"]

    def blocks(words: _Words, at: np.ndarray, size: np.ndarray, kind: int) -> Iterator[pa.RecordBatch]:
        key, lead = words.salt[at].copy(), words.salt[at].copy()
        for k in range(longest):
            on = np.flatnonzero(size > k)
            key[on] = mix(key[on] * _BASE + words.hashes[at[on] + k])
            if k < 3:
                lead[on] = key[on]
        part = (lead >> np.uint64(32)) % np.uint64(groups)
        _, first, n = np.unique(key, return_index=True, return_counts=True)
        order = np.lexsort((lead[first], part[first], words.language[at[first]]))
        first, n = first[order], n[order]
        language, part = words.language[at[first]], part[first]
        starts = _runs(language, part)
        for lo, hi in zip(starts.tolist(), [*starts[1:].tolist(), len(first)]):
            some = first[lo:hi]
            grams = np.zeros((longest if kind == 3 else kind, hi - lo), np.int64)
            for k in range(len(grams)):
                on = size[some] > k
                grams[k, on] = words.hashes[at[some[on]] + k].view(np.int64)
            spelling = b" ".join(words.data[a:b].tobytes().lower() for a, b in zip(words.begins[at[some]].tolist(), words.ends[at[some]].tolist())) if kind == 1 else None
            yield words.languages[int(language[lo])].as_py(), kind, int(part[lo]), grams.tobytes(), n[lo:hi].astype(np.int64).tobytes(), spelling

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text", 8 << 20):
            words = _Words(batch)
            single, pair = words.keys()
            joined = words.joined
            joined[np.flatnonzero(joined)[~marks.hit(pair)]] = False
            last = np.flatnonzero(~joined)
            size = np.minimum(longest, last[np.searchsorted(last, np.arange(len(joined)))] + 1 - np.arange(len(joined))) if len(joined) else np.zeros(0, np.int64)
            rows = [(name, 0, 0, b"", np.int64(n).tobytes(), None) for name, n in zip(words.languages.to_pylist(), np.bincount(words.language, minlength=len(words.languages)))]
            for kind, at in ((1, np.flatnonzero(marks.hit(single))), (2, np.flatnonzero(size >= 2)), (3, np.flatnonzero(size >= 3))):
                rows += blocks(words, at, np.minimum(size[at], (0, 1, 2, longest)[kind]), kind)
            columns = list(zip(*rows)) or [()] * 6
            kinds = (pa.string(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)
    return run


EDGES = "lang string, size int, part long, words binary, n binary, spelling binary"


def _flows(longest: int, least: int):
    """The phrases whose flow is at least ``least``, and each language's words as the empty phrase, from blocks in order."""
    def merged(lang: str, kind: int, words: list[bytes], n: list[bytes], spelling: list[bytes]) -> Iterator[tuple]:
        count = np.frombuffer(b"".join(n), np.int64)
        if kind == 0:
            yield lang, [], int(count.sum()), None
            return
        width = longest if kind == 3 else kind
        grams = np.concatenate([np.frombuffer(w, np.int64).reshape(width, -1) for w in words], axis=1)
        order = np.lexsort(grams[::-1])
        grams, count = grams[:, order], count[order]
        spelled = b" ".join(spelling).split(b" ") if kind == 1 else None
        for m in range(kind, width + 1):
            starts = _runs(*grams[:m])
            flow = np.add.reduceat(count, starts)
            for at, f in zip(starts[flow >= least].tolist(), flow[flow >= least].tolist()):
                if grams[m - 1, at]:  # 0 where a piece left a shorter one
                    yield lang, grams[:m, at].tolist(), f, spelled[order[at]] if spelled else None

    def given(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows)) or [()] * 4
        kinds = (pa.string(), pa.list_(pa.int64()), pa.int64(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["lang", "words", "f", "word"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = (block for batch in batches for block in zip(*(batch.column(c).to_pylist() for c in ("lang", "size", "part", "words", "n", "spelling"))))
        for (lang, kind, _), same in groupby(blocks, key=itemgetter(0, 1, 2)):
            _, _, _, words, n, spelling = zip(*same)
            yield given(list(merged(lang, kind, words, n, spelling)))
    return run


def collocations(docs: DataFrame, longest: int = LONGEST, least: int = LEAST, reported: int = REPORTED) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score) of the best phrases of each language of ``docs`` (text, lang; other columns are not read).

    A-Z count as a-z. Pieces end at ``.,;:!?`` and line ends, words at blanks and tabs. A phrase of 2 to ``longest`` (3 or more) words of
    one piece is a candidate if it occurs ``least`` times or more, overlaps included; a says how often, n counts all words of the language,
    l and r the two parts of the cut with the lowest score, floor(1000 * a * n / (l * r)), the first one of several. Candidates that
    lie in a longer one as frequent as they are left out. Phrases are ranked by score, then a, then their bytes; the first
    ``reported`` of each language are given. A null text is empty, a null language is ``und``; repeated rows count each; an empty
    table, or one without a candidate, gives none. Products are decimals of 38 digits.
    """
    prepare(docs.sparkSession)
    texts = docs.select(F.coalesce(F.col("lang"), F.lit("und")).alias("lang"), F.col("text").cast("binary").alias("text"))
    counted = texts.mapInArrow(_pairs, "key long, n int").groupBy("key").agg(F.sum("n").alias("n"))
    frequent = stored(counted.where(F.col("n") >= least).select("key"), "frequent")
    marks, blocks = Marks(frequent, frequent.count()), ["lang", "size", "part"]
    groups = 1 + (texts.agg(F.sum(F.length("text"))).first()[0] or 0) // GROUP
    edges = texts.mapInArrow(_edges(marks, longest, groups), EDGES).repartition(*blocks).sortWithinPartitions(*blocks)
    found = stored(edges.mapInArrow(_flows(longest, least), "lang string, words array<long>, f long, word binary"), "phrases")
    discard(frequent)
    totals = found.where("size(words) = 0").select("lang", F.col("f").alias("total"))
    names = found.where("size(words) = 1").groupBy(F.col("words")[0].alias("hash")).agg(F.min("word").cast("string").alias("word"))
    phrases = found.where("size(words) > 0").select("lang", "words", "f")

    longer = phrases.where("size(words) > 2")
    unary = longer.select("lang", F.expr("slice(words, 1, size(words) - 1)").alias("words"), "f").union(
        longer.select("lang", F.expr("slice(words, 2, size(words) - 1)").alias("words"), "f"))
    candidates = phrases.where("size(words) > 1").join(unary, ["lang", "words", "f"], "left_anti")
    cuts = candidates.select("lang", "words", F.col("f").alias("a"), F.explode(F.expr("sequence(1, size(words) - 1)")).alias("k"))
    cuts = cuts.withColumn("left", F.slice("words", F.lit(1), F.col("k"))).withColumn("right", F.expr("slice(words, k + 1, size(words) - k)"))
    cuts = cuts.join(phrases.select("lang", F.col("words").alias("left"), F.col("f").alias("l")), ["lang", "left"])
    cuts = cuts.join(phrases.select("lang", F.col("words").alias("right"), F.col("f").alias("r")), ["lang", "right"]).join(totals, "lang")
    score = F.expr("cast(1000 * a as decimal(19, 0)) * cast(total as decimal(19, 0)) div (cast(l as decimal(19, 0)) * cast(r as decimal(19, 0)))")
    best = cuts.withColumn("score", score).groupBy("lang", "words").agg(F.min("a").alias("a"), F.min("total").alias("n"), F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    spelled = best.select("lang", "words", "a", "n", "cut", F.posexplode("words").alias("at", "hash")).join(names, "hash")
    spelled = spelled.groupBy("lang", "words").agg(F.min(F.struct("a", "n", "cut")).alias("of"), F.array_sort(F.collect_list(F.struct("at", "word"))).alias("spelling"))
    phrase = F.array_join(F.transform("spelling", lambda w: w["word"]), " ")
    ranked = spelled.select("lang", phrase.alias("phrase"), F.col("of.a").alias("a"), F.col("of.cut.l").alias("l"), F.col("of.cut.r").alias("r"), F.col("of.n").alias("n"),
                            F.col("of.cut.score").alias("score"))
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    return top_per_group(ranked, ["lang"], order, reported).select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
