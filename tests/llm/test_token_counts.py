"""Edits of the counting query against the plain pattern, and kept trees against counting anew."""

from __future__ import annotations

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from sourceloom.llm import token_counts
from sourceloom.llm.queries import BYTE_RANKS
from sourceloom.llm.redactions import redactions
from sourceloom.session import stored

PLAIN = re.compile(r"(?P<mail>[\w.+-]+@[\w-]+\.[\w.]+)|(?P<key>\b[0-9a-f]{32,}\b)|(?P<number>\+?\d[\d .()-]{6,}\d)|(?P<sign>[^\w\s])(?P=sign)+")
SIGNS = ["@", "a.b", "x@y.z", "1", "12", "+", " ", "-", "(", ")", ".", "..", "!!", "?", "\u00e9", "\u3002", "\u3002\u3002", "\u0663", "\n", "0123456789abcdef" * 2, "f" * 31, "g", " ", "_",
         "\u4e2d", "\u2026", "\u2026\u2026", "\U0001f600", "word "]


def by_pattern(text):
    return [(*m.span(), m["sign"] or f"<{m.lastgroup}>") for m in PLAIN.finditer(text)]


def test_redactions_are_those_of_the_pattern():
    rng, found = random.Random(3), 0
    for _ in range(30_000):
        text = "".join(rng.choice(SIGNS) for _ in range(rng.randint(0, 14)))
        assert redactions(text) == by_pattern(text)
        found += len(redactions(text))
    assert found > 10_000


@pytest.mark.parametrize("text", ["x" * 1_000_000, "abc123+/" * 125_000, "1." * 500_000 + "x", "a@" * 500_000, "1 . " * 250_000, "-+" * 500_000 + "@x"])
def test_redactions_of_long_words_take_linear_time(text):
    started = time.perf_counter()
    redactions(text)
    assert time.perf_counter() - started < 2


def test_edits_go_on_from_kept_trees(spark):
    """Counts of trees that were stored, edited, stored and edited again are those of the new texts."""
    rng = random.Random(8)
    texts = ["".join(rng.choice(SIGNS) for _ in range(rng.choice([0, 3, 400]))) for _ in range(60)]
    docs = spark.createDataFrame([(i, i // 2, t) for i, t in enumerate(texts)], "row long, doc_id long, text string")
    trees = stored(token_counts.token_trees(docs, BYTE_RANKS, ("row",)), "trees")
    for turn in range(2):
        edits, after = [], list(texts)
        for i in range(turn, len(texts), 3):
            points = sorted(rng.sample(range(len(texts[i]) + 1), min(len(texts[i]) + 1, 2 * rng.randint(1, 3)) // 2 * 2))
            mine = [(a, b, rng.choice(SIGNS)) for a, b in zip(points[::2], points[1::2])]
            for a, b, new in reversed(mine):
                after[i] = after[i][:a] + new + after[i][b:]
            edits.append((i, texts[i], mine))
        edited = spark.createDataFrame(edits, f"row long, text string, edits {token_counts.EDITS}")
        changed = stored(token_counts.apply_edits(trees, edited, "row", BYTE_RANKS), "changed")
        fresh = {r.row: r for r in token_counts.token_trees(spark.createDataFrame([(i, 0, t) for i, t in enumerate(after)], docs.schema), BYTE_RANKS, ("row",)).collect()}
        for r in changed.collect():
            assert r.text.decode() == after[r.row] and r.n_tokens == fresh[r.row].n_tokens
        texts = after
        kept = trees.select("row", "characters", "tokens").join(changed.select("row"), "row", "left_anti")
        trees = stored(kept.union(changed.select("row", "characters", "tokens")), "trees")


def test_an_edit_encodes_little(spark):
    docs = spark.createDataFrame([(1, "some words, and more " * 20_000)], "row long, text string").withColumn("doc_id", F.col("row"))
    trees = stored(token_counts.token_trees(docs, BYTE_RANKS, ("row",)), "trees")
    edited = docs.select("row", "text", F.expr("array(named_struct('start', 200000, 'stop', 200003, 'new', 'x'))").alias("edits"))
    found = token_counts.apply_edits(trees, edited, "row", BYTE_RANKS).first()
    assert 0 < found.n_encoded <= 3 * token_counts.LEAF and trees.first().n_pretokens > 80_000


def test_rows_are_counted_one_by_one(spark):
    rows = [(1, None), (None, ""), (None, "a@b.cc !!"), (1, "a@b.cc !!"), (1, "a@b.cc !!"), (2, "plain")]
    docs = spark.createDataFrame([(i, t, 0, "x") for i, t in rows], "doc_id long, text string, row_key int, tokens string")
    got = sorted((r.doc_id or 0, r.n_edits, r.n_tokens > 0) for r in token_counts.edited_counts(docs, BYTE_RANKS, redactions).collect())
    assert got == [(0, 0, False), (0, 2, True), (1, 0, False), (1, 2, True), (1, 2, True), (2, 0, True)]
    assert token_counts.edited_counts(docs.where(F.lit(False)), BYTE_RANKS, redactions).collect() == []
