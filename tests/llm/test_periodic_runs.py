"""Periodic runs against a slow version that tries every period at every place."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from sourceloom.llm import queries
from sourceloom.llm.periodic_runs import periodic_runs, word_runs

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, runs string, collapsed int, start long, words int, h string"


def frame(spark, rows):
    return spark.createDataFrame([(i, text, "x", 1, 2, 3, "h") for i, text in rows], SCHEMA)


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def brute_runs(words):
    """Every period is tried at every place."""
    numbers, out = np.unique(np.array(words, object).astype(str), return_inverse=True)[1] if words else np.zeros(0), []
    for q in range(1, len(words) // 4 + 1):
        edges = np.flatnonzero(np.diff(np.concatenate([[0], numbers[q:] == numbers[:-q], [0]])))
        for start, end in zip(edges[::2].tolist(), (edges[1::2] + q).tolist()):
            if end - start >= max(6, 4 * q) and not any(words[start + p:end] == words[start:end - p] for p in range(1, q)):
                out.append((start, end - start, q))
    return sorted(out, key=lambda run: (run[0], run[2]))


def brute_collapsed(words, runs):
    gone = {i for start, length, period in runs for i in range(start + period, start + length)}
    return " ".join(word for i, word in enumerate(words) if i not in gone)


def made(rng):
    vocabulary = [f"w{i}" for i in range(rng.choice([1, 2, 3, 6, 50]))]
    words = [rng.choice(vocabulary) for _ in range(rng.randint(0, 160))]
    for _ in range(rng.randint(0, 3)):
        unit = [rng.choice(vocabulary) for _ in range(rng.randint(1, 40))]
        at = rng.randint(0, len(words))
        words[at:at] = (unit * 8)[:rng.randint(len(unit), 7 * len(unit))]
    return words


def test_runs_against_brute_force():
    rng, codes, seen = random.Random(1), np.random.default_rng(0).integers(0, 2**63, 64, dtype=np.uint64), 0
    for _ in range(150):
        texts = [[int(w[1:]) for w in made(rng)] for _ in range(rng.randint(1, 8))]
        first = np.cumsum([0] + [len(t) for t in texts])
        got = list(zip(*(part.tolist() for part in word_runs(codes[np.array(sum(texts, []), int)], first))))
        want = [(int(f) + start, length, period) for t, f in zip(texts, first) for start, length, period in brute_runs(t)]
        assert got == want
        seen += len(want)
    assert seen > 300


@pytest.mark.parametrize("unit, times", [(1, 200_000), (2, 70_000), (997, 150), (30_000, 5)])
def test_long_texts(unit, times):
    codes = np.random.default_rng(unit).integers(0, 2**63, unit, dtype=np.uint64)
    text = np.concatenate([codes[:1] + np.uint64(1), np.tile(codes, times), codes[:unit // 2], codes[:1] + np.uint64(3)])
    assert [part.tolist() for part in word_runs(text, np.array([0, len(text)]))] == [[1], [unit * times + unit // 2], [unit]]


def test_rows(spark):
    rng = random.Random(2)
    long = " ".join(f"v{i % 999}" for i in range(20_000))
    rows = [(1, None), (2, ""), (3, " \t\r\n\x0b\x0c "), (4, "a  a\ta a a"), (5, "a  a\ta a  a a a a a"), (6, "x" * 300_000), (7, long), (7, long), (None, "é é é é é é"), (None, None),
            (8, "b a a a a a a\na"), (9, "a b c a b c a b c a b c")]
    rows += [(100 + i, rng.choice(" \n\t") + rng.choice([" ", "  ", "\n"]).join(made(rng)) + rng.choice(["", " "])) for i in range(200)]
    got = Counter((r.doc_id, tuple(tuple(run) for run in r.runs), r.collapsed.decode()) for r in periodic_runs(frame(spark, rows)).collect())
    want = Counter()
    for i, text in rows:
        words = words_of(text)
        runs = [(0, 20_000, 999)] if text == long else brute_runs(words)
        want[i, tuple(runs), brute_collapsed(words, runs)] += 1
    assert got == want
    assert periodic_runs(frame(spark, [])).collect() == []


def test_query_against_brute_force(spark):
    got = {r.doc_id: tuple(r) for r in queries.QUERIES["op12_periodic_runs"](spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    for doc_id, text in docs:
        words, h = words_of(text), zlib.crc32(str(doc_id).encode())
        n, g = len(words), h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [word if i < a else words[a + (i - a) % p] for i, word in enumerate(words)]
        runs = brute_runs(words)
        best = min(runs, key=lambda run: (-run[1], run[0], run[2]), default=None)
        shown = (None,) * 4 if best is None else (*best, 1000 * best[1] // best[2])
        lines = "".join(f"{start},{length},{period}\n" for start, length, period in runs)
        assert got[doc_id] == (doc_id, len(runs), *shown, *(hashlib.sha256(t.encode()).hexdigest() for t in (lines, brute_collapsed(words, runs))))
    assert len(got) == len(docs)
