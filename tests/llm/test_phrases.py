"""Phrase collocations against a slow version that counts every phrase."""

from __future__ import annotations

import random
import re
from collections import Counter

import pytest

from sourceloom.llm import jaccard, phrases
from sourceloom.llm.phrases import collocations

SCHEMA = "doc_id long, text string, lang string, words int, n string, f long, word string"


def frame(spark, rows):
    return spark.createDataFrame([(i, text, lang, 1, "n", 2, "w") for i, (text, lang) in enumerate(rows)], SCHEMA)


def brute(rows, longest, least, reported):
    count, total = {}, Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        lower = (text or "").translate({c: c + 32 for c in range(65, 91)})
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower):
            words = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(words)
            for m in range(1, longest + 1):
                for i in range(len(words) - m + 1):
                    count[lang, tuple(words[i:i + m])] = count.get((lang, tuple(words[i:i + m])), 0) + 1
    candidates = {g: a for g, a in count.items() if len(g[1]) > 1 and a >= least}
    inside = set()
    for (lang, words), a in candidates.items():
        for m in range(2, len(words)):
            for i in range(len(words) - m + 1):
                if 100 * a >= 100 * count[lang, words[i:i + m]]:
                    inside.add((lang, words[i:i + m]))
    out = {}
    for (lang, words), a in candidates.items():
        if (lang, words) not in inside:
            cuts = [(1000 * a * total[lang] // (count[lang, words[:k]] * count[lang, words[k:]]), k, count[lang, words[:k]], count[lang, words[k:]]) for k in range(1, len(words))]
            score, _, left, right = min(cuts)
            out.setdefault(lang, []).append((-score, -a, " ".join(words).encode(), left, right))
    return {(lang, rank + 1, phrase.decode(), -a, left, right, total[lang], -score)
            for lang, found in out.items() for rank, (score, a, phrase, left, right) in enumerate(sorted(found)[:reported])}


def made(rng, n):
    vocabulary = ["The", "cat", "sat", "on", "a", "Mat", "é", " x", "É", "中", "a-b", "'t", "\U0001f600"]
    fixed = [["new", "york"], ["of", "the", "united", "states", "of", "america"], ["a", "a", "a", "a"], ["on", "the"]]
    rows = []
    for _ in range(n):
        words = []
        for _ in range(rng.randint(0, 30)):
            words += rng.choice(fixed) if rng.random() < 0.3 else [rng.choice(vocabulary)]
        text = "".join(w + rng.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\r\n", " ?! "]) for w in words)
        rows.append((text, rng.choice(["en", "de", None, "und", "languages-1", "languages-2"])))
    return rows


@pytest.mark.parametrize("longest, least, reported, bits", [(5, 10, 2000, 1 << 25), (5, 10, 7, 1 << 10), (3, 4, 2000, 1 << 10), (7, 6, 50, 1 << 25)])
def test_against_brute_force(spark, monkeypatch, longest, least, reported, bits):
    monkeypatch.setattr(jaccard, "FILTER_BITS", bits)  # at the smallest size the filter lets pairs pass that are not frequent
    monkeypatch.setattr(phrases, "GROUP", 5000)
    rows = made(random.Random(least), 400)
    rows += [(None, None), ("", "en"), (" \t\n", "en"), (".", ""), ("x" * 100_000 + " y", "en"), ("one two " * 20_000, "long"), ("r s t u v w", "same")] + [("r s t u v w", "same")] * 40
    got = {tuple(r) for r in collocations(frame(spark, rows), longest, least, reported).collect()}
    want = brute(rows, longest, least, reported)
    assert got == want and len(want) > 30


def test_large_products_are_exact(spark):
    """Counts of a few millions give products beyond 64 bits."""
    text = "a b a b c " * 400_000
    got = {tuple(r) for r in collocations(frame(spark, [(text, "en")] * 4), 2, 100, 10).collect()}
    n, ab, ba, bc, ca = 8_000_000, 3_200_000, 1_600_000, 1_600_000, 1_599_996
    f = {"a": 3_200_000, "b": 3_200_000, "c": 1_600_000}
    want = sorted(((-(1000 * k * n // (f[p[0]] * f[p[2]])), -k, p) for p, k in (("a b", ab), ("b a", ba), ("b c", bc), ("c a", ca))))
    assert got == {("en", i + 1, p, -a, f[p[0]], f[p[2]], n, -score) for i, (score, a, p) in enumerate(want)}


def test_nothing_to_report(spark):
    assert collocations(frame(spark, [])).collect() == []
    assert collocations(frame(spark, [(None, None), ("", "en"), ("one two three", "en")])).collect() == []
