"""The training-data operators against brute force, round trips, held-out rows and SQL on small tables."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sourceloom.llm import byte_bpe, exact_dedup, jaccard, mixing, quality, queries, redactions, token_counts, token_files, topk, toxicity, url_templates
from sourceloom.llm.textarrays import binary_buffers

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, node long, times int"
LABELS = "doc_id long, quality int, toxic int, label int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, *[None] * (8 - len(r))) for r in rows], SCHEMA)


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty and very long texts, equal texts, a repeated row and ids, and clashing column names."""
    long = " ".join(f"word{i % 997}" for i in range(30_000))
    rows = [(1, None, None, None, None), (2, "", "en", "a", 0), (3, " \t\n", "en", "a", 3), (4, "one two", "en", "b", 7), (5, "One  two", "en", "b", 8),
            (6, long, "en", "a", len(long)), (7, long + " end", "en", "a", 0), (7, long + " end", "en", "a", 0), (8, "é ñ 中 \u2028 '!", None, "é", 1),
            (None, "one two", None, None, None), (None, None, None, None, None), (9, "x" * 50_000, "en", "b", 1)]
    return frame(spark, rows), rows


def brute_groups(rows, words, percent):
    sets = []
    for r in rows:
        found = [w.translate({c: c + 32 for c in range(65, 91)}) for w in re.findall(r"[^\x20\x09-\x0D]+", r[1] or "")]
        sets.append(frozenset(tuple(found[k:k + words]) for k in range(len(found) - words + 1)) if len(found) >= words else frozenset([tuple(found)] if found else []))
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                parent[find(i)] = find(j)
    best = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            best[find(i)] = min(best.get(find(i), r[0]), r[0])
    return Counter((r[0], len(s), best.get(find(i))) for i, (r, s) in enumerate(zip(rows, sets)))


@pytest.mark.parametrize("words, percent, sets", [(3, 90, 1024), (5, 80, 1024), (3, 60, 6)])
def test_jaccard_groups(spark, odd, monkeypatch, words, percent, sets):
    monkeypatch.setattr(jaccard, "LEAF_SETS", sets)
    rng = random.Random(words)
    rows = list(odd[1])
    for family in range(12):
        base = [f"w{rng.randrange(5000)}" for _ in range(rng.choice([3, 20, 60, 200]))]
        for copy in range(rng.choice([1, 4, 12])):
            text = [w if rng.random() > 0.02 * (copy % 4) else f"e{rng.randrange(9999)}" for w in base]
            rows.append((1000 + 100 * family + copy, " ".join(text)))
    got = Counter(map(tuple, jaccard.jaccard_groups(frame(spark, rows), words, percent).collect()))
    assert got == brute_groups(rows, words, percent)


def test_exact_duplicates(spark, odd):
    got = exact_dedup.exact_duplicates(odd[0]).collect()
    plain = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t or "")
    groups = {}
    for r in odd[1]:
        groups.setdefault(plain(r[1]), []).append(r)
    want = Counter()
    for text, rows in groups.items():
        keep = min(rows, key=lambda r: (-len(r[1] or ""), r[0] is None, r[0] or 0))[0]
        for r in rows:
            want[(r[0], keep, len(rows), hashlib.sha256(text.encode()).hexdigest())] += 1
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == want
    assert sum(r.kept for r in got) == len(groups) and all(r.doc_id == r.keep_id for r in got if r.kept)


def test_long_texts_that_differ_in_one_block(spark):
    base = "".join(chr(97 + i % 26) for i in range(9 * exact_dedup.BLOCK))
    rows = [(i, base[:k] + "#" + base[k + 1:]) for i, k in enumerate([300, 2000, 2000, 9000, 9001])]
    got = {r.doc_id: r.keep_id for r in exact_dedup.exact_duplicates(frame(spark, rows)).collect()}
    assert got == {0: 0, 1: 1, 2: 1, 3: 3, 4: 4}


def test_toxicity(spark, odd):
    docs, labels = spark.read.parquet(f"{SF}/../sf0.1/documents.parquet"), spark.read.parquet(f"{SF}/../sf0.1/labels.parquet")
    kept = quality.held_out()
    found = toxicity.toxicity(docs, labels.where(~kept)).join(labels.where(kept), "doc_id").groupBy("toxic", "rejected").count().collect()
    n = {(r.toxic, r.rejected): r["count"] for r in found}
    assert n[1, True] / (n[1, True] + n[1, False]) > 0.8 and n.get((0, True), 0) / n[0, False] < 0.02
    none = toxicity.toxicity(odd[0], spark.createDataFrame([(1, None, None, 0)], LABELS)).collect()
    assert len(none) == len(odd[1]) and not any(r.rejected for r in none)


def test_quality(spark, odd):
    docs, labels = spark.read.parquet(f"{SF}/../sf0.1/documents.parquet"), spark.read.parquet(f"{SF}/../sf0.1/labels.parquet")
    found = quality.quality_scores(docs, labels).where("held_out").join(labels, "doc_id").selectExpr("avg(cast(predicted = quality as int)) a").first().a
    assert found > 0.97
    rows = quality.quality_scores(odd[0], spark.createDataFrame([(2, 1, 0, 0), (6, 0, 0, 1), (None, 1, 0, 0)], LABELS)).collect()
    assert len(rows) == len(odd[1]) and all(0 <= r.score <= 1 for r in rows)
    assert {(r.doc_id, r.held_out) for r in rows} == {(r[0], r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 1) for r in odd[1]}


def test_trees_need_both_labels():
    assert quality.grow(np.zeros((0, 3)), np.zeros(0)).score(np.zeros((2, 3))).tolist() == [0.5, 0.5]


def test_url_verdicts(spark):
    rows = [(1, None), (2, "no scheme"), (3, "http://A.Example.NET/en/1?x"), (4, "http://a.net/x"), (5, "http://a.net"), (6, "s://b.example.com/de/9#t"),
            (7, "http://b.example.com/fr/9"), (8, "http://x.org/fr/"), (9, "http://net/q"), (9, "http://net/q"), (None, "x://h/" + "a/" * 5000)]
    got = Counter((r.page_id, r.host, r.rule, r.verdict) for r in url_templates.url_verdicts(spark.createDataFrame(rows, "page_id long, url string"), queries.URL_RULES).collect())
    assert got == Counter([(1, "", None, "allow"), (2, "", None, "allow"), (3, "a.example.net", "example.net/en/", "allow"), (4, "a.net", "net/", "block"), (5, "a.net", None, "allow"),
                           (6, "b.example.com", "example.com/de/", "block"), (7, "b.example.com", None, "allow"), (8, "x.org", "org/fr/", "allow"),
                           (9, "net", "net/", "block"), (9, "net", "net/", "block"), (None, "h", None, "allow")])


def test_templates_are_rejected_by_their_labels(spark):
    rows = [(i, f"http://h.example/bad/x{i}/") for i in range(40)] + [(100 + i, f"http://h.example/good/{i}/") for i in range(40)]
    rules = [(f"h.example/bad/x{i}/", "block") for i in range(12)] + [(f"h.example/good/{i}/", "allow") for i in range(12)]
    got = {r.page_id: r.verdict for r in url_templates.url_verdicts(spark.createDataFrame(rows, "page_id long, url string"), rules).collect()}
    assert {got[i] for i in range(100, 140)} == {"allow"} and {got[i] for i in range(12)} == {"block"}


def encoding():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.ranks(queries.BYTE_RANKS), special_tokens={})


SIGNS = ["'", "s", "t", "re", "ve", "ll", " ", "  ", "\n", "A", "é", "中", "1", "²", "!", "\u00a0", "\u3000", "\u0301", "J\u030c", "\x85", "<|endoftext|>", "\U0001f600"]


def made(n, seed):
    rng = random.Random(seed)
    return ["".join(rng.choice(SIGNS) for _ in range(rng.randint(0, 30))) for _ in range(n)]


def test_byte_bpe_equals_the_library(spark, odd):
    enc, texts = encoding(), [*made(5000, 1), "".join(map(chr, [*range(0xD800), *range(0xE000, 0x20000)])), "ab" * 30_000]
    ids, before = byte_bpe.encoded(*binary_buffers(pa.array([t.encode() for t in texts], pa.binary())), queries.BYTE_RANKS)
    assert all(ids[a:b].tolist() == enc.encode_ordinary(t) for t, a, b in zip(texts, before, before[1:]))
    out = byte_bpe.decode(byte_bpe.encode(odd[0], queries.BYTE_RANKS), queries.BYTE_RANKS).collect()
    assert Counter((r.doc_id, r.decoded.decode()) for r in out) == Counter((r[0], r[1] or "") for r in odd[1])
    digests = byte_bpe.token_digests(odd[0], queries.BYTE_RANKS).collect()
    want = Counter()
    for r in odd[1]:
        found = np.array(enc.encode_ordinary(r[1] or ""), "<u4")
        want[r[0], len(found), hashlib.sha256(found.tobytes()).hexdigest(), hashlib.sha256((r[1] or "").encode()).hexdigest()] += 1
    assert Counter(map(tuple, digests)) == want


def test_edited_counts(spark, odd, monkeypatch):
    monkeypatch.setattr(token_counts, "LEAF", 2)
    enc, cache, rng = encoding(), byte_bpe.pieces(queries.BYTE_RANKS), random.Random(5)
    for text in made(1500, 2):
        begins = token_counts._cut(text, len(text))[0] if text else np.zeros(0, np.int64)
        tree = token_counts.TokenTree(text, begins, token_counts.piece_tokens(text, begins, cache) if text else begins, cache)
        for new in made(3, rng.random()):
            a = rng.randint(0, len(text))
            b = rng.randint(a, min(len(text), a + 6))
            tree.edit(a, b, new[:5])
            text = text[:a] + new[:5] + text[b:]
            assert tree.text() == text and tree.total() == len(enc.encode_ordinary(text))
    rows = [*odd[1], (20, "mail me.1@ex.com now!!!! " * 50), (21, "5555 5555 5555 5555")]
    for r in token_counts.edited_counts(frame(spark, rows), queries.BYTE_RANKS, redactions.redactions).where("doc_id >= 20").collect():
        text = dict((x[0], x[1]) for x in rows)[r.doc_id]
        for a, b, new in reversed(redactions.redactions(text)):
            text = text[:a] + new + text[b:]
        assert r.n_edits and r.n_tokens_edited == len(enc.encode_ordinary(text))


def test_mix(spark, odd):
    out = mixing.mixed(odd[0]).collect()
    assert len(out) == len(odd[1])
    total = sum(len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or "")) for r in odd[1])
    targets = {r.source: (r.source_size, r.target) for r in out}
    assert abs(sum(t for _, t in targets.values()) - 1.5 * total) < 1e-6 and all(t <= 2 * s for s, t in targets.values())
    assert all(0 <= r.times <= 2 for r in out)


@pytest.mark.parametrize("name", list(queries.ORACLE_SQL))
def test_queries_match_their_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "pages", "embeddings"):
        con.execute(f"create view {table} as select * from read_parquet('{SF}/{table}.parquet')")
    frame_ = queries.QUERIES[name](spark, SF)
    columns = sorted(frame_.columns)
    key = lambda row: tuple(round(v, 6) if isinstance(v, float) else v for v in row)
    got = Counter(key(r) for r in frame_.select(*columns).collect())
    assert got == Counter(key(r) for r in con.execute(f"select {', '.join(columns)} from ({queries.ORACLE_SQL[name]})").fetchall())


def test_top_k_odd_vectors(spark):
    nan = float("nan")
    rows = [(0, [1.0, 0.5]), (0, [1.0, 0.5]), (20, [0.5, 0.5]), (1, None), (2, [1.0, None]), (3, [nan, 1.0]), (4, []), (5, [1.0]), (None, [1.0, 1.0]), *[(100 + i, [1.0, 1.0]) for i in range(1, 5)]]
    got = [tuple(r) for r in topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), k=3).where("query_id = 20").orderBy("rank").collect()]
    assert got == [(20, 1, 100 + 1, 4096), (20, 2, 102, 4096), (20, 3, 103, 4096)]


def test_top_k_with_one_id_repeated_often(spark):
    often = spark.range(1, 20).where("pmod(xxhash64(id, 7), 2) = 1").first().id  # by the id alone, all copies go to the second block
    rows = [(often, [100.0, 100.0])] * 2500 + [(20, [-50.0, 3.0]), (40, [-40.0, 0.0])]
    got = [tuple(r) for r in topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), k=3).orderBy("query_id", "rank").collect()]
    assert got == [(20, 1, 40, 64 * 64 * 2000), *[(20, k, often, 64 * 64 * -4700) for k in (2, 3)], (40, 1, 20, 64 * 64 * 2000), *[(40, k, often, 64 * 64 * -4000) for k in (2, 3)]]


def test_top_k_blocks_stay_small(spark, monkeypatch):
    stored, sizes = topk.stored, []

    def watched(df, name):
        out = stored(df, name)
        if name == "blocks":
            sizes.extend(r.n for r in out.selectExpr("octet_length(ids) / 8 as n").collect())
        return out

    monkeypatch.setattr(topk, "stored", watched)
    topk.top_k(spark.createDataFrame([(7, [1.0, 2.0])] * 9000 + [(20, [1.0, 1.0])], "vec_id long, embedding array<float>"), k=3).count()
    assert sum(sizes) == 9001 and max(sizes) < 1.5 * topk.BLOCK


def test_packed_numbers():
    numbers = np.array([0, 255, 256, 65535, 65536, 2**24 - 1, 2**24, 2**32 - 1, 7], np.uint32)
    assert token_files.unpack(*token_files.pack(numbers), len(numbers)).tolist() == numbers.tolist()


def test_token_files(spark, odd):
    tokenizer = Tokenizer.from_file(queries.WORD_TOKENIZER)
    tokenizer.encode_special_tokens = True
    texts = made(5000, 3)
    ids, before = token_files.word_ids(*binary_buffers(pa.array([t.encode() for t in texts], pa.binary())), queries.WORD_TOKENIZER)
    assert all(ids[a:b].tolist() == tokenizer.encode(t, add_special_tokens=False).ids for t, a, b in zip(texts, before, before[1:]))
    got = token_files.token_directory(*token_files.write_tokens(odd[0], queries.WORD_TOKENIZER, 2)).orderBy("start").collect()
    assert [r.doc_id for r in got] == sorted((r[0] for r in odd[1]), key=lambda i: (i is not None, i or 0))
    at = 0
    of = {r[0]: np.array([*tokenizer.encode(r[1] or "", add_special_tokens=False).ids, 2], "<u4") for r in odd[1]}
    for r in got:
        assert r.start == at
        at += r.n_tokens
        if r.doc_id is not None:
            assert (r.n_tokens, r.ids_crc32) == (len(of[r.doc_id]), zlib.crc32(of[r.doc_id].tobytes()))


def test_token_files_match_special_tokens_as_the_library_does(spark):
    tokenizer, start, end, rng = Tokenizer.from_file(queries.WORD_TOKENIZER), "<|startoftext|>", "<|endoftext|>", random.Random(9)
    assert tokenizer.encode(f"end {end} of", add_special_tokens=False).ids == [806, 49407, 539]
    signs = [*SIGNS, end, start, end.upper(), "<", "|>", "endoftext", "<|endof", "text|>", "'", "\u0301"]
    texts = [f"end {end} of", "", end, end + start, f"it'{end}s", "a<|endof", "text|>b", f"!{end}!", end.upper(), f"J{end}\u030c",
             *["".join(rng.choice(signs) for _ in range(rng.randint(0, 20))) for _ in range(5000)]]
    want = [np.array([*tokenizer.encode(t, add_special_tokens=False).ids, 2], "<u4") for t in texts]
    got = token_files.token_directory(*token_files.write_tokens(frame(spark, list(enumerate(texts))), queries.WORD_TOKENIZER, 2)).collect()
    assert len(got) == len(texts)
    assert all((r.n_tokens, r.ids_crc32) == (len(want[r.doc_id]), zlib.crc32(want[r.doc_id].tobytes())) for r in got)


def test_empty_tables(spark):
    none = frame(spark, [])
    labels = spark.createDataFrame([], LABELS)
    for out in (jaccard.jaccard_groups(none), exact_dedup.exact_duplicates(none), toxicity.toxicity(none, labels), quality.quality_scores(none, labels),
                byte_bpe.token_digests(none, queries.BYTE_RANKS), token_counts.edited_counts(none, queries.BYTE_RANKS, redactions.redactions), mixing.mixed(none),
                token_files.token_directory(*token_files.write_tokens(none, queries.WORD_TOKENIZER, 2)),
                url_templates.url_verdicts(spark.createDataFrame([], "page_id long, url string"), queries.URL_RULES),
                topk.top_k(spark.createDataFrame([], "vec_id long, embedding array<float>"))):
        assert out.count() == 0
