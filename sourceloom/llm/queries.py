"""The operators over the driver's tables, with production parameters, and the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sourceloom.llm.byte_bpe import token_digests
from sourceloom.llm.exact_dedup import exact_duplicates
from sourceloom.llm.jaccard import jaccard_groups
from sourceloom.llm.lattice_dedup import near_vectors
from sourceloom.llm.mixing import SYMBOLS, mixed
from sourceloom.llm.periodic_runs import periodic_runs
from sourceloom.llm.phrases import collocations
from sourceloom.llm.quality import quality_scores
from sourceloom.llm.redactions import redactions
from sourceloom.llm.token_counts import edited_counts
from sourceloom.llm.token_files import token_directory, write_tokens
from sourceloom.llm.topk import top_k
from sourceloom.llm.toxicity import toxicity
from sourceloom.llm.url_templates import APART, BRANCHES, ID_SEGMENT, LEVELS, PRIOR, REJECT, url_verdicts

#: Ranks of the byte-level BPE queries.
BYTE_RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
#: Tokenizer and end id of the token files.
WORD_TOKENIZER, END_ID = public_tokenizers.path("word_bpe_49k.json"), 2
#: The rules of the URL query.
URL_RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_ngram_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard_groups(_table(spark, folder, "documents"), words=3, percent=90)


def op2_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact_duplicates(_table(spark, folder, "documents"))


def op3_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity(_table(spark, folder, "documents"), _table(spark, folder, "labels"))


def op4_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    return url_verdicts(_table(spark, folder, "pages"), URL_RULES)


def op5_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    return quality_scores(_table(spark, folder, "documents"), _table(spark, folder, "labels"))


def op6_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    return token_digests(_table(spark, folder, "documents"), BYTE_RANKS)


def op7_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return edited_counts(_table(spark, folder, "documents"), BYTE_RANKS, redactions)


def op8_source_mix(spark: SparkSession, folder: str) -> DataFrame:
    out = mixed(_table(spark, folder, "documents"))
    return out.select("doc_id", "size", "source_size", "target", (F.col("times") * F.col("size")).alias("taken"))


def op9_exact_top_k(spark: SparkSession, folder: str) -> DataFrame:
    return top_k(_table(spark, folder, "embeddings"), k=20, scale=64, query_step=20)


def op10_token_files(spark: SparkSession, folder: str) -> DataFrame:
    return token_directory(*write_tokens(_table(spark, folder, "documents"), WORD_TOKENIZER, END_ID))


def op11_embedding_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return near_vectors(_table(spark, folder, "embeddings"), cosine=0.93)


def with_periods(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text) with a periodic end planted in the texts of one id in ten, at a place and with a period that the id's
    crc32 gives; null ids and texts without words stay as they are."""
    h = F.crc32(F.col("doc_id").cast("string"))
    words = docs.select("doc_id", "text", h.alias("h")).withColumn("words", F.when(h % 10 == 0, F.expr(r"regexp_extract_all(text, r'[^\x20\x09-\x0D]+', 0)")))
    planted = words.withColumn("g", F.floor(F.col("h") / 10)).withColumn("n", F.size("words")).withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")))
    planted = planted.withColumn("p", F.expr("1 + (n - a) div (3 + g % 8)"))
    text = F.expr("array_join(transform(sequence(0L, n - 1L), i -> get(words, cast(if(i < a, i, a + (i - a) % p) as int))), ' ')")
    return planted.select("doc_id", F.when(F.col("n") > 0, text).otherwise(F.col("text")).alias("text"))


def op12_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    found = periodic_runs(with_periods(_table(spark, folder, "documents")))
    best = "array_max(transform(runs, r -> struct(r.length as length, -r.start as start, -r.period as period)))"
    return found.withColumn("best", F.expr(best)).selectExpr(
        "doc_id", "cast(size(runs) as bigint) as n_runs", "-best.start as start", "best.length as length", "-best.period as period",
        "1000 * best.length div -best.period as exponent_milli",
        r"sha2(array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\n')), ''), 256) as runs_sha256", "sha2(collapsed, 256) as collapsed_sha256")


def op13_phrase_collocations(spark: SparkSession, folder: str) -> DataFrame:
    return collocations(_table(spark, folder, "documents"), longest=5, least=100, reported=2000)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_ngram_jaccard_join, op2_exact_dedup, op3_toxicity, op4_url_filter, op5_quality_classifier, op6_byte_bpe, op7_token_counts, op8_source_mix, op9_exact_top_k, op10_token_files,
                              op11_embedding_near_dedup, op12_periodic_runs, op13_phrase_collocations)}

_OP2_SQL = r"""
WITH t AS (SELECT doc_id, length(coalesce(text, '')) AS size, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS plain,
                  row_number() OVER () AS r FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY plain) AS group_size,
       r = first_value(r) OVER w AS kept, sha256(plain) AS text_sha256
FROM t WINDOW w AS (PARTITION BY plain ORDER BY size DESC, doc_id NULLS LAST, r)
"""

_FITS = "(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '/{p}')"
_LEVEL_SQL = f"""
c{{k}} AS (SELECT *, parts[{{k}}] AS segment FROM t{{j}}),
b{{k}} AS (SELECT host, template, segment, sum(pages) AS n, sum(labelled) AS l, sum(blocked) AS b FROM c{{k}} WHERE segment IS NOT NULL GROUP BY ALL),
p{{k}} AS (SELECT *, count(*) OVER w AS branches, sum(n) OVER w AS pn, sum(l) OVER w AS pl, sum(b) OVER w AS pb, (b + {PRIOR}) / (l + {2 * PRIOR}) AS rate,
        (pb + {PRIOR}) / (pl + {2 * PRIOR}) AS all_rate FROM b{{k}} WINDOW w AS (PARTITION BY host, template)),
t{{k}} AS (SELECT c.* EXCLUDE (template, segment), CASE WHEN c.segment IS NULL THEN c.template
        WHEN p.branches > {BRANCHES} AND p.n * {BRANCHES} < p.pn AND p.l = 0
          OR p.l > 0 AND p.pl > p.l AND abs(p.rate - p.all_rate) < {APART} * sqrt(p.all_rate * (1 - p.all_rate) / p.l)
        THEN c.template || '/*' ELSE c.template || '/' || c.segment END AS template
     FROM c{{k}} c LEFT JOIN p{{k}} p ON p.host = c.host AND p.template = c.template AND p.segment = c.segment)"""
_OP4_SQL = rf"""
WITH u AS (SELECT page_id, regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', ['h', 'p']) AS e FROM pages),
r AS (SELECT page_id, translate(e.h, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, e.p AS path FROM u),
d AS (SELECT *, CASE WHEN {_FITS.format(h='example.net', p='en/')} THEN 'example.net/en/' WHEN {_FITS.format(h='example.com', p='de/')} THEN 'example.com/de/'
        WHEN {_FITS.format(h='org', p='fr/')} THEN 'org/fr/' WHEN {_FITS.format(h='net', p='')} THEN 'net/' END AS rule,
        CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow' END AS ruled,
        list_transform(list_filter(string_split(path, '/'), lambda s: s <> ''), lambda s: CASE WHEN regexp_matches(s, '{ID_SEGMENT}') THEN '*' ELSE s END) AS full_parts,
        CASE WHEN len(full_parts) > {LEVELS} THEN list_append(full_parts[1:{LEVELS}], array_to_string(full_parts[{LEVELS + 1}:], '/')) ELSE full_parts END AS parts,
        array_to_string(parts, '/') AS shape FROM r),
t0 AS (SELECT host, shape, parts, count(*) AS pages, count(ruled) AS labelled, count(*) FILTER (WHERE ruled = 'block') AS blocked, '' AS template FROM d GROUP BY ALL),
{','.join(_LEVEL_SQL.format(k=k, j=k - 1) for k in range(1, LEVELS + 2))},
m AS (SELECT host, shape, template, (sum(blocked) OVER w + {PRIOR}) / (sum(labelled) OVER w + {2 * PRIOR}) AS rate FROM t{LEVELS + 1}
      WINDOW w AS (PARTITION BY host, template))
SELECT page_id, d.host, path, rule, coalesce(ruled, CASE WHEN rate >= {REJECT} THEN 'block' ELSE 'allow' END) AS verdict, m.template
FROM d JOIN m ON m.host = d.host AND m.shape = d.shape
"""

_OP8_SQL = rf"""
WITH x AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size, coalesce(text, '') AS body FROM documents),
k AS (SELECT doc_id, source, size, -ln((('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null')), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0)
        / greatest(0.1, 1 - 4 * ((length(body) - length(translate(body, '{SYMBOLS}', ''))) / greatest(length(body), 1))) AS key FROM x),
s AS (SELECT source, sum(size)::BIGINT AS source_size, (ARRAY[3.0, 1.0, 2.0])[((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS w FROM k GROUP BY source),
l AS (SELECT a.source, ((SELECT 1.5 * sum(source_size) FROM s) - coalesce(sum(2.0 * b.source_size) FILTER (WHERE b.source_size / b.w < a.source_size / a.w), 0))
        / coalesce(sum(b.w) FILTER (WHERE b.source_size / b.w >= a.source_size / a.w), 0) AS level, 2.0 * a.source_size / a.w AS fill FROM s a, s b GROUP BY a.source, a.source_size, a.w),
g AS (SELECT max(level) FILTER (WHERE level <= fill) AS reach FROM l),
t AS (SELECT source, source_size, coalesce(least(2.0 * source_size, w * reach), 2.0 * source_size) AS target FROM s, g),
e AS (SELECT *, CASE WHEN source_size = 0 THEN 0 ELSE floor(target / source_size) END::BIGINT AS epochs, target - epochs * source_size AS rest FROM t),
u AS (SELECT source, key, doc_id, sum(size) AS unit FROM k GROUP BY ALL),
c AS (SELECT *, sum(unit) OVER (PARTITION BY source ORDER BY key, doc_id NULLS LAST) - unit / 2 AS middle FROM u)
SELECT k.doc_id, k.size::BIGINT AS size, e.source_size, e.target, (k.size * (e.epochs + (e.rest > 0 AND c.middle <= e.rest)::BIGINT))::BIGINT AS taken
FROM k JOIN c ON c.source IS NOT DISTINCT FROM k.source AND c.key = k.key AND c.doc_id IS NOT DISTINCT FROM k.doc_id
JOIN e ON e.source IS NOT DISTINCT FROM k.source
"""

_OP9_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS x FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.x, c.x)::BIGINT AS score FROM v q, v c WHERE q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""

_OP11_SQL = """
WITH RECURSIVE e AS (SELECT vec_id, label, embedding AS x, row_number() OVER () AS r FROM embeddings),
v AS (SELECT r, vec_id, label, list_transform(x, lambda c: c::DOUBLE) AS x FROM e WHERE label IS NOT NULL AND len(x) > 0
      AND len(list_filter(x, lambda c: c IS NULL OR NOT isfinite(c))) = 0 AND len(list_filter(x, lambda c: c <> 0)) > 0),
l AS MATERIALIZED (SELECT a.r AS a, b.r AS b FROM v a, v b WHERE a.label = b.label AND a.r <> b.r AND list_cosine_similarity(a.x, b.x) >= 0.93),
n AS (SELECT a AS r, count(*) AS links FROM l GROUP BY a),
c AS (SELECT r, r AS other FROM e UNION SELECT c.r, l.b FROM c JOIN l ON l.a = c.other),
m AS (SELECT c.r, min(e.vec_id) AS component_id FROM c JOIN e ON e.r = c.other GROUP BY c.r)
SELECT vec_id, coalesce(links, 0)::BIGINT AS n_links, component_id, vec_id IS NOT DISTINCT FROM component_id AS kept
FROM e JOIN m USING (r) LEFT JOIN n USING (r)
"""

_OP13_SQL = r"""
WITH t AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                  '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM t),
b AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM w),
g AS (SELECT lang, w[i:i + m - 1] AS w, count(*) AS f FROM b, range(1, 6) AS s(m) WHERE i + m - 1 <= len(w) GROUP BY ALL),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM g WHERE len(w) = 1 GROUP BY lang),
c AS (SELECT lang, w, f AS a FROM g WHERE len(w) > 1 AND f >= 100),
d AS (SELECT DISTINCT lang, w[i:j] AS w, a FROM c, range(1, 6) AS s(i), range(1, 6) AS e(j) WHERE i <= j AND j <= len(w) AND j - i + 1 < len(w)),
x AS (SELECT c.*, k FROM c, range(1, 5) AS s(k) WHERE k < len(w) AND NOT EXISTS (SELECT 1 FROM d WHERE d.lang = c.lang AND d.w = c.w AND 100 * d.a >= 100 * c.a)),
s AS (SELECT x.lang, x.w, a, k, l.f AS l, r.f AS r, n, (1000::HUGEINT * a * n // (l.f::HUGEINT * r.f))::BIGINT AS score
      FROM x JOIN n ON n.lang = x.lang JOIN g l ON l.lang = x.lang AND l.w = x.w[1:k] JOIN g r ON r.lang = x.lang AND r.w = x.w[k + 1:len(x.w)]),
m AS (SELECT *, array_to_string(w, ' ') AS phrase FROM s QUALIFY row_number() OVER (PARTITION BY lang, w ORDER BY score, k) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM m QUALIFY rank <= 2000
"""

ORACLE_SQL: dict[str, str] = {"op2_exact_dedup": _OP2_SQL, "op4_url_filter": _OP4_SQL, "op8_source_mix": _OP8_SQL, "op9_exact_top_k": _OP9_SQL,
                              "op11_embedding_near_dedup": _OP11_SQL, "op13_phrase_collocations": _OP13_SQL}
