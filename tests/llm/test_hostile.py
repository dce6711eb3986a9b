"""Columns that clash with the operators' own, ids that repeat many times, and empty tables through the whole pipeline."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import functions as F

import corpus_pipeline
from sourceloom.llm import mixing, quality, queries, toxicity, url_templates
from sourceloom.session import discard, fresh_name, row_key, stored

SF = "/root/testdata/sf0.001"
CLASHING = "doc_id long, text string, lang string, source string, n_chars long, size string, _row string, epochs int, `range` int, last int, row_key string, mix_size int, target int"


def clashing(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, len(t or ""), f"s{k}", f"r{k}", 7, 8, 9, f"k{k}", k, 11) for k, (i, t, s) in enumerate(rows)], CLASHING)


ROWS = [(1, "one two three", "a"), (2, "one two three", "a"), (None, None, None), (3, "", "b"), (3, "four five", "b"), (None, "six", None)]


def test_mixing_keeps_columns_of_any_name(spark):
    docs = clashing(spark, ROWS)
    plain = {(r.doc_id, r.text): (r.size, r.source_size, r.target, r.times) for r in mixing.mixed(docs.select("doc_id", "text", "source")).collect()}
    names = ("w_size", "w_source", "w_target", "w_times")
    out = mixing.mixed(docs, names)
    assert out.columns == [*docs.columns, *names]
    for r in out.collect():
        assert tuple(r[n] for n in names) == plain[r.doc_id, r.text] and (r.epochs, r.range, r.last, r.target) == (7, 8, 9, 11)


def test_stages_keep_columns_of_any_name(spark):
    docs = stored(clashing(spark, ROWS), "clashing")
    before = {tuple(r) for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        assert {tuple(r) for r in out.collect()} <= before
    kept = Counter(r.text or "" for r in corpus_pipeline.exact_dedup(spark, docs, SF).collect())
    assert kept == Counter({"one two three": 1, "": 1, "four five": 1, "six": 1})


def test_empty_tables_through_the_pipeline(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_labelled_id_that_repeats_counts_once(spark, monkeypatch):
    docs = spark.range(2000).select(F.lit(1).cast("long").alias("doc_id"), F.concat_ws(" ", F.lit("word"), "id").alias("text"))
    labels = spark.createDataFrame([(1, 1, 1), (1, 0, 0), (1, 1, 1)], "doc_id long, quality int, toxic int")
    seen, grow, learn = [], quality.grow, toxicity.learn
    monkeypatch.setattr(quality, "grow", lambda x, y: seen.append(len(y)) or grow(x, y))
    monkeypatch.setattr(toxicity, "learn", lambda *a: seen.append(len(a[4])) or learn(*a))
    assert quality.quality_scores(docs, labels).count() == 2000 and toxicity.toxicity(docs, labels).count() == 2000
    assert seen == [1, 1]


def test_pages_with_columns_of_any_name(spark):
    rows = [(1, "http://a.net/x"), (2, "http://b.org/fr/"), (3, None)]
    plain = Counter((r.page_id, r.verdict) for r in url_templates.url_verdicts(spark.createDataFrame(rows, "page_id long, url string"), queries.URL_RULES).collect())
    more = spark.createDataFrame([(i, u, "h", "t", "s", 1, 2, 3) for i, u in rows],
                                 "page_id long, url string, host string, template string, shape string, pages int, labelled int, blocked int")
    assert Counter((r.page_id, r.verdict) for r in url_templates.url_verdicts(more, queries.URL_RULES).collect()) == plain


def test_row_keys_and_scratch_tables(spark, tmp_path):
    table = stored(spark.range(1000).repartition(3), "keys")
    name = fresh_name(table.withColumnRenamed("id", "Key"), "key")
    assert name == "key_"
    keyed = row_key(table, name)
    assert keyed.select(name).distinct().count() == 1000
    assert row_key(spark.range(5), "k") is None and row_key(table.where("id > 5"), "k") is None
    assert row_key(table.withColumn("twice", F.explode(F.array(F.lit(1), F.lit(2)))), "k") is None
    path = table.stored_at
    discard(table, spark.range(3))
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    assert not place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)
