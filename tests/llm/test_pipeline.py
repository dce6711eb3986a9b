"""Stages of the corpus pipeline on rows whose ids repeat or are null."""

from __future__ import annotations

from collections import Counter

import corpus_pipeline
from sourceloom.llm.toxicity import toxicity

SF = "/root/testdata/sf0.01"
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, rows):
    return spark.createDataFrame([(i, text, "en", "a", len(text or "")) for i, text in rows], COLUMNS)


def test_clean_rejects_rows_not_ids(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    judged = toxicity(docs, labels).join(docs, "doc_id").where("length(text) > 100").select("rejected", "text")
    bad, good = (judged.where(f"rejected = {r}").orderBy("text").first().text for r in ("true", "false"))
    added = [(i, text) for i in (None, 10**9) for text in (bad, good, bad, good)]
    out = corpus_pipeline.clean(spark, docs.select(*frame(spark, []).columns).union(frame(spark, added)), SF)
    assert out.columns == docs.columns
    found = Counter((r.doc_id, r.text) for r in out.where("doc_id is null or doc_id = 1000000000").collect())
    assert found == Counter({(None, good): 2, (10**9, good): 2})


def test_near_dedup_keeps_one_row_of_each_group(spark):
    base = [" ".join(f"{family}{i}" for i in range(60)) for family in "abcde"]
    near = [f"{text} end" for text in base]
    rows = [(7, base[0]), (7, near[0]), (None, base[1]), (None, near[1]), (None, near[1]), (9, base[2]), (None, near[2]), (7, base[3]), (3, near[3]), (None, base[4]),
            (None, None), (None, ""), (4, " "), (4, " ")]
    found = Counter((r.doc_id, (r.text or " ").split(" ")[0][:1]) for r in corpus_pipeline.near_dedup(spark, frame(spark, rows), SF).collect())
    assert found == Counter([(7, "a"), (None, "b"), (9, "c"), (3, "d"), (None, "e"), (None, ""), (None, ""), (4, ""), (4, "")])


def test_exact_dedup_when_files_are_split_anew(spark, tmp_path, monkeypatch):
    rows = [(i, f"text {i % 150}") for i in range(300)]
    frame(spark, rows).repartition(6, "doc_id").write.parquet(str(tmp_path / "docs"))
    setting = "spark.sql.files.maxPartitionBytes"
    found = corpus_pipeline.exact_duplicates

    def then_split_anew(*given, **named):
        decided = found(*given, **named)
        spark.conf.set(setting, "64k")
        return decided

    monkeypatch.setattr(corpus_pipeline, "exact_duplicates", then_split_anew)
    usual = {setting: "128m", "spark.sql.files.openCostInBytes": "4m", "spark.sql.files.minPartitionNum": "1"}
    for name, value in usual.items():
        spark.conf.set(name, value)
    try:
        kept = [r.text for r in corpus_pipeline.exact_dedup(spark, spark.read.parquet(str(tmp_path / "docs")), SF).collect()]
    finally:
        for name in usual:
            spark.conf.unset(name)
    assert Counter(kept) == Counter({f"text {i}": 1 for i in range(150)})
