"""A training-corpus pipeline over ``documents``: each stage is one operator of sourceloom.llm and works on what its predecessor kept.

Every stage takes (spark, docs, folder) and returns a DataFrame, which ``run`` writes as Parquet into the shared folder and reads
again as the next stage's docs; what the stage no longer needs is deleted then. All stages but the last return the columns of
``documents``, whatever else they are called, with all rows they keep: null and empty texts are neither toxic nor copies of others but
of each other (they have no shingles, so that only exact dedup joins them), rows with null or repeated ids are judged one by one, ties
go to the smallest doc_id, null last, and empty tables stay empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sourceloom.llm.byte_bpe import token_digests
from sourceloom.llm.exact_dedup import exact_duplicates
from sourceloom.llm.jaccard import near_kept
from sourceloom.llm.mixing import ADDED, mixed
from sourceloom.llm.queries import BYTE_RANKS
from sourceloom.llm.toxicity import without_toxic
from sourceloom.session import discard, fresh_name, prepare, row_key, stored


def _keyed(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` with a key for each row, and the key's name, which no column had. Rows of stored tables are told apart by their places;
    others are numbered as they are stored, once, so that every later read finds the same numbers however files are split."""
    name = fresh_name(docs, "row_key")
    keyed = row_key(docs, name)
    return (stored(docs.withColumn(name, F.monotonically_increasing_id()), "keyed") if keyed is None else keyed), name


def clean(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """The documents that the toxicity chain, learned from the folder's labels, does not reject."""
    return without_toxic(docs, spark.read.parquet(f"{folder}/labels.parquet"))


def exact_dedup(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """One row of each group of equal texts."""
    rows, key = _keyed(docs)
    kept = exact_duplicates(rows, also=(key,)).where("kept").select(key)
    return rows.join(kept, key, "left_semi").select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """One row of each group linked by five-word shingles at a similarity of 0.8 or more: that with the smallest doc_id, null last."""
    rows, key = _keyed(docs)
    return rows.join(near_kept(rows, key), key, "left_semi").select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    names = [fresh_name(docs, f"mix_{name}") for name in ADDED]
    taken = mixed(docs, tuple(names))
    copies = F.explode(F.sequence(F.lit(1), F.col(names[-1]).cast("int")))
    return taken.where(F.col(names[-1]) > 0).withColumn(fresh_name(taken, "mix_copy"), copies).select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every row."""
    return token_digests(docs, BYTE_RANKS)


STAGES = [("toxicity", clean), ("exact dedup", exact_dedup), ("n-gram jaccard join", near_dedup), ("source mix", mix), ("byte-level BPE", tokens)]

#: SQL can't express the classifier of the first stage or the encoding of the last.
ORACLE_SQL = None


def run(spark: SparkSession, folder: str) -> DataFrame:
    """The rows of the last stage for the documents in ``folder``."""
    prepare(spark)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in STAGES:
        before, docs = docs, stored(stage(spark, docs, folder), name.replace(" ", "-"))
        discard(before)
    return docs
