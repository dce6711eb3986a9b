"""Exact deduplication by deterministic block naming.

A text without its white space is cut into blocks of fixed size. Distinct blocks are sorted and get integer names; then adjacent
names are paired and the distinct pairs are sorted and named, level by level, until one name is left: equal texts, and they
alone, have equal lengths and names. No hash decides anything. A text that is the only one of its length and beginning has its
identity from the start, so only texts that share both send their blocks through the levels.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sourceloom.session import discard, prepare, stored

#: Characters of a block, and of the beginning by which texts are told apart first.
BLOCK, LEAD = 1024, 256
_WHITE = " \t\n\x0b\x0c\r"


def normalised(text: str = "text") -> Column:
    """The text without ``[\\x20\\x09-\\x0D]``; null is empty."""
    return F.translate(F.coalesce(F.col(text), F.lit("")), _WHITE, "")


def _named(parts: DataFrame, *keys: str) -> DataFrame:
    """``parts`` with the integer name of its keys instead of them, stored: equal keys, and they alone, share a name."""
    names = parts.select(*keys).distinct().sortWithinPartitions(*keys).withColumn("name", F.monotonically_increasing_id())
    names = stored(names, "names")
    same = [parts[k].eqNullSafe(names[k]) for k in keys]
    condition = same[0]
    for more in same[1:]:
        condition = condition & more
    out = stored(parts.join(names, condition).select(*[parts[c] for c in parts.columns if c not in keys], names["name"]), "level")
    discard(names)
    return out


def _identities(texts: DataFrame) -> DataFrame:
    """(row, name) of texts (row, plain)."""
    blocks = F.expr(f"regexp_extract_all(plain, '(?s).{{1,{BLOCK}}}', 0)")
    parts = texts.select("row", F.posexplode_outer(blocks).alias("at", "block"))
    parts = parts.select("row", F.coalesce("at", F.lit(0)).alias("at"), F.coalesce("block", F.lit("")).alias("block"))
    level = _named(parts, "block")
    done = None
    while True:
        longer = level.where("at > 0").select("row").distinct()
        single = stored(level.join(longer, "row", "left_anti").select("row", "name"), "single")
        done = single if done is None else done.union(single)
        if longer.isEmpty():
            discard(level)
            return done
        pairs = level.join(longer, "row", "left_semi").groupBy("row", F.expr("at div 2").cast("int").alias("at")).agg(
            F.max(F.expr("if(at % 2 = 0, name, null)")).alias("one"), F.max(F.expr("if(at % 2 = 1, name, null)")).alias("two"))
        level, last = _named(pairs, "one", "two"), level
        discard(last)


def exact_duplicates(docs: DataFrame, also: tuple[str, ...] = ()) -> DataFrame:
    """Every row of ``docs`` (doc_id, text) with keep_id, group_size, kept and text_sha256, and the columns ``also`` of docs.

    Rows are equal when their texts are, white space left out; null counts as empty. Of equal rows that with the most code points
    in the original text stays, then the one with the smallest doc_id, null last; of wholly equal rows one. text_sha256 is a
    digest for readers and takes no part in the decision. Other columns are not read; an empty table gives no rows.
    """
    prepare(docs.sparkSession)
    plain = normalised()
    rows = docs.select("doc_id", *also, F.length(F.coalesce("text", F.lit(""))).alias("size"), F.length(plain).alias("n"),
                       F.substring(plain, 1, LEAD).alias("lead"), F.sha2(plain.cast("binary"), 256).alias("text_sha256"), plain.alias("plain"))
    crowded = rows.groupBy("n", "lead").count().where("count > 1").select("n", "lead", F.lit(True).alias("crowded"))
    rows = rows.join(crowded, ["n", "lead"], "left").select(
        F.monotonically_increasing_id().alias("row"), "doc_id", *also, "size", "n", "text_sha256", F.expr("if(crowded, plain, null)").alias("plain"))
    rows = stored(rows, "rows")
    open_ = rows.where("plain is not null")
    named = open_.select("row", "doc_id", "size", "n").join(_identities(open_.select("row", "plain")), "row")
    order = F.struct((-F.col("size")).alias("s"), F.col("doc_id").isNull().alias("u"), F.col("doc_id").alias("d"), F.col("row").alias("r"))
    groups = named.groupBy("n", "name").agg(F.count("*").alias("group_size"), F.min(order).alias("best"))
    placed = named.select("row", "n", "name").join(groups, ["n", "name"])
    placed = placed.select("row", "group_size", F.col("best.d").alias("keep_id"), (F.col("best.r") == F.col("row")).alias("kept"))
    light = rows.select("row", "doc_id", *also, "text_sha256", F.col("plain").isNull().alias("single"))
    alone = light.where("single").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"),
                                         F.lit(True).alias("kept"), "text_sha256", *also)
    return alone.union(light.where("not single").join(placed, "row").select("doc_id", "keep_id", "group_size", "kept", "text_sha256", *also))
