"""Mixing sources to target weights: complete epochs, then Efraimidis-Spirakis sampling by quality weight.

Each document draws an exponential key, -ln(u) / weight, from a uniform number that its id fixes. Within a source, documents are
taken by rising key until their prefix sum reaches the budget that complete epochs leave over. The prefix sums go through sums
of key ranges, so only the range at the cut is sorted; the decision for a row is a comparison with its source's cut.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from sourceloom.session import discard, fresh_name, prepare, stored

#: Weights of the sources in code-point order, repeating; share of all sizes to take; most repeats of a source.
WEIGHTS, SHARE, MOST = (3, 1, 2), 1.5, 2
#: The columns that a mix adds.
ADDED = ("size", "source_size", "target", "times")
#: Ranges of keys per source.
RANGES = 4096
#: Signs whose share lowers a document's weight.
SYMBOLS = "#$%&*!|<>{}[]=~^_@\\"


def word_count() -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of the text, null: 0."""
    return F.coalesce(F.expr(r"regexp_count(text, '[^\\x20\\x09-\\x0D]+')"), F.lit(0)).cast("long")


def quality_weight() -> Column:
    """Between 0.1 and 1, less for texts with many symbols."""
    text = F.coalesce(F.col("text"), F.lit(""))
    symbols = (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))) / F.greatest(F.length(text), F.lit(1))
    return F.greatest(F.lit(0.1), 1 - 4 * symbols)


def sample_key(weight: Column) -> Column:
    """The exponential key of a row; 52 bits of the MD5 of its id give the uniform number."""
    drawn = F.conv(F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")).cast("binary")), 1, 13), 16, 10)
    return -F.log((drawn.cast("double") + 0.5) / F.lit(float(2**52))) / weight


def source_targets(sizes: DataFrame) -> DataFrame:
    """(source, source_size, target) from (source, source_size), one row a source.

    Sources in code-point order, null last, have WEIGHTS in turn and share SHARE of all sizes. A target stops at MOST times its
    source's size, and what is over goes to the others by weight: with the sources in the order in which they fill up, the first
    k are full, and k is the least for which the rest don't exceed theirs. One window over the sources, which are few.
    """
    ordered = sizes.withColumn("nth", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1)
    weighed = ordered.withColumn("w", F.element_at(F.array(*[F.lit(float(w)) for w in WEIGHTS]), (F.col("nth") % len(WEIGHTS) + 1).cast("int")))
    weighed = weighed.withColumn("full", F.col("source_size") * F.lit(float(MOST))).withColumn("fill", F.col("full") / F.col("w"))
    rising, everything = W.orderBy("fill", "nth").rowsBetween(W.unboundedPreceding, -1), W.orderBy(F.lit(1)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    level = (F.sum("source_size").over(everything) * F.lit(SHARE) - F.coalesce(F.sum("full").over(rising), F.lit(0.0))) / (
        F.sum("w").over(everything) - F.coalesce(F.sum("w").over(rising), F.lit(0.0)))
    open_ = weighed.withColumn("level", level).withColumn("reach", F.max(F.expr("if(level <= fill, level, null)")).over(everything))
    return open_.select("source", "source_size", F.coalesce(F.least("full", F.col("w") * F.col("reach")), F.col("full")).alias("target"))


def _cuts(drawn: DataFrame) -> DataFrame:
    """Per source: source_size, target, epochs, and the key and id up to which documents get one more pass."""
    ranged = drawn.withColumn("range", F.floor(-F.expm1(-F.col("key")) * RANGES))
    sums = stored(ranged.groupBy("source", "range").agg(F.sum("size").alias("size")), "sums")
    sources = source_targets(sums.groupBy("source").agg(F.sum("size").alias("source_size")))
    sources = stored(sources.withColumn("epochs", F.expr("if(source_size = 0, 0L, cast(floor(target / source_size) as bigint))"))
                     .withColumn("rest", F.expr("target - epochs * source_size")), "sources")
    before = F.coalesce(F.sum("size").over(W.partitionBy("source").orderBy("range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    placed = sums.withColumn("before", before).join(sources.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of"))).drop("of")
    at_cut = placed.where("before <= rest and rest <= before + size and rest > 0").select(F.col("source").alias("s"), F.col("range").alias("r"), "before", "rest")
    units = (ranged.join(at_cut, F.col("source").eqNullSafe(F.col("s")) & (F.col("range") == F.col("r")))
             .groupBy("source", "range", "before", "rest", "key", "doc_id").agg(F.sum("size").alias("size")))
    here = W.partitionBy("source", "range").orderBy("key", F.col("doc_id").asc_nulls_last()).rowsBetween(W.unboundedPreceding, 0)
    taken = units.withColumn("middle", F.col("before") + F.sum("size").over(here) - F.col("size") / 2).where("middle <= rest")
    last = taken.groupBy("source").agg(F.max(F.struct("key", F.col("doc_id").isNull().alias("none"), "doc_id")).alias("last"))
    first = at_cut.groupBy(F.col("s").alias("source")).agg(F.min("r").alias("range"))
    cut = sources.join(last.withColumnRenamed("source", "l"), F.col("source").eqNullSafe(F.col("l")), "left").drop("l")
    return cut.join(first.withColumnRenamed("source", "f"), F.col("source").eqNullSafe(F.col("f")), "left").drop("f")


def mixed(docs: DataFrame, names: tuple[str, str, str, str] = ADDED) -> DataFrame:
    """Every row of ``docs`` with size, source_size, target, and times: how often the mix takes it; ``names`` are the columns' names.

    size is the number of words; null texts have 0 and are never counted. A null source is a source of its own, null ids share
    one key and come last among ties. Rows of one id and key are taken together, so repeated rows are decided alike. A source
    without words has target 0. An empty table gives no rows. The taken words of a source differ from its target by at most half
    the row (or rows of one id) at the cut. Columns of ``docs`` that have one of the added names are replaced, all others are kept
    whatever they are called.
    """
    prepare(docs.sparkSession)
    key = sample_key(quality_weight())
    drawn = stored(docs.select("doc_id", "source", word_count().alias("size"), key.alias("key")), "drawn")
    cuts = stored(_cuts(drawn), "cuts")
    discard(drawn)
    kept = [docs[c] for c in docs.columns if c not in names]
    row, cut = fresh_name(docs, "row"), fresh_name(docs, "cut")
    mine = docs.select(*kept, F.struct(F.col("source").alias("source"), word_count().alias("size"), key.alias("key"), F.col("doc_id").alias("doc_id")).alias(row))
    joined = mine.join(cuts.select(F.struct(*cuts.columns).alias(cut)), F.col(f"{row}.source").eqNullSafe(F.col(f"{cut}.source")))
    at = F.struct(F.col(f"{row}.key").alias("key"), F.col(f"{row}.doc_id").isNull().alias("none"), F.col(f"{row}.doc_id").alias("doc_id"))
    within, early = at <= F.col(f"{cut}.last"), F.floor(-F.expm1(-F.col(f"{row}.key")) * RANGES) < F.col(f"{cut}.range")
    times = F.col(f"{cut}.epochs") + F.coalesce((within | early).cast("long"), early.cast("long"), F.lit(0))
    added = (F.col(f"{row}.size"), F.col(f"{cut}.source_size"), F.col(f"{cut}.target"), times)
    return joined.select(*[mine[c] for c in docs.columns if c not in names], *[c.alias(n) for c, n in zip(added, names)])
