"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Every document draws an exponential key from a hash of its identifier, divided by its quality weight; sorted by that
key within its source, documents are a weighted sample without replacement at every prefix. A source's target is
split into complete epochs, which take every document, and a fraction, which takes the prefix whose words add up to
the rest. Prefix sums are two-level. Rows are range-partitioned by source and key with sampled splitters, so that bins
hold about equally many rows whatever the weights, the identifiers or the sources are; sums by bin come first, then a
running sum inside a bin. A source with a third of all rows is spread over a third of the bins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscan.llm.common import WORD, join_sized, settle, unsettle, word_count

#: Mean rows of a bin, whose rows meet in one task, and the most bins.
BIN_ROWS, BINS = 8192, 4096
#: Weights by rank of the source, repeating.
WEIGHTS = (5, 2, 1)
#: Most copies of a document.
MAX_EPOCHS = 3


def text_quality(text: Column) -> Column:
    """A weight in 0.05..1 from the text alone: the share of its characters that are neither digits nor symbols."""
    plain = F.length(F.regexp_replace(text, r"[\x21-\x26\x28-\x2B\x2F-\x39\x3C-\x40\x5B-\x60\x7B-\x7E]+", ""))
    return F.greatest(F.lit(0.05), F.coalesce(plain / F.nullif(F.length(text), F.lit(0)), F.lit(0.05)))


def uniform(*parts: Column) -> Column:
    """A repeatable number in (0, 1) from the MD5 of the parts: 52 bits, never an end of the interval."""
    digest = F.md5(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / F.lit(float(2**52))


def source_targets(sources: DataFrame, weights=WEIGHTS, cap: float = MAX_EPOCHS) -> DataFrame:
    """(source, source_size, target) from one row per source (source, source_size).

    Sources in code-point order, null last, get the weights in turn. Targets share the sum of all sizes by weight,
    stop at cap times the source's size, and what exceeds the cap goes to the others by weight. The level at which
    that ends is found in one pass: sources ordered by cap per weight are capped while their ratio is below the level
    that the remaining ones would get. One row per source is all that meets here.
    """
    rank = F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))) - 1
    pick = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(rank, F.lit(len(weights))) + 1).cast("int"))
    s = sources.withColumn("w", pick).withColumn("most", F.col("source_size") * F.lit(float(cap)))
    order = Window.orderBy(F.col("most") / F.col("w"), F.asc_nulls_last("source"))
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(0, Window.unboundedFollowing)
    total = F.sum("source_size").over(Window.partitionBy(F.lit(0)))
    level = (total - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / F.sum("w").over(after)
    s = s.withColumn("level", level).withColumn("place", F.row_number().over(order)).withColumn("free", F.col("most") / F.col("w") >= F.col("level"))
    settled = F.min(F.when(F.col("free"), F.struct("place", "level"))).over(Window.partitionBy(F.lit(0)))["level"]
    target = F.least(F.col("most"), F.col("w") * F.coalesce(settled, F.lit(float("inf"))))
    return s.select("source", "source_size", F.coalesce(target, F.lit(0.0)).alias("target"))


def mix_sources(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", quality: Column | None = None, weights=WEIGHTS, cap: int = MAX_EPOCHS, seed: int = 0) -> DataFrame:
    """One row per row of df: (id, size, source_size, target, copies, taken).

    size is the number of words (null text: 0), copies how often the document is in the mix, taken = copies * size.
    quality: a positive weight per row from df's columns, by default text_quality; null, zero and negative weights
    count as 0.001. The last document of a fraction is taken if its middle is within the rest, so a source misses its
    target by half of one document at most. Keys come from hashes: reruns agree. Rows that repeat an identifier with
    equal weights have equal keys and are ordered by size; full ties are taken in any order, with equal columns. Documents
    without words are taken with every complete epoch and in the fraction where the prefix ends behind them. Null
    sources are one source; an empty table gives an empty result. Extra columns are ignored.
    """
    weight = quality if quality is not None else text_quality(F.col(text_col))
    weight = F.when(weight > 0, weight.cast("double")).otherwise(F.lit(0.001))
    slim = df.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), weight.alias("weight"))
    key = -F.log(uniform(F.col("id"), F.lit(seed))) / F.col("weight")
    # the row number tells full ties apart, which are equal in all other columns; null sources are named apart
    named = F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n"))
    slim = settle(slim.select("id", "source", named.alias("s"), "size", key.alias("key"), F.monotonically_increasing_id().alias("row")), "mix")
    rows = slim.count()
    order = ["key", "id", "size", "row"]
    bins = max(1, min(BINS, -(-rows // BIN_ROWS)))
    ranged = settle(slim.repartitionByRange(bins, "s", *order).withColumn("bin", F.spark_partition_id()), "ranged")
    unsettle(slim)
    sums = ranged.groupBy("s", "bin").agg(F.sum("size").alias("bin_size"), F.count("*").alias("n"), F.first("source").alias("source"))
    upto = Window.partitionBy("s").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("before", F.coalesce(F.sum("bin_size").over(upto), F.lit(0)))
    targets = source_targets(sums.groupBy("source").agg(F.sum("bin_size").alias("source_size")), weights, cap)
    targets = targets.select(F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n")).alias("s"), "source_size", "target")
    plan = sums.select("s", "bin", "before", "n").join(targets, "s")
    within = Window.partitionBy("s", "bin").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    run = ranged.withColumn("upto", F.coalesce(F.sum("size").over(within), F.lit(0)))
    rows = join_sized(run.select("id", "size", "s", "bin", "upto"), plan, ["s", "bin"], rows)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("bigint")
    rows = rows.withColumn("start", F.col("before") + F.col("upto")).withColumn("epochs", epochs)
    rest = F.col("target") - F.col("epochs") * F.col("source_size")
    copies = F.least(F.col("epochs") + F.when(F.col("start") + F.col("size") / 2 < rest, 1).otherwise(0), F.lit(int(cap)))
    rows = rows.withColumn("copies", copies)
    return rows.select(F.col("id").alias(id_col), "size", "source_size", "target", F.col("copies").cast("int").alias("copies"), (F.col("copies") * F.col("size")).cast("bigint").alias("taken"))


__all__ = ["BINS", "MAX_EPOCHS", "WEIGHTS", "WORD", "mix_sources", "source_targets", "text_quality", "uniform"]
