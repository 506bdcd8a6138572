"""Exact dedup by content sort.

Rows are range-partitioned by sampled splitters over the leading bytes of the normalised text, every partition is
sorted externally so that equal texts become adjacent, and a window compares each whole text with its neighbour.
A text that holds more than its share of all rows is dealt over several salts first; the leaders of the salts, a few
rows for each such text, are compared once more. All of it runs on DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscan.llm.common import partitions

#: Characters of the text in a splitter. Texts with a common start are told apart by the hash that follows it.
SPLITTER_CHARS = 32
#: A text is hot if it has more than rows / (HOT_PER_PARTITION * partitions) rows, so at most that many texts are hot.
HOT_PER_PARTITION = 4
#: Salts of a hot text.
SALTS = 64


def identity(text: Column) -> Column:
    """Normalisation of the contract: null is empty, nothing else changes."""
    return F.coalesce(text, F.lit(""))


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min", normalise=identity) -> DataFrame:
    """One row per row of df: (id, keep_id, group_size, kept, text_sha256).

    keep: "min" retains the smallest identifier of equal texts, "max" the largest. text_sha256 is the digest of the
    normalised text. Null text counts as empty. A null identifier sorts behind all others, so it stays only if its
    group has no other. Rows that repeat text and identifier count one by one and exactly one of them is kept. Texts of
    any length are compared whole. An
    empty table gives an empty result. Other columns are ignored, so their names cannot clash.
    """
    if keep not in ("min", "max"):
        raise ValueError(f"keep must be 'min' or 'max', not {keep!r}")
    spark = df.sparkSession
    n = partitions(spark)
    # the row number salts hot texts, so that a row repeated with its id is spread like others
    rows = df.select(F.col(id_col).alias("id"), normalise(F.col(text_col)).alias("body"), F.monotonically_increasing_id().alias("row")).withColumn("h", F.xxhash64("body"))
    counts = rows.groupBy("h").agg(F.count("*").alias("n"))
    # one pass over the counts finds the total; the threshold then bounds the hot set to HOT_PER_PARTITION * n rows
    total = df.count()
    hot = counts.where(F.col("n") > max(1, total // (HOT_PER_PARTITION * n))).select("h", F.lit(True).alias("hot"))
    salt = F.when(F.col("hot"), F.pmod(F.xxhash64("row"), F.lit(SALTS)).cast("int")).otherwise(F.lit(0))
    dealt = rows.join(F.broadcast(hot), "h", "left").withColumn("salt", salt)
    dealt = dealt.withColumn("head", F.substring("body", 1, SPLITTER_CHARS))
    ranged = dealt.repartitionByRange(n, "head", "h", "salt")
    order = F.desc_nulls_last("id") if keep == "max" else F.asc_nulls_last("id")
    same = Window.partitionBy("head", "h", "salt", "body")
    # rank over the sorted neighbours; the group's size is the rank of its last row
    found = ranged.select(
        "id",
        "row",
        "body",
        F.col("hot").isNotNull().alias("hot"),
        F.sha2(F.encode("body", "UTF-8"), 256).alias("text_sha256"),
        F.row_number().over(same.orderBy(order, "row")).alias("rank"),
        F.first("id").over(same.orderBy(order, "row")).alias("lead_id"),
        F.count("*").over(same).alias("part_size"),
    )
    known = F.struct(F.col("id").isNotNull(), "id", (-F.col("row")).alias("row")) if keep == "max" else F.struct(F.col("id").isNull(), "id", "row")
    leaders = found.where("hot AND rank = 1").groupBy("body").agg(
        F.first("text_sha256").alias("text_sha256"),
        (F.max if keep == "max" else F.min)(known).alias("lead"),
        F.sum("part_size").alias("all_size"),
    )
    # as many rows as there are hot texts, at most HOT_PER_PARTITION * n
    whole = leaders.select("text_sha256", F.col("lead.id").alias("all_id"), F.abs("lead.row").alias("all_row"), "all_size")
    out = found.drop("body").join(F.broadcast(whole), "text_sha256", "left")
    return out.select(
        F.col("id").alias(id_col),
        F.when(F.col("hot"), F.col("all_id")).otherwise(F.col("lead_id")).alias("keep_id"),
        F.coalesce("all_size", "part_size").cast("bigint").alias("group_size"),
        F.when(F.col("hot"), F.col("row") == F.col("all_row")).otherwise(F.col("rank") == 1).alias("kept"),
        "text_sha256",
    )
