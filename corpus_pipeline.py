"""The corpus pipeline: from documents to packed bins.

Each stage works on the table that the one before it has written. Every decision is taken on its own stage's input:
the quality model is fitted on the labelled documents of the corpus, spread and groups are counted over what is left.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscan.llm.common import passing, settle, unsettle
from folioscan.llm.line_crf import keep_good, scored, train
from folioscan.llm.line_dedup import dedup_lines
from folioscan.llm.mixing import mix_sources
from folioscan.llm.packing import pack_documents
from folioscan.llm.simhash import drop_near_copies

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line model accepts. Null and empty texts and texts of any length are scored whole; rows that
    repeat an identifier are judged by their own text; other columns go. An empty table stays empty."""
    return keep_good(docs.select(COLUMNS), _table(spark, sf_dir, "labels")).select(COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without boilerplate lines; n_chars follows the text. A null text becomes empty, a text of boilerplate
    alone does too and its row stays, rows that repeat lose the same lines."""
    out = dedup_lines(docs.select(COLUMNS)).withColumn("text", F.col("kept_text"))
    return out.withColumn("n_chars", F.length("text").cast("bigint")).select(COLUMNS)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, on shingles of five words: the one with the smallest identifier. Rows
    that repeat an identifier are one document, empty texts are copies of each other, a null identifier stays."""
    return drop_near_copies(docs.select(COLUMNS), words=5).select(COLUMNS)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, weighed by the line model's score. Rows that repeat an identifier share
    the largest of their numbers of copies; texts without words stay with the complete epochs of their source."""
    docs = docs.select(COLUMNS)
    # the model is fitted on all documents, since only good ones are left here
    model = train(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    mixed = mix_sources(scored(docs, model, "text", "quality"), quality=F.col("quality"))
    plan = mixed.groupBy(F.col("doc_id").alias("_id")).agg(F.max("copies").alias("_copies")).where("_copies > 0")
    taken = docs.join(plan, F.col("doc_id").eqNullSafe(F.col("_id")))
    return taken.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies")))).select(COLUMNS)


def bins(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per bin: its documents, its words, and the pieces in it. Null and empty texts take a place without words,
    longer texts than a bin are cut into pieces, every row is in some bin; an empty table gives no bin."""
    pieces = pack_documents(docs.select(COLUMNS))
    piece = F.struct("doc_id", "row_no", "piece", "start", "size")
    # a bin holds one document of a source at most
    packed = pieces.groupBy("bin_id").agg(F.array_sort(F.collect_list(piece)).alias("pieces"), F.sum("size").alias("words"))
    return packed.select("bin_id", F.col("pieces.doc_id").alias("doc_ids"), F.size("pieces").cast("bigint").alias("n_pieces"), "words", "pieces")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


STAGES = [("quality classifier", quality), ("line dedup", lines), ("simhash near-dedup", near_copies), ("mixing", mixture), ("packing", bins)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each one's result written and read again. What a stage has written for itself and the
    table that it has read are deleted behind it."""
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        with passing() as written:
            done = settle(stage(spark, docs, sf_dir), name.replace(" ", "-"))
            written[:] = [t for t in written if t is not done]
        unsettle(docs)
        docs = done
    return docs


#: SQL can express neither the trained model nor best-fit packing.
ORACLE_SQL = None
