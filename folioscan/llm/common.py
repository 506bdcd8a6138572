"""Shared pieces: shared-folder tables that cut lineage, joins that spread large keys, and connected components."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscan.sources.shared import remove, shared_dir

#: A key is large if it has more than rows / (LARGE_SHARE * partitions) rows, so that many keys are large at most.
LARGE_SHARE = 4
#: No key with fewer rows is large.
LARGE_LEAST = 256

#: A word of a text: a run of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"


def partitions(spark: SparkSession) -> int:
    """spark.sql.shuffle.partitions, Spark's own value where nobody sets it, or the default parallelism where a platform
    sets it to a word."""
    # no default here: Spark refuses one that is not a number where the key is unset
    value = spark.conf.get("spark.sql.shuffle.partitions")
    return int(value) if value.isdecimal() else spark.sparkContext.defaultParallelism


#: Rows of a batch that carries whole texts to Python; the default would put ten thousand texts into one.
TEXT_ROWS = 512
_ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def settle(df: DataFrame, label: str, batch_rows: int | None = None) -> DataFrame:
    """Write df as a table in the shared folder and read it back: lineage ends here, and a lost executor costs no rework.
    batch_rows: rows of the batches that go to Python meanwhile."""
    spark = df.sparkSession
    path, before = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}", spark.conf.get(_ARROW_ROWS)
    if batch_rows:
        spark.conf.set(_ARROW_ROWS, batch_rows)
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_ARROW_ROWS, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._settled_path = path
    for written in _passing:
        written.append(out)
    return out


_passing: list[list[DataFrame]] = []


@contextmanager
def passing() -> Iterator[list[DataFrame]]:
    """Tables that settle() writes inside are deleted at the end, but for those that are taken from the list."""
    written: list[DataFrame] = []
    _passing.append(written)
    try:
        yield written
    finally:
        _passing.pop()
        unsettle(*written)


def unsettle(*frames: DataFrame) -> None:
    """Delete tables written by settle(); a no-op for other frames."""
    for df in frames:
        if path := getattr(df, "_settled_path", None):
            remove(df.sparkSession, path)


def word_count(text):
    """Words of a text column as BIGINT; null counts 0. The text is scanned once, no array is built."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def join_sized(rows: DataFrame, table: DataFrame, keys: list[str], total: int, count: str = "n", how: str = "inner") -> DataFrame:
    """rows joined with table, which has one row for each of the keys and in `count` how many of the rows that key has;
    total: the number of rows. Large keys, of which there are LARGE_SHARE * partitions at most, are broadcast, so that
    none of them meets in one task; the others are shuffled. how: "inner" or "left". Keys must not be null."""
    limit = max(LARGE_LEAST, total // (LARGE_SHARE * partitions(rows.sparkSession)))
    more = [c for c in table.columns if c not in keys]
    large = table.where(F.col(count) > limit).select(*keys, F.struct(*more).alias("_large"))
    marked = rows.join(F.broadcast(large), keys, "left")
    spread = marked.where("_large IS NOT NULL").select(*rows.columns, *[F.col(f"_large.{c}").alias(c) for c in more])
    small = marked.where("_large IS NULL").select(*rows.columns).join(table.where(F.col(count) <= limit), keys, how)
    return spread.unionByName(small.select(*rows.columns, *more))


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Label every node of edges(a, b) with the smallest node of its component.

    Alternating large-star and small-star contraction: every round is two grouped minima and two equi-joins, the
    number of rounds grows with the logarithm of the longest path. No round holds a component in one place: a centre
    with more than its share of the edges is broadcast (join_sized).
    Returns (node, root) for every node that has an edge; self loops and repeated edges are ignored, an edge with a
    null end links nothing. Raises RuntimeError if the contraction has not settled after `rounds` rounds.
    """
    edges = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    current, before = settle(edges, "edges"), None
    for _ in range(rounds):
        state = current.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(state) == before or not state[0]:
            break
        before, total = tuple(state), state[0]
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        large = settle(join_sized(both, low, ["u"], 2 * total).where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct(), "large")
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        joined = join_sized(large, least, ["u"], total)
        small = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        settled = settle(small.distinct(), "edges")
        unsettle(current, large)
        current = settled
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    roots = current.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return current.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
