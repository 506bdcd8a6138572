"""Nearest neighbours by inverted lists and an adaptive dimension scan.

Vectors are rotated by a fixed random rotation, so that the first d of D coordinates estimate the whole distance.
Every vector belongs to the list of its nearest centroid; a query scans its nearest lists. Inside a list the
coordinates are read in column blocks: after each block a hypothesis test compares the scaled partial distance with
the query's k-th best and abandons candidates that are almost surely worse. The k-th best comes from the query's nearest
lists, which are searched first, and goes with the query to all others. Survivors are measured exactly, on the original
vectors in double precision.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscan.llm.common import join_sized, settle

#: The centroids are fitted on so many vectors, the first by a hash of their identifier.
TRAIN_VECTORS = 16384
#: Mean vectors of a list, and the most lists (a fifth of the sample would no longer place a centroid).
LIST_SIZE = 512
MAX_LISTS = TRAIN_VECTORS // 8
#: Share of the lists that a query scans, and the fewest.
PROBE_SHARE = 0.7
MIN_PROBES = 24
#: Rows of a list that meet in one task; a longer list is dealt over several blocks.
BLOCK_ROWS = 2048
#: Coordinates of a column block, and the width of the test in standard errors of the estimate.
COLUMN_BLOCK = 8
EPSILON = 2.1
#: Candidates measured whole before the first test where no k-th best is known yet.
WARM_UP = 128
#: Queries that are compared with a block at once, and the share of live pairs from which pairs are kept one by one.
QUERY_ROWS, SPARSE = 64, 0.2


def usable(vec: Column, dim: int | None = None) -> Column:
    """True for vectors that take part: no null, no non-finite component, not all zero, of the given length."""
    finite = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    ok = vec.isNotNull() & finite & F.exists(vec, lambda x: x != 0)
    return F.coalesce(ok if dim is None else ok & (F.size(vec) == dim), F.lit(False))


def rotation(dim: int) -> np.ndarray:
    """A fixed random rotation."""
    q, r = np.linalg.qr(np.random.default_rng(20240611).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def centroids(sample: np.ndarray, lists: int, rounds: int = 12) -> np.ndarray:
    """Lloyd's rounds from evenly spaced members; an empty centroid moves to the member farthest from its own."""
    lists = min(lists, len(np.unique(sample, axis=0)))
    start = np.unique(sample, axis=0)
    c = start[np.linspace(0, len(start) - 1, lists).astype(int)].copy()
    for _ in range(rounds):
        d = _squares(sample, c)
        own = d.argmin(axis=1)
        counts = np.bincount(own, minlength=len(c))
        sums = np.zeros_like(c)
        np.add.at(sums, own, sample)
        c = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], c)
        far = np.argsort(-d[np.arange(len(sample)), own], kind="stable")
        for k, empty in enumerate(np.nonzero(counts == 0)[0]):
            c[empty] = sample[far[k % len(far)]]
    return c


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a * a).sum(1)[:, None] - 2 * a @ b.T + (b * b).sum(1)[None, :], 0)


def scan_list(queries: np.ndarray, ids: np.ndarray, vectors: np.ndarray, turn: np.ndarray, k: int, limits: np.ndarray | None = None, column_block: int = COLUMN_BLOCK, epsilon: float = EPSILON) -> list[tuple[np.ndarray, np.ndarray]]:
    """For every query the k nearest of vectors found: (positions, distances), nearest first, ties to smaller ids.
    limits: distances beyond which nothing is wanted; by default the k-th best of the first WARM_UP vectors."""
    order = np.argsort(ids, kind="stable")
    vectors = vectors[order]
    turned = vectors @ turn
    dim, out = vectors.shape[1], []
    edges = [*range(column_block, dim, column_block), dim]
    norms = (vectors * vectors).sum(axis=1)
    for at in range(0, len(queries), QUERY_ROWS):
        some = queries[at : at + QUERY_ROWS]
        if limits is None:
            first = np.sqrt(((some[:, None, :] - vectors[None, :WARM_UP]) ** 2).sum(axis=2))
            limit = np.partition(first, k - 1, axis=1)[:, k - 1] if first.shape[1] >= k else np.full(len(some), np.inf)
        else:
            limit = limits[at : at + QUERY_ROWS]
        q = some @ turn
        near = limit**2
        # what rounding can add to a distance that is summed by products
        loose = 1e-9 * (1 + (some * some).sum(axis=1)[:, None] + norms)
        partial, start, pairs = np.zeros((len(some), len(vectors))), 0, None
        for stop in edges:
            slack = (1 + epsilon / np.sqrt(stop)) ** 2 * stop / dim if stop < dim else 1.0
            if pairs is None:
                a, b = q[:, start:stop], turned[:, start:stop]
                partial += (a * a).sum(axis=1)[:, None] - 2 * a @ b.T + (b * b).sum(axis=1)
                live = partial <= near[:, None] * slack + loose
                if live.mean() <= SPARSE or stop == dim:
                    pairs = np.nonzero(live)
                    partial = partial[pairs]
                else:
                    partial[~live] = np.inf
            else:
                gap = q[pairs[0], start:stop] - turned[pairs[1], start:stop]
                partial = partial + np.einsum("ij,ij->i", gap, gap)
                stay = partial <= near[pairs[0]] * slack + loose[pairs]
                pairs, partial = (pairs[0][stay], pairs[1][stay]), partial[stay]
            start = stop
        gap = some[pairs[0]] - vectors[pairs[1]]
        exact = np.sqrt((gap * gap).sum(axis=1))
        ranked = np.lexsort((pairs[1], exact, pairs[0]))
        ends = np.searchsorted(pairs[0][ranked], np.arange(len(some) + 1))
        out += [(order[pairs[1][own]], exact[own]) for own in (ranked[a : min(b, a + k)] for a, b in zip(ends, ends[1:], strict=False))]
    return out


def nearest(df: DataFrame, is_query: Column, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 10, probe_share: float = PROBE_SHARE, min_probes: int = MIN_PROBES) -> DataFrame:
    """(query_id, rank, id, score): for every query row the k nearest other rows found, score the Euclidean distance.

    is_query: a predicate on df's columns. Vectors that are null, zero, or hold null or non-finite components take no
    part, nor do those whose length is not the most frequent one (the smaller of equally frequent ones), as they have no
    distance to the others; a null identifier takes no part. Rows that repeat an identifier are rows like others: each
    is found, and each that is a query has its own k results. Ties go to the smaller identifier; with k or fewer
    candidates all are returned. Equal query vectors are searched once, so a vector that is a third of all rows costs
    one search. A task holds one block of BLOCK_ROWS vectors and reads queries in batches. An empty table gives an empty
    result; extra columns are ignored.
    """
    spark = df.sparkSession
    rows = df.select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("vec"), F.coalesce(is_query, F.lit(False)).alias("is_query"))
    rows = rows.where(usable(F.col("vec")) & F.col("id").isNotNull())
    lengths = rows.groupBy(F.size("vec").alias("dim")).count().orderBy(F.desc("count"), "dim").limit(1).collect()
    kind = dict(rows.dtypes)["id"]
    if not lengths:
        return spark.createDataFrame([], f"query_id {kind}, rank int, {id_col} {kind}, score double")
    dim, total = lengths[0]["dim"], lengths[0]["count"]
    rows = settle(rows.where(F.size("vec") == dim).withColumn("row", F.monotonically_increasing_id()), "vectors")
    sample = np.array([r.vec for r in rows.orderBy(F.xxhash64("id", "row"), "id").select("vec").limit(TRAIN_VECTORS).collect()])
    turn = rotation(dim)
    centres = centroids(sample, int(np.clip(-(-total // LIST_SIZE), 1, MAX_LISTS)))
    probes = min(len(centres), max(min_probes, int(np.ceil(probe_share * len(centres)))))
    matrix = lambda column: column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = _squares(matrix(b.column(2)), centres).argmin(axis=1).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(own), b.column(0), b.column(1), b.column(2)], names=["list", "row", "id", "vec"])

    placed = settle(rows.select("row", "id", "vec").mapInArrow(place, f"list int, row bigint, id {kind}, vec array<double>"), "lists")
    counts = np.zeros(len(centres), np.int64)
    for r in placed.groupBy("list").count().collect():  # one row per list, at most MAX_LISTS
        counts[r["list"]] = r["count"]
    blocks = np.maximum(-(-counts // BLOCK_ROWS), 1)

    def probe(first: bool):
        """The blocks of a query's nearest lists: those that hold k + 1 vectors, or the others that are probed."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if not b.num_rows:
                    continue
                near = np.argsort(_squares(matrix(b.column(1)), centres), axis=1, kind="stable")
                of, lists, parts = [], [], []
                for i, order in enumerate(near):
                    head = int(np.searchsorted(np.cumsum(counts[order]), k + 1)) + 1
                    for c in order[:head] if first else order[head : max(probes, head)]:
                        if counts[c]:
                            of += [i] * int(blocks[c])
                            lists += [c] * int(blocks[c])
                            parts += range(int(blocks[c]))
                for at in range(0, len(of), 4096):
                    take = pa.array(of[at : at + 4096], pa.int32())
                    yield pa.RecordBatch.from_arrays([pa.array(lists[at : at + 4096], pa.int32()), pa.array(parts[at : at + 4096], pa.int32()), *[b.column(c).take(take) for c in range(3)]], names=["list", "part", "name", "vec", "bound"])

        return run

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by block, a block's vectors (no bound) in front of its queries."""
        block, held, vectors = None, [], np.empty((0, dim))
        for b in batches:
            where = list(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True))
            marks = b.column(4).is_null().to_numpy(zero_copy_only=False)
            cuts = [0, *(i for i in range(1, len(where)) if where[i] != where[i - 1] or marks[i] != marks[i - 1]), len(where)]
            for a, z in zip(cuts, cuts[1:], strict=False):
                if a == z:
                    continue
                if where[a] != block:
                    block, held, vectors = where[a], [], np.empty((0, dim))
                own = b.slice(a, z - a)
                if marks[a]:
                    held.append(own)
                    vectors = np.vstack([vectors, matrix(own.column(3))])
                elif held:
                    names, ids = (pa.concat_arrays([h.column(c) for h in held]) for c in (2, 5))
                    bound = own.column(4).to_numpy()
                    found = scan_list(matrix(own.column(3)), ids.to_numpy(zero_copy_only=False), vectors, turn, k + 1, None if np.isinf(bound).all() else bound)
                    hits = pa.array(np.concatenate([p for p, _ in found]), pa.int64())
                    qids = np.repeat(own.column(2).to_numpy(), [len(p) for p, _ in found])
                    yield pa.RecordBatch.from_arrays([pa.array(qids), names.take(hits), ids.take(hits), pa.array(np.concatenate([d for _, d in found]))], names=["qid", "row", "id", "score"])

    asked = rows.where("is_query").select("id", "row", "vec")
    firsts = settle(asked.groupBy("vec").agg(F.min("row").alias("qid"), F.count("*").alias("n")), "queries")
    members = join_sized(asked, firsts, ["vec"], total).select("id", F.col("row").alias("own"), "qid")
    width = F.element_at(F.array(*[F.lit(int(b)) for b in blocks]), F.col("list") + 1)
    stored = placed.select("list", F.pmod(F.xxhash64("row"), width).cast("int").alias("part"), F.col("row").alias("name"), "vec", F.lit(None).cast("double").alias("bound"), "id")

    def found(queries: DataFrame, first: bool) -> DataFrame:
        probed = queries.mapInArrow(probe(first), "list int, part int, name bigint, vec array<double>, bound double").withColumn("id", F.lit(None).cast(kind))
        both = stored.unionByName(probed).repartition("list", "part").sortWithinPartitions("list", "part", F.col("bound").isNotNull(), "name")
        return both.mapInArrow(search, f"qid bigint, row bigint, id {kind}, score double")

    nth = F.row_number().over(Window.partitionBy("qid").orderBy("score", "id", "row"))
    head = settle(found(firsts.select("qid", "vec", F.lit(float("inf")).alias("bound")), True), "head")
    worst = head.withColumn("r", nth).where(F.col("r") <= k + 1).groupBy("qid").agg(F.max("score").alias("bound"), F.count("*").alias("hits"))
    bounded = firsts.join(worst, "qid").select("qid", "vec", F.when(F.col("hits") > k, F.col("bound")).otherwise(F.lit(float("inf"))).alias("bound"))
    top = head.unionByName(found(bounded, False)).withColumn("r", nth).where(F.col("r") <= k + 1)
    lists = top.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("score", "id", "row"))).alias("hits")).join(firsts.select("qid", "n"), "qid")
    each = join_sized(members, lists, ["qid"], total)
    others = F.slice(F.filter("hits", lambda h: h["row"] != F.col("own")), 1, k)
    out = each.select(F.col("id").alias("query_id"), F.posexplode(others).alias("at", "h"))
    return out.select("query_id", (F.col("at") + 1).alias("rank"), F.col("h.id").alias(id_col), F.col("h.score").alias("score"))
