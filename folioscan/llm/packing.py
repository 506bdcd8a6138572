"""Conflict-constrained best-fit packing.

Documents fill bins of a fixed number of words. A bin carries two bitmaps, of the sources and of the duplicate
clusters in it; a document fits only where both of its bits are free. Bins are ordered by residual in a tree whose
nodes hold the bits that all bins below share, so that the search for the tightest compatible bin skips whole ranges
of bins and continues until it has one. Documents are dealt evenly over shards of a bounded size that pack on their
own; the number of shards grows with the documents.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscan.llm.common import settle, word_count

#: Words of a bin.
CAPACITY = 1024
#: Mean documents of a shard.
SHARD_DOCS = 4096


class Bins:
    """Open bins by residual. Leaves of the tree are residuals 0..capacity; a node is the AND of the bitmaps below it,
    -1 if there is no bin. A node that shares a bit with the document holds no compatible bin."""

    def __init__(self, capacity: int) -> None:
        self.leaves = 1 << capacity.bit_length()
        self.tree = [-1] * (2 * self.leaves)
        self.at: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]

    def _set(self, residual: int) -> None:
        shared = -1
        for bits, _ in self.at[residual]:
            shared &= bits
        node = residual + self.leaves
        self.tree[node] = shared
        while node > 1:
            node >>= 1
            shared = self.tree[2 * node] & self.tree[2 * node + 1]
            if self.tree[node] == shared:
                return
            self.tree[node] = shared

    def _search(self, node: int, left: int, width: int, low: int, bits: int) -> tuple[int, int] | None:
        """(residual, position) of the first compatible bin at residual low or above, in the node's range."""
        if left + width <= low or self.tree[node] & bits:
            return None
        if width == 1:
            return next(((left, k) for k, (own, _) in enumerate(self.at[left]) if not own & bits), None)
        half = width >> 1
        return self._search(2 * node, left, half, low, bits) or self._search(2 * node + 1, left + half, half, low, bits)

    def take(self, size: int, bits: int) -> tuple[int, int, int] | None:
        """Remove and return (residual, bitmap, number) of the tightest compatible bin."""
        found = self._search(1, 0, self.leaves, size, bits)
        if found is None:
            return None
        own, number = self.at[found[0]].pop(found[1])
        self._set(found[0])
        return found[0], own, number

    def put(self, residual: int, bits: int, number: int) -> None:
        self.at[residual].append((bits, number))
        self._set(residual)


def best_fit(sizes: list[int], bits: list[int], capacity: int) -> list[int]:
    """The bin of every item, items in the order given; none is larger than capacity."""
    bins, made, out = Bins(capacity), 0, []
    for size, own in zip(sizes, bits, strict=True):
        residual, held, number = bins.take(size, own) or (capacity, 0, made)
        made += number == made
        out.append(number)
        bins.put(residual - size, held | own, number)
    return out


def pack_shard(frame: pd.DataFrame, capacity: int) -> pd.DataFrame:
    """Rows (id, row, size, source, cluster) of one shard to pieces (id, row, piece, start, size, source, bin)."""
    frame = frame.sort_values(["size", "row"], ascending=[False, True], kind="stable")
    # bits: sources first, then the clusters that occur more than once here (others cannot conflict)
    sources = {s: 1 << k for k, s in enumerate(sorted(frame["source"].unique()))}
    repeated = sorted(frame["cluster"][frame["cluster"].duplicated()].unique())
    clusters = {c: 1 << (len(sources) + k) for k, c in enumerate(repeated)}
    whole, rest = [], []
    for key, row, size, source, cluster in zip(frame["id"], frame["row"], frame["size"], frame["source"], frame["cluster"], strict=True):
        full = size // capacity
        whole += [(key, row, p, p * capacity, capacity, source) for p in range(full)]
        if size % capacity or not full:
            rest.append((key, row, full, full * capacity, size % capacity, source, sources[source] | clusters.get(cluster, 0)))
    rest.sort(key=lambda r: -r[4])
    bins = best_fit([r[4] for r in rest], [r[6] for r in rest], capacity)
    after = max(bins, default=-1) + 1
    pieces = [(*r[:6], b) for r, b in zip(rest, bins, strict=True)] + [(*w, after + k) for k, w in enumerate(whole)]
    return pd.DataFrame(pieces, columns=["id", "row", "piece", "start", "size", "source", "bin"])


def pack_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", cluster: Column | None = None, capacity: int = CAPACITY, shard_docs: int = SHARD_DOCS) -> DataFrame:
    """One row per piece: (bin_id, id, row_no, piece, start, size, source), start and size in words.

    No bin holds more than capacity words, two documents of one source, or two of one duplicate cluster. cluster: a
    column of df that names it, by default the hash of the text, so exact copies and repeated rows never share a bin.
    Documents longer than a bin are cut: whole bins of their own, and the rest is packed like any other; nothing is
    dropped. Texts without words take a bin's bits but no room. A null text is empty, a null source a source of its
    own, a null id stays null. row_no tells repeated rows apart. Rows are packed in descending size, ties by row_no. An empty table gives an empty result; extra columns are ignored.
    """
    own = cluster if cluster is not None else F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    source = F.coalesce(F.concat(F.lit("s"), F.col(source_col)), F.lit("n"))
    slim = df.select(F.col(id_col).alias("id"), word_count(F.col(text_col)).alias("size"), source.alias("source"), own.alias("cluster"))
    slim = settle(slim.withColumn("row", F.monotonically_increasing_id()), "sizes")
    shards = max(1, -(-slim.count() // shard_docs))
    slim = slim.withColumn("shard", F.pmod(F.xxhash64("row"), F.lit(shards)))
    kind = dict(slim.dtypes)["id"]

    def pack(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        return pack_shard(frame, capacity).assign(shard=key[0])

    # the identifier passes as text, so that neither size nor nulls change it
    packed = slim.withColumn("id", F.col("id").cast("string")).groupBy("shard").applyInPandas(pack, "id string, row bigint, piece int, start bigint, size bigint, source string, bin bigint, shard bigint")
    return packed.select((F.col("bin") * shards + F.col("shard")).alias("bin_id"), F.col("id").cast(kind).alias(id_col), F.col("row").alias("row_no"), "piece", "start", "size", F.when(F.col("source") != "n", F.substring("source", 2, 1 << 30)).alias(source_col))
