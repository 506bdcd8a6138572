"""SimHash near-dedup with pivot distance tables.

1. Every text becomes a 64-bit fingerprint; equal fingerprints are one class with its smallest identifier.
2. Fingerprints that differ in at most four bits agree on at least two of six blocks of their bits, so each class is
   dealt to fifteen keys, one for each pair of blocks. The rows of a key are neighbours after a sort; no pair is
   missed, and no key holds more than the classes that share some 21 bits.
3. Inside a key, each fingerprint's Hamming distances to PIVOTS fixed reference fingerprints are tabulated once. By
   the triangle inequality a pair whose coordinates differ by more than the limit anywhere is discarded; survivors
   are verified by their differing bits. A fingerprint is compared only with those it is not yet linked to, and a
   link is emitted only if it joins two parts: a key of g near copies emits g - 1 links, not all pairs.
4. Links contract to components over shuffles (connected_components).

64 bits cannot tell a shingle similarity of 0.8: such pairs differ in some 4 to 16 bits, more than agreeing blocks can
search, and repeats of one passage sway them. Where a similarity is asked for, it is that of the sets of shingles, and
64 bits play no part. Equal sets are one class. Classes that share a key of smallest shingle hashes are compared by
fingerprints of WIDE bits, whose differing share follows the angle between sets closely: the pivot table discards pairs
first, by distances to rows of the same block, then their differing bits do. What is still connected is compared again by the whole sets, and only pairs that
reach the similarity link. Both comparisons meet in blocks of a bounded size (grouped_links), also in large groups.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscan.llm.common import TEXT_ROWS, connected_components, join_sized, settle, unsettle

BITS = 64
#: Reference fingerprints of the pivot table.
PIVOTS = 16
#: Shingles hashed at once; bounds the memory a very long text needs.
CHUNK = 1 << 15
#: Rows from which those of one key are dealt anew over finer keys before they are compared one by one.
LARGE_RUN = 2048
#: Rows of a batch between the sorted scan and its links.
BATCH = 1 << 16

#: Bits of the wide fingerprint, and the standard errors by which its limit exceeds the mean at the similarity.
WIDE = 2048
WIDE_ERRORS = 5
#: Shingles from which a set's wide fingerprint follows the angle; pairs with a smaller set are not discarded by it.
WIDE_LEAST = 128
#: Keys of the search by similarity, and smallest hashes in one: at 0.8 all keys miss 3 pairs of 1,000,000.
BANDS, ROWS = 32, 5
#: Classes of a group that are compared in one place; larger groups are dealt over blocks of half as many.
LARGE_GROUP = 256


def _made(label: str, n: int) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(f"{label} {i}", 0) for i in range(n)], dtype=np.uint64)


_REFERENCES = _made("pivot", PIVOTS)[:, None]
_SHIFTS = _made("shift", WIDE // BITS)
_FACTORS = _made("factor", BANDS * ROWS) | np.uint64(1)


def shingle_hashes(text: str | None, words: int, seed: int = 42) -> Iterator[np.ndarray]:
    """XXH64 of the text's shingles in order, in chunks: A-Z lower-cased, ASCII white space splits words. Fewer words
    than a shingle are one shingle, none give nothing."""
    tokens = text.encode("utf-8").lower().split() if text else []
    if not tokens:
        return
    joined, digest = b" ".join(tokens), xxhash.xxh64_intdigest
    words = min(words, len(tokens))
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1)
    starts = np.concatenate(([0], ends[:-1]))[: len(tokens) - words + 1]
    stops = ends[words - 1 :] - 1
    for at in range(0, len(starts), CHUNK):
        spans = zip(starts[at : at + CHUNK].tolist(), stops[at : at + CHUNK].tolist(), strict=True)
        yield np.array([digest(joined[a:b], seed) for a, b in spans], dtype="<u8")


def _votes(hashes: np.ndarray) -> np.ndarray:
    """How many rows of hashes (rows, words) set each bit."""
    total, octets = np.zeros(hashes.shape[1] * BITS, np.int64), np.ascontiguousarray(hashes).view(np.uint8)
    for at in range(0, len(octets), 255):  # so many fit the sums of one octet
        total += np.add.reduce(np.unpackbits(octets[at : at + 255], axis=1, bitorder="little"), axis=0, dtype=np.uint8)
    return total


def fingerprint(text: str | None, words: int = 4, seed: int = 42) -> int:
    """The text's fingerprint as an unsigned integer: a bit is set if it is set in over half of the shingles' hashes;
    0 without words."""
    return _hashed(text, words, seed, False)[0]


def _hashed(text: str | None, words: int, seed: int = 42, distinct: bool = True) -> tuple[int, np.ndarray]:
    """The fingerprint and, if asked for, the sorted distinct shingle hashes, in one pass over the text."""
    votes, n, parts = np.zeros(BITS, np.int64), 0, [np.zeros(0, np.uint64)]
    for hashes in shingle_hashes(text, words, seed):
        votes += _votes(hashes[:, None])
        n += len(hashes)
        if distinct:
            parts.append(np.unique(hashes))
    return int(np.packbits(votes * 2 > n, bitorder="little").view("<u8")[0]), np.unique(np.concatenate(parts))


def shingle_set(text: str | None, words: int, seed: int = 42) -> np.ndarray:
    """The text's distinct shingle hashes, sorted."""
    return np.unique(np.concatenate([np.zeros(0, np.uint64), *(np.unique(h) for h in shingle_hashes(text, words, seed))]))


def wide_keys(once: np.ndarray) -> tuple[bytes, np.ndarray]:
    """(wide fingerprint, keys) of a set of shingle hashes: WIDE bits, each set if it is set in over half of the hashes
    mixed anew, and BANDS keys of ROWS smallest hashes each. An empty set has zeros."""
    wide, least = np.zeros(WIDE, np.int64), np.zeros(BANDS * ROWS, np.uint64)
    for at in range(0, len(once), 2040):
        z = once[at : at + 2040, None] ^ _SHIFTS
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        wide += _votes(z ^ (z >> np.uint64(31)))
    keys = [0] * BANDS
    if len(once):
        for k, factor in enumerate(_FACTORS):
            least[k] = (once * factor).min()
        keys = [xxhash.xxh64_intdigest(row.tobytes(), 0) for row in least.reshape(BANDS, ROWS)]
    return np.packbits(wide * 2 > len(once), bitorder="little").tobytes(), np.array(keys, np.uint64).view(np.int64)


def wide_sketch(text: str | None, words: int = 5, seed: int = 42) -> tuple[int, bytes, np.ndarray]:
    """(fingerprint, wide fingerprint, keys) of a text; only the first counts repeated shingles."""
    fp, once = _hashed(text, words, seed)
    return fp, *wide_keys(once)


def wide_limit(similarity: float) -> int:
    """Differing bits of the wide fingerprint up to which texts of that similarity (shared among all shingles) are
    found: the angle of sets of equal size, which is the widest, and WIDE_ERRORS standard errors."""
    share = math.acos(2 * similarity / (1 + similarity)) / math.pi
    return int(WIDE * share + WIDE_ERRORS * math.sqrt(WIDE * share * (1 - share)))


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4) -> DataFrame:
    """(id, fp): one row per row of df, fp the fingerprint's 64 bits as BIGINT. Null text counts as empty."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                fps = np.array([fingerprint(t, words) for t in part.column(1).to_pylist()], dtype=np.uint64)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(fps.view(np.int64))], names=["id", "fp"])

    slim = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("body"))
    return slim.mapInArrow(scan, f"id {dict(slim.dtypes)['id']}, fp bigint")


def wide_fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5) -> DataFrame:
    """(id, body, fp, class, size, wide, keys): fingerprints() with the hashes of the text and of its set of shingles,
    the size of the set, its wide fingerprint and its keys."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                texts = part.column(2).to_pylist()
                fps, sets = zip(*[_hashed(t, words) for t in texts], strict=True)
                wide, keys = zip(*[wide_keys(s) for s in sets], strict=True)
                signed = lambda v: pa.array(np.array(v, np.uint64).view(np.int64))
                columns = [part.column(0), part.column(1), signed(fps), signed([xxhash.xxh3_64_intdigest(s.tobytes()) for s in sets]), pa.array([len(s) for s in sets], pa.int32()), pa.array(wide, pa.binary()), pa.array(list(keys), pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "body", "fp", "class", "size", "wide", "keys"])

    slim = df.select(F.col(id_col).alias("id"), body_hash(text_col).alias("body"), F.col(text_col).alias("text"))
    return slim.mapInArrow(scan, f"id {dict(slim.dtypes)['id']}, body bigint, fp bigint, class bigint, size int, wide binary, keys array<bigint>")


def body_hash(text_col: str) -> Column:
    """The hash that names a whole text; null counts as empty."""
    return F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))


def block_masks(blocks: int) -> list[int]:
    """Masks of `blocks` runs of bits that cover the fingerprint, as even as can be."""
    edges = [i * BITS // blocks for i in range(blocks + 1)]
    return [((1 << b) - (1 << a)) for a, b in zip(edges, edges[1:], strict=False)]


def key_masks(limit: int, blocks: int) -> list[int]:
    """One mask for each choice of the blocks - limit blocks that a pair within `limit` bits must agree on."""
    return [sum(chosen) for chosen in combinations(block_masks(blocks), blocks - limit)]


class _Parts:
    """Union-find over positions, from single ones or from parts that are linked already."""

    def __init__(self, n: int, known: np.ndarray | None = None) -> None:
        self.root = np.arange(n) if known is None else np.unique(known, return_inverse=True)[1].reshape(-1)
        self.parts = len(np.unique(self.root))

    def join(self, i: int, found: np.ndarray) -> list[int]:
        """Link i with the positions found; returns one position for each part that was not yet i's."""
        new = []
        for part in np.unique(self.root[found]).tolist():
            if part != self.root[i]:
                new.append(int(found[np.argmax(self.root[found] == part)]))
        if new:
            self.root[np.isin(self.root, self.root[new])] = self.root[i]
            self.parts -= len(new)
        return new


def _differ(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Differing bits of fingerprints whose words are the last axis."""
    return np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int16)


def _compare(fps: np.ndarray, where: np.ndarray, parts: _Parts, limit: int, out: list) -> None:
    """Link the rows `where` of one key by pivot filter and verification."""
    own = fps[where, None]
    table = np.column_stack([_differ(own, r) for r in _REFERENCES])
    for k in range(len(own) - 1):
        rest = np.nonzero(parts.root[where] != parts.root[where[k]])[0]
        if not len(rest):
            return
        rest = rest[np.abs(table[rest] - table[k]).max(axis=1) <= limit]
        rest = rest[_differ(own[rest], own[k]) <= limit]
        if len(rest):
            out.extend((fps[where[k]], fps[j]) for j in parts.join(int(where[k]), where[rest]))


def _wide_rest(k: int, rest: np.ndarray, sizes: np.ndarray, wide: np.ndarray, table: np.ndarray, similarity: float, limit: int) -> np.ndarray:
    """Those of rest that the sizes, the pivot table and the wide fingerprints leave as partners of k. The last two do
    not tell sets of fewer than WIDE_LEAST shingles."""
    rest = rest[np.minimum(sizes[rest], sizes[k]) >= similarity * np.maximum(sizes[rest], sizes[k]) - 1e-9]
    if sizes[k] >= WIDE_LEAST:
        rest = rest[(sizes[rest] < WIDE_LEAST) | (np.abs(table[rest] - table[k]).max(axis=1) <= limit)]
        rest = rest[(sizes[rest] < WIDE_LEAST) | (_differ(wide[rest], wide[k]) <= limit)]
    return rest


def _pivot_table(wide: np.ndarray) -> np.ndarray:
    """Distances to PIVOTS of the rows. References from outside are about equally far from all wide fingerprints; rows
    of the same block tell its clusters apart."""
    return np.column_stack([_differ(wide, wide[k]) for k in np.linspace(0, len(wide) - 1, min(PIVOTS, len(wide))).astype(int)])


def link_wide(classes: np.ndarray, parts: _Parts, sizes: np.ndarray, wide: np.ndarray, similarity: float) -> list[tuple[int, int]]:
    """Links that join all of classes that are connected by pairs which the wide fingerprints cannot tell to be below
    the similarity."""
    out, limit = [], wide_limit(similarity)
    table = _pivot_table(wide)
    for k in range(len(classes) - 1):
        rest = np.nonzero(parts.root != parts.root[k])[0]
        if not len(rest):
            break
        rest = _wide_rest(k, rest, sizes, wide, table, similarity, limit)
        if len(rest):
            out.extend((classes[k], classes[j]) for j in parts.join(k, rest))
    return out


def link_sets(classes: np.ndarray, parts: _Parts, wide: np.ndarray, sets: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """Links that join all of classes that are connected by pairs whose sets have at least the similarity."""
    out, limit = [], wide_limit(similarity)
    sizes = np.array([len(s) for s in sets])
    stops = np.cumsum(sizes)
    starts = stops - sizes
    codes = np.unique(np.concatenate(sets), return_inverse=True)[1].reshape(-1)
    mark = np.zeros(codes.max(initial=0) + 1, bool)
    table = _pivot_table(wide)
    for k in range(len(sets) - 1):
        rest = np.nonzero(parts.root != parts.root[k])[0]
        if not len(rest):
            break
        rest = _wide_rest(k, rest, sizes, wide, table, similarity, limit)
        if not len(rest):
            continue
        mark[codes[starts[k] : stops[k]]] = True
        common = np.array([np.count_nonzero(mark[codes[starts[j] : stops[j]]]) for j in rest])
        mark[codes[starts[k] : stops[k]]] = False
        rest = rest[common >= similarity * (sizes[rest] + sizes[k] - common) - 1e-9]
        if len(rest):
            out.extend((classes[k], classes[j]) for j in parts.join(k, rest))
    return out


def link_run(fps: np.ndarray, limit: int, known: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links that join all of fps (distinct, one key) that are connected by pairs within `limit` bits; known: the parts
    that they belong to already."""
    parts, out = _Parts(len(fps), known), []
    if len(fps) > LARGE_RUN:
        for mask in key_masks(limit, 2 * limit):
            keys = fps & np.uint64(mask)
            order = np.argsort(keys, kind="stable")
            cuts = np.nonzero(np.diff(keys[order]))[0] + 1
            for where in np.split(order, cuts):
                if len(where) > 1 and parts.parts > 1:
                    _compare(fps, where, parts, limit, out)
    else:
        _compare(fps, np.arange(len(fps)), parts, limit, out)
    return out


def _whole_runs(batches: Iterator[list[np.ndarray]]) -> Iterator[list[np.ndarray]]:
    """Columns of batches sorted by the first two, cut anew so that no run of equal keys is divided."""
    held: list[list[np.ndarray]] = []
    for new in batches:
        if not len(new[0]):
            continue
        if held and new[0][-1] == held[-1][0][-1] and new[1][-1] == held[-1][1][-1]:
            held.append(new)  # the whole batch may continue the run that is held
            continue
        full = [np.concatenate(c) for c in zip(*held, new, strict=True)]
        other = np.nonzero((full[0] != full[0][-1]) | (full[1] != full[1][-1]))[0]
        cut = int(other[-1]) + 1 if len(other) else 0
        held = [[c[cut:] for c in full]]
        if cut:
            yield [c[:cut] for c in full]
    if held:
        yield [np.concatenate(c) for c in zip(*held, strict=True)]


def _run_starts(no: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Where runs of equal keys start, and the end of the last."""
    return np.concatenate(([0], np.nonzero((np.diff(key) != 0) | (np.diff(no) != 0))[0] + 1, [len(key)]))


def _emit(pairs: list) -> pa.RecordBatch:
    got = np.array(pairs, dtype=np.uint64).reshape(-1, 2).view(np.int64)
    return pa.RecordBatch.from_arrays([pa.array(got[:, 0].copy()), pa.array(got[:, 1].copy())], names=["a", "b"])


def _compare_bits(limit: int):
    def columns(b: pa.RecordBatch) -> list[np.ndarray]:
        run, fps, part = (b.column(i).to_numpy(zero_copy_only=False) for i in range(3))
        return [run, run, fps, part]

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run, _, fps, part in _whole_runs(columns(b) for b in batches if b.num_rows):
            fps, starts = fps.view(np.uint64), _run_starts(run, run)
            sizes = np.diff(starts)
            twos = starts[:-1][sizes == 2]
            twos = twos[part[twos] != part[twos + 1]]
            a, b = fps[twos], fps[twos + 1]
            near = np.ones(len(a), bool)
            for ref in _REFERENCES[:, 0]:
                near &= np.abs(np.bitwise_count(a ^ ref).astype(np.int8) - np.bitwise_count(b ^ ref).astype(np.int8)) <= limit
            a, b = a[near], b[near]
            near = np.bitwise_count(a ^ b) <= limit
            out = list(zip(a[near].tolist(), b[near].tolist(), strict=True))
            for at in np.nonzero(sizes > 2)[0].tolist():
                s = slice(starts[at], starts[at + 1])
                out += link_run(fps[s], limit, part[s])
            if out:
                yield _emit(out)

    return link


def _compare_wide(similarity: float):
    limit = wide_limit(similarity)

    def columns(b: pa.RecordBatch) -> list[np.ndarray]:
        run, classes, part, size = (b.column(i).to_numpy(zero_copy_only=False) for i in range(4))
        return [run, run, classes, part, size, np.frombuffer(b"".join(b.column(4).to_pylist()), "<u8").reshape(len(run), -1)]

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run, _, classes, part, size, wide in _whole_runs(columns(b) for b in batches if b.num_rows):
            classes, starts = classes.view(np.uint64), _run_starts(run, run)
            sizes = np.diff(starts)
            a = starts[:-1][(sizes == 2)]  # by far the most runs are pairs: all of them at once
            a = a[(part[a] != part[a + 1]) & (np.minimum(size[a], size[a + 1]) >= similarity * np.maximum(size[a], size[a + 1]) - 1e-9)]
            told = np.minimum(size[a], size[a + 1]) >= WIDE_LEAST
            a = a[(_differ(wide[a], wide[a + 1]) <= limit) | ~told]  # to each other they are the pivots
            out = list(zip(classes[a].tolist(), classes[a + 1].tolist(), strict=True))
            for at in np.nonzero(sizes > 2)[0].tolist():
                s = slice(starts[at], starts[at + 1])
                out += link_wide(classes[s], _Parts(s.stop - s.start, part[s]), size[s].astype(np.int64), wide[s], similarity)
            if out:
                yield _emit(out)

    return link


def _compare_sets(similarity: float, words: int):
    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def done() -> list[tuple[int, int]]:
            rows = pa.Table.from_batches(held)
            if rows.num_rows < 2:
                return []
            classes, part = rows.column(1).to_numpy().view(np.uint64), rows.column(2).to_numpy()
            wide = np.frombuffer(b"".join(rows.column(4).to_pylist()), "<u8").reshape(len(part), -1)
            return link_sets(classes, _Parts(len(part), part), wide, [shingle_set(t, words) for t in rows.column(5).to_pylist()], similarity)

        for batch in batches:
            run = batch.column(0).to_numpy(zero_copy_only=False)
            cuts = np.concatenate(([0], np.nonzero(np.diff(run))[0] + 1, [len(run)])).tolist()
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a == b:
                    continue
                if held and held[0].column(0)[0].as_py() != run[a]:
                    if out := done():
                        yield _emit(out)
                    held = []
                held.append(batch.slice(a, b - a))
        if held and (out := done()):
            yield _emit(out)

    return link


def grouped_links(rows: DataFrame, facts: DataFrame | None, compare) -> DataFrame:
    """(a, b): links that join, in every group, the classes that compare connects; no pair of a group is left out.

    rows(no, key, class, n): the groups' members with the size of their group. facts: one row per class with what
    compare reads behind (run, class, part), if anything. Groups of up to LARGE_GROUP members meet in one task. Larger ones are dealt over
    blocks first, and most of a group of copies is one part then. Where parts remain, the members outside the largest
    part, in blocks, meet every block of the group once more. So a task holds two blocks at most, a group of copies
    costs about its size, and only a group whose members do not link costs the square of its blocks.
    """
    half = max(1, LARGE_GROUP // 2)
    names = [c for c in facts.columns if c != "class"] if facts else []

    def compared(dealt: DataFrame) -> DataFrame:
        runs = (dealt.join(facts, "class") if facts else dealt).select("run", "class", "part", *names)
        return settle(runs.repartition("run").sortWithinPartitions("run", "class").mapInArrow(compare, "a bigint, b bigint").distinct(), "links", TEXT_ROWS if "text" in names else None)

    blocks = F.when(F.col("n") <= LARGE_GROUP, F.lit(1)).otherwise(F.ceil(F.col("n") / half)).cast("bigint")
    # a run is told by a hash; if two runs shared one, more pairs would be compared
    first = rows.select(F.xxhash64("no", "key", F.pmod(F.xxhash64("class", "no"), blocks)).alias("run"), "class", F.col("class").alias("part"))
    links = compared(first)
    wide = rows.where(F.col("n") > LARGE_GROUP)
    if wide.isEmpty():
        return links
    nodes = connected_components(links).withColumnRenamed("node", "class").withColumnRenamed("root", "part")
    wide = settle(wide.join(nodes, "class", "left").withColumn("part", F.coalesce("part", "class")), "wide")
    parts = wide.groupBy("no", "key", "part").agg(F.count("*").alias("c"))
    groups = parts.groupBy("no", "key").agg(F.sum("c").alias("n"), F.max(F.struct("c", "part")).alias("most"), F.count("*").alias("parts")).where("parts > 1")
    ceil = lambda c: F.ceil(c / half).cast("bigint")
    groups = groups.select("no", "key", "n", F.col("most.part").alias("main"), ceil(F.col("most.c")).alias("mains"), ceil(F.col("n") - F.col("most.c")).alias("others"))
    rest = join_sized(wide.drop("n"), groups, ["no", "key"], wide.count())
    upto = lambda n: F.sequence(F.lit(0).cast("bigint"), n - 1)
    at = F.xxhash64("class", "no", F.lit(1))
    main_at, other_at = F.pmod(at, F.col("mains")), F.pmod(at, F.col("others"))
    cell = lambda kind, i, j: F.struct(F.lit(kind).alias("kind"), i.alias("i"), j.alias("j"))
    as_main = F.transform(upto(F.col("others")), lambda j: cell(0, main_at, j))
    as_other = F.concat(F.transform(upto(F.col("mains")), lambda i: cell(0, i, other_at)), F.transform(upto(F.col("others")), lambda j: cell(1, F.least(j, other_at), F.greatest(j, other_at))))
    cells = rest.withColumn("cell", F.explode(F.when(F.col("part") == F.col("main"), as_main).otherwise(as_other)))
    second = cells.select(F.xxhash64("no", "key", "cell").alias("run"), "class", "part")
    return links.unionByName(compared(second)).distinct()


def near_links(classes: DataFrame, limit: int = 4, blocks: int = 6) -> DataFrame:
    """(a, b): links between distinct fingerprints fp of classes that join every group connected within `limit` bits."""
    masks = key_masks(limit, blocks)
    signed = [m - (1 << BITS) if m >= 1 << (BITS - 1) else m for m in masks]
    keys = F.array(*[F.struct(F.lit(i).cast("bigint").alias("no"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for i, m in enumerate(signed)])
    dealt = classes.select(F.col("fp").alias("class"), F.explode(keys).alias("k")).select(F.col("k.no").alias("no"), F.col("k.key").alias("key"), "class")
    return grouped_links(shared_keys(dealt, classes.count() * len(masks)), None, _compare_bits(limit))


def shared_keys(dealt: DataFrame, total: int) -> DataFrame:
    """The rows (no, key, class) of dealt, total in number, whose key others have too, with the key's size n."""
    counts = dealt.groupBy("no", "key").agg(F.count("*").alias("n")).where("n > 1")
    return settle(join_sized(dealt, counts, ["no", "key"], total), "shared")


def similar_links(docs: DataFrame, id_col: str, text_col: str, classes: DataFrame, similarity: float, words: int) -> DataFrame:
    """(a, b): links that join every group of classes(class, one, size, wide, keys) connected by pairs that share a key
    and whose sets of shingles have at least the similarity; one names a row of docs by identifier and text."""
    dealt = classes.select("class", F.posexplode("keys").alias("no", "key")).select(F.col("no").cast("bigint").alias("no"), "key", "class")
    shared = shared_keys(dealt, classes.count() * BANDS)
    near = connected_components(grouped_links(shared, classes.select("class", "size", "wide"), _compare_wide(similarity)))
    near = settle(near.withColumnRenamed("node", "class"), "near")
    sizes = near.groupBy("root").agg(F.count("*").alias("n"))
    groups = join_sized(near, sizes, ["root"], near.count()).select(F.lit(0).cast("bigint").alias("no"), F.col("root").alias("key"), "class", "n")
    # one text for each class that is left: that of its first row, or of equal ones
    wanted = near.select("class").join(classes, "class").select("class", "size", "wide", F.col("one.id").alias("_id"), F.col("one.body").alias("_body"))
    texts = docs.select(F.col(id_col).alias("_id"), body_hash(text_col).alias("_body"), F.col(text_col).alias("text"))
    found = texts.join(wanted, texts["_id"].eqNullSafe(wanted["_id"]) & (texts["_body"] == wanted["_body"]))
    facts = settle(found.select("class", "size", "wide", "text").dropDuplicates(["class"]), "facts")
    links = grouped_links(settle(groups, "groups"), facts, _compare_sets(similarity, words))
    unsettle(shared)
    return links


def simhash_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, limit: int = 4, blocks: int = 6, similarity: float | None = None) -> DataFrame:
    """One row per row of df: (id, fp, component_id), component_id the smallest id of the group.

    Groups are connected by pairs of fingerprints that differ in at most `limit` bits; equal fingerprints are one
    class. With a similarity, groups are connected by pairs of texts with at least that share of common shingles among
    all of both instead, repeats not counted; limit and blocks have no part then. Null and empty texts, and texts of white space, have fingerprint 0 and link like any other. Rows that
    repeat an id get a row each. A null id takes part and belongs to its group, but names a group only where it has
    no other id. An empty table gives an empty result; extra columns are ignored.
    """
    first = [F.min("id").alias("first_id"), F.count("*").alias("n")]
    if similarity is None:
        prints, by = settle(fingerprints(df, id_col, text_col, words), "prints", TEXT_ROWS), "fp"
        classes = settle(prints.groupBy("fp").agg(*first), "classes")
        links = near_links(classes, limit, blocks)
    else:
        prints, by = settle(wide_fingerprints(df, id_col, text_col, words), "prints", TEXT_ROWS), "class"
        facts = settle(prints.groupBy("class").agg(*first, F.min(F.struct("id", "body")).alias("one"), F.first("size").alias("size"), F.first("wide").alias("wide"), F.first("keys").alias("keys")), "classes")
        links = similar_links(df, id_col, text_col, facts, similarity, words)
        prints, classes = prints.select("id", "fp", "class"), facts.select("class", "first_id", "n")
    nodes = connected_components(links)
    # what is linked to nothing names itself; the others learn the smallest identifier of their root
    joined = settle(classes.join(nodes.withColumnRenamed("node", by), by, "left"), "named")
    linked = joined.where("root IS NOT NULL")
    roots = linked.groupBy("root").agg(F.min("first_id").alias("component_id"), F.count("*").alias("members"))
    named = join_sized(linked, roots, ["root"], linked.count(), "members").select(by, "component_id", "n")
    named = named.unionByName(joined.where("root IS NULL").select(by, F.col("first_id").alias("component_id"), "n"))
    return join_sized(prints, named, [by], prints.count()).select(F.col("id").alias(id_col), "fp", "component_id")


def drop_near_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, limit: int = 4, blocks: int = 6, similarity: float | None = 0.8) -> DataFrame:
    """df without the documents whose group has a smaller id; all columns stay.

    Rows that repeat an id are one document and stay or go together; rows with a null id stay.
    """
    groups = simhash_groups(df, id_col, text_col, words, limit, blocks, similarity)
    gone = groups.where(F.col(id_col) != F.col("component_id")).select(F.col(id_col).alias("_gone")).distinct()
    return df.join(gone, df[id_col] == gone["_gone"], "left_anti")
