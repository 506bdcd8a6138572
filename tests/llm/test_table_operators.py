"""Exact dedup, mixing, packing, chat and vector search against plain-Python versions and on awkward rows."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioscan.llm import chat, exact_dedup, mixing, packing, vector_search

DOCS = "doc_id long, text string, source string, id long, size string, h int, salt int, body string, key double, bin int, row long, shard int, s string"


def docs(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", 1, 1, "x", 1.0, 1, 1, 1, "x") for r in rows], DOCS)


AWKWARD = [(1, "a b c", "s"), (1, "a b c", "s"), (2, None, None), (3, "", "t"), (None, "a b c", None), (4, " \t\n", "t"), (5, "word " * 30000, "u"), (6, "a b c ", "u"), (7, "é" * 50, None)]


# --- exact dedup ---------------------------------------------------------------------------------------------------


def brute_dedup(rows, keep):
    groups = defaultdict(list)
    for r in rows:
        groups[r[1] or ""].append(r[0])
    out = []
    for text, ids in groups.items():
        known = [i for i in ids if i is not None]
        kept = (max if keep == "max" else min)(known) if known else None
        sha = hashlib.sha256(text.encode()).hexdigest()
        first = True
        for i in ids:
            out.append((i, kept, len(ids), i == kept and first, sha))
            first = first and i != kept
    return Counter(out)


@pytest.mark.parametrize("keep", ["min", "max"])
def test_exact_dedup(spark, keep):
    r = random.Random(4)
    rows = AWKWARD + [(100 + k, r.choice(["x" * 40 + r.choice("abc"), "hot", "hot", str(k)]), "s") for k in range(400)]
    got = exact_dedup.exact_dedup(docs(spark, rows), keep=keep)
    assert Counter(tuple(x) for x in got.collect()) == brute_dedup(rows, keep)
    assert exact_dedup.exact_dedup(docs(spark, []), keep=keep).count() == 0
    plan = got._jdf.queryExecution().toString()
    assert "rangepartitioning" in plan and "Python" not in plan and "Arrow" not in plan


@pytest.mark.parametrize("keep", ["min", "max"])
def test_exact_dedup_of_one_row_repeated(spark, keep):
    rows = [(7, "the same", "s")] * 900 + [(None, "nobody", "s")] * 900 + [(k, str(k), "s") for k in range(900)]
    got = exact_dedup.exact_dedup(docs(spark, rows).repartition(6), keep=keep)
    assert Counter(tuple(x) for x in got.collect()) == brute_dedup(rows, keep)
    dealt = exact_dedup.exact_dedup(docs(spark, rows), keep=keep)._jdf.queryExecution().toString()
    assert "row#" in dealt  # salts come from rows, not from identifiers


def test_exact_dedup_parameters(spark):
    with pytest.raises(ValueError):
        exact_dedup.exact_dedup(docs(spark, AWKWARD), keep="first")
    folded = exact_dedup.exact_dedup(docs(spark, [(1, "A", "s"), (2, "a", "s")]), normalise=lambda t: F.lower(F.coalesce(t, F.lit(""))))
    assert {(x.doc_id, x.kept) for x in folded.collect()} == {(1, True), (2, False)}


# --- mixing --------------------------------------------------------------------------------------------------------


def fill(sizes, weights, cap):
    """Targets by repeating the reshare until no source is above its cap."""
    total, fixed = sum(sizes.values()), {}
    while True:
        free = [s for s in sizes if s not in fixed]
        if not free:
            return fixed
        level = (total - sum(fixed.values())) / sum(weights[s] for s in free)
        over = [s for s in free if weights[s] * level > cap * sizes[s] + 1e-9]
        if not over:
            return fixed | {s: weights[s] * level for s in free}
        fixed |= {s: cap * sizes[s] for s in over}


def test_targets(spark):
    r = random.Random(9)
    for _ in range(3):
        sizes = {f"s{k}": r.choice([0, 3, 50, 1000, 40000]) for k in range(r.randint(1, 9))}
        names = sorted(sizes)
        want = fill(sizes, {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}, 3) if sum(sizes.values()) else dict.fromkeys(sizes, 0)
        got = mixing.source_targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()
        assert {x.source: x.target for x in got} == pytest.approx(want)


def test_mix(spark):
    r = random.Random(1)
    rows = [(k, "w " * r.randint(0, 60), r.choice(["a", "a", "a", "b", "c", "d", None])) for k in range(1500)]
    got = mixing.mix_sources(docs(spark, rows)).collect()
    again = {x.doc_id: x.copies for x in mixing.mix_sources(docs(spark, rows[::-1])).collect()}
    assert len(got) == 1500 and again == {x.doc_id: x.copies for x in got}
    source, text = {x[0]: x[2] for x in rows}, {x[0]: x[1] for x in rows}
    by = defaultdict(list)
    for x in got:
        assert x.size == len(text[x.doc_id].split()) and x.taken == x.copies * x.size <= 3 * x.size
        by[source[x.doc_id]].append(x)
    sizes = {s: sum(x.size for x in xs) for s, xs in by.items()}
    names = sorted((s for s in sizes if s is not None)) + [None]
    want = fill(sizes, {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}, 3)
    for s, xs in by.items():
        assert xs[0].target == pytest.approx(want[s]) and xs[0].source_size == sizes[s]
        assert abs(sum(x.taken for x in xs) - want[s]) <= 60
        epochs = {x.copies for x in xs if x.size}
        assert max(epochs) - min(epochs) <= 1


def test_heavier_documents_come_first(spark):
    rows = [(k, "w", "a" if k % 2 else "b") for k in range(4000)]
    weight = F.when(F.col("doc_id") % 4 < 2, 4.0).otherwise(1.0)
    got = mixing.mix_sources(docs(spark, rows), quality=weight).collect()
    part = [x for x in got if x.doc_id % 2 == 0]
    share = lambda heavy: sum(x.copies for x in part if (x.doc_id % 4 < 2) == heavy)
    assert share(True) > 1.5 * share(False)


def test_mix_spreads_low_weights_and_repeats(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BIN_ROWS", 100)
    rows = [(k, "12 34 56", "a") for k in range(3000)] + [(None, "w w", "a")] * 1500 + [(5000 + k, "word", f"b{k % 7}") for k in range(500)]
    got = mixing.mix_sources(docs(spark, rows)).collect()
    assert len(got) == 5000
    sizes = {"a": 12000, **{f"b{k}": sum(1 for j in range(500) if j % 7 == k) for k in range(7)}}
    want = fill(sizes, {s: (5, 2, 1)[k % 3] for k, s in enumerate(sorted(sizes))}, 3)
    taken = sum(x.taken for x in got if x.doc_id is None or x.doc_id < 5000)
    assert abs(taken - want["a"]) <= 3
    again = mixing.mix_sources(docs(spark, rows[::-1])).collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, again))


def test_mix_awkward(spark):
    got = mixing.mix_sources(docs(spark, AWKWARD)).collect()
    assert len(got) == len(AWKWARD) and all(x.taken <= 3 * x.size and not math.isnan(x.target) for x in got)
    assert mixing.mix_sources(docs(spark, [])).count() == 0
    assert [x.taken for x in mixing.mix_sources(docs(spark, [(1, None, "a"), (2, "", "b")])).collect()] == [0, 0]


# --- packing -------------------------------------------------------------------------------------------------------


def test_best_fit_is_tightest():
    r = random.Random(8)
    for _ in range(60):
        capacity = r.randint(5, 40)
        n = r.randint(1, 60)
        sizes = sorted((r.randint(0, capacity) for _ in range(n)), reverse=True)
        bits = [1 << r.randrange(4) | r.choice([0, 1 << (4 + r.randrange(3))]) for _ in range(n)]
        got = packing.best_fit(sizes, bits, capacity)
        room, held = {}, {}
        for size, own, bin_no in zip(sizes, bits, got, strict=True):
            fits = [b for b in room if room[b] >= size and not held[b] & own]
            if fits:
                assert bin_no in fits and room[bin_no] == min(room[b] for b in fits)
            else:
                assert bin_no not in room
            room[bin_no] = room.get(bin_no, capacity) - size
            held[bin_no] = held.get(bin_no, 0) | own


def check_bins(rows, pieces, capacity):
    text = defaultdict(list)
    for r in rows:
        text[r[0]].append(r[1] or "")
    words = defaultdict(int)
    for p in pieces:
        words[p.bin_id] += p.size
    assert max(words.values()) <= capacity
    for b, n in Counter((p.bin_id, p.source) for p in pieces).items():
        assert n == 1, b
    by_row = defaultdict(list)
    for p in pieces:
        by_row[p.row_no].append(p)
    assert len(by_row) == len(rows)
    assert Counter((ps[0].doc_id, sum(p.size for p in ps)) for ps in by_row.values()) == Counter((r[0], len((r[1] or "").split())) for r in rows)
    for ps in by_row.values():
        ps.sort(key=lambda p: p.piece)
        assert [p.piece for p in ps] == list(range(len(ps))) and all(a.start + a.size == b.start for a, b in zip(ps, ps[1:], strict=False))


def test_packing(spark):
    r = random.Random(6)
    rows = [(k, "w " * r.choice([0, 3, 20, 64, 65, 200]), r.choice("aaabcdefgh")) for k in range(900)]
    pieces = packing.pack_documents(docs(spark, rows), capacity=64, shard_docs=300).collect()
    check_bins(rows, pieces, 64)
    text = {x[0]: x[1] for x in rows}
    per_bin = defaultdict(set)
    for p in pieces:
        if p.piece == len(text[p.doc_id].split()) // 64:
            assert (text[p.doc_id]) not in per_bin[p.bin_id]
            per_bin[p.bin_id].add(text[p.doc_id])


def test_packing_awkward(spark):
    check_bins(AWKWARD, packing.pack_documents(docs(spark, AWKWARD)).collect(), packing.CAPACITY)
    assert packing.pack_documents(docs(spark, [])).count() == 0


# --- chat ----------------------------------------------------------------------------------------------------------

TURNS = [
    (1, 0, "system", "be kind"), (1, 2, "ann", "hi <|end|> bob"), (1, 1, "bob", "hello"), (1, 2, "ann", "hi <|end|> bob"), (2, 0, None, None), (2, None, "cy\"d", ""),
    (3, 0, "system", "alone"), (None, 0, "ann", "x"), (4, 5, "ann", "long " * 20000),
]


def brute_views(turns, max_turns=256):
    out = Counter()
    convs = defaultdict(list)
    guard = lambda s: re.sub(r"<(\\*)\|", r"<\\\1|", s)
    for cid, turn, role, text in turns:
        name = "unknown" if role is None else guard(role.replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n"))
        convs[cid].append((-1 if turn is None else turn, name, guard(text or "")))
    for cid, ts in convs.items():
        ts.sort()
        for who in {t[1] for t in ts} - {"system"}:
            whole = ""
            for part in range(-(-len(ts) // max_turns)):
                own, begin, mask = ts[part * max_turns : (part + 1) * max_turns], len(whole), []
                for _, name, text in own:
                    whole += "<|assistant|>\n" if name == who else "<|system|>\n" if name == "system" else f'<|user name="{name}"|>\n'
                    if name == who:
                        mask.append((len(whole), len(whole) + len(text) + 7))
                    whole += text + "<|end|>\n"
                out[(cid, part, who, len(own), len(mask), len(whole) - begin, begin, whole[begin:], tuple(mask))] += 1
    return out


def views(frame, **options):
    return Counter((*r[:8], tuple((s.start, s.stop) for s in r.mask)) for r in chat.rotate_perspectives(frame, **options).collect())


def test_chat(spark):
    rows = spark.createDataFrame([(*t, "x", 1) for t in TURNS], "conv_id long, turn long, role string, text string, part string, k long")
    assert views(rows) == brute_views(TURNS)
    assert chat.rotate_perspectives(rows.limit(0)).count() == 0
    plan = chat.rotate_perspectives(rows)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_names_and_marks_stay_apart(spark):
    turns = [(1, 0, 'a"b', "one <|user|> <\\\\|x"), (1, 1, "a'b", "two"), (1, 2, 'a\\"b', "three"), (1, 3, "a\nb", "four"), (1, 4, "a b", "five")]
    got = views(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string"))
    assert got == brute_views(turns) and len(got) == 5 and all(k[4] == 1 for k in got)
    text = next(k[7] for k in got)
    assert "one <\\|user|> <\\\\\\|x<|end|>" in text


def test_long_conversations_are_one_rendering(spark):
    r = random.Random(6)
    turns = [(1, k * 1000, "ann" if k % 2 else "bob", f"t{k}") for k in range(600)]  # sparse numbers, three rows of a rendering
    turns += [(2, r.randrange(40), r.choice(["a", "b", "system", "c" if k > 30 else "a"]), str(r.random())) for k in range(90)]
    turns += [(3, None, "ann", str(k)) for k in range(300)]
    frame = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    got = views(frame)
    assert got == brute_views(turns) and sum(k[0] == 1 for k in got) == 6
    assert views(frame, max_turns=7) == brute_views(turns, 7)


# --- vector search -------------------------------------------------------------------------------------------------


def brute_nearest(ids, vectors, k=10):
    out = {}
    for i, v in zip(ids, vectors, strict=True):
        if i % 100 == 0:
            d = np.sqrt(((vectors - v) ** 2).sum(axis=1))
            out[i] = [(ids[j], d[j]) for j in np.lexsort((ids, d)) if ids[j] != i][:k]
    return out


def as_lists(rows):
    got = defaultdict(list)
    for r in sorted(rows, key=lambda r: (r.query_id, r.rank)):
        got[r.query_id].append((r.vec_id, r.score))
        assert r.rank == len(got[r.query_id])
    return got


def test_nearest(spark):
    rng = np.random.default_rng(3)
    vectors = (rng.normal(size=(20, 32))[rng.integers(0, 20, 6000)] + 0.7 * rng.normal(size=(6000, 32))).astype("float32")
    vectors[1000:1900] = vectors[0]
    ids = np.arange(6000)
    frame = spark.createDataFrame([(int(i), v.tolist(), 1, 1) for i, v in zip(ids, vectors, strict=True)], "vec_id long, embedding array<float>, label int, qid int")
    got = as_lists(vector_search.nearest(frame, F.col("vec_id") % 100 == 0, min_probes=4).collect())
    want = brute_nearest(ids, vectors.astype(float))
    hits = sum(len({a for a, _ in got[q]} & {a for a, _ in w}) for q, w in want.items())
    assert hits / sum(map(len, want.values())) >= 0.9 and all(len(g) == 10 for g in got.values())
    assert got[0] == want[0] and got[1500] == want[1500]


def test_nearest_awkward(spark):
    good = [(k, [float(k % 7), 1.0, float(k % 3)]) for k in range(0, 260, 20)]
    bad = [(300, None), (400, [0.0, 0.0, 0.0]), (500, [1.0, None, 2.0]), (600, [float("nan"), 1.0, 1.0]), (700, [float("inf"), 1.0, 1.0]), (800, [1.0]), (None, [1.0, 1.0, 1.0])]
    frame = spark.createDataFrame([(i, v, "x") for i, v in good + bad], "vec_id long, embedding array<float>, list string")
    got = as_lists(vector_search.nearest(frame, F.col("vec_id") % 100 == 0).collect())
    ids, vectors = np.array([i for i, _ in good]), np.array([v for _, v in good])
    assert dict(got) == brute_nearest(ids, vectors)
    few = as_lists(vector_search.nearest(frame.where("vec_id IN (0, 20, 40)"), F.col("vec_id") % 100 == 0).collect())
    assert len(few[0]) == 2
    for nothing in (frame.limit(0), frame.where("vec_id IN (300, 400)"), frame.where("vec_id IN (20, 40)")):
        assert vector_search.nearest(nothing, F.col("vec_id") % 100 == 0).count() == 0


def test_rows_that_repeat_an_identifier_are_rows(spark):
    rows = [(k, [float(k), 1.0]) for k in (0, 1, 2, 100, 100, 200)] + [(200, [2.5, 1.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = Counter((r.query_id, r["rank"], r.vec_id, r.score) for r in vector_search.nearest(frame, F.col("vec_id") % 100 == 0, k=3).collect())
    want = Counter()
    for i, (q, v) in enumerate(rows):
        if q % 100 == 0:
            near = sorted((abs(v[0] - w[0]), o) for j, (o, w) in enumerate(rows) if j != i)[:3]
            want.update((q, n + 1, o, d) for n, (d, o) in enumerate(near))
    assert got == want


def test_blocks_and_lists_find_nine_in_ten(spark, monkeypatch):
    monkeypatch.setattr(vector_search, "BLOCK_ROWS", 128)
    monkeypatch.setattr(vector_search, "LIST_SIZE", 64)
    rng = np.random.default_rng(5)
    vectors = np.vstack([rng.normal(size=(5000, 48)), np.repeat(rng.normal(size=(1, 48)), 2500, axis=0)]).astype("float32")
    frame = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(vectors)], "vec_id long, embedding array<float>")
    got = as_lists(vector_search.nearest(frame, F.col("vec_id") % 100 == 0).collect())
    want = brute_nearest(np.arange(len(vectors)), vectors.astype(float))
    hits = sum(len({a for a, _ in got[q]} & {a for a, _ in w}) for q, w in want.items())
    assert hits / sum(map(len, want.values())) >= 0.9 and all(len(g) == 10 for g in got.values())
    assert all(got[q] == want[q] for q in range(5000, 7500, 100))
