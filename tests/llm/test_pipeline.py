"""The pipeline's stages on awkward rows, one after the other, and on a small generated table."""

import os
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from folioscan.llm.common import connected_components, partitions, settle
from tests.llm.test_table_operators import fill

DATA = "/root/testdata/sf0.001"


def awkward(spark, tmp_path, empty=False):
    long = "\n".join(f"word{k} line of a very long text." for k in range(4000))
    rows = [(1, "alpha beta gamma delta epsilon zeta", "en", "a", 35), (1, "alpha beta gamma delta epsilon zeta", "en", "a", 35), (2, None, None, None, None), (None, "own words stand here", "en", None, 1), (3, "", "en", "b", 0), (4, long, "en", "b", 1), (5, long + " end", "de", "c", 1)]
    docs = spark.createDataFrame([] if empty else [(*r, 1, "x") for r in rows], "doc_id long, text string, lang string, source string, n_chars long, _id long, copies string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, 1, 0), (4, 1, 0), (None, None, None)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    return str(tmp_path)


@pytest.mark.parametrize("empty", [False, True])
def test_stages_awkward(spark, tmp_path, empty):
    folder = awkward(spark, tmp_path, empty)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs.count()
        docs = settle(stage(spark, docs, folder), "test")
        assert docs.columns == corpus_pipeline.COLUMNS, name
        if name == "simhash near-dedup" and not empty:
            assert Counter(r.doc_id for r in docs.collect())[5] == 0 and docs.count() < before
    bins = corpus_pipeline.bins(spark, docs, folder)
    assert (bins.count() > 0) != empty


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the generated tables")
def test_run(spark):
    out = corpus_pipeline.run(spark, DATA).collect()
    assert out and all(r.words <= 1024 and len(r.doc_ids) == r.n_pieces for r in out)


@pytest.fixture
def unset(spark):
    """The session without a number of shuffle partitions, as it is where nobody sets one."""
    key = "spark.sql.shuffle.partitions"
    before = spark.conf.get(key)
    spark.conf.unset(key)
    yield spark
    spark.conf.set(key, before)


def test_line_dedup_stage_without_set_partitions(unset, tmp_path):
    folder = awkward(unset, tmp_path)
    assert partitions(unset) == 200
    assert corpus_pipeline.lines(unset, unset.read.parquet(f"{folder}/documents.parquet"), folder).count() == 7


def test_components(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1000 + k) for k in range(1, 300)] + [(5000, 5001), (5001, 5000), (7, 7), (None, 3)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(201)} | {1000 + k: 1000 for k in range(300)} | {5000: 5000, 5001: 5000}
    assert connected_components(spark.createDataFrame([], "a long, b long").select(F.col("a"), F.col("b"))).count() == 0


def planted(spark, tmp_path):
    """Good documents, bad ones, exact and near copies, a line on twelve sources; (folder, texts by id)."""
    r = random.Random(12)
    word = lambda: "".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(2, 8)))
    say = lambda n, mark="": "\n".join(" ".join(word() + mark for _ in range(12)) + "." for _ in range(n))
    texts = {k: say(8) for k in range(150)}
    texts |= {200 + k: say(8, r.choice(["###", "&&&", "%%%"])) for k in range(60)}
    texts |= {300 + k: texts[k] for k in range(20)}  # exact copies
    for k in range(20, 40):  # one word of 96 changed: 5 of 92 shingles
        words = texts[k].split(" ")
        words[r.randrange(len(words))] = "changed"
        texts[300 + k] = " ".join(words)
    for k in range(40, 60):  # half of the text is another one: clean
        texts[300 + k] = texts[k][: len(texts[k]) // 2] + " " + say(4)
    for k in range(60, 84):
        texts[k] += "\nThis line stands on every site."
    rows = [(k, t, "en", f"s{k % 12}", len(t)) for k, t in texts.items()]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(k, int(not 200 <= k < 260), 0) for k in texts], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    return str(tmp_path), texts


def shingles(text):
    words = text.lower().split()
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))}


def test_every_stage_against_brute_force(spark, tmp_path):
    folder, texts = planted(spark, tmp_path)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    got = []
    for _, stage in corpus_pipeline.STAGES:
        docs = settle(stage(spark, docs, folder), "planted")
        got.append(docs.collect())
    good = {r.doc_id for r in got[0]}
    assert good == {k for k in texts if not 200 <= k < 260}
    cleaned = {r.doc_id: r.text for r in got[1]}
    assert cleaned == {k: texts[k].replace("\nThis line stands on every site.", "") for k in good}
    sets, left = {k: shingles(t) for k, t in cleaned.items()}, set(good)
    for a in sorted(good):
        for b in sorted(good):
            if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                left.discard(b)
    assert {r.doc_id for r in got[2]} == left == good - set(range(300, 340))
    words = {k: len(cleaned[k].split()) for k in left}
    sizes = Counter()
    for k in left:
        sizes[f"s{k % 12}"] += words[k]
    taken = Counter()
    for r in got[3]:
        taken[r.source] += words[r.doc_id]
    want = fill(dict(sizes), {s: (5, 2, 1)[k % 3] for k, s in enumerate(sorted(sizes))}, 3)
    assert all(abs(taken[s] - want[s]) <= max(words.values()) for s in sizes)
    assert max(Counter(r.doc_id for r in got[3]).values()) <= 3
    packed = Counter(p.doc_id for r in got[4] for p in r.pieces)
    assert packed == Counter(r.doc_id for r in got[3])
    for r in got[4]:
        assert sum(p["size"] for p in r.pieces) == r.words <= 1024 and len({p.doc_id % 12 for p in r.pieces}) == r.n_pieces
