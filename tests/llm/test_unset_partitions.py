"""Operators in a session that sets no number of shuffle partitions."""

from __future__ import annotations

from folioscan.llm import queries
from tests.llm.test_pipeline import unset  # noqa: F401

TEXTS = ["one two three four five six", "one two three four five six", "seven eight nine ten eleven", None]


def written(spark, folder, name, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def test_op1(unset, tmp_path):  # noqa: F811
    folder = written(unset, tmp_path, "documents", list(enumerate(TEXTS)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in queries.op1_simhash(unset, folder).collect()}
    assert got == {0: 0, 1: 0, 2: 2, 3: 3}


def test_op5(unset, tmp_path):  # noqa: F811
    rows = [(k, f"all rights\nown line {k}", f"site{k}") for k in range(12)]
    folder = written(unset, tmp_path, "documents", rows, "doc_id long, text string, source string")
    assert {(r.doc_id, r.n_removed, r.n_kept_chars) for r in queries.op5_line_dedup(unset, folder).collect()} == {(k, 1, len(f"own line {k}")) for k in range(12)}


def test_op10(unset, tmp_path):  # noqa: F811
    rows = [(k, [float(k + 1), 1.0]) for k in range(0, 200, 50)]
    folder = written(unset, tmp_path, "embeddings", rows, "vec_id long, embedding array<float>")
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in queries.op10_nearest(unset, folder).collect()}
    assert got == {(0, 1): (50, 50.0), (0, 2): (100, 100.0), (0, 3): (150, 150.0), (100, 1): (50, 50.0), (100, 2): (150, 50.0), (100, 3): (0, 100.0)}
