"""Numeric audit of tables: values worked out by hand."""

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from folioscan.operators import tables


def docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def tabular(*rows):
    return "\\begin{tabular}{lrrr}\n" + " \\\\\n".join(rows) + " \\\\\n\\end{tabular}\n"


def signals(spark, *rows):
    return [r.asDict() for r in tables.table_signals(docs(spark, tabular(*rows))).collect()]


def test_summary_column_ambiguous(spark):
    (s,) = signals(spark, "Model & A & B & C & Avg.", "ours & 95.10 & 95.60 & 95.86 & 95.77", "clean & 90.00 & 91.00 & 92.00 & 91.00")
    assert (s["reported_value"], s["visible_computed_value"], s["delta"], s["gap_tier"]) == ("95.77", "95.52", "+0.25", "ambiguous")
    assert (s["row_no"], s["column_no"], s["row_label"], s["component_count"], s["scope"]) == (2, 5, "ours", 3, "column")


def test_summary_column_deterministic(spark):
    (s,) = signals(spark, "Model & A & B & C & D & E & F & Average", "x & 10 & 20 & 30 & 40 & 50 & 75.84 & 47.70")
    assert (s["visible_computed_value"], s["delta"], s["gap_tier"]) == ("37.64", "+10.06", "deterministic")


def test_summary_row_uses_earlier_data_rows(spark):
    found = signals(spark, "Model & A & B", "x & 10.0 & 20.0", "y & 20.0 & 30.0", "Mean & 15.0 & 26.0")
    assert [(s["scope"], s["column_no"], s["visible_computed_value"], s["delta"]) for s in found] == [("row", 3, "25.00", "+1.00")]


def test_comments_rules_and_escapes(spark):
    rows = tables.table_rows(docs(spark, tabular("\\toprule a \\& b & c % & hidden", "\\midrule", "x & \\textbf{1,234.5}", "50\\% & 2")))
    assert [(r.row_no, list(r.cells)) for r in rows.orderBy("row_no").collect()] == [(1, ["a & b", "c"]), (3, ["x", "1,234.5"]), (4, ["50\\"])]
    kept = tables.table_rows(docs(spark, tabular("50\\% & 2")), escaped_percent=True)
    assert [list(r.cells) for r in kept.collect()] == [["50\\%", "2"]]


def test_blank_and_ragged(spark):
    rows = tables.table_rows(docs(spark, tabular("a & b & c", "1 & -- & ", "2 & 3")))
    assert [(r.row_no, r.columns) for r in tables.blank_cells(rows).collect()] == [(2, [2, 3])]
    assert [(r.row_no, r.n_cells, r.expected) for r in tables.ragged_rows(rows).collect()] == [(3, 2, 3)]
    capped = tables.table_sanity(docs(spark, tabular("a & b & c", "1 & -- & ", "2 & 3")), limit=1).collect()
    assert [(r.rank, r.total, r.incomplete) for r in capped] == [(1, 2, True)]


PDF = """Table 3 Scores
Method (DSRp) (DSRp) (DSRp) (DSRp) (DSRh) (DSRh)
Ours 94.0 95.0 96.0 95.0 96.0 96.08 95.77
Model Art Business Health Science Avg. Right Law Avg.
Base 30.0 40.0 35.0 45.56 47.7 20.0 30.0 25.0
Figure 2 Nothing
Base 30.0 40.0 35.0 45.56 47.7 20.0 30.0 25.0
Page text with 1 2 3 4 5
"""


def test_line_state_machine(spark):
    found = tables.line_signals(docs(spark, PDF)).orderBy("signal_id").collect()
    got = [(r.signal_id, r.table_id, r.line_no, r.row_label, r.reported_value, r.visible_computed_value, r.delta, r.gap_tier, r.formula) for r in found]
    assert got == [
        ("N1", "Table 3", 3, "Ours", "95.77", "95.52", "+0.25", "ambiguous", "component_mean_of_means"),
        ("N2", "Table 3", 5, "Base", "47.7", "37.64", "+10.06", "deterministic", "header_summary_mean"),
    ]
    assert found[0].component_groups[0].tag == "DSRP" and found[1].summary_column_index == 4
    assert '"signal_count":2' in tables.numeric_payload(tables.line_signals(docs(spark, PDF))).first().json
    assert tables.line_signals(docs(spark, PDF), limit=1).count() == 1
    with pytest.raises(ValueError):
        tables.line_signals(docs(spark, PDF), limit=0)


def test_lookback_is_bounded(spark):
    row = "Model A B C Avg.\nBase 1.0 2.0 3.0 9.0"
    near = tables.line_signals(docs(spark, "Table 1 x\n" + "\n" * 27 + row)).first()
    far = tables.line_signals(docs(spark, "Table 1 x\n" + "\n" * 28 + row)).first()
    assert (near.table_id, far.table_id) == ("Table 1", "PDF table")


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.integers(100, 9999), min_size=2, max_size=6), st.sampled_from([0, 37, 310]))
def test_injected_error_is_found(spark, cents, shift):
    mean = sum(cents) / len(cents)
    cells = " & ".join(f"{c / 100:.2f}" for c in cells_of(cents))
    head = " & ".join("P" for _ in cents)
    found = signals(spark, f"Model & {head} & Avg", f"x & {cells} & {(mean + shift) / 100:.4f}")
    assert len(found) == (1 if shift else 0)


def cells_of(cents):
    return cents


def test_number_extract_like_its_sql(spark, tmp_path):
    import duckdb

    import __spark_entry__ as entry

    texts = ["face \U0001f600\U0001f600 is 12 wide", "account 89370400440532013000 and 1", "key 1000000000000000.3", "a\rb 7\nc d 8", " tab\t 5", "3 \U0001f600 4,000%", "-9007199254740993.5 x", "none", None, "", "1\n"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    got = entry.queries()["q22_number_extract"](spark, str(tmp_path)).collect()
    with duckdb.connect() as base:
        base.execute(f"CREATE VIEW documents AS FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
        want = base.execute(entry.oracle_sql()["q22_number_extract"]).fetchall()
    assert sorted(map(tuple, got)) == sorted(want)


def test_tables_of_files_are_not_broadcast(spark):
    from folioscan.sources import projects

    files = spark.createDataFrame([("/c", "/c/0.tex", "a \\input{1} z"), ("/c", "/c/1.tex", "b")], "root string, path string, text string")
    edges = projects.include_edges(files)
    out = projects.expanded(files, edges, spark.createDataFrame([("/c/0.tex",)], "root string"))
    for plan in (edges, out):
        assert "Broadcast" not in plan._jdf.queryExecution().executedPlan().toString()
    assert out.first().text.split() == ["a", "b", "z"]
