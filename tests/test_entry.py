"""The entry points, also without the training-data subpackage, and the streaming extension."""

import json
import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
DATA = "/root/testdata/sf0.001"
generated = pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the generated tables")


@generated
def test_flagship(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


@generated
@pytest.mark.parametrize("name", ["q17_word_cite_stats", "q48_line_states", "q54_symbol_signals", "q66_finding_rules", "q72_report_rules", "q78_finding_drift"])
def test_compiled_plans_give_the_same_rows(spark, name):
    """The other tests run without generated code; users do not."""
    import __spark_entry__ as entry

    rows = {}
    for whole in ("false", "true"):
        spark.conf.set("spark.sql.codegen.wholeStage", whole)
        spark.conf.set("spark.sql.codegen.factoryMode", "NO_CODEGEN" if whole == "false" else "FALLBACK")
        rows[whole] = sorted(map(repr, entry.queries()[name](spark, DATA).collect()))
    spark.conf.set("spark.sql.codegen.wholeStage", "false")
    spark.conf.set("spark.sql.codegen.factoryMode", "NO_CODEGEN")
    assert rows["true"] == rows["false"] and rows["true"]


def test_imports_without_the_subpackage(tmp_path):
    for name in ("__spark_entry__.py", "folioscan"):
        (shutil.copytree if (ROOT / name).is_dir() else shutil.copy)(ROOT / name, tmp_path / name)
    shutil.rmtree(tmp_path / "folioscan" / "llm", ignore_errors=True)
    said = subprocess.run([sys.executable, "-B", "-c", "import __spark_entry__ as e; print(*e.queries())"], cwd=tmp_path, capture_output=True, text=True, check=True)
    names = said.stdout.split()
    assert "q66_finding_rules" in names and "x12_issue_types" in names
    assert "q01_table_mean_audit" in names and not any(n.startswith("op") or n == "pipeline" for n in names)


def test_stream_of_bundles(spark, tmp_path):
    from folioscan.streaming import drop_directory

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text(json.dumps({"bundle_id": "b", "findings": "[{\"id\": \"F1\", \"severity\": \"Odd\"}]"}) + "\n")
    drop_directory.audit_to(drop_directory.read_bundles(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    rules = {r.rule_id for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert rules == {"D2", "D3"}
