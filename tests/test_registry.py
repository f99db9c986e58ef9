"""The registry: whole, importable without the training-data operators, and equal to its SQL on the smallest tables."""

import os
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from copresence.plans.registry import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
ROWS_ONLY = {"ensemble_from_model", "analysis_report", "gbt_predictions", "gbt_importances", "classifier_comparison", "loo_half_month_cv", "file_fingerprint"}


def test_every_query_has_an_oracle_or_is_known_to_have_none():
    assert set(QUERIES) - set(ORACLES) == ROWS_ONLY and set(ORACLES) <= set(QUERIES)


def test_imports_without_llm(tmp_path):
    root = Path(__file__).resolve().parent.parent
    copy = tmp_path / "copresence"
    subprocess.run(["cp", "-r", str(root / "copresence"), str(copy)], check=True)
    subprocess.run(["rm", "-rf", str(copy / "llm")], check=True)
    subprocess.run(["cp", str(root / "__spark_entry__.py"), str(tmp_path)], check=True)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'days_together' in q and not any(n.startswith('op1') for n in q); assert e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env=os.environ | {"PYTHONPATH": str(tmp_path)})


@pytest.mark.skipif(not Path(SF).exists(), reason="needs the driver's tables")
@pytest.mark.parametrize("name", ["dedup_2min", "raw_overlaps", "fine_overlaps", "tracked_metrics", "export_b_pings", "cv_groups"])
def test_same_as_sql(spark, name):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{SF}/events.parquet'")
    want = con.sql(ORACLES[name])
    columns = sorted(want.columns)
    got = QUERIES[name](spark, SF)
    assert sorted(got.columns) == columns
    at = [want.columns.index(c) for c in columns]
    tidy = lambda v: round(v, 6) if isinstance(v, float) else v
    assert sorted(tuple(str(tidy(r[c])) for c in columns) for r in got.collect()) == sorted(tuple(str(tidy(r[i])) for i in at) for r in want.fetchall())


@pytest.mark.skipif(not Path(SF).exists(), reason="needs the driver's tables")
def test_joins_are_no_nested_loops(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for name in ("raw_overlaps", "segment_pairs", "fine_overlaps"):
            plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
            assert "NestedLoop" not in plan and "Cartesian" not in plan, name
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_entry_is_registered():
    assert "days_together" in entry.queries()
