"""Registered queries against their SQL on the smallest data, and the contract."""

import pytest

import check
from chartloom.plans import load

QUERIES, ORACLES = load()


@pytest.fixture(scope="module")
def con(sf):
    return check.connect(sf)


@pytest.mark.parametrize("name", list(ORACLES))
def test_query_equals_sql(spark, sf, con, name):
    why, _ = check.compare(QUERIES[name](spark, sf), con, ORACLES[name])
    assert why is None, why


def test_patient_reports_are_whole(spark, sf):
    rows = QUERIES["h18_patient_reports"](spark, sf).collect()
    assert len(rows) == spark.read.parquet(f"{sf}/customer.parquet").count()
    assert all(r["report"].startswith("**Treatment Analysis for Patient ") and r["report"].endswith("*") and "**Patient Overview:**" in r["report"] for r in rows)
    for part in ("**Current Active Treatments:**", "**Clinical Timeline Summary:**"):
        assert any(part in r["report"] for r in rows)
    assert any("Conditions: " in r["overview"] for r in rows)


def test_contract(spark):
    import __spark_entry__ as entry
    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(entry.queries()) > 170
    assert entry.entry(spark).count() > 0


def test_scan_reads_only_what_it_needs(spark, sf):
    plan = QUERIES["v09_chunk_counts"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<l_suppkey:bigint>" in plan
    plan = QUERIES["s05_expired"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(ts), LessThan(ts" in plan


@pytest.mark.parametrize("name", ["g12_patient_statistics", "g16_visit_timeline", "g19_interacting_pairs", "g20_care_gaps", "h06_current_treatments", "i01_treatment_progression"])
def test_no_nested_loops_and_no_python(spark, sf, name):
    plan = QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "NestedLoop" not in plan and "CartesianProduct" not in plan
