"""What the physical plans must and must not hold."""

from __future__ import annotations

import os
import re

import pytest

from paceline.plans import catalog, free

SF_DIR = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test data")

# Queries whose result is a row made on the driver after a run.
REPORTS = {
    "q06_run_queries",
    "s08_load_table",
    "s08_load_time",
    "s08_load_time_checked",
    "s10_trial_load",
    "s11_load_to_threshold",
    "s16_time_df",
    *(name for name in catalog.QUERIES if name.startswith("r0")),
}


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - REPORTS))
def test_no_plan_pairs_rows_or_leaves_the_jvm(spark, name):
    plan = plan_of(catalog.QUERIES[name](spark, SF_DIR))
    for unwanted in ("CartesianProduct", "BroadcastNestedLoopJoin", "Window", "Python", "ArrowEval"):
        assert unwanted not in plan


@pytest.mark.parametrize("name", sorted(free.QUERIES))
def test_no_free_plan_pairs_rows_or_leaves_the_jvm(spark, name):
    """Windows there are, inside buckets."""
    plan = plan_of(free.QUERIES[name](spark, SF_DIR))
    for unwanted in ("CartesianProduct", "BroadcastNestedLoopJoin", "Python", "ArrowEval"):
        assert unwanted not in plan


@pytest.mark.parametrize("name", ["w01_last_load", "w02_runs_during_own_loads", "w08_change_of_runs"])
def test_rows_are_dealt_by_key_and_bucket(spark, name):
    """No window or join over rows is dealt by a key alone."""
    plan = plan_of(free.QUERIES[name](spark, SF_DIR))
    dealt = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line or "HashJoin" in line]
    assert any("_bucket" in line for line in dealt)


@pytest.mark.parametrize(
    "name,pushed",
    [
        ("q02_join", "GreaterThan(o_totalprice,300000.0)"),
        ("q02_join_all", "GreaterThan(o_totalprice,300000.0)"),
        ("q05_filter", "GreaterThan(l_extendedprice,50000.0)"),
        ("q07_bound_parameters", "GreaterThan(o_totalprice,300000.0)"),
        ("i03_fk_orphans", "IsNotNull(doc_id)"),
        ("i04_cascade_parent", "c_acctbal"),
        ("t04_sum_segments_of_schema", "EqualTo(p_brand,Brand#7)"),
    ],
)
def test_filters_reach_the_scan(spark, name, pushed):
    scans = [line for line in plan_of(catalog.QUERIES[name](spark, SF_DIR)).splitlines() if "FileScan" in line]
    assert any(pushed in line for line in scans)


@pytest.mark.parametrize(
    "name,columns",
    [
        ("q02_join", [{"o_orderkey", "o_custkey", "o_totalprice", "o_orderdate"}, {"c_custkey", "c_name"}]),
        ("q03_aggregate", [{"o_orderkey", "o_custkey", "o_totalprice"}, {"c_custkey", "c_name"}]),
        ("i01_pk_violations", [{"l_orderkey", "l_linenumber"}]),
        ("t07_block_sizes", [{"l_suppkey", "l_linestatus", "l_partkey"}]),
        ("m06_avg_query_time", [{"user_id", "value"}]),
    ],
)
def test_scans_read_only_what_is_used(spark, name, columns):
    scans = re.findall(r"FileScan parquet \[([^\]]*)\]", plan_of(catalog.QUERIES[name](spark, SF_DIR)))
    read = [sorted(re.sub(r"#\w+", "", scan).split(",")) for scan in scans]
    assert sorted(read) == sorted(map(sorted, columns))


@pytest.mark.parametrize(
    "name,shuffles",
    [("m01_mean_runs", 1), ("m05_import_metrics_by_user", 1), ("m06_avg_query_time", 1), ("m10_pivot_loads", 2),
     ("m12_query_grid", 3), ("q03_aggregate", 1), ("t05_active_parts_size", 1), ("m18_comparison", 1), ("m09_chart_overall", 1)],
)
def test_number_of_shuffles(spark, name, shuffles):
    assert plan_of(catalog.QUERIES[name](spark, SF_DIR)).count("Exchange hashpartitioning") == shuffles
