"""Registered queries against their check SQL, and the shape of plans."""

import pytest

from check_oracle import compare, connect
from tidewater import registry
from tidewater.sources import tpcds_views, tpch_views

FOLDER = "/root/testdata/sf0.001"
# one query of each plan shape; tests/check_oracle.py runs them all
SAMPLE = ["h_q01", "h_q02", "h_q13", "h_q16", "h_q18", "h_q21", "h_q22", "ds_q02", "ds_q05", "ds_q14", "ds_q23", "ds_q34", "ds_q36", "ds_q38", "ds_q44", "ds_q47", "ds_q51",
          "ds_q67", "ds_q72", "ds_q78", "ds_q95", "ds_q97", "qm_suite_summary", "hw_05_disk_rate", "tq_04_backlog", "fe_02_suite_totals", "rk_02_composite_score", "co_04_tuning_report",
          "cf_07_constraints", "st_02_running_outcomes", "st_03_stale_claims", "src_01_delimited_load", "src_02_suite_load", "src_04_statistics", "src_09_features", "src_09_features_as_csv", "src_12_metric_runs"]


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


def test_registry_is_complete():
    queries, sqls = registry.queries(), registry.oracle_sql()
    assert set(sqls) <= set(queries)
    assert {f"h_q{i:02d}" for i in range(1, 23)} <= set(sqls) and {f"ds_q{i:02d}" for i in range(1, 100)} <= set(sqls)


@pytest.mark.parametrize("name", SAMPLE)
def test_matches_check_sql(spark, con, name):
    ok, why, _ = compare(spark, con, registry.queries()[name], registry.oracle_sql()[name], FOLDER)
    assert ok, why


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["h_q04", "h_q17", "h_q19", "h_q21", "ds_q13", "ds_q48", "ds_q64", "ds_q72"])
def test_no_cartesian_product(spark, name):
    plan = _plan(registry.queries()[name](spark, FOLDER))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_filters_and_columns_reach_the_scan(spark):
    plan = _plan(registry.queries()["h_q06"](spark, FOLDER))
    assert "l_shipdate" in plan.split("PushedFilters: ")[1].split("]")[0]
    assert "l_comment" not in plan and "l_returnflag" not in plan.split("ReadSchema")[1]


def test_only_wanted_tiers_are_scanned(spark):
    scans = _plan(registry.queries()["src_09_features"](spark, FOLDER)).split("PartitionFilters: [")
    assert any("tier" in s.split("]")[0] and "low" in s.split("]")[0] for s in scans[1:])


def test_rank_filter_is_pushed_below_the_shuffle(spark):
    from tidewater.plans import retail_windows

    assert "WindowGroupLimit" in _plan(retail_windows.q67(tpcds_views.tables(spark, FOLDER)))


def test_reference_literals_by_default(spark):
    from tidewater.plans import tpch

    t = tpch_views.tables(spark, FOLDER)
    t.year_shift = 0
    assert t.day("1994-01-01") == "DATE '1994-01-01'"
    assert tpch.q6(t).columns == ["revenue"]


def test_offers_are_filtered_before_they_are_made(spark):
    for name in ("h_q02", "h_q09", "h_q11", "h_q16", "h_q20"):
        plan = registry.queries()[name](spark, FOLDER)._jdf.queryExecution().optimizedPlan().toString().split("\n")
        assert any("Aggregate [l_partkey" in x and "LeftSemi" in y + z for x, y, z in zip(plan, plan[1:], plan[2:])), name
