"""Plans that must hold at any size: what is shuffled, scanned and put into one task."""

from __future__ import annotations

import re
from pathlib import Path

import pytest

from stallwise.plans.workload import QUERIES

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF_DIR).exists(), reason="no test data")


def final_plan(spark, name):
    frame = QUERIES[name](spark, SF_DIR)
    frame.collect()
    return frame._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


def planned(spark, name):
    return QUERIES[name](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize(
    "name", ["severity_impact_rank", "gmv_contribution", "rate_change_contribution", "experiment_by_segment"]
)
def test_totals_reuse_the_grouped_shuffle(spark, name):
    assert "ReusedExchange" in final_plan(spark, name)


@pytest.mark.parametrize(
    "name", ["cohort_retention", "repeat_customer_rate", "cancellation_by_traffic", "rolling_7d_orders"]
)
def test_lines_are_not_read_where_not_needed(spark, name):
    plan = planned(spark, name)
    assert "l_orderkey" not in plan and "Join" not in plan


def test_top_restaurants_are_cut_before_the_shuffle(spark):
    plan = planned(spark, "top3_restaurants_by_cuisine")
    partial = plan.index("WindowGroupLimit", plan.index("WindowGroupLimit") + 1)
    assert "Exchange hashpartitioning(cuisine" in plan[:partial] and "Partial" in plan[partial : partial + 200]


def test_scans_read_the_needed_columns_only(spark):
    plan = QUERIES["cohort_retention"](spark, SF_DIR)._jdf.queryExecution().toString()
    schemas = re.findall(r"ReadSchema: struct<(.*?)>", plan)
    assert set(schemas) == {"o_custkey:bigint,o_orderstatus:string,o_orderdate:timestamp_ntz"}


def untrained():
    return [name for name in QUERIES if "model_metrics" not in name and not name.startswith("score_")]


def test_no_python_and_no_cross_join_in_any_plan(spark):
    for name in untrained():
        plan = planned(spark, name)
        assert not re.search(r"PythonUDF|EvalPython|InPandas|MapInArrow", plan), name
        assert not re.search(r"CartesianProduct|NestedLoopJoin", plan), name


def test_single_task_windows_see_bounded_rows_only(spark):
    """Windows that gather rows in one task are allowed over calendar days, weeks and hours."""
    bounded = {
        "rolling_7d_orders",
        "daily_trends_7d",
        "wow_growth",
        "hourly_demand",
    }
    for name in untrained():
        plan = planned(spark, name)
        single = re.search(r"Window \[.*\n[^\n]*Sort[^\n]*\n[^\n]*Exchange SinglePartition", plan)
        assert bool(single) == (name in bounded), name
