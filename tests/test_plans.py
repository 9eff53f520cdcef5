"""Shape of the physical plans: no cross joins, pruned scans, filters at the scan."""

import os

import pytest

from weekspan.catalog import load

FOLDER = os.environ.get("WEEKSPAN_TEST_DATA", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
NAMES = [
    "stage1_behavioral", "user_summary", "weekly_features", "dropout_labels", "stage2_dataset", "seq_fixed", "seq_multi_window",
    "binary_metrics", "roc_auc", "chi_square", "adjusted_rand", "outcome_by_cluster_group", "calendar_week_counts_complete",
    "sample_representativeness", "fairness_frame", "weekly_extended",
]


def plan_of(spark, name):
    return load()[0][name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", NAMES)
def test_no_nested_loops(spark, name):
    plan = plan_of(spark, name)
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan


def test_scans_read_only_what_they_need(spark):
    plan = plan_of(spark, "outcome_by_cluster_group")
    assert "o_orderpriority" in plan and "o_orderdate" not in plan and "o_orderstatus" not in plan
    plan = plan_of(spark, "clean_transactions")
    assert "EqualTo(event_type,purchase)" in plan
