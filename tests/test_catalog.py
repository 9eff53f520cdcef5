"""Registered queries against DuckDB at the smallest scale, and the shape of the registry."""

import os

import pytest

import compare
from weekspan.catalog import base, load

FOLDER = os.environ.get("WEEKSPAN_TEST_DATA", "/root/testdata/sf0.001")
QUERIES, ORACLES = load()
# One query per family; ``tools/compare.py`` runs all of them.
CHECKED = [
    "stage1_dataset", "user_summary", "calendar_week_counts", "weekly_features", "week_dates", "dropout_labels", "gap_dropout_points",
    "seq_fixed", "train_fitted_scaling", "stratified_cap", "masking", "mixup", "local_swap", "threshold_sweep", "validation_tuned_metrics",
    "outcome_by_cluster_group", "chi_square", "adjusted_rand", "silhouette_exact", "top_z_features",
]


@pytest.fixture(scope="module")
def con():
    return compare.duck(FOLDER)


def test_registry():
    assert set(ORACLES) <= set(QUERIES)
    assert len(QUERIES) >= 145 and len(ORACLES) >= 120
    for name, (_, _, spec) in base.ORACLES.items():
        names = [n for n, _ in base._columns(spec)]
        assert len(names) == len(set(names)), name


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
@pytest.mark.parametrize("name", CHECKED)
def test_against_duckdb(spark, con, name):
    ok, note = compare.compare(spark, con, FOLDER, name, QUERIES[name], ORACLES[name])
    assert ok, note


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
def test_entry(spark):
    import __spark_entry__

    df = __spark_entry__.entry(spark)
    assert df.columns[0] == "user_id" and df.columns[-1] == "came_back" and df.count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
