"""Studies of feature sets cut their sequences once."""

import pytest
from pyspark.sql import functions as F

from weekspan.plans import experiments as X

COLUMNS = ["n_events", "year", "mean_hour", "day"]


@pytest.fixture(scope="module")
def weeks(spark):
    df = spark.range(40 * 9).selectExpr("id div 9 as user_id", "id % 9 as relative_week", "cast(id * 7 % 3 = 0 as int) as is_dropout_point", "id % 5 = 0 as is_summer")
    return df.select("*", *[(F.pmod(F.xxhash64("user_id", "relative_week", F.lit(c)), F.lit(50)) / 7.0).alias(c) for c in COLUMNS]).localCheckpoint()


def rows(df):
    return sorted((r["user_id"], r["target_week"], r["label"], tuple(r["features"].toArray())) for r in df.collect())


def test_narrowed_splits_are_those_cut_for_the_columns(weeks):
    left = ["mean_hour", "n_events"]
    got = X.narrowed(X.sequence_splits(weeks, COLUMNS, 4), COLUMNS, left, 4)
    expected = X.sequence_splits(weeks, left, 4)
    for part in ("train", "validation", "test"):
        assert rows(getattr(got, part)) == rows(getattr(expected, part)) != []


def test_studies_cut_sequences_once(weeks, monkeypatch):
    cuts, cut = [], X.sequence_splits
    monkeypatch.setattr(X, "sequence_splits", lambda *a, **o: cuts.append(a[1]) or cut(*a, **o))
    monkeypatch.setattr(X.M, "evaluate_model", lambda name, model, splits, n: (name, len(splits.train.first()["features"]), *[0.0] * 6))
    fit = lambda train, validation: None
    found = X.leave_out_study(weeks, COLUMNS, {"without hours": ["mean_hour"], "without calendar": ["year", "day"]}, 4, fit).collect()
    assert len(cuts) == 1 and [r["n_features"] for r in found] == [16, 12, 8, 8, 4]
    del cuts[:]
    found = X.cumulative_study(weeks, {"a": COLUMNS[:2], "b": COLUMNS[2:]}, 4, fit).collect()
    assert len(cuts) == 1 and [r["n_features"] for r in found] == [8, 16]
