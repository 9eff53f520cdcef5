"""Hand-made logs with the awkward rows: cleaning, week arithmetic, timeline and labels."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from weekspan.functions import scalars as S
from weekspan.operators import clean, demographics, features, labels, timeline
from weekspan.sources.logs import Logs, load_table, read_raw_logs, require_columns, save_table

START = datetime(2024, 2, 5, 9, 0, 0)
EVENT = "event_id long, user_id long, event_date string, event_type string, action string, session_id string, topic_id long"
TX = (
    "transaction_id long, user_id long, start_time string, commit_time string, evaluation string, "
    "document_id long, topic_id long, challenge_id long"
)
USER = "user_id long, gender string, canton string, class_level string, class_id string, study string"


def at(days=0.0, seconds=0.0):
    return str(START + timedelta(days=days, seconds=seconds))


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


@pytest.fixture(scope="module")
def raw(spark):
    events = [
        (1, 1, at(0, -1), "CLICK", "REVIEW_TASK", "a", 1),  # one second before the first transaction: week -1
        (2, 1, at(0), "VIEW", "SUBMIT_ANSWER", "a", 2),
        (3, 1, at(7, -1), "OTHER", None, None, None),  # still week 0
        (4, 1, at(7), None, "SUBMIT_ANSWER", "b", 2),  # week 1
        (5, 1, at(21), "CLICK", "REVIEW_TASK", "b", 2),  # week 3
        (6, 2, at(1), "CLICK", "REVIEW_TASK", "c", 1),  # user without transactions
        (7, None, at(1), "CLICK", None, None, None),
        (8, 1, "not a date", "CLICK", None, None, None),
        (9, 4, at(-30), "CLICK", "REVIEW_TASK", "d", 1),  # only negative weeks
    ]
    transactions = [
        (1, 1, at(0), at(0, -1), "CORRECT", 1, 1, 1),
        (2, 1, at(0, 1), at(0, 1), "PARTIAL", 1, 2, 1),
        (3, 1, at(0, 2), at(0, 3602), "WRONG", 2, 2, 1),
        (4, 1, at(0, 3), at(0, 3603.5), None, 2, 2, 1),
        (5, 3, at(40), None, "ODD", None, None, 1),  # user without events
        (6, 4, at(0), at(0, 5), "CORRECT", 1, 1, 1),
        (7, 1, None, at(0), "CORRECT", 1, 1, 1),
    ]
    users = [
        (1, "FEMALE", "ZH", "Gymnasium - 3. Jahr", "c1", "True"),
        (2, "*", None, "WMS", None, "False"),
        (3, "STAR", "BE", None, "c2", None),
        (4, None, "ZH", "Sek - 12. Jahr", "c2", "maybe"),
    ]
    return Logs(spark.createDataFrame(users, USER), spark.createDataFrame(events, EVENT), spark.createDataFrame(transactions, TX))


@pytest.fixture(scope="module")
def logs(raw):
    return timeline.clean_logs(raw)


def test_users(raw):
    got = {r["user_id"]: r for r in clean.clean_users(raw.users).collect()}
    assert [got[i]["gender"] for i in (1, 2, 3, 4)] == ["FEMALE", "Unknown", "Other", "Unknown"]
    assert [got[i]["study"] for i in (1, 2, 3, 4)] == [True, False, False, True]
    assert got[2]["canton"] == got[2]["class_id"] == got[3]["class_level"] == "Unknown"


def test_school_columns(raw):
    got = {r["user_id"]: (r["school_type"], r["class_year"]) for r in demographics.school_columns(clean.clean_users(raw.users)).collect()}
    assert got == {1: ("Gymnasium", 3), 2: ("WMS", 0), 3: ("Unknown", 0), 4: ("Sek", 12)}


def test_response_time_bounds(logs):
    got = dict(rows(logs.transactions, "transaction_id", "response_time_sec"))
    assert got == {1: None, 2: 0.0, 3: 3600.0, 4: None, 5: None, 6: 5.0}


def test_evaluation_scores(logs):
    got = {r["transaction_id"]: (r["evaluation"], r["evaluation_score"], r["is_unknown_eval"]) for r in logs.transactions.collect()}
    assert got[4] == ("UNKNOWN", 0.0, 1) and got[5] == ("ODD", 0.0, 0) and got[2][1] == 0.5


def test_relative_weeks(logs):
    got = dict(rows(logs.events, "event_id", "relative_week"))
    assert got == {1: -1, 2: 0, 3: 0, 4: 1, 5: 3, 6: None, 9: -5}


def test_hot_users_are_sliced_without_changing_rows(raw, logs):
    sliced = timeline.clean_logs(raw, rows_per_task=2)
    assert rows(sliced.events, "event_id", "user_id") == rows(logs.events, "event_id", "user_id")
    assert dict(rows(sliced.events, "event_id", "relative_week")) == dict(rows(logs.events, "event_id", "relative_week"))
    assert sliced.transactions.count() == logs.transactions.count()


def test_calendar_week(spark):
    df = spark.sql("select timestamp_ntz'2024-03-03 23:59:59' as t union all select timestamp_ntz'2024-03-04 00:00:00'")
    got = rows(clean.add_calendar(df, "t"), "week", "dayofweek", "hour")
    assert got == [("2024-02-26/2024-03-03", 6, 23), ("2024-03-04/2024-03-10", 0, 0)]


def test_stage1_keeps_only_users_with_early_events(logs):
    early = timeline.early_window(logs.events), timeline.early_window(logs.transactions)
    got = features.stage1_behavioral(*early).collect()
    assert [r["user_id"] for r in got] == [1]
    row = got[0]
    assert row["total_events_0_2"] == 3 and row["n_sessions_0_2"] == 2 and row["review_rate_0_2"] == 0.0
    assert row["retry_ratio_0_2"] == 2.0 and row["session_duration_std_0_2"] == 0.0
    assert row["time_between_sessions_mean_0_2"] == 7 * 86400


def test_came_back_forms_agree(raw, logs):
    users = logs.events.select("user_id").distinct()
    a = rows(labels.came_back(logs.events, users), "user_id", "came_back")
    anchors = timeline.first_activity(logs.transactions)
    b = rows(labels.came_back_by_last_event(logs.events, anchors, users), "user_id", "came_back")
    assert a == b == [(1, 1), (2, 0), (4, 0)]
    assert rows(labels.came_back(logs.events, users, 1, 2), "user_id", "came_back") == [(1, 1), (2, 0), (4, 0)]


def test_overlapping_sessions_have_no_negative_gap(spark):
    sessions = spark.sql(
        "select 1L user_id, s session_id, timestamp_ntz'2024-01-01 00:00:00' + make_interval(0,0,0,0,a,0,0) start, "
        "timestamp_ntz'2024-01-01 00:00:00' + make_interval(0,0,0,0,b,0,0) end from values ('x',0,5),('y',1,30),('z',40,41) v(s,a,b)"
    )
    got = dict(rows(features.session_gaps(sessions, ["user_id"]), "session_id", "gap_sec"))
    assert got == {"x": None, "y": 0.0, "z": 36000.0}


def test_spine_drops_negative_weeks_and_eventless_users(logs):
    weekly = features.weekly_features(logs.events, logs.transactions)
    got = rows(timeline.weekly_timeline(weekly), "user_id", "relative_week")
    assert got == [(1, 0), (1, 1), (1, 2), (1, 3), (3, 0), (4, 0)]


def weeks_frame(spark, active, start):
    data = [(1, w, float(a), start + timedelta(days=7 * w)) for w, a in enumerate(active)]
    return spark.createDataFrame(data, "user_id long, relative_week long, n_events double, week_start timestamp_ntz")


@pytest.mark.parametrize(
    "active, expected",
    [
        ([1, 0, 0, 0, 1, 1], [0, 0, None, None, None, None]),
        ([1, 0, 0, 0, 0, 1], [1, 0, None, None, None, None]),
        ([1, 0, 0, 0, 0, 0, 1], [1, 1, 0, None, None, None, None]),
        ([1, 0, 0, 0, 0], [1, None, None, None, None]),
        ([1, 1, 1, 1], [None] * 4),
    ],
)
def test_labels_by_gap_length(spark, active, expected):
    df = labels.add_dropout_labels(weeks_frame(spark, active, datetime(2024, 1, 1)))
    assert [r["is_dropout_point"] for r in df.orderBy("relative_week").collect()] == expected


@pytest.mark.parametrize(
    "start, end, expected",
    [
        ("2024-05-01 00:00:00", "2024-06-30 23:59:59", False),
        ("2024-05-01 00:00:00", "2024-07-01 00:00:00", True),
        ("2024-08-31 00:00:00", "2024-09-10 00:00:00", True),
        ("2024-08-31 10:00:00", "2024-09-10 00:00:00", False),
        ("2024-09-01 00:00:00", "2025-06-30 00:00:00", False),
        ("2024-12-20 00:00:00", "2025-07-02 00:00:00", True),
        ("2024-09-01 00:00:00", "2027-01-01 00:00:00", True),
        (None, "2024-08-01 00:00:00", False),
    ],
)
def test_summer_overlap(spark, start, end, expected):
    df = spark.createDataFrame([(start, end)], "a string, b string").select(
        F.col("a").cast("timestamp_ntz").alias("a"), F.col("b").cast("timestamp_ntz").alias("b")
    )
    assert df.select(S.overlaps_summer("a", "b")).first()[0] is expected


def test_last_weeks_are_unlabelled(spark):
    df = labels.add_dropout_labels(weeks_frame(spark, [1, 0, 1, 0, 0, 0, 0, 0, 1, 1, 0, 1], datetime(2023, 10, 1)))
    got = [r["is_dropout_point"] for r in df.orderBy("relative_week").collect()]
    assert [g is None for g in got] == [False] * 8 + [True] * 4


def test_one_hot_decoding(spark):
    df = spark.createDataFrame([(1, 0, 1), (2, 0, 0), (3, 1, 1)], "user_id int, gender_A int, gender_B int")
    got = df.select(demographics.one_hot_label(df, "gender_"), demographics.one_hot_label(df, "none_")).collect()
    assert [tuple(r) for r in got] == [("B", "Unknown"), ("Unknown", "Unknown"), ("A", "Unknown")]


def test_csv_round_trip_and_required_columns(spark, raw, tmp_path):
    for name in ("users", "events", "transactions"):
        save_table(getattr(raw, name), f"{tmp_path}/{name}.csv.gz")
    back = read_raw_logs(spark, str(tmp_path))
    assert rows(back.events, "event_id", "event_date") == rows(raw.events, "event_id", "event_date")
    with pytest.raises(ValueError, match="came_back"):
        load_table(spark, f"{tmp_path}/users.csv.gz", ["user_id", "came_back"])
    assert require_columns(raw.users, ["gender"]) is raw.users
