"""Per-user and per-week aggregates of cleaned logs.

Raw rows only meet plain group-bys with exact distinct counts: Spark first merges duplicates per task and spreads
each (group, distinct value) pair on its own, so one very active user does not end up in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weekspan.functions.ordered import grouped_median, previous_value
from weekspan.functions.scalars import DAY_MICROS, floor_units, micros_between, safe_divide

# The ordered feature lists of the two stages.
STAGE1_EVENT_FEATURES = [
    "total_events_0_2", "n_active_days_0_2", "n_click_events_0_2", "n_view_events_0_2",
    "n_sessions_0_2", "n_topics_event_0_2", "mean_hour_0_2", "std_hour_0_2",
]
STAGE1_BASELINE = [
    "total_events_0_2", "n_active_days_0_2", "mean_hour_0_2", "n_click_events_0_2", "n_view_events_0_2",
    "n_sessions_0_2", "n_topics_event_0_2", "total_transactions_0_2", "correct_rate_0_2", "partial_rate_0_2",
    "mean_evaluation_score_0_2", "avg_response_time_0_2", "n_topics_transaction_0_2", "n_documents_0_2",
]
STAGE1_ADDITIONAL = [
    "std_hour_0_2", "std_evaluation_score_0_2", "std_response_time_0_2", "session_duration_mean_0_2",
    "session_duration_std_0_2", "time_between_sessions_mean_0_2", "retry_ratio_0_2", "review_rate_0_2",
]
STAGE1_FEATURES = [
    "total_events_0_2", "n_active_days_0_2", "n_click_events_0_2", "n_view_events_0_2", "n_sessions_0_2",
    "n_topics_event_0_2", "mean_hour_0_2", "std_hour_0_2", "total_transactions_0_2", "correct_rate_0_2",
    "partial_rate_0_2", "mean_evaluation_score_0_2", "avg_response_time_0_2", "n_documents_0_2",
    "n_topics_transaction_0_2", "std_evaluation_score_0_2", "std_response_time_0_2", "session_duration_mean_0_2",
    "session_duration_std_0_2", "time_between_sessions_mean_0_2", "retry_ratio_0_2", "review_rate_0_2",
]
WEEKLY_FEATURES = [
    "n_events", "n_active_days", "mean_hour", "n_click_events", "n_view_events", "n_sessions", "n_topics_event",
    "n_transactions", "correct_rate", "partial_rate", "mean_evaluation_score", "avg_response_time", "n_documents",
    "n_topics_transaction", "activity_score", "year", "day",
]
CALENDAR_FEATURES = ["year", "day"]
BEHAVIOUR_FEATURES = [c for c in WEEKLY_FEATURES if c not in CALENDAR_FEATURES]
WEEKLY_COUNTS = [
    "n_events", "n_active_days", "n_click_events", "n_view_events", "n_sessions", "n_topics_event",
    "n_transactions", "n_documents", "n_topics_transaction",
]
WEEKLY_ADDITIONAL = [
    "std_hour", "std_evaluation_score", "std_response_time", "session_duration_mean", "session_duration_std",
    "time_between_sessions_mean", "retry_ratio", "review_rate",
]
TRAJECTORY_GROUPS = {
    "activity": [
        "n_events", "n_click_events", "n_view_events", "n_transactions", "n_documents", "n_sessions", "activity_score",
    ],
    "regularity": ["n_active_days", "mean_hour"],
    "performance": ["correct_rate", "partial_rate", "mean_evaluation_score"],
    "breadth": ["n_topics_event", "n_topics_transaction"],
}
STAGE1_GROUPS = {
    "activity": [
        "total_events_0_2", "n_click_events_0_2", "n_view_events_0_2", "total_transactions_0_2", "n_documents_0_2",
    ],
    "regularity": [
        "n_active_days_0_2", "n_sessions_0_2", "time_between_sessions_mean_0_2", "mean_hour_0_2", "std_hour_0_2",
    ],
    "performance": [
        "correct_rate_0_2", "partial_rate_0_2", "mean_evaluation_score_0_2", "std_evaluation_score_0_2",
    ],
    "persistence": [
        "retry_ratio_0_2", "review_rate_0_2", "avg_response_time_0_2", "std_response_time_0_2",
        "session_duration_mean_0_2", "session_duration_std_0_2",
    ],
    "breadth": ["n_topics_event_0_2", "n_topics_transaction_0_2"],
}


def _event_measures(suffix: str = "") -> dict[str, Column]:
    return {
        f"n_active_days{suffix}": F.count_distinct("date"),
        f"n_click_events{suffix}": F.count_if(F.col("event_type") == "CLICK"),
        f"n_view_events{suffix}": F.count_if(F.col("event_type") == "VIEW"),
        f"n_sessions{suffix}": F.count_distinct("session_id"),
        f"n_topics_event{suffix}": F.count_distinct("topic_id"),
        f"mean_hour{suffix}": F.avg("hour"),
    }


def _transaction_measures(suffix: str = "") -> dict[str, Column]:
    return {
        f"correct_rate{suffix}": F.avg("is_correct"),
        f"partial_rate{suffix}": F.avg("is_partial"),
        f"mean_evaluation_score{suffix}": F.avg("evaluation_score"),
        f"avg_response_time{suffix}": F.avg("response_time_sec"),
        f"n_documents{suffix}": F.count_distinct("document_id"),
        f"n_topics_transaction{suffix}": F.count_distinct("topic_id"),
    }


def _aggregate(df: DataFrame, keys: Sequence[str], measures: dict[str, Column]) -> DataFrame:
    return df.groupBy(*keys).agg(*[m.alias(name) for name, m in measures.items()])


def fill_missing_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Every listed column exists as a double and holds 0 instead of null."""
    wanted = set(columns)
    have = set(df.columns)
    kept = [f"coalesce(cast(`{c}` as double), 0D) as `{c}`" if c in wanted else f"`{c}`" for c in df.columns]
    return df.selectExpr(*kept, *[f"0D as `{c}`" for c in columns if c not in have])


# --- stage 1: one row per user -------------------------------------------------------------------------------------


def _stage1_event_measures() -> dict[str, Column]:
    return {"total_events_0_2": F.count("event_id"), **_event_measures("_0_2"), "std_hour_0_2": F.stddev_samp("hour")}


def stage1_events(events: DataFrame) -> DataFrame:
    return _aggregate(events, ["user_id"], _stage1_event_measures())


def stage1_transactions(transactions: DataFrame) -> DataFrame:
    measures = {
        "total_transactions_0_2": F.count("transaction_id"),
        **_transaction_measures("_0_2"),
        "std_evaluation_score_0_2": F.stddev_samp("evaluation_score"),
        "std_response_time_0_2": F.stddev_samp("response_time_sec"),
    }
    return _aggregate(transactions, ["user_id"], measures).withColumn(
        "retry_ratio_0_2", safe_divide("total_transactions_0_2", "n_documents_0_2")
    )


def session_bounds(events: DataFrame, extra: dict[str, Column] | None = None) -> DataFrame:
    """Start, end and length of each (user, session); rows without a session are left out."""
    measures = {"start": F.min("event_date"), "end": F.max("event_date"), **(extra or {})}
    sessions = _aggregate(events.filter(F.col("session_id").isNotNull()), ["user_id", "session_id"], measures)
    return sessions.withColumn("duration_sec", micros_between("start", "end") / 1e6)


def session_gaps(sessions: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Add the pause since the end of the previous session (by start), not below zero, null for the first one."""
    day = F.datediff(F.to_date("start"), F.lit("1970-01-01"))
    ordered = previous_value(sessions, keys, day, ["start", "session_id"], "end", "_prev_end")
    pause = micros_between("_prev_end", "start") / 1e6
    return ordered.withColumn("gap_sec", F.when(pause < 0, F.lit(0.0)).otherwise(pause)).drop("_prev_end")


def _session_measures(suffix: str = "") -> dict[str, Column]:
    return {
        f"session_duration_mean{suffix}": F.avg("duration_sec"),
        f"session_duration_std{suffix}": F.stddev_samp("duration_sec"),
        f"time_between_sessions_mean{suffix}": F.avg("gap_sec"),
    }


def stage1_sessions(events: DataFrame) -> DataFrame:
    return _aggregate(session_gaps(session_bounds(events), ["user_id"]), ["user_id"], _session_measures("_0_2"))


def review_rate(events: DataFrame, keys: Sequence[str], out: str) -> DataFrame:
    """Reviews per submitted answer; groups without any named action are absent, without submissions null."""
    counts = events.filter(F.col("action").isNotNull()).groupBy(*keys).agg(
        F.count_if(F.col("action") == "REVIEW_TASK").alias("_reviews"),
        F.count_if(F.col("action") == "SUBMIT_ANSWER").alias("_answers"),
    )
    return counts.select(*keys, safe_divide("_reviews", "_answers").alias(out))


def stage1_review_rate(events: DataFrame) -> DataFrame:
    return review_rate(events, ["user_id"], "review_rate_0_2")


def stage1_behavioral(events: DataFrame, transactions: DataFrame) -> DataFrame:
    """All 22 features of users with at least one early event.

    Only those users are kept, so the other parts hang on the event part by left joins, all of them keyed by user.
    Event features and the review rate come from one aggregation.
    """
    answers, reviews = (F.count_if(F.col("action") == a) for a in ("SUBMIT_ANSWER", "REVIEW_TASK"))
    measures = {**_stage1_event_measures(), "_reviews": reviews, "_answers": answers}
    features = _aggregate(events, ["user_id"], measures).withColumn("review_rate_0_2", safe_divide("_reviews", "_answers"))
    for part in (stage1_transactions(transactions), stage1_sessions(events)):
        features = features.join(part, "user_id", "left")
    return fill_missing_columns(features, STAGE1_FEATURES).select("user_id", *STAGE1_FEATURES)


# --- whole-history user summary ------------------------------------------------------------------------------------


def _user_event_measures() -> list[Column]:
    return [
        F.count("event_id").alias("n_events"),
        F.count_distinct("date").alias("n_active_days"),
        F.count_distinct("week").alias("n_active_weeks"),
        F.min("event_date").alias("first_event"),
        F.max("event_date").alias("last_event"),
        F.avg("hour").alias("mean_event_hour"),
    ]


def user_event_summary(events: DataFrame) -> DataFrame:
    return events.groupBy("user_id").agg(*_user_event_measures())


def user_transaction_summary(transactions: DataFrame) -> DataFrame:
    summary = transactions.groupBy("user_id").agg(
        F.count("transaction_id").alias("n_transactions"),
        F.count_distinct("week").alias("n_transaction_weeks"),
        F.count_distinct("document_id").alias("n_documents"),
        F.count_distinct("topic_id").alias("n_topics"),
        F.avg("is_correct").alias("correct_rate"),
        F.avg("is_partial").alias("partial_rate"),
        F.avg("response_time_sec").alias("avg_response_time"),
        F.count_distinct("challenge_id").alias("n_challenges"),
    )
    median = grouped_median(transactions, ["user_id"], "response_time_sec", 1.0, "median_response_time")
    return summary.join(median, "user_id", "left")


MOST_CATEGORIES = 10_000


def categories_of(df: DataFrame, column: str, most: int = MOST_CATEGORIES) -> list[str]:
    """Sorted distinct non-null values of a category column. More than ``most`` are no vocabulary: pass them in instead."""
    rows = df.select(F.col(column).cast("string").alias("v")).filter("v is not null").distinct().limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"{column} has more than {most} values; pass the wanted ones")
    return sorted(r["v"] for r in rows)


def _category_counts(df: DataFrame, column: str, prefix: str, values: Sequence[str] | None) -> list[Column]:
    values = list(values) if values is not None else categories_of(df, column)
    return [F.count_if(F.col(column) == v).alias(f"{prefix}_{v.lower()}") for v in values]


def prefixed_crosstab(df: DataFrame, column: str, prefix: str, values: Sequence[str] | None = None) -> DataFrame:
    """Counts per user and category as columns ``<prefix>_<category in lower case>``; null categories drop out."""
    counts = _category_counts(df, column, prefix, values)
    kept = df.filter(F.col(column).isNotNull())
    return kept.groupBy("user_id").agg(*counts) if counts else kept.select("user_id").distinct()


def user_summary(
    users: DataFrame,
    events: DataFrame,
    transactions: DataFrame,
    actions: Sequence[str] | None = None,
    event_types: Sequence[str] | None = None,
) -> DataFrame:
    """Profile of every user with whole-history activity measures and ratios.

    One aggregation of the events gives their summary and the counts of both categories.
    """
    counts = [*_category_counts(events, "action", "action", actions), *_category_counts(events, "event_type", "event_type", event_types)]
    summary = events.groupBy("user_id").agg(*_user_event_measures(), *counts)
    features = users.join(summary, "user_id", "left").join(user_transaction_summary(transactions), "user_id", "left")
    zero = [c for c in features.columns if c.startswith(("n_", "action_", "event_type_"))]
    return features.fillna(0, subset=[*zero, "correct_rate", "partial_rate"]).withColumns(
        {
            "has_events": F.col("first_event").isNotNull().cast("int"),
            "has_transactions": (F.col("n_transactions") > 0).cast("int"),
            "activity_span_days": floor_units(micros_between("first_event", "last_event"), DAY_MICROS),
            "events_per_active_day": safe_divide("n_events", "n_active_days"),
            "events_per_active_week": safe_divide("n_events", "n_active_weeks"),
            "transactions_per_active_week": safe_divide("n_transactions", "n_transaction_weeks"),
            "has_response_time": F.col("avg_response_time").isNotNull().cast("int"),
        }
    )


# --- stage 2: one row per user and week ----------------------------------------------------------------------------

WEEK_KEYS = ["user_id", "relative_week"]


def weekly_events(events: DataFrame, extended: bool = False) -> DataFrame:
    measures = {"n_events": F.count("event_id"), **_event_measures()}
    if extended:
        measures["std_hour"] = F.stddev_samp("hour")
    return _aggregate(events.filter(F.col("relative_week").isNotNull()), WEEK_KEYS, measures)


def weekly_transactions(transactions: DataFrame, extended: bool = False) -> DataFrame:
    measures = {"n_transactions": F.count("transaction_id"), **_transaction_measures()}
    if extended:
        measures["std_evaluation_score"] = F.stddev_samp("evaluation_score")
        measures["std_response_time"] = F.stddev_samp("response_time_sec")
    weekly = _aggregate(transactions.filter(F.col("relative_week").isNotNull()), WEEK_KEYS, measures)
    return weekly.withColumn("retry_ratio", safe_divide("n_transactions", "n_documents")) if extended else weekly


def _with_activity_score(weekly: DataFrame) -> DataFrame:
    # clicks and views are events too and deliberately count twice
    score = F.col("n_events") + F.col("n_transactions") + F.col("n_click_events") + F.col("n_view_events")
    return weekly.fillna(0, subset=WEEKLY_COUNTS).withColumn("activity_score", score)


def weekly_features(events: DataFrame, transactions: DataFrame) -> DataFrame:
    return _with_activity_score(weekly_events(events).join(weekly_transactions(transactions), WEEK_KEYS, "outer"))


def weekly_sessions(events: DataFrame) -> DataFrame:
    """Session shape per week; a session belongs to the week of its first event."""
    sessions = session_bounds(events, {"relative_week": F.min("relative_week")})
    sessions = sessions.filter(F.col("relative_week").isNotNull())
    return _aggregate(session_gaps(sessions, WEEK_KEYS), WEEK_KEYS, _session_measures())


def weekly_review_rate(events: DataFrame) -> DataFrame:
    return review_rate(events.filter(F.col("relative_week").isNotNull()), WEEK_KEYS, "review_rate")


def weekly_extended(events: DataFrame, transactions: DataFrame) -> DataFrame:
    """Weekly features with spread, session-shape, retry and review measures."""
    weekly = (
        weekly_events(events, extended=True)
        .join(weekly_transactions(transactions, extended=True), WEEK_KEYS, "outer")
        .join(weekly_sessions(events), WEEK_KEYS, "outer")
        .join(weekly_review_rate(events), WEEK_KEYS, "outer")
    )
    return _with_activity_score(weekly.fillna(0.0, subset=WEEKLY_ADDITIONAL))


def early_week_rollup(weekly: DataFrame, first: int = 0, last: int = 2) -> DataFrame:
    """Early weeks of each user summed up from weekly rows."""
    early = weekly.filter(F.col("relative_week").between(first, last))
    sums = {
        "total_events_0_2": "n_events",
        "total_transactions_0_2": "n_transactions",
        "total_clicks_0_2": "n_click_events",
        "total_views_0_2": "n_view_events",
        "total_sessions_0_2": "n_sessions",
        "total_topics_event_0_2": "n_topics_event",
        "total_topics_transaction_0_2": "n_topics_transaction",
        "total_documents_0_2": "n_documents",
        "total_activity_0_2": "activity_score",
    }
    means = {
        "mean_correct_rate_0_2": "correct_rate",
        "mean_partial_rate_0_2": "partial_rate",
        "mean_evaluation_score_0_2": "mean_evaluation_score",
        "mean_response_time_0_2": "avg_response_time",
    }
    return early.groupBy("user_id").agg(
        *[F.sum(c).alias(out) for out, c in sums.items()],
        F.count_if(F.col("activity_score") > 0).alias("active_weeks_0_2"),
        F.max("activity_score").alias("max_activity_0_2"),
        *[F.avg(c).alias(out) for out, c in means.items()],
    )
