"""Retention and interruption labels.

Windows here run over weekly rows of one user: their number is bounded by the calendar span of the data, not by how
active the user is.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weekspan.functions.scalars import (
    DAY_MICROS,
    days_after,
    floor_units,
    micros_between,
    overlaps_summer,
)
from weekspan.operators.timeline import add_week_dates, relative_week


def came_back(events: DataFrame, users: DataFrame, return_from: int = 3, return_to: int | None = None) -> DataFrame:
    """0/1 flag per row of ``users``: any event in relative week ``return_from`` or later (up to ``return_to``)."""
    late = F.col("relative_week") >= return_from
    if return_to is not None:
        late = late & (F.col("relative_week") <= return_to)
    returning = events.filter(late).select("user_id").distinct().withColumn("_back", F.lit(1))
    return (
        users.join(returning, "user_id", "left").withColumn("came_back", F.coalesce(F.col("_back"), F.lit(0))).drop("_back")
    )


def came_back_by_last_event(events: DataFrame, anchors: DataFrame, users: DataFrame, return_from: int = 3) -> DataFrame:
    """Same flag without an upper bound, from each user's last event alone: no join on raw rows is needed."""
    last = events.groupBy("user_id").agg(F.max("event_date").alias("_last_event"))
    late = relative_week("_last_event", "_anchor") >= return_from
    anchored = last.join(anchors.select("user_id", F.col("first_activity_time").alias("_anchor")), "user_id")
    flags = anchored.select("user_id", late.cast("int").alias("_back"))
    return (
        users.join(flags, "user_id", "left").withColumn("came_back", F.coalesce(F.col("_back"), F.lit(0))).drop("_back")
    )


def add_dropout_labels(timeline: DataFrame, horizon_weeks: int = 4) -> DataFrame:
    """Interruption label of each week on the dense timeline.

    Null when the next ``horizon_weeks`` weeks are not all on the timeline; 0 when any of them has an event or the
    gap touches the summer break; 1 otherwise.
    """
    by_week = Window.partitionBy("user_id").orderBy("relative_week")
    ahead = by_week.rowsBetween(1, horizon_weeks)
    gap = overlaps_summer(days_after("week_start", F.lit(7)), days_after("week_start", F.lit(7 * horizon_weeks)))
    label = F.when(F.col("_future_active") > 0, 0).when(gap, 0).otherwise(1)
    return (
        timeline.withColumn("is_active", (F.coalesce(F.col("n_events"), F.lit(0)) > 0).cast("int"))
        .withColumn("_future_active", F.sum("is_active").over(ahead))
        .withColumn("_horizon", F.lead("relative_week", horizon_weeks).over(by_week))
        .withColumn("is_dropout_point", F.when(F.col("_horizon").isNotNull(), label))
        .drop("_future_active", "_horizon")
    )


def add_dropout_labels_from(timeline: DataFrame, first_events: DataFrame, horizon_weeks: int = 4) -> DataFrame:
    """Variant whose week dates start at the first event while weeks still count from the first transaction."""
    dated = add_week_dates(timeline, first_events, "first_event")
    return add_dropout_labels(dated, horizon_weeks)


def gap_dropout_points(weekly: DataFrame, first_events: DataFrame, as_of: str, max_gap: int = 4) -> DataFrame:
    """Interruptions between observed weeks.

    A week is flagged when the next observed week is more than ``max_gap`` weeks later and the pause misses the
    summer break; a user's last week is flagged when it started more than ``max_gap`` weeks before ``as_of``.
    """
    by_week = Window.partitionBy("user_id").orderBy("relative_week")
    whole_user = Window.partitionBy("user_id")
    dated = add_week_dates(weekly, first_events, "first_event").drop("year", "day")
    age = floor_units(micros_between("week_start", F.lit(as_of).cast("timestamp_ntz")), DAY_MICROS) / F.lit(7.0)
    pause = overlaps_summer(days_after("week_start", F.lit(7)), F.timestamp_add("DAY", F.lit(-7), F.col("_next_start")))
    long_gap = (F.col("_next_week") - F.col("relative_week") > max_gap) & ~pause
    return (
        dated.withColumns(
            {
                "_next_week": F.lead("relative_week").over(by_week),
                "_next_start": F.lead("week_start").over(by_week),
                "is_last_week": F.max("relative_week").over(whole_user) == F.col("relative_week"),
            }
        )
        .withColumn("weeks_since", age)
        .withColumn(
            "is_dropout_point",
            F.coalesce(F.when(F.col("is_last_week"), F.col("weeks_since") > max_gap).otherwise(long_gap), F.lit(False)),
        )
        .drop("_next_week", "_next_start")
    )


def time_to_dropout(points: DataFrame) -> DataFrame:
    """First flagged week per user (indicator 1), or the last observed week (indicator 0)."""
    flagged = F.min(F.when(F.col("is_dropout_point"), F.col("relative_week")))
    return (
        points.groupBy("user_id")
        .agg(flagged.alias("_first"), F.max("relative_week").alias("_last"))
        .select(
            "user_id",
            F.col("_first").isNotNull().cast("int").alias("dropout_indicator"),
            F.coalesce("_first", "_last").alias("dropout_week"),
        )
    )


def early_dropout_label(
    weekly: DataFrame, early: DataFrame, users: DataFrame, summary: DataFrame, first: int = 3, last: int = 8
) -> DataFrame:
    """Early-week features with the label "no activity in weeks first..last", profile columns and global ratios."""
    late = (
        weekly.filter(F.col("relative_week").between(first, last))
        .groupBy("user_id")
        .agg(F.sum("activity_score").alias("late_activity_sum"))
    )
    profile = users.select("user_id", "gender", "canton", "class_level", "study")
    ratios = [
        "correct_rate", "partial_rate", "avg_response_time",
        "events_per_active_day", "events_per_active_week", "transactions_per_active_week",
    ]
    labelled = early.join(late, "user_id", "left").fillna(0, subset=["late_activity_sum"])
    labelled = labelled.withColumn("dropout", (F.col("late_activity_sum") == 0).cast("int"))
    out = labelled.join(profile, "user_id", "left").join(summary.select("user_id", *ratios), "user_id", "left")
    numeric = [f.name for f in out.schema if f.dataType.typeName() in ("long", "integer", "double") and f.name != "user_id"]
    return out.fillna(0, subset=numeric)
