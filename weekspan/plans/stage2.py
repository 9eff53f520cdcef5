"""Stage 2: one row per learner-week on the gap-filled timeline, with the interruption label."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame

from weekspan.functions.scalars import in_summer
from weekspan.operators.features import WEEKLY_FEATURES, fill_missing_columns, user_summary, weekly_features
from weekspan.operators.labels import add_dropout_labels
from weekspan.operators.timeline import cleaned_logs, deal_users, first_activity, placed_logs, week_dates, weekly_timeline, with_anchor
from weekspan.plans.stage1 import Dataset
from weekspan.session import durable
from weekspan.sources.logs import Logs


def labelled_timeline(logs: Logs, horizon_weeks: int = 4, anchors: DataFrame | None = None) -> DataFrame:
    """Dense weeks with dates and labels, features still null where nothing was observed.

    The sparse weekly table is stored and dealt out by user once; anchors are joined to it, and the dense weeks are made,
    dated and labelled where they are. ``anchors`` saves a pass over the logs.
    """
    weekly = durable(weekly_features(logs.events, logs.transactions), "weekly")
    anchored = with_anchor(deal_users(weekly), first_activity(logs.transactions) if anchors is None else anchors)
    return add_dropout_labels(week_dates(weekly_timeline(anchored, ["_anchor"])), horizon_weeks)


@dataclass(frozen=True)
class Stage2(Dataset):
    """The weekly table with the cleaned users and their whole-history summary."""

    users: DataFrame
    user_summary: DataFrame


def stage2_result(raw: Logs, horizon_weeks: int = 4, actions: Sequence[str] | None = None, event_types: Sequence[str] | None = None) -> Stage2:
    """The stage 2 table together with its users; each log is placed for the weeks and read once more for the summary."""
    logs, anchors = placed_logs(raw)
    table = _filled(labelled_timeline(logs, horizon_weeks, anchors))
    plain = cleaned_logs(raw)
    return Stage2(table.df, table.feature_cols, logs.users, user_summary(plain.users, plain.events, plain.transactions, actions, event_types))


def _filled(timeline: DataFrame) -> Dataset:
    filled = fill_missing_columns(timeline, WEEKLY_FEATURES)
    return Dataset(filled.withColumn("is_summer", in_summer("week_start")), list(WEEKLY_FEATURES))


def stage2_dataset(raw: Logs, horizon_weeks: int = 4) -> Dataset:
    logs, anchors = placed_logs(raw)
    return _filled(labelled_timeline(logs, horizon_weeks, anchors))
