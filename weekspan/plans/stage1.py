"""Stage 1: one row per learner, features of weeks 0-2, label "came back later"."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame

from weekspan.operators.clean import clean_events
from weekspan.operators.demographics import demographic_categories, demographic_features
from weekspan.operators.features import STAGE1_FEATURES, stage1_behavioral
from weekspan.operators.labels import came_back, came_back_by_last_event
from weekspan.operators.timeline import early_window, placed_logs
from weekspan.session import durable
from weekspan.sources.logs import Logs


EARLY_EVENT_COLUMNS = [
    "user_id", "event_id", "event_date", "event_type", "action", "session_id", "topic_id", "date", "hour",
]


@dataclass(frozen=True)
class Dataset:
    df: DataFrame
    feature_cols: list[str]


def stage1_dataset(
    raw: Logs,
    include_demographics: bool = True,
    categories: dict[str, Sequence[str]] | None = None,
    early_end: int = 2,
    return_from: int = 3,
    return_to: int | None = None,
) -> Dataset:
    logs, anchors = placed_logs(raw)
    # several aggregations read the early events: those few weeks are stored once, the whole log never
    early_events = durable(early_window(logs.events, 0, early_end).select(*EARLY_EVENT_COLUMNS))
    early_transactions = early_window(logs.transactions, 0, early_end)
    df = stage1_behavioral(early_events, early_transactions)
    features = list(STAGE1_FEATURES)
    if include_demographics:
        categories = categories or demographic_categories(logs.users)
        demographics = demographic_features(logs.users, categories)
        extra = [c for c in demographics.columns if c != "user_id"]
        df = df.join(demographics, "user_id", "left").fillna(0, subset=extra)
        features += extra
    if return_to is None:
        df = came_back_by_last_event(clean_events(raw.events), anchors, df, return_from)
    else:
        df = came_back(logs.events, df, return_from, return_to)
    return Dataset(df.select("user_id", *features, "came_back"), features)
