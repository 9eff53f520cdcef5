"""Data profiles: value counts, null counts, time ranges, weekly volumes, dataset summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weekspan.functions.scalars import monday_of


def value_counts(df: DataFrame, column: str, drop_null: bool = False, top: int | None = None) -> DataFrame:
    kept = df.filter(F.col(column).isNotNull()) if drop_null else df
    counts = kept.groupBy(F.col(column).cast("string").alias("value")).agg(F.count(F.lit(1)).alias("n"))
    return counts if top is None else counts.orderBy(F.desc("n"), "value").limit(top)


def null_counts(df: DataFrame) -> DataFrame:
    """Number of nulls per column, one row each."""
    return df.agg(*[F.count_if(F.col(f"`{c}`").isNull()).alias(c) for c in df.columns]).unpivot(
        [], df.columns, "column", "n_null"
    )


def time_range(df: DataFrame, ts: str) -> DataFrame:
    return df.agg(F.min(ts).alias("first"), F.max(ts).alias("last"))


def data_profile(users: DataFrame, events: DataFrame, transactions: DataFrame, summary: DataFrame) -> DataFrame:
    """Value counts with nulls, null counts, time ranges and flag means as (section, item, value) rows."""

    def part(df: DataFrame, section: str, item, value) -> DataFrame:
        return df.select(F.lit(section).alias("section"), item.alias("item"), value.cast("double").alias("value"))

    def epoch(c: str):
        return F.timestamp_diff("SECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col(c))

    parts = [
        part(value_counts(events, "action", drop_null=True, top=20), "action", F.col("value"), F.col("n")),
        part(value_counts(events, "event_type"), "event_type", F.col("value"), F.col("n")),
        part(value_counts(transactions, "evaluation"), "evaluation", F.col("value"), F.col("n")),
        part(value_counts(users, "gender"), "gender", F.col("value"), F.col("n")),
        part(null_counts(users), "users nulls", F.col("column"), F.col("n_null")),
        part(null_counts(summary), "summary nulls", F.col("column"), F.col("n_null")),
    ]
    for df, ts in ((events, "event_date"), (transactions, "start_time"), (transactions, "commit_time")):
        for end in ("first", "last"):
            parts.append(part(time_range(df, ts), "time range", F.lit(f"{ts} {end}"), epoch(end)))
    flags = ["has_events", "has_transactions", "has_response_time"]
    means = summary.agg(*[F.avg(c).alias(c) for c in flags]).unpivot([], flags, "item", "v")
    parts.append(part(means, "flag means", F.col("item"), F.col("v")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def calendar_week_counts(events: DataFrame, ts: str = "event_date") -> DataFrame:
    """Events per calendar week, labelled by its Sunday, with zero rows for empty weeks in between."""
    sunday = F.date_add(monday_of(F.to_date(ts)), 6)
    counts = events.groupBy(sunday.alias("week_end")).agg(F.count(F.lit(1)).alias("n_events"))
    span = counts.agg(F.min("week_end").alias("a"), F.max("week_end").alias("b"))
    weeks = span.select(F.explode(F.sequence("a", "b", F.expr("interval 7 days"))).alias("week_end"))
    return weeks.join(counts, "week_end", "left").fillna(0, subset=["n_events"])


def calendar_week_counts_complete(events: DataFrame, ts: str = "event_date") -> DataFrame:
    """Events per observed calendar week; the last week only if the data reaches its end."""
    monday = monday_of(F.to_date(ts))
    counts = events.groupBy(monday.alias("week_start")).agg(
        F.count(F.lit(1)).alias("n_events"), F.max(ts).alias("_latest")
    )
    whole = Window.partitionBy(F.lit(0))  # one row per calendar week
    week_end = F.timestamp_add("DAY", F.lit(7), F.col("week_start").cast("timestamp_ntz"))
    unfinished = F.max("_latest").over(whole) < F.timestamp_add("MICROSECOND", F.lit(-1), week_end)
    is_last = F.col("week_start") == F.max("week_start").over(whole)
    return counts.withColumn("_drop", is_last & unfinished).filter(~F.col("_drop")).select("week_start", "n_events")


def dataset_summary(df: DataFrame, label: str, user: str = "user_id") -> DataFrame:
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_distinct(user).alias("n_users"),
        F.count(label).alias("n_labelled"),
        F.avg(label).alias("label_rate"),
        F.count_if(F.col(label) == 0).alias("n_negative"),
        F.count_if(F.col(label) == 1).alias("n_positive"),
    )


def group_counts(df: DataFrame, column: str, out: str = "n_users") -> DataFrame:
    return df.groupBy(column).agg(F.count(F.lit(1)).alias(out)).orderBy(F.desc(out), column)


def unpivot(df: DataFrame, ids: Sequence[str], columns: Sequence[str], name: str, value: str) -> DataFrame:
    return df.select(*ids, *[F.col(c).cast("double").alias(c) for c in columns]).unpivot(list(ids), list(columns), name, value)
