"""User-relative time: first activity, relative weeks, the gap-filled weekly spine and its dates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weekspan.functions.scalars import WEEK_MICROS, days_after, floor_units, micros_between
from weekspan.functions.skew import ROWS_PER_TASK, attach
from weekspan.operators.clean import clean_events, clean_transactions, clean_users
from weekspan.session import durable
from weekspan.sources.logs import Logs

WEEKS_A_TASK = 200_000


def first_activity(transactions: DataFrame, ts: str = "start_time", out: str = "first_activity_time") -> DataFrame:
    """Earliest transaction of each user: the anchor of week 0."""
    return transactions.groupBy("user_id").agg(F.min(ts).alias(out))


def relative_week(ts: str, anchor: str = "first_activity_time"):
    """Whole weeks since the anchor: negative before it, null without one."""
    return floor_units(micros_between(anchor, ts), WEEK_MICROS)


def user_anchors(transactions: DataFrame) -> DataFrame:
    """(user_id, first_activity_time, _n): anchor and number of transactions of every user, stored."""
    return durable(transactions.groupBy("user_id").agg(F.min("start_time").alias("first_activity_time"), F.count(F.lit(1)).alias("_n")), "per_user")


def add_relative_weeks(
    events: DataFrame, transactions: DataFrame, rows_per_task: int = ROWS_PER_TASK, per_user: DataFrame | None = None
) -> tuple[DataFrame, DataFrame]:
    """Both logs with the anchor and the week; a stored table per user gives anchors and the sizes of hot users."""
    per_user = user_anchors(transactions) if per_user is None else per_user
    anchor, sizes = per_user.drop("_n"), per_user.select("user_id", "_n")
    events = attach(events, anchor, "user_id", ["event_id", "event_date"], rows_per_task)
    transactions = attach(transactions, anchor, "user_id", ["transaction_id", "start_time"], rows_per_task, sizes)
    return (
        events.withColumn("relative_week", relative_week("event_date")),
        transactions.withColumn("relative_week", relative_week("start_time")),
    )


def placed_logs(raw: Logs, rows_per_task: int = ROWS_PER_TASK) -> tuple[Logs, DataFrame]:
    """Cleaned users, events and transactions on the user's own weekly clock, and the anchors of ``user_anchors``.

    Nothing but the anchors is stored: for whoever reads each log once, only the columns it needs are read and placed.
    """
    transactions = clean_transactions(raw.transactions)
    per_user = user_anchors(transactions)
    events, transactions = add_relative_weeks(clean_events(raw.events), transactions, rows_per_task, per_user)
    return Logs(clean_users(raw.users), events, transactions), per_user.drop("_n")


def clean_logs(raw: Logs, rows_per_task: int = ROWS_PER_TASK) -> Logs:
    """The logs of ``placed_logs``, both stored once placed, for several readers."""
    logs, _ = placed_logs(raw, rows_per_task)
    return Logs(logs.users, durable(logs.events, "events"), durable(logs.transactions, "transactions"))


def cleaned_logs(raw: Logs) -> Logs:
    """Cleaned users, events and transactions without weeks."""
    return Logs(clean_users(raw.users), clean_events(raw.events), clean_transactions(raw.transactions))


def early_window(df: DataFrame, first: int = 0, last: int = 2) -> DataFrame:
    return df.filter(F.col("relative_week").between(first, last))


def deal_users(weekly: DataFrame, weeks_a_task: int = WEEKS_A_TASK) -> DataFrame:
    """The stored weekly rows dealt out by user, into as many tasks as the weeks between them will need.

    A number of its own keeps adaptive execution from joining the small sparse parts, whose timelines are long.
    """
    last = weekly.filter("relative_week >= 0").groupBy("user_id").agg((F.max("relative_week") + 1).alias("_weeks"))
    weeks = last.agg(F.sum("_weeks")).first()[0] or 0
    at_once = min(weekly.sparkSession.sparkContext.defaultParallelism, weeks * 10 // weeks_a_task)
    return weekly.repartition(max(1, at_once, -(-weeks // weeks_a_task)), "user_id")


def weekly_timeline(weekly: DataFrame, whole: Sequence[str] = ()) -> DataFrame:
    """Weeks 0..last observed week of each user, observed or not. Users without a week >= 0 have no timeline.

    Every observed week brings the unobserved ones since the week before it, so only the sparse rows are shuffled.
    Columns named in ``whole`` belong to the user and stand on unobserved weeks too. Rows without a user make one
    timeline without observations.
    """
    week, known = F.col("relative_week"), F.col("user_id").isNotNull()
    before = F.lag("relative_week").over(Window.partitionBy("user_id").orderBy("relative_week"))
    first = F.coalesce(F.col("_before") + 1, F.lit(0)).cast("long")
    again = F.col("_before") == week
    weeks = F.when(again & ~known, F.array().cast("array<bigint>")).when(again, F.array(week.cast("long"))).otherwise(F.sequence(first, week.cast("long")))
    spread = weekly.filter(week >= 0).withColumn("_before", before).withColumn("_week", F.explode(weeks))
    seen = known & (F.col("_week") == week)
    values = [F.col(f"`{c}`") if c in whole else F.when(seen, F.col(f"`{c}`")).alias(c) for c in weekly.columns if c not in ("user_id", "relative_week")]
    return spread.select("user_id", F.col("_week").alias("relative_week"), *values)


def with_anchor(df: DataFrame, anchors: DataFrame, anchor: str = "first_activity_time") -> DataFrame:
    """Add ``_anchor``, the start of the user's week 0. ``anchors`` has one row per user."""
    return df.join(anchors.select("user_id", F.col(anchor).alias("_anchor")), "user_id", "left")


def week_dates(anchored: DataFrame) -> DataFrame:
    """week_start = ``_anchor`` + 7 days per week, and its year and day of year."""
    return (
        anchored.withColumn("week_start", days_after("_anchor", F.col("relative_week") * 7))
        .withColumns({"year": F.year("week_start"), "day": F.dayofyear("week_start")})
        .drop("_anchor")
    )


def add_week_dates(timeline: DataFrame, anchors: DataFrame, anchor: str = "first_activity_time") -> DataFrame:
    """Start, year and day of year of every week, counted from the user's anchor."""
    return week_dates(with_anchor(timeline, anchors, anchor))
