"""Log cleaning: recoding, lenient parsing, calendar columns, bounded response times."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weekspan.functions.scalars import monday_of, parse_timestamp, seconds_between, truthy

# Score of each evaluation; anything else scores 0.
EVALUATION_SCORES = {"CORRECT": 1.0, "PARTIAL": 0.5}
MAX_RESPONSE_SEC = 3600


def clean_users(users: DataFrame) -> DataFrame:
    gender = F.when(F.col("gender") == "STAR", F.lit("Other")).when(F.col("gender") != "*", F.col("gender"))
    known = {c: F.coalesce(F.col(c), F.lit("Unknown")) for c in ("canton", "class_level", "class_id")}
    return users.withColumns({"gender": F.coalesce(gender, F.lit("Unknown")), **known, "study": truthy("study")})


def add_calendar(df: DataFrame, ts: str) -> DataFrame:
    """date, year, month, dayofweek (Monday 0), hour, and the Monday/Sunday week as text."""
    day = F.to_date(ts)
    monday = monday_of(day)
    return df.withColumns(
        {
            "date": day,
            "year": F.year(day),
            "month": F.month(day),
            "dayofweek": F.weekday(day),
            "hour": F.hour(ts),
            "week": F.concat_ws("/", monday.cast("string"), F.date_add(monday, 6).cast("string")),
        }
    )


def clean_events(events: DataFrame) -> DataFrame:
    dated = events.withColumn("event_date", parse_timestamp("event_date")).dropna(subset=["user_id", "event_date"])
    return add_calendar(dated, "event_date")


def clean_transactions(transactions: DataFrame) -> DataFrame:
    dated = transactions.withColumns(
        {"start_time": parse_timestamp("start_time"), "commit_time": parse_timestamp("commit_time")}
    ).dropna(subset=["user_id", "start_time"])
    evaluation = F.coalesce(F.col("evaluation"), F.lit("UNKNOWN"))
    score = F.lit(0.0)
    for name, points in EVALUATION_SCORES.items():
        score = F.when(evaluation == name, F.lit(points)).otherwise(score)
    response = seconds_between("start_time", "commit_time")
    return add_calendar(dated, "start_time").withColumns(
        {
            "evaluation": evaluation,
            "evaluation_score": score,
            "is_correct": (evaluation == "CORRECT").cast("int"),
            "is_partial": (evaluation == "PARTIAL").cast("int"),
            "is_unknown_eval": (evaluation == "UNKNOWN").cast("int"),
            "response_time_sec": F.when(response.between(0, MAX_RESPONSE_SEC), response),
        }
    )
