"""Queries over weekly features, the dense timeline and the interruption labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from weekspan.catalog.base import cte, query
from weekspan.catalog.logs import ACTIONS, TYPES, long_logs, short_logs
from weekspan.operators import features, labels, profile, timeline
from weekspan.plans import stage2
from weekspan.sources import star

EVENT_WEEK = "n_events:i n_active_days:i mean_hour:d n_click_events:i n_view_events:i n_sessions:i n_topics_event:i"
TX_WEEK = (
    "n_transactions:i correct_rate:d partial_rate:d mean_evaluation_score:d avg_response_time:d n_documents:i n_topics_transaction:i"
)
KEYS = "user_id:i relative_week:i"
WEEK = f"{KEYS} {EVENT_WEEK} {TX_WEEK} activity_score:i"


def weekly(logs):
    return features.weekly_features(logs.events, logs.transactions)


@query("weekly_events", f"{KEYS} {EVENT_WEEK} std_hour:d", "select * from lx_week_events", "lx_week_events")
def weekly_events(spark, folder):
    return features.weekly_events(short_logs(spark, folder).events, extended=True)


@query(
    "weekly_transactions",
    f"{KEYS} {TX_WEEK} std_evaluation_score:d std_response_time:d retry_ratio:d",
    "select * from ll_week_tx",
    "ll_week_tx",
)
def weekly_transactions(spark, folder):
    return features.weekly_transactions(long_logs(spark, folder).transactions, extended=True)


@query("weekly_features", WEEK, "select * from ll_weekly", "ll_weekly")
def weekly_features(spark, folder):
    return weekly(long_logs(spark, folder))


cte(
    "lx_week_sessions",
    """
select user_id, relative_week, avg(dur) as session_duration_mean, stddev_samp(dur) as session_duration_std,
       avg(gap) as time_between_sessions_mean
from (select *, (epoch_us(e) - epoch_us(s)) / 1e6 as dur,
             case when lag(e) over w is null then null when s < lag(e) over w then 0
                  else (epoch_us(s) - epoch_us(lag(e) over w)) / 1e6 end as gap
      from (select user_id, session_id, min(event_date) as s, max(event_date) as e, min(relative_week) as relative_week
            from lx_ev where session_id is not null group by user_id, session_id)
      where relative_week is not null
      window w as (partition by user_id, relative_week order by s, session_id))
group by user_id, relative_week
""",
    "lx_ev",
)
cte(
    "lx_week_review",
    """select user_id, relative_week,
       count(*) filter (action = 'REVIEW_TASK') / nullif(count(*) filter (action = 'SUBMIT_ANSWER'), 0)::double as review_rate
       from lx_ev where action is not null and relative_week is not null group by all""",
    "lx_ev",
)


@query(
    "weekly_sessions",
    f"{KEYS} session_duration_mean:f session_duration_std:f time_between_sessions_mean:f",
    "select * from lx_week_sessions",
    "lx_week_sessions",
)
def weekly_sessions(spark, folder):
    return features.weekly_sessions(short_logs(spark, folder).events)


@query("weekly_review_rate", f"{KEYS} review_rate:d", "select * from lx_week_review", "lx_week_review")
def weekly_review_rate(spark, folder):
    return features.weekly_review_rate(short_logs(spark, folder).events)


@query(
    "weekly_extended",
    f"{WEEK} std_hour:d std_evaluation_score:d std_response_time:d session_duration_mean:f session_duration_std:f "
    "time_between_sessions_mean:f retry_ratio:d review_rate:d",
    """select w.*, coalesce(session_duration_mean, 0) as session_duration_mean, coalesce(session_duration_std, 0) as session_duration_std,
       coalesce(time_between_sessions_mean, 0) as time_between_sessions_mean, coalesce(review_rate, 0) as review_rate
       from lx_weekly w left join lx_week_sessions using (user_id, relative_week) left join lx_week_review using (user_id, relative_week)""",
    "lx_weekly lx_week_sessions lx_week_review",
)
def weekly_extended(spark, folder):
    logs = short_logs(spark, folder)
    return features.weekly_extended(logs.events, logs.transactions)


ROLLUP = (
    "user_id:i total_events_0_2:i total_transactions_0_2:i total_clicks_0_2:i total_views_0_2:i total_sessions_0_2:i "
    "total_topics_event_0_2:i total_topics_transaction_0_2:i total_documents_0_2:i active_weeks_0_2:i total_activity_0_2:i "
    "max_activity_0_2:i mean_correct_rate_0_2:d mean_partial_rate_0_2:d mean_evaluation_score_0_2:d mean_response_time_0_2:d"
)
for v in ("lx", "ll"):
    cte(
        f"{v}_rollup",
        f"""
select user_id, sum(n_events) as total_events_0_2, sum(n_transactions) as total_transactions_0_2, sum(n_click_events) as total_clicks_0_2,
       sum(n_view_events) as total_views_0_2, sum(n_sessions) as total_sessions_0_2, sum(n_topics_event) as total_topics_event_0_2,
       sum(n_topics_transaction) as total_topics_transaction_0_2, sum(n_documents) as total_documents_0_2,
       sum((activity_score > 0)::int) as active_weeks_0_2, sum(activity_score) as total_activity_0_2,
       max(activity_score) as max_activity_0_2, avg(correct_rate) as mean_correct_rate_0_2, avg(partial_rate) as mean_partial_rate_0_2,
       avg(mean_evaluation_score) as mean_evaluation_score_0_2, avg(avg_response_time) as mean_response_time_0_2
from {v}_weekly where relative_week between 0 and 2 group by user_id
""",
        f"{v}_weekly",
    )


@query("early_week_rollup", ROLLUP, "select * from ll_rollup", "ll_rollup")
def early_week_rollup(spark, folder):
    return features.early_week_rollup(weekly(long_logs(spark, folder)))


@query("weekly_timeline", f"{KEYS} {EVENT_WEEK} {TX_WEEK} activity_score:i", "select * from lx_timeline", "lx_timeline")
def weekly_timeline(spark, folder):
    return timeline.weekly_timeline(weekly(short_logs(spark, folder)))


@query(
    "week_dates",
    f"{KEYS} n_events:i week_start:t year:i day:i",
    "select *, year(week_start) as year, dayofyear(week_start) as day from lx_timeline",
    "lx_timeline",
)
def week_dates(spark, folder):
    logs = short_logs(spark, folder)
    spine = timeline.weekly_timeline(weekly(logs))
    return timeline.add_week_dates(spine, timeline.first_activity(logs.transactions))


@query(
    "dropout_labels",
    f"{KEYS} week_start:t is_active:i is_dropout_point:i",
    "select user_id, idx as relative_week, week_start, is_active, is_dropout_point from ll_labels",
    "ll_labels",
)
def dropout_labels(spark, folder):
    """Every learner-week of the long view."""
    return stage2.labelled_timeline(long_logs(spark, folder))


DIGEST = " ".join(f"{c}:f" for c in features.WEEKLY_FEATURES)
DIGEST_SQL = ", ".join(f"sum({c} * (1 + relative_week % 7)) / pi() as {c}" for c in features.WEEKLY_FEATURES)


@query(
    "stage2_dataset",
    f"user_id:i n_weeks:i n_active:i n_labelled:i n_positive:i n_summer:i last_week_start:t {DIGEST}",
    f"""select user_id, count(*) as n_weeks, sum(is_active) as n_active, count(is_dropout_point) as n_labelled,
        sum(is_dropout_point) as n_positive, sum(is_summer::int) as n_summer, max(week_start) as last_week_start, {DIGEST_SQL}
        from ll_stage2 group by user_id""",
    "ll_stage2",
)
def stage2_table(spark, folder):
    """The full stage 2 table of the long view, condensed to week-weighted feature sums per learner."""
    df = stage2.stage2_dataset(star.long_view(spark, folder)).df
    return df.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("n_weeks"),
        F.sum("is_active").alias("n_active"),
        F.count("is_dropout_point").alias("n_labelled"),
        F.sum("is_dropout_point").alias("n_positive"),
        F.count_if("is_summer").alias("n_summer"),
        F.max("week_start").alias("last_week_start"),
        *[F.expr(f"sum({c} * (1 + relative_week % 7)) / pi() as {c}") for c in features.WEEKLY_FEATURES],
    )


@query(
    "stage2_short",
    f"{KEYS} week_start:t is_active:i is_dropout_point:i is_summer:b " + " ".join(f"{c}:d" for c in features.WEEKLY_FEATURES),
    "select * from lx_stage2",
    "lx_stage2",
)
def stage2_short(spark, folder):
    """The same table of the short view, every row."""
    return stage2.stage2_dataset(star.short_view(spark, folder)).df


@query(
    "stage2_users",
    "user_id:i gender:s canton:s study:b n_events:i n_transactions:i n_active_days:i correct_rate:d n_weeks:i",
    """select s.user_id, s.gender, s.canton, s.study, s.n_events, s.n_transactions, s.n_active_days, s.correct_rate, count(t.idx) as n_weeks
       from lx_summary s left join lx_timeline t using (user_id) group by all""",
    "lx_summary lx_timeline",
)
def stage2_users(spark, folder):
    """Users of the stage 2 result with their summary and the number of their weeks."""
    result = stage2.stage2_result(star.short_view(spark, folder), actions=ACTIONS, event_types=TYPES)
    spans = result.df.groupBy("user_id").agg(F.count(F.lit(1)).alias("n_weeks"))
    return result.user_summary.join(spans, "user_id", "left").fillna(0, subset=["n_weeks"])


AS_OF = "2001-12-01 00:00:00"
TOUCHES_SUMMER = """exists(from range(1990, 2010) y(yr) where {0} <= make_timestamp(yr, 8, 31, 0, 0, 0) and {1} >= make_timestamp(yr, 7, 1, 0, 0, 0)
                    and yr between year({0}) and year({1}))"""
cte(
    "ll_points",
    f"""
select user_id, relative_week, week_start, next_week is null as is_last_week,
       (epoch_us(timestamp '{AS_OF}') - epoch_us(week_start)) // 86400000000 / 7.0::double as weeks_since,
       case when next_week is null then (epoch_us(timestamp '{AS_OF}') - epoch_us(week_start)) // 86400000000 / 7.0::double > 4
            else next_week - relative_week > 4
                 and not {TOUCHES_SUMMER.format("(week_start + to_days(7))", "(next_start - to_days(7))")} end as is_dropout_point
from (select *, lead(relative_week) over w as next_week, lead(week_start) over w as next_start
      from (select user_id, relative_week, first_event + to_days(cast(7 * relative_week as integer)) as week_start
            from ll_week_events join ll_user_events using (user_id))
      window w as (partition by user_id order by relative_week))
""",
    "ll_week_events",
    "ll_user_events",
)


def points(spark, folder):
    events = long_logs(spark, folder).events
    first_events = events.groupBy("user_id").agg(F.min("event_date").alias("first_event"))
    return labels.gap_dropout_points(features.weekly_events(events), first_events, AS_OF)


@query(
    "gap_dropout_points",
    f"{KEYS} week_start:t is_last_week:b weeks_since:d is_dropout_point:b",
    "select * from ll_points",
    "ll_points",
)
def gap_dropout_points(spark, folder):
    return points(spark, folder)


@query(
    "time_to_dropout",
    "user_id:i dropout_indicator:i dropout_week:i",
    """select user_id, (count(*) filter (is_dropout_point) > 0)::int as dropout_indicator,
       coalesce(min(relative_week) filter (is_dropout_point), max(relative_week)) as dropout_week from ll_points group by user_id""",
    "ll_points",
)
def time_to_dropout(spark, folder):
    return labels.time_to_dropout(points(spark, folder))


cte(
    "ll_activity_from_event",
    """select t.user_id, idx, n_weeks, (coalesce(t.n_events, 0) > 0)::int as is_active,
       first_event + to_days(cast(7 * idx as integer)) as week_start
       from ll_timeline t left join ll_user_events u on t.user_id = u.user_id""",
    "ll_timeline",
    "ll_user_events",
)


@query(
    "dropout_labels_event_anchor",
    "user_id:i year:i n_weeks:i n_labelled:i n_positive:i week_sum:i",
    f"""select user_id, year(week_start) as year, count(*) as n_weeks, count(label) as n_labelled, sum(label) as n_positive,
        sum(label * idx) as week_sum
        from (select *, case when idx + 4 >= n_weeks then null when ahead > 0 then 0
                             when {TOUCHES_SUMMER.format("(week_start + to_days(7))", "(week_start + to_days(28))")} then 0 else 1 end as label
              from (select *, sum(is_active) over (partition by user_id order by idx rows between 1 following and 4 following) as ahead
                    from ll_activity_from_event))
        group by user_id, year(week_start)""",
    "ll_activity_from_event",
)
def dropout_labels_event_anchor(spark, folder):
    logs = long_logs(spark, folder)
    first_events = logs.events.groupBy("user_id").agg(F.min("event_date").alias("first_event"))
    spine = timeline.weekly_timeline(weekly(logs))
    df = labels.add_dropout_labels_from(spine, first_events)
    return df.groupBy("user_id", "year").agg(
        F.count(F.lit(1)).alias("n_weeks"),
        F.count("is_dropout_point").alias("n_labelled"),
        F.sum("is_dropout_point").alias("n_positive"),
        F.expr("sum(is_dropout_point * relative_week)").alias("week_sum"),
    )


cte(
    "ll_late",
    "select user_id, sum(activity_score) as late_activity_sum from ll_weekly where relative_week between 3 and 26 group by user_id",
    "ll_weekly",
)


@query(
    "early_dropout_label",
    ROLLUP + " late_activity_sum:i dropout:i gender:s canton:s class_level:s study:b correct_rate:d partial_rate:d "
    "avg_response_time:d events_per_active_day:d events_per_active_week:d transactions_per_active_week:d",
    """select r.* replace (coalesce(mean_correct_rate_0_2, 0) as mean_correct_rate_0_2, coalesce(mean_partial_rate_0_2, 0) as mean_partial_rate_0_2,
              coalesce(mean_evaluation_score_0_2, 0) as mean_evaluation_score_0_2, coalesce(mean_response_time_0_2, 0) as mean_response_time_0_2),
              coalesce(late_activity_sum, 0) as late_activity_sum, (coalesce(late_activity_sum, 0) = 0)::int as dropout,
              gender, canton, class_level, study, coalesce(correct_rate, 0) as correct_rate, coalesce(partial_rate, 0) as partial_rate,
              coalesce(avg_response_time, 0) as avg_response_time,
              coalesce(e.n_events / nullif(e.n_active_days, 0)::double, 0) as events_per_active_day,
              coalesce(e.n_events / nullif(e.n_active_weeks, 0)::double, 0) as events_per_active_week,
              coalesce(t.n_transactions / nullif(t.n_transaction_weeks, 0)::double, 0) as transactions_per_active_week
       from ll_rollup r left join ll_late using (user_id) left join users_c using (user_id)
       left join ll_user_events e using (user_id) left join ll_user_tx t using (user_id)""",
    "ll_rollup ll_late users_c ll_user_events ll_user_tx",
)
def early_dropout_label(spark, folder):
    logs = long_logs(spark, folder)
    week = weekly(logs)
    summary = features.user_summary(logs.users, logs.events, logs.transactions)
    return labels.early_dropout_label(week, features.early_week_rollup(week), logs.users, summary, 3, 26)


SUMMARY = "dataset:s n_rows:i n_users:i n_labelled:i label_rate:d n_negative:i n_positive:i"


@query(
    "dataset_summary",
    SUMMARY,
    " union all ".join(
        f"""select '{name}' as dataset, count(*) as n_rows, count(distinct user_id) as n_users, count({label}) as n_labelled,
            avg({label}) as label_rate, count(*) filter ({label} = 0) as n_negative, count(*) filter ({label} = 1) as n_positive
            from {table}"""
        for name, label, table in (("stage1", "came_back", "lx_stage1"), ("stage2", "is_dropout_point", "ll_labels"))
    ),
    "lx_stage1 ll_labels",
)
def dataset_summary(spark, folder):
    from weekspan.catalog.logs import stage1

    parts = {
        "stage1": profile.dataset_summary(stage1(spark, folder, include_demographics=False).df, "came_back"),
        "stage2": profile.dataset_summary(stage2.labelled_timeline(long_logs(spark, folder)), "is_dropout_point"),
    }
    first, second = (df.withColumn("dataset", F.lit(name)) for name, df in parts.items())
    return first.unionByName(second)
