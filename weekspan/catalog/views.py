"""Shared sub-selects of the oracle SQL: the derived logs, their cleaning, and the weekly timeline."""

from __future__ import annotations

from weekspan.catalog.base import cte

cte(
    "lx_users",
    """
select c_custkey as user_id,
       case c_mktsegment when 'BUILDING' then 'FEMALE' when 'AUTOMOBILE' then 'MALE' when 'HOUSEHOLD' then 'STAR'
            when 'FURNITURE' then '*' end as gender,
       case when c_acctbal < 0 then null else n_name end as canton,
       case when c_custkey % 11 = 0 then null
            else (case c_custkey % 4 when 0 then 'Gymnasium' when 1 then 'WMS' when 2 then 'BM' else 'KME Passerelle' end)
                 || ' - ' || cast(c_custkey % 5 + 1 as varchar) || '. Jahr' end as class_level,
       case when c_custkey % 6 = 0 then null else 'c' || cast(c_custkey % 40 as varchar) end as class_id,
       case c_custkey % 3 when 0 then 'True' when 1 then 'False' end as study
from customer left join nation on c_nationkey = n_nationkey
""",
)
cte(
    "lx_transactions",
    """
select event_id as transaction_id, user_id, ts as start_time,
       ts + to_microseconds(cast(round((value * 30 - 60) * 1000000) as bigint)) as commit_time,
       case k % 5 when 0 then 'CORRECT' when 1 then 'PARTIAL' when 2 then 'WRONG' when 3 then 'CORRECT' end as evaluation,
       k as document_id, k % 7 as topic_id, k % 3 as challenge_id
from (select *, cast(json_extract_string(props, '$.k') as bigint) as k from events)
where event_type = 'purchase'
""",
)
cte(
    "lx_events",
    """
select event_id, user_id, ts as event_date, upper(event_type) as event_type,
       case when event_type = 'view' then 'REVIEW_TASK' when event_type = 'click' then 'SUBMIT_ANSWER'
            when event_type = 'signup' then 'OPEN_TOPIC' end as action,
       case when event_type <> 'error' then cast(user_id as varchar) || '-' || cast(sid as varchar) end as session_id,
       case when k % 10 = 0 then null else k % 13 end as topic_id
from (select *, sum(is_new) over (partition by user_id order by ts, event_id rows unbounded preceding) as sid
      from (select *, cast(json_extract_string(props, '$.k') as bigint) as k,
                   case when ts - lag(ts) over (partition by user_id order by ts, event_id) <= interval 6 hour
                        then 0 else 1 end as is_new
            from events where event_type <> 'purchase'))
""",
)
cte(
    "ll_events",
    """
select o_orderkey as event_id, o_custkey as user_id, o_orderdate as event_date,
       case o_orderstatus when 'O' then 'CLICK' when 'F' then 'VIEW' else 'OTHER' end as event_type,
       case o_orderpriority when '1-URGENT' then 'REVIEW_TASK' when '5-LOW' then null else 'SUBMIT_ANSWER' end as action,
       cast(o_orderkey % 997 as varchar) as session_id, o_orderkey % 17 as topic_id
from orders
""",
)
cte(
    "ll_transactions",
    """
select l_orderkey * 10 + l_linenumber as transaction_id, o_custkey as user_id, o_orderdate as start_time,
       o_orderdate + to_microseconds(cast(round(l_quantity * 100) as bigint) * 1000000) as commit_time,
       case when l_linestatus = 'O' and l_returnflag = 'A' then null when l_returnflag = 'N' then 'CORRECT'
            when l_returnflag = 'A' then 'PARTIAL' else 'WRONG' end as evaluation,
       l_partkey as document_id, l_suppkey % 23 as topic_id, l_orderkey as challenge_id
from lineitem join orders on l_orderkey = o_orderkey
""",
)
cte(
    "users_c",
    """
select user_id, coalesce(case gender when '*' then null when 'STAR' then 'Other' else gender end, 'Unknown') as gender,
       coalesce(canton, 'Unknown') as canton, coalesce(class_level, 'Unknown') as class_level,
       coalesce(class_id, 'Unknown') as class_id, coalesce(study, 'False') <> 'False' as study
from lx_users
""",
    "lx_users",
)


def _calendar(ts: str) -> str:
    return f"""cast({ts} as date) as date, year({ts}) as year, month({ts}) as month, isodow({ts}) - 1 as dayofweek,
       hour({ts}) as hour,
       strftime(date_trunc('week', {ts}), '%Y-%m-%d') || '/' || strftime(date_trunc('week', {ts}) + interval 6 day, '%Y-%m-%d') as week"""




def _relative(ts: str) -> str:
    gap = f"(epoch_us({ts}) - epoch_us(first_activity_time))"
    return f"case when {gap} >= 0 then {gap} // 604800000000 else -((-{gap} + 604799999999) // 604800000000) end"


for v in ("lx", "ll"):
    cte(f"{v}_first", f"select user_id, min(start_time) as first_activity_time from {v}_transactions group by user_id", f"{v}_transactions")
    cte(
        f"{v}_ev",
        f"""
select e.*, {_calendar('event_date')}, first_activity_time, {_relative('event_date')} as relative_week
from {v}_events e left join {v}_first using (user_id)
where user_id is not null and event_date is not null
""",
        f"{v}_events",
        f"{v}_first",
    )
    cte(
        f"{v}_tx",
        f"""
select transaction_id, user_id, start_time, commit_time, coalesce(evaluation, 'UNKNOWN') as evaluation, document_id, topic_id,
       challenge_id, {_calendar('start_time')},
       case evaluation when 'CORRECT' then 1.0::double when 'PARTIAL' then 0.5::double else 0.0::double end as evaluation_score,
       (coalesce(evaluation, '') = 'CORRECT')::int as is_correct, (coalesce(evaluation, '') = 'PARTIAL')::int as is_partial,
       (evaluation is null)::int as is_unknown_eval,
       case when epoch_us(commit_time) - epoch_us(start_time) between 0 and 3600000000
            then (epoch_us(commit_time) - epoch_us(start_time)) / 1e6 end as response_time_sec,
       first_activity_time, {_relative('start_time')} as relative_week
from {v}_transactions left join {v}_first using (user_id)
where user_id is not null and start_time is not null
""",
        f"{v}_transactions",
        f"{v}_first",
    )
    # --- stage 1
    cte(f"{v}_ev02", f"select * from {v}_ev where relative_week between 0 and 2", f"{v}_ev")
    cte(f"{v}_tx02", f"select * from {v}_tx where relative_week between 0 and 2", f"{v}_tx")
    cte(
        f"{v}_s1_events",
        f"""
select user_id, count(event_id) as total_events_0_2, count(distinct date) as n_active_days_0_2,
       count(*) filter (event_type = 'CLICK') as n_click_events_0_2, count(*) filter (event_type = 'VIEW') as n_view_events_0_2,
       count(distinct session_id) as n_sessions_0_2, count(distinct topic_id) as n_topics_event_0_2,
       avg(hour) as mean_hour_0_2, stddev_samp(hour) as std_hour_0_2
from {v}_ev02 group by user_id
""",
        f"{v}_ev02",
    )
    cte(
        f"{v}_s1_tx",
        f"""
select user_id, count(transaction_id) as total_transactions_0_2, avg(is_correct) as correct_rate_0_2,
       avg(is_partial) as partial_rate_0_2, avg(evaluation_score) as mean_evaluation_score_0_2,
       stddev_samp(evaluation_score) as std_evaluation_score_0_2, avg(response_time_sec) as avg_response_time_0_2,
       stddev_samp(response_time_sec) as std_response_time_0_2, count(distinct document_id) as n_documents_0_2,
       count(distinct topic_id) as n_topics_transaction_0_2,
       count(transaction_id) / nullif(count(distinct document_id), 0)::double as retry_ratio_0_2
from {v}_tx02 group by user_id
""",
        f"{v}_tx02",
    )
    cte(
        f"{v}_s1_sessions",
        f"""
select user_id, avg(dur) as session_duration_mean_0_2, stddev_samp(dur) as session_duration_std_0_2,
       avg(gap) as time_between_sessions_mean_0_2
from (select user_id, (epoch_us(e) - epoch_us(s)) / 1e6 as dur,
             greatest((epoch_us(s) - lag(epoch_us(e)) over (partition by user_id order by s, session_id)) / 1e6,
                      case when lag(e) over (partition by user_id order by s, session_id) is not null then 0 end) as gap
      from (select user_id, session_id, min(event_date) as s, max(event_date) as e from {v}_ev02
            where session_id is not null group by all))
group by user_id
""",
        f"{v}_ev02",
    )
    cte(
        f"{v}_s1_review",
        f"""
select user_id, sum((action = 'REVIEW_TASK')::int) / nullif(sum((action = 'SUBMIT_ANSWER')::int), 0)::double as review_rate_0_2
from {v}_ev02 where action is not null group by user_id
""",
        f"{v}_ev02",
    )
    # --- whole history
    cte(
        f"{v}_user_events",
        f"""
select user_id, count(event_id) as n_events, count(distinct date) as n_active_days, count(distinct week) as n_active_weeks,
       min(event_date) as first_event, max(event_date) as last_event, avg(hour) as mean_event_hour
from {v}_ev group by user_id
""",
        f"{v}_ev",
    )
    cte(
        f"{v}_user_tx",
        f"""
select user_id, count(transaction_id) as n_transactions, count(distinct week) as n_transaction_weeks,
       count(distinct document_id) as n_documents, count(distinct topic_id) as n_topics, avg(is_correct) as correct_rate,
       avg(is_partial) as partial_rate, avg(response_time_sec) as avg_response_time,
       median(response_time_sec) as median_response_time, count(distinct challenge_id) as n_challenges
from {v}_tx group by user_id
""",
        f"{v}_tx",
    )
    # --- stage 2
    cte(
        f"{v}_week_events",
        f"""
select user_id, relative_week, count(event_id) as n_events, count(distinct date) as n_active_days, avg(hour) as mean_hour,
       stddev_samp(hour) as std_hour,
       count(*) filter (event_type = 'CLICK') as n_click_events, count(*) filter (event_type = 'VIEW') as n_view_events,
       count(distinct session_id) as n_sessions, count(distinct topic_id) as n_topics_event
from {v}_ev where relative_week is not null group by user_id, relative_week
""",
        f"{v}_ev",
    )
    cte(
        f"{v}_week_tx",
        f"""
select user_id, relative_week, count(transaction_id) as n_transactions, avg(is_correct) as correct_rate,
       avg(is_partial) as partial_rate, avg(evaluation_score) as mean_evaluation_score,
       stddev_samp(evaluation_score) as std_evaluation_score, avg(response_time_sec) as avg_response_time,
       stddev_samp(response_time_sec) as std_response_time, count(distinct document_id) as n_documents,
       count(distinct topic_id) as n_topics_transaction,
       count(transaction_id) / nullif(count(distinct document_id), 0)::double as retry_ratio
from {v}_tx where relative_week is not null group by user_id, relative_week
""",
        f"{v}_tx",
    )
    cte(
        f"{v}_weekly",
        f"""
select *, n_events + n_transactions + n_click_events + n_view_events as activity_score from (
select user_id, relative_week, coalesce(n_events, 0) as n_events, coalesce(n_active_days, 0) as n_active_days, mean_hour,
       coalesce(n_click_events, 0) as n_click_events, coalesce(n_view_events, 0) as n_view_events,
       coalesce(n_sessions, 0) as n_sessions, coalesce(n_topics_event, 0) as n_topics_event,
       coalesce(n_transactions, 0) as n_transactions, correct_rate, partial_rate, mean_evaluation_score, avg_response_time,
       coalesce(n_documents, 0) as n_documents, coalesce(n_topics_transaction, 0) as n_topics_transaction,
       coalesce(std_hour, 0) as std_hour, coalesce(std_evaluation_score, 0) as std_evaluation_score,
       coalesce(std_response_time, 0) as std_response_time, coalesce(retry_ratio, 0) as retry_ratio
from {v}_week_events full join {v}_week_tx using (user_id, relative_week))
""",
        f"{v}_week_events",
        f"{v}_week_tx",
    )
    cte(
        f"{v}_spine",
        f"""
select user_id, unnest(range(0, last_week + 1)) as relative_week
from (select user_id, max(relative_week) as last_week from {v}_weekly group by user_id) where last_week >= 0
""",
        f"{v}_weekly",
    )
    cte(
        f"{v}_timeline",
        f"""
select s.user_id, s.relative_week, w.* exclude (user_id, relative_week),
       first_activity_time + to_days(cast(7 * s.relative_week as integer)) as week_start,
       row_number() over (partition by s.user_id order by s.relative_week) - 1 as idx,
       count(*) over (partition by s.user_id) as n_weeks
from {v}_spine s left join {v}_weekly w using (user_id, relative_week) join {v}_first using (user_id)
""",
        f"{v}_spine",
        f"{v}_weekly",
        f"{v}_first",
    )
    cte(
        f"{v}_activity",
        f"select user_id, idx, n_weeks, week_start, (coalesce(n_events, 0) > 0)::int as is_active from {v}_timeline",
        f"{v}_timeline",
    )
    cte(
        f"{v}_labels",
        f"""
select a.user_id, a.idx, a.week_start, a.is_active,
       case when a.idx + 4 >= a.n_weeks then null
            when a.is_active_1 + a.is_active_2 + a.is_active_3 + a.is_active_4 > 0 then 0
            when (week_start + to_days(7) <= make_timestamp(year(week_start + to_days(7)), 8, 31, 0, 0, 0)
                  and week_start + to_days(28) >= make_timestamp(year(week_start + to_days(7)), 7, 1, 0, 0, 0))
              or (week_start + to_days(7) <= make_timestamp(year(week_start + to_days(28)), 8, 31, 0, 0, 0)
                  and week_start + to_days(28) >= make_timestamp(year(week_start + to_days(28)), 7, 1, 0, 0, 0)) then 0
            else 1 end as is_dropout_point
from (select *, lead(is_active, 1) over w as is_active_1, lead(is_active, 2) over w as is_active_2,
             lead(is_active, 3) over w as is_active_3, lead(is_active, 4) over w as is_active_4
      from {v}_activity window w as (partition by user_id order by idx)) a
""",
        f"{v}_activity",
    )
    cte(
        f"{v}_stage2",
        f"""
select t.user_id, t.relative_week, t.idx, t.n_weeks, t.week_start, l.is_active, l.is_dropout_point,
       month(t.week_start) in (7, 8) as is_summer,
       """
        + ", ".join(
            f"coalesce({c}, 0)::double as {c}"
            for c in (
                "n_events n_active_days mean_hour n_click_events n_view_events n_sessions n_topics_event n_transactions "
                "correct_rate partial_rate mean_evaluation_score avg_response_time n_documents n_topics_transaction activity_score"
            ).split()
        )
        + f""",
       year(t.week_start)::double as year, dayofyear(t.week_start)::double as day
from {v}_timeline t join {v}_labels l on t.user_id = l.user_id and t.idx = l.idx
""",
        f"{v}_timeline",
        f"{v}_labels",
    )
