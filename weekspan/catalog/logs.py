"""Queries over cleaned logs and per-user features (short view, long view where noted)."""

from __future__ import annotations

from pyspark.sql import functions as F

from weekspan.catalog.base import cte, query
from weekspan.functions import scalars as S
from weekspan.operators import clean, demographics, features, labels, profile, timeline
from weekspan.plans.stage1 import stage1_dataset
from weekspan.session import scratch_path
from weekspan.sources import logs as logs_io
from weekspan.sources import star

GENDERS = ["FEMALE", "MALE", "Other", "Unknown"]
CANTONS = sorted([f"NATION_{i}" for i in range(25)] + ["Unknown"])
SCHOOLS = ["BM", "Gymnasium", "KME Passerelle", "Unknown", "WMS"]
CATEGORIES = {"gender": GENDERS, "canton": CANTONS, "school_type": SCHOOLS}


def short_logs(spark, folder):
    return timeline.clean_logs(star.short_view(spark, folder))


def short_cleaned(spark, folder):
    return timeline.cleaned_logs(star.short_view(spark, folder))


def long_logs(spark, folder):
    return timeline.clean_logs(star.long_view(spark, folder))


def short_early(spark, folder):
    logs = short_logs(spark, folder)
    return timeline.early_window(logs.events), timeline.early_window(logs.transactions)


CALENDAR_SPEC = "date:y year:i month:i dayofweek:i hour:i week:s"

# --- sources and sinks ---------------------------------------------------------------------------------------------


@query(
    "load_learner_events",
    f"event_id:i user_id:i event_date:t event_type:s action:s session_id:s topic_id:i {CALENDAR_SPEC} first_activity_time:t relative_week:i",
    "select * from lx_ev",
    "lx_ev",
)
def load_learner_events(spark, folder):
    """Raw logs as three gzip CSV files, read back and cleaned."""
    raw = star.short_view(spark, folder)
    path = scratch_path(spark, "raw")
    logs_io.export_tables({"users": raw.users, "events": raw.events, "transactions": raw.transactions}, path, ".csv.gz")
    return timeline.clean_logs(logs_io.read_raw_logs(spark, path)).events


S1_SPEC = " ".join(["user_id:i", *[f"{c}:d" for c in features.STAGE1_FEATURES]])
S1_SELECT = ", ".join(f"coalesce({c}, 0) as {c}" for c in features.STAGE1_FEATURES)
for v in ("lx", "ll"):
    cte(
        f"{v}_s1_behavioral",
        f"""select user_id, {S1_SELECT} from {v}_s1_events left join {v}_s1_tx using (user_id)
        left join {v}_s1_sessions using (user_id) left join {v}_s1_review using (user_id)""",
        f"{v}_s1_events",
        f"{v}_s1_tx",
        f"{v}_s1_sessions",
        f"{v}_s1_review",
    )
cte("returning_users", "select distinct user_id from lx_ev where relative_week >= 3", "lx_ev")
DEMO_FLAGS = {f"gender_{g}": f"gender = '{g}'" for g in GENDERS}
DEMO_FLAGS |= {f"canton_{c}": f"canton = '{c}'" for c in CANTONS}
DEMO_FLAGS |= {f"school_{s}": f"school = '{s}'" for s in SCHOOLS}
cte(
    "demo",
    f"""select user_id, study::int as study, class_year,
        {', '.join(f'({cond})::int as "{name}"' for name, cond in DEMO_FLAGS.items())}
        from (select user_id, gender, canton, study, split_part(class_level, ' - ', 1) as school,
                     coalesce(try_cast(regexp_extract(class_level, '(\\d+)\\. Jahr', 1) as integer), 0) as class_year
              from users_c)""",
    "users_c",
)
DEMO_SPEC = ["user_id:i", "study:i", "class_year:i", *[f"{n}:i" for n in DEMO_FLAGS]]
S1_FULL_SPEC = [*S1_SPEC.split(), *DEMO_SPEC[1:], "came_back:i"]
cte(
    "lx_stage1",
    f"""select b.*, coalesce(study, 0) as study, coalesce(class_year, 0) as class_year,
        {', '.join(f'coalesce("{n}", 0) as "{n}"' for n in DEMO_FLAGS)},
        (user_id in (from returning_users))::int as came_back
        from lx_s1_behavioral b left join demo using (user_id)""",
    "lx_s1_behavioral",
    "demo",
    "returning_users",
)


def stage1(spark, folder, **options):
    return stage1_dataset(star.short_view(spark, folder), **options)


@query("load_stage1_checked", S1_SPEC + " came_back:i", "select * from lx_stage1", "lx_stage1")
def load_stage1_checked(spark, folder):
    """Saved stage 1 table, reopened with its required columns checked."""
    df = stage1(spark, folder, include_demographics=False).df
    path = scratch_path(spark, "stage1.csv.gz")
    logs_io.save_table(df, path)
    return logs_io.load_table(spark, path, ["user_id", "came_back"], df.schema)


@query(
    "load_assignments",
    "user_id:i cluster_spectral_eucl:i kmeans_flat:i kmeans_eucl:i is_dropout_point:i stage2_outcome:d",
    """select o_custkey as user_id, o_custkey % 4 as cluster_spectral_eucl, o_orderkey % 4 as kmeans_flat,
       (o_custkey % 4 + case when o_orderkey % 5 = 0 then 1 else 0 end) % 4 as kmeans_eucl,
       (o_totalprice > 200000)::int as is_dropout_point, (o_totalprice > 200000)::int as stage2_outcome from orders""",
)
def load_assignments(spark, folder):
    path = scratch_path(spark, "assignments.csv")
    logs_io.save_table(star.clusters_view(spark, folder), path)
    return logs_io.select_assignments(logs_io.load_table(spark, path, ["user_id", "is_dropout_point"]))


@query(
    "sink_roundtrip",
    "source:s user_id:i n_events:i mean_event_hour:d first_event:t",
    """select source, user_id, n_events, mean_event_hour, first_event
       from lx_user_events cross join (values ('parquet'), ('csv.gz')) f(source)""",
    "lx_user_events",
)
def sink_roundtrip(spark, folder):
    df = features.user_event_summary(short_cleaned(spark, folder).events)
    out = None
    for suffix in ("parquet", "csv.gz"):
        path = logs_io.export_tables({"summary": df}, scratch_path(spark, "out"), f".{suffix}")["summary"]
        back = logs_io.load_table(spark, path, ["user_id"], df.schema if suffix == "csv.gz" else None)
        back = back.withColumn("source", F.lit(suffix))
        out = back if out is None else out.unionByName(back)
    return out


# --- cleaning ------------------------------------------------------------------------------------------------------


@query("clean_users", "user_id:i gender:s canton:s class_level:s class_id:s study:b", "select * from users_c", "users_c")
def clean_users(spark, folder):
    return clean.clean_users(star.star_users(spark, folder))


@query(
    "clean_events",
    f"event_id:i user_id:i event_date:t event_type:s action:s session_id:s topic_id:i {CALENDAR_SPEC}",
    "select * from lx_ev",
    "lx_ev",
)
def clean_events(spark, folder):
    return clean.clean_events(star.short_events(spark, folder))


@query(
    "clean_transactions",
    f"transaction_id:i user_id:i start_time:t commit_time:t evaluation:s document_id:i topic_id:i challenge_id:i {CALENDAR_SPEC} "
    "evaluation_score:d is_correct:i is_partial:i is_unknown_eval:i response_time_sec:d",
    "select * from lx_tx",
    "lx_tx",
)
def clean_transactions(spark, folder):
    return clean.clean_transactions(star.short_transactions(spark, folder))


@query(
    "calendar_columns",
    f"event_id:i {CALENDAR_SPEC}",
    "select event_id, date, year, month, dayofweek, hour, week from ll_ev",
    "ll_ev",
)
def calendar_columns(spark, folder):
    return clean.add_calendar(star.long_events(spark, folder), "event_date")


@query("first_activity", "user_id:i first_activity_time:t", "select * from lx_first", "lx_first")
def first_activity(spark, folder):
    return timeline.first_activity(star.short_transactions(spark, folder))


@query(
    "relative_weeks",
    "kind:s row_id:i user_id:i relative_week:i",
    """select 'event' as kind, event_id as row_id, user_id, relative_week from lx_ev
       union all select 'transaction', transaction_id, user_id, relative_week from lx_tx""",
    "lx_ev lx_tx",
)
def relative_weeks(spark, folder):
    logs = short_logs(spark, folder)
    events = logs.events.select(F.lit("event").alias("kind"), F.col("event_id").alias("row_id"), "user_id", "relative_week")
    return events.union(
        logs.transactions.select(F.lit("transaction"), F.col("transaction_id"), "user_id", "relative_week")
    )


@query("early_window", "event_id:i user_id:i relative_week:i", "select * from lx_ev02", "lx_ev02")
def early_window(spark, folder):
    return short_early(spark, folder)[0]


@query(
    "summer_overlap",
    "event_id:i next_days:i overlaps:b",
    """select event_id, n as next_days, exists(
           from range(1994, 2004) y(yr)
           where event_date <= make_timestamp(yr, 8, 31, 0, 0, 0) and event_date + to_days(n::integer) >= make_timestamp(yr, 7, 1, 0, 0, 0)
             and yr between year(event_date) and year(event_date + to_days(n::integer))) as overlaps
       from (select *, event_id % 700 as n from ll_events)""",
    "ll_events",
)
def summer_overlap(spark, folder):
    df = star.long_events(spark, folder).withColumn("next_days", F.col("event_id") % 700)
    return df.withColumn("overlaps", S.overlaps_summer("event_date", S.days_after("event_date", F.col("next_days"))))


# --- stage 1 -------------------------------------------------------------------------------------------------------


def _spec(cols, exact=("total_", "n_")):
    return " ".join(["user_id:i", *[f"{c}:{'i' if c.startswith(exact) else 'd'}" for c in cols]])


@query("stage1_events", _spec(features.STAGE1_EVENT_FEATURES), "select * from lx_s1_events", "lx_s1_events")
def stage1_events(spark, folder):
    return features.stage1_events(short_early(spark, folder)[0])


@query(
    "stage1_transactions",
    _spec(
        "total_transactions_0_2 correct_rate_0_2 partial_rate_0_2 mean_evaluation_score_0_2 std_evaluation_score_0_2 "
        "avg_response_time_0_2 std_response_time_0_2 n_documents_0_2 n_topics_transaction_0_2 retry_ratio_0_2".split()
    ),
    "select * from lx_s1_tx",
    "lx_s1_tx",
)
def stage1_transactions(spark, folder):
    return features.stage1_transactions(short_early(spark, folder)[1])


@query(
    "stage1_sessions",
    "user_id:i session_duration_mean_0_2:f session_duration_std_0_2:f time_between_sessions_mean_0_2:f",
    "select * from lx_s1_sessions",
    "lx_s1_sessions",
)
def stage1_sessions(spark, folder):
    return features.stage1_sessions(short_early(spark, folder)[0])


@query("stage1_review_rate", "user_id:i review_rate_0_2:d", "select * from lx_s1_review", "lx_s1_review")
def stage1_review_rate(spark, folder):
    return features.stage1_review_rate(short_early(spark, folder)[0])


@query("stage1_behavioral", S1_SPEC, "select * from lx_s1_behavioral", "lx_s1_behavioral")
def stage1_behavioral(spark, folder):
    return features.stage1_behavioral(*short_early(spark, folder))


@query("stage1_behavioral_long", S1_SPEC, "select * from ll_s1_behavioral", "ll_s1_behavioral")
def stage1_behavioral_long(spark, folder):
    logs = long_logs(spark, folder)
    return features.stage1_behavioral(timeline.early_window(logs.events), timeline.early_window(logs.transactions))


@query("stage1_dataset", S1_FULL_SPEC, "select * from lx_stage1", "lx_stage1")
def stage1_table(spark, folder):
    return stage1(spark, folder, categories=CATEGORIES).df


@query(
    "came_back_label",
    "user_id:i came_back:i",
    "select distinct user_id, (user_id in (select user_id from lx_ev where relative_week >= 4))::int as came_back from lx_ev02",
    "lx_ev lx_ev02",
)
def came_back_label(spark, folder):
    events = short_logs(spark, folder).events
    return labels.came_back(events, timeline.early_window(events).select("user_id").distinct(), return_from=4)


@query(
    "feature_catalog",
    "position:i feature:s section:s n_nonzero:i",
    """select row_number() over () - 1 as position, feature, section, n_nonzero from (
       """
    + " union all ".join(
        f"select {i} as p, '{c}' as feature, '{s}' as section, count(*) filter (\"{c}\" <> 0) as n_nonzero from lx_stage1"
        for i, (c, s) in enumerate(
            [(c, "behaviour") for c in features.STAGE1_FEATURES]
            + [(c, "demographic") for c in ["study", "class_year", *DEMO_FLAGS]]
        )
    )
    + " order by p)",
    "lx_stage1",
)
def feature_catalog(spark, folder):
    """Ordered numeric features without key and label, split by section, written and read back as JSON."""
    data = stage1(spark, folder, categories=CATEGORIES)
    cols = demographics.numeric_feature_columns(data.df, ["user_id", "came_back"])
    demo = set(demographics.demographic_columns(cols))
    path = scratch_path(spark, "features.json")
    logs_io.save_feature_lists(spark, {"stage1": cols}, path)
    cols = logs_io.load_feature_lists(spark, path)["stage1"]
    counts = data.df.agg(*[F.count_if(F.col(f"`{c}`") != 0).alias(c) for c in cols])
    counts = counts.unpivot([], [F.col(f"`{c}`") for c in cols], "feature", "n_nonzero")
    place = F.array_position(F.array(*map(F.lit, cols)), F.col("feature")) - 1
    section = F.when(F.col("feature").isin(*demo), "demographic").otherwise("behaviour")
    return counts.withColumns({"position": place, "section": section})


# --- demographics --------------------------------------------------------------------------------------------------


@query("demographic_features", DEMO_SPEC, "select * from demo", "demo")
def demographic_features(spark, folder):
    return demographics.demographic_features(clean.clean_users(star.star_users(spark, folder)), CATEGORIES)


SCHOOL_SQL = "split_part(class_level, ' - ', 1)"
cte(
    "decoded",
    f"""select s.user_id, coalesce(u.gender, 'Unknown') as gender, coalesce(u.canton, 'Unknown') as canton,
        coalesce({SCHOOL_SQL}, 'Unknown') as school, s.study, s.class_year, s.came_back
        from lx_stage1 s left join users_c u using (user_id)""",
    "lx_stage1",
    "users_c",
)


@query("one_hot_decode", "user_id:i gender:s canton:s school:s none:s", "select *, 'Unknown' as \"none\" from decoded", "decoded")
def one_hot_decode(spark, folder):
    df = stage1(spark, folder, categories=CATEGORIES).df
    labels_ = {p: demographics.one_hot_label(df, f"{p}_") for p in ("gender", "canton", "school", "none")}
    return df.select("user_id", *[c.alias(p) for p, c in labels_.items()])


EDUCATION = """case when class_year is null or class_year = 0 then 'Unknown' when class_year <= 2 then 'Lower secondary'
               when class_year <= 4 then 'Upper secondary' else 'Other' end"""
SCHOOL_TYPE = """case when lower(school) in ('unknown', 'nan', 'none') then 'Unknown' when regexp_matches(lower(school), 'gym|passerelle') then 'Academic'
                 when regexp_matches(lower(school), 'sek|secondary') then 'Secondary'
                 when regexp_matches(lower(school), 'bm|efz|wms') then 'Vocational' else 'Other' end"""
EDUCATION_V2 = """case when regexp_matches(lower(school), '[1-7]\\. klasse|primaire') then 'Primary_LowerSec'
   when regexp_matches(lower(school), 'gymnasium|lycee|liceo|matura|maturitat|hms|ims|isme|passerelle') then 'Secondary'
   when regexp_matches(lower(school), 'bme|fm|fms|fachmatur|apprentice') then 'Tertiary_Apprentice' else 'Unknown' end"""
SCHOOL_TYPE_V2 = """case when regexp_matches(lower(school), 'gymnasium|lycee|liceo|matura|maturitat|passerelle') then 'Academic'
   when regexp_matches(lower(school), 'bme|fm|fms|fachmatur|apprentice') then 'Vocational'
   when regexp_matches(lower(school), 'sekundar|realschule|klasse') then 'Secondary'
   when lower(school) in ('unknown', 'keine angabe') then 'Unknown' else 'Other' end"""


@query(
    "stage1_demographics",
    "user_id:i gender:s canton:s school:s class_year:i education_level:s school_type:s",
    f"select *, {EDUCATION} as education_level, {SCHOOL_TYPE} as school_type from decoded",
    "decoded",
)
def stage1_demographics(spark, folder):
    return demographics.stage1_demographics(stage1(spark, folder, categories=CATEGORIES).df)


@query(
    "stage1_demographics_v2",
    "user_id:i gender:s canton:s school:s study:i class_year:i continuation_indicator:i education_level:s school_type:s",
    f"""select *, came_back as continuation_indicator, {EDUCATION_V2} as education_level, {SCHOOL_TYPE_V2} as school_type
        from decoded""",
    "decoded",
)
def stage1_demographics_v2(spark, folder):
    return demographics.stage1_demographics_v2(stage1(spark, folder, categories=CATEGORIES).df)


@query(
    "education_level",
    "user_id:i level:s level_v2:s",
    f"""select user_id, {EDUCATION} as level, {EDUCATION_V2} as level_v2
        from (select user_id, class_level as school, nullif(user_id % 9, 8) as class_year from lx_users)""",
    "lx_users",
)
def education_level(spark, folder):
    year = F.nullif(F.col("user_id") % 9, F.lit(8))
    users = star.star_users(spark, folder)
    return users.select(
        "user_id", S.education_level(year).alias("level"), S.education_level_old("class_level").alias("level_v2")
    )


@query(
    "school_type_category",
    "user_id:i kind:s kind_v2:s",
    f"select user_id, {SCHOOL_TYPE} as kind, {SCHOOL_TYPE_V2} as kind_v2 from (select user_id, class_level as school from users_c)",
    "users_c",
)
def school_type_category(spark, folder):
    users = clean.clean_users(star.star_users(spark, folder))
    return users.select(
        "user_id",
        S.school_type_category("class_level").alias("kind"),
        S.school_type_category_old("class_level").alias("kind_v2"),
    )


# --- whole-history summaries ---------------------------------------------------------------------------------------


@query(
    "user_event_summary",
    "user_id:i n_events:i n_active_days:i n_active_weeks:i first_event:t last_event:t mean_event_hour:d",
    "select * from lx_user_events",
    "lx_user_events",
)
def user_event_summary(spark, folder):
    return features.user_event_summary(short_cleaned(spark, folder).events)


@query(
    "user_tx_summary",
    "user_id:i n_transactions:i n_transaction_weeks:i n_documents:i n_topics:i correct_rate:d partial_rate:d "
    "avg_response_time:d median_response_time:d n_challenges:i",
    "select * from lx_user_tx",
    "lx_user_tx",
)
def user_tx_summary(spark, folder):
    return features.user_transaction_summary(short_cleaned(spark, folder).transactions)


@query(
    "action_crosstab",
    "user_id:i action_review_task:i action_submit_answer:i action_open_topic:i",
    """select user_id, count(*) filter (action = 'REVIEW_TASK') as action_review_task,
       count(*) filter (action = 'SUBMIT_ANSWER') as action_submit_answer, count(*) filter (action = 'OPEN_TOPIC') as action_open_topic
       from lx_events where action is not null group by user_id""",
    "lx_events",
)
def action_crosstab(spark, folder):
    return features.prefixed_crosstab(clean.clean_events(star.short_events(spark, folder)), "action", "action")


TYPES = ["CLICK", "ERROR", "SIGNUP", "VIEW"]
ACTIONS = ["OPEN_TOPIC", "REVIEW_TASK", "SUBMIT_ANSWER"]
SUMMARY_COUNTS = (
    ["n_events", "n_active_days", "n_active_weeks", "n_transactions", "n_transaction_weeks", "n_documents", "n_topics", "n_challenges"]
    + [f"action_{a.lower()}" for a in ACTIONS]
    + [f"event_type_{t.lower()}" for t in TYPES]
)
cte(
    "lx_summary",
    f"""
select *, (first_event is not null)::int as has_events, (n_transactions > 0)::int as has_transactions,
       (epoch_us(last_event) - epoch_us(first_event)) // 86400000000 as activity_span_days,
       n_events / nullif(n_active_days, 0)::double as events_per_active_day,
       n_events / nullif(n_active_weeks, 0)::double as events_per_active_week,
       n_transactions / nullif(n_transaction_weeks, 0)::double as transactions_per_active_week,
       (avg_response_time is not null)::int as has_response_time
from (select user_id, gender, canton, class_level, class_id, study, first_event, last_event, mean_event_hour,
             {', '.join(f'coalesce({c}, 0) as {c}' for c in SUMMARY_COUNTS)},
             coalesce(correct_rate, 0) as correct_rate, coalesce(partial_rate, 0) as partial_rate, avg_response_time,
             median_response_time
      from users_c left join lx_user_events using (user_id) left join lx_user_tx using (user_id)
      left join (select user_id,
          {', '.join(f"count(*) filter (action = '{a}') as action_{a.lower()}" for a in ACTIONS)},
          {', '.join(f"count(*) filter (event_type = '{t}') as event_type_{t.lower()}" for t in TYPES)}
          from lx_events group by user_id) using (user_id))
""",
    "users_c",
    "lx_user_events",
    "lx_user_tx",
    "lx_events",
)
SUMMARY_COLUMNS = (
    "user_id:i gender:s canton:s class_level:s class_id:s study:b first_event:t last_event:t mean_event_hour:d "
    + " ".join(f"{c}:i" for c in SUMMARY_COUNTS)
    + " correct_rate:d partial_rate:d avg_response_time:d median_response_time:d has_events:i has_transactions:i "
    "activity_span_days:i events_per_active_day:d events_per_active_week:d transactions_per_active_week:d has_response_time:i"
)


def short_summary(spark, folder):
    logs = short_cleaned(spark, folder)
    return features.user_summary(logs.users, logs.events, logs.transactions, ACTIONS, TYPES)


@query("user_summary", SUMMARY_COLUMNS, "select * from lx_summary", "lx_summary")
def user_summary(spark, folder):
    return short_summary(spark, folder)


@query(
    "safe_divide",
    "order_id:i ratio:d",
    "select o_orderkey as order_id, o_totalprice / nullif(o_orderkey % 4, 0)::double as ratio from orders",
)
def safe_divide(spark, folder):
    orders = star.table(spark, folder, "orders")
    return orders.select(
        F.col("o_orderkey").alias("order_id"), S.safe_divide("o_totalprice", F.col("o_orderkey") % 4).alias("ratio")
    )


@query(
    "fill_missing_columns",
    "user_id:i relative_week:i mean_hour:d correct_rate:d avg_response_time:d never_seen:d",
    """select user_id, relative_week, coalesce(mean_hour, 0) as mean_hour, coalesce(correct_rate, 0) as correct_rate,
       coalesce(avg_response_time, 0) as avg_response_time, 0 as never_seen from ll_weekly""",
    "ll_weekly",
)
def fill_missing_columns(spark, folder):
    logs = long_logs(spark, folder)
    weekly = features.weekly_features(logs.events, logs.transactions)
    return features.fill_missing_columns(weekly, ["mean_hour", "correct_rate", "avg_response_time", "never_seen"])


# --- profiles ------------------------------------------------------------------------------------------------------


@query(
    "calendar_week_counts",
    "week_end:y n_events:i",
    """select d::date as week_end, count(event_date) as n_events
       from (select unnest(range(min(date_trunc('week', event_date)) + interval 6 day,
                                 max(date_trunc('week', event_date)) + interval 7 day, interval 7 day)) as d from lx_events) w
       left join lx_events on date_trunc('week', event_date) + interval 6 day = d group by d""",
    "lx_events",
)
def calendar_week_counts(spark, folder):
    return profile.calendar_week_counts(clean.clean_events(star.short_events(spark, folder)))


@query(
    "calendar_week_counts_complete",
    "week_start:y n_events:i",
    """select week_start, n_events from (
         select date_trunc('week', event_date) as week_start, count(*) as n_events, max(event_date) as latest from ll_events group by 1)
       where week_start < (select max(date_trunc('week', event_date)) from ll_events)
          or (select max(event_date) from ll_events) >= week_start + interval 7 day - interval 1 microsecond""",
    "ll_events",
)
def calendar_week_counts_complete(spark, folder):
    return profile.calendar_week_counts_complete(clean.clean_events(star.long_events(spark, folder)))


_USER_COLS = ["user_id", "gender", "canton", "class_level", "class_id", "study"]
_SUMMARY_COLS = [w.rsplit(":", 1)[0] for w in SUMMARY_COLUMNS.split()]
_PROFILE = [
    """select * from (select 'action' as section, action as item, count(*) as value from lx_ev where action is not null
       group by action order by value desc, item limit 20)""",
    "select 'event_type', event_type, count(*) from lx_ev group by event_type",
    "select 'evaluation', evaluation, count(*) from lx_tx group by evaluation",
    "select 'gender', gender, count(*) from users_c group by gender",
    "select 'flag means', 'has_events', avg(has_events) from lx_summary",
    "select 'flag means', 'has_transactions', avg(has_transactions) from lx_summary",
    "select 'flag means', 'has_response_time', avg(has_response_time) from lx_summary",
]
_PROFILE += [f"select 'users nulls', '{c}', count(*) - count({c}) from users_c" for c in _USER_COLS]
_PROFILE += [f"select 'summary nulls', '{c}', count(*) - count({c}) from lx_summary" for c in _SUMMARY_COLS]
for _t, _c in (("lx_ev", "event_date"), ("lx_tx", "start_time"), ("lx_tx", "commit_time")):
    for _f, _n in (("min", "first"), ("max", "last")):
        _PROFILE.append(f"select 'time range', '{_c} {_n}', epoch_us({_f}({_c})) // 1000000 from {_t}")


@query("data_profile", "section:s item:s value:d", " union all ".join(_PROFILE), "lx_ev lx_tx users_c lx_summary")
def data_profile(spark, folder):
    logs = short_logs(spark, folder)
    summary = features.user_summary(logs.users, logs.events, logs.transactions, ACTIONS, TYPES)
    return profile.data_profile(logs.users, logs.events, logs.transactions, summary)


@query(
    "group_counts",
    "canton:s n_users:i",
    "select canton, count(*) as n_users from decoded group by canton",
    "decoded",
)
def group_counts(spark, folder):
    table = demographics.stage1_demographics(stage1(spark, folder, categories=CATEGORIES).df)
    return profile.group_counts(table, "canton")
