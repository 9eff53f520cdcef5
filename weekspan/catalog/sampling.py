"""Queries over splits, scaling, samples and flat-row augmentation."""

from __future__ import annotations

from pyspark.sql import functions as F

from weekspan.catalog.base import cte, query
from weekspan.catalog.logs import long_logs
from weekspan.catalog.sequences import u_sql
from weekspan.operators import augment as A
from weekspan.operators import sampling as P
from weekspan.operators.features import fill_missing_columns, weekly_features
from weekspan.session import durable

VALUES = ["n_events", "n_transactions", "activity_score", "mean_hour", "correct_rate", "avg_response_time"]
KEY = ["user_id", "relative_week"]
cte(
    "weeks",
    f"""select user_id, relative_week, (n_transactions > 4)::int as label, {', '.join(f'coalesce({c}, 0)::double as {c}' for c in VALUES)}
        from ll_weekly""",
    "ll_weekly",
)
WEEK_KEY = "user_id || '|' || relative_week"
HASH = "cast('0x' || substr(md5({0} || '|{1}'), 1, 8) as bigint)"


def weeks(spark, folder):
    """Observed learner-weeks of the long view with a 0/1 label."""
    logs = long_logs(spark, folder)
    filled = fill_missing_columns(weekly_features(logs.events, logs.transactions), VALUES)
    return durable(filled.selectExpr(*KEY, "cast(n_transactions > 4 as int) as label", *VALUES))


def rows_with_array(spark, folder):
    return weeks(spark, folder).selectExpr(*KEY, "label", f"array({', '.join(VALUES)}) as x")


cte("user_ids", "select distinct user_id from weeks", "weeks")
cte(
    "user_parts",
    f"""select user_id, case when r < nt then 'test' when r < nt + ceil((n - nt) * 0.2) then 'validation' else 'train' end as part
        from (select *, ceil(n * 0.15) as nt from (
          select user_id, row_number() over (order by {HASH.format('user_id', 42)}, user_id) - 1 as r, count(*) over () as n from user_ids))""",
    "user_ids",
)


@query(
    "split_by_users",
    "user_id:i relative_week:i part:s",
    "select user_id, relative_week, part from weeks join user_parts using (user_id)",
    "weeks user_parts",
)
def split_by_users(spark, folder):
    return P.split_by_users(weeks(spark, folder))


@query(
    "stratified_split",
    "user_id:i relative_week:i label:i part:s",
    f"""select *, case when r < nt then 'test' when r < nt + ceil((n - nt) * 0.2) then 'validation' else 'train' end as part
        from (select *, ceil(n * 0.2) as nt from (select *, row_number() over (partition by label order by {HASH.format(WEEK_KEY, 42)}, user_id, relative_week) - 1 as r,
              count(*) over (partition by label) as n from weeks))""",
    "weeks",
)
def stratified_split(spark, folder):
    return P.stratified_split(weeks(spark, folder), KEY, "label")


SCALED = ", ".join(f"({c} - m_{c}) / s_{c} as {c}" for c in VALUES)


@query(
    "train_fitted_scaling",
    "user_id:i relative_week:i part:s " + " ".join(f"{c}:d" for c in VALUES),
    f"""with parts as (select weeks.*, part from weeks join user_parts using (user_id)),
        fit as (select {', '.join(f'avg({c}) as m_{c}, coalesce(nullif(stddev_pop({c}), 0), 1) as s_{c}' for c in VALUES)} from parts where part = 'train')
        select user_id, relative_week, part, {SCALED} from parts cross join fit""",
    "weeks user_parts",
)
def train_fitted_scaling(spark, folder):
    df = P.split_by_users(weeks(spark, folder))
    return P.fit_scaler(df.filter("part = 'train'"), VALUES).apply(df)


@query(
    "balanced_class_weights",
    "label:i n:i weight:d",
    "select label, count(*) as n, (select count(*) from weeks) / (2.0::double * count(*)) as weight from weeks group by label",
    "weeks",
)
def balanced_class_weights(spark, folder):
    df = P.balanced_class_weights(weeks(spark, folder), "label")
    return df.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.max("weight").alias("weight"))


RANKED = f"select *, row_number() over (partition by label order by {HASH.format(WEEK_KEY, 42)}, user_id, relative_week) as r from weeks"


@query(
    "stratified_subsample",
    "user_id:i relative_week:i label:i",
    f"""with c as (select label, count(*) as n, sum(count(*)) over () as total from weeks group by label),
        q as (select label, floor(n * 7500.0::double / total) as base, n * 7500.0::double / total - floor(n * 7500.0::double / total) as rest from c),
        quota as (select label, base + (row_number() over (order by rest desc, label) <= 7500 - sum(base) over ())::int as quota from q)
        select user_id, relative_week, label from ({RANKED}) join quota using (label) where r <= quota""",
    "weeks",
)
def stratified_subsample(spark, folder):
    return P.stratified_subsample(weeks(spark, folder), KEY, "label", 7500)


@query(
    "stratified_cap",
    "user_id:i relative_week:i label:i",
    f"""with c as (select label, greatest(1, floor(count(*) * 5001.0::double / sum(count(*)) over ())) as base from weeks group by label),
        quota as (select label, base + case when row_number() over (order by base, label) = 1 then 5001 - sum(base) over () else 0 end as quota from c)
        select user_id, relative_week, label from ({RANKED}) join quota using (label) where r <= quota""",
    "weeks",
)
def stratified_cap(spark, folder):
    return P.stratified_cap(weeks(spark, folder), KEY, "label", 5001)


@query(
    "hash_sample",
    "user_id:i",
    f"select user_id from user_ids order by {HASH.format('user_id', 42)}, user_id limit 200",
    "user_ids",
)
def hash_sample(spark, folder):
    return P.hash_sample(weeks(spark, folder).select("user_id").distinct(), "user_id", 200)


# --- flat-row augmentation -----------------------------------------------------------------------------------------

ROW_SPEC = "draw:i user_id:i relative_week:i label:i " + " ".join(f"x{i}:d" for i in range(len(VALUES)))
ORDER = f"order by {HASH.format(WEEK_KEY, '42|order')}, user_id, relative_week"


def spread_out(df):
    return df.selectExpr("draw", *KEY, "label", *[f"x[{i}] as x{i}" for i in range(len(VALUES))])


XS = ", ".join(f"{c} as x{i}" for i, c in enumerate(VALUES))


@query(
    "oversample_minority",
    ROW_SPEC,
    f"""with ranked as (select *, row_number() over (partition by label {ORDER}) - 1 as r from weeks),
        c as (select label, count(*) as n, max(count(*)) over () - count(*) as missing from weeks group by label),
        draws as (select label, n, unnest(range(0, missing)) as draw from c),
        picked as (select label, draw, floor({u_sql("draw || '|' || label", '42|pick')} * n) as r from draws)
        select null as draw, user_id, relative_week, label, {XS} from weeks
        union all select draw, user_id, relative_week, label, {XS} from picked join ranked using (label, r)""",
    "weeks",
)
def oversample_minority(spark, folder):
    return spread_out(A.oversample_minority(rows_with_array(spark, folder), KEY, "label"))


MASKED = ", ".join(
    f"case when {u_sql(f"draw || '|{i}'", '42|mask')} < 0.1 then (select median({c}) from weeks) else {c} end as x{i}"
    for i, c in enumerate(VALUES)
)


@query(
    "masking",
    ROW_SPEC,
    f"""with ranked as (select *, row_number() over ({ORDER}) - 1 as r, count(*) over () as n from weeks),
        draws as (select draw, floor({u_sql('draw', '42|pick')} * n) as r from (select unnest(range(0, count(*) // 2)) as draw, count(*) as n from weeks))
        select null as draw, user_id, relative_week, label, {XS} from weeks
        union all select draw, user_id, relative_week, label, {MASKED} from draws join ranked using (r)""",
    "weeks",
)
def masking(spark, folder):
    return spread_out(A.masking(rows_with_array(spark, folder), KEY, width=len(VALUES), rate=0.1))


def _beta_sql() -> str:
    out = "0.5::double"
    for a in reversed(range(A.BETA_ATTEMPTS)):
        u, v = (f"power({u_sql('draw', f'42|beta|{s}{a}')}, 5.0::double)" for s in "uv")
        out = f"case when {u} + {v} > 0 and {u} + {v} <= 1 then {u} / ({u} + {v}) else {out} end"
    return out


@query(
    "mixup",
    ROW_SPEC,
    f"""with ranked as (select *, row_number() over ({ORDER}) - 1 as r from weeks),
        draws as (select draw, floor({u_sql('draw', '42|first')} * n) as i, floor({u_sql('draw', '42|second')} * n) as j, {_beta_sql()} as w
                  from (select unnest(range(0, count(*) // 2)) as draw, count(*) as n from weeks))
        select null as draw, user_id, relative_week, label, {XS} from weeks
        union all select draw, a.user_id, a.relative_week, (w * a.label + (1 - w) * b.label >= 0.5)::int,
               {', '.join(f'w * a.{c} + (1 - w) * b.{c}' for c in VALUES)}
        from draws join ranked a on a.r = i join ranked b on b.r = j""",
    "weeks",
)
def mixup(spark, folder):
    return spread_out(A.mixup(rows_with_array(spark, folder), KEY, "label"))


UNTOUCHED = ", ".join(f"case when (select count(distinct {c}) from weeks) < 50 then {c} end as x{i}" for i, c in enumerate(VALUES))


@query(
    "continuous_noise",
    f"{ROW_SPEC} moved:i far:i",
    f"""with ranked as (select *, row_number() over ({ORDER}) - 1 as r, count(*) over () as n from weeks),
        draws as (select draw, floor({u_sql('draw', '42|pick')} * n) as r from (select unnest(range(0, count(*) // 2)) as draw, count(*) as n from weeks))
        select null as draw, user_id, relative_week, label, {XS}, 0 as moved, 0 as far from weeks
        union all select draw, user_id, relative_week, label, {UNTOUCHED},
               {' + '.join(f'(select (count(distinct {c}) >= 50)::int from weeks)' for c in VALUES)} as moved, 0 as far from draws join ranked using (r)""",
    "weeks",
)
def continuous_noise(spark, folder):
    """Hashed normal draws cannot be repeated in SQL: noisy values of added rows are shown as null, with how many values
    moved from their original and how many by more than nine deviations of the noise."""
    rows = durable(rows_with_array(spark, folder))
    spread = A.column_spread(rows, "x", len(VALUES))
    noisy = F.array(*[F.lit(v > 0) for v in spread])
    limit = F.array(*[F.lit(9 * 0.01 * v) for v in spread])
    added = A.continuous_noise(rows, KEY, width=len(VALUES))
    joined = added.join(rows.select(*KEY, F.col("x").alias("before")), KEY)
    away = F.zip_with("x", "before", lambda a, b: F.abs(a - b))
    count = lambda flags: F.aggregate(F.transform(flags, lambda f: f.cast("int")), F.lit(0), lambda a, v: a + v)
    moved, far = count(F.transform(away, lambda v: v > 0)), count(F.transform(away, lambda v, i: v > F.get(limit, i)))
    fresh = F.col("draw").isNotNull()
    shown = F.transform("x", lambda v, i: F.when(fresh & F.get(noisy, i), F.lit(None)).otherwise(v))
    out = joined.select("draw", *KEY, "label", shown.alias("x"), moved.alias("moved"), far.alias("far"))
    return out.selectExpr("draw", *KEY, "label", *[f"x[{i}] as x{i}" for i in range(len(VALUES))], "moved", "far")


SQUARED = " + ".join(f"(a.{c} - b.{c}) * (a.{c} - b.{c})" for c in VALUES)


@query(
    "smote_subset",
    ROW_SPEC,
    f"""with c as (select label, count(*) as n, sum(count(*)) over () as total, greatest(1, floor(count(*) * 5000.0::double / sum(count(*)) over ())) as base from weeks group by label),
        quota as (select label, case when total <= 5000 then n else base + case when row_number() over (order by base, label) = 1 then 5000 - sum(base) over () else 0 end end as q from c),
        cut as (select w.*, q from (select *, row_number() over (partition by label order by {HASH.format(WEEK_KEY, 42)}, user_id, relative_week) as rn from weeks) w
                join quota using (label) where rn <= q),
        members as (select *, row_number() over (partition by label {ORDER}) - 1 as r, count(*) over (partition by label) as n from cut
                    where q < (select max(q) from quota)),
        pairs as (select a.label, a.r, b.r as other, row_number() over (partition by a.label, a.r order by {SQUARED}, b.r) - 1 as slot
                  from members a join members b on a.label = b.label and a.r <> b.r),
        sizes as (select label, max(n) as n, (select max(q) from quota) - max(n) as missing from members group by label),
        draws as (select label, n, unnest(range(0, missing::bigint)) as draw from sizes),
        picked as (select label, draw, floor({u_sql('draw', '42|base')} * n) as r, floor({u_sql('draw', '42|slot')} * 5) as slot, {u_sql('draw', '42|step')} as u from draws)
        select null as draw, user_id, relative_week, label, {XS} from cut
        union all select p.draw, a.user_id, a.relative_week, a.label, {', '.join(f'a.{c} + u * (b.{c} - a.{c})' for c in VALUES)}
        from picked p join pairs using (label, r, slot) join members a on a.label = p.label and a.r = p.r join members b on b.label = p.label and b.r = pairs.other""",
    "weeks",
)
def smote_subset(spark, folder):
    return spread_out(A.smote(rows_with_array(spark, folder), KEY, "label", max_samples=5000))


@query(
    "smote_balance",
    "source:s label:i n:i",
    """with c as (select label, greatest(1, floor(count(*) * 5000.0::double / sum(count(*)) over ())) as base from weeks group by label),
       quota as (select label, base + case when row_number() over (order by base, label) = 1 then 5000 - sum(base) over () else 0 end as q from c)
       select 'original' as source, label, q as n from quota union all
       select 'synthetic', label, max_q - q from (select *, max(q) over () as max_q from quota) where max_q > q""",
    "weeks",
)
def smote_balance(spark, folder):
    """Class sizes of the filled-up subset."""
    df = A.smote(rows_with_array(spark, folder), KEY, "label", max_samples=5000)
    source = F.when(F.col("draw").isNull(), "original").otherwise("synthetic")
    return df.groupBy(source.alias("source"), "label").agg(F.count(F.lit(1)).alias("n"))
