"""Queries over week sequences and their augmentation (long view, all learners).

Sequences are condensed per learner: their number, their positive labels, first and last target week, and a checksum
that weights every value by its position, so that a wrong value, week or order changes it.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from weekspan.catalog.base import cte, query
from weekspan.catalog.logs import CATEGORIES
from weekspan.functions import arrays
from weekspan.functions.cells import cells_apart, weighted_sums
from weekspan.operators import augment as A
from weekspan.operators import clean, demographics, sampling
from weekspan.operators import sequences as Q
from weekspan.operators.features import BEHAVIOUR_FEATURES, TRAJECTORY_GROUPS, WEEKLY_FEATURES
from weekspan.plans.stage2 import stage2_dataset
from weekspan.session import durable
from weekspan.sources import star

L = 12
ALL = list(WEEKLY_FEATURES)
SCALE = "(pi() * 10000)"


def stage2(spark, folder):
    return stage2_dataset(star.long_view(spark, folder)).df


def weighted(cols: list[str], t: str = "t") -> str:
    """SQL: values of one week times their position weights."""
    return " + ".join(f"{c} * ((({t}) * {len(cols)} + {i}) % 97 + 1)" for i, c in enumerate(cols))


def condensed(df, seq="seq", label="label", week="target_week", by="user_id"):
    rows = df.select(by, F.col(label).alias("_y"), F.col(week).alias("_week"), F.flatten(seq).alias("_cells")).filter(F.size("_cells") > 0)
    return weighted_sums(rows, "_cells", 97, "_sum").groupBy(by).agg(
        F.count(F.lit(1)).alias("n_sequences"),
        F.coalesce(F.sum("_y"), F.lit(0)).alias("n_positive"),
        F.min("_week").alias("first_week"),
        F.max("_week").alias("last_week"),
        F.expr(f"sum(_sum) / {SCALE}").alias("checksum"),
    )


CONDENSED = "user_id:i n_sequences:i n_positive:i first_week:i last_week:i checksum:f"
cte(
    "ll_targets",
    "select user_id, idx, is_dropout_point as label, is_summer from ll_stage2 where is_dropout_point is not null and idx >= 12",
    "ll_stage2",
)
cte(
    "ll_cells",
    """select q.user_id, q.idx as target_week, label, q.is_summer, t::int as t, s.* exclude (user_id, is_summer)
       from ll_targets q cross join range(0, 12) r(t) join ll_stage2 s on s.user_id = q.user_id and s.idx = q.idx - 12 + t""",
    "ll_targets",
    "ll_stage2",
)


def condensed_sql(cells: str, cols: list[str], where: str = "true", t: str = "t", positives: str = "sum(label) / 12") -> str:
    return f"""select user_id, count(*) / 12 as n_sequences, {positives} as n_positive, min(target_week) as first_week,
        max(target_week) as last_week, sum({weighted(cols, t)}) / {SCALE} as checksum from {cells} where {where} group by user_id"""


# --- construction --------------------------------------------------------------------------------------------------


@query("seq_fixed", CONDENSED, condensed_sql("ll_cells", WEEKLY_FEATURES), "ll_cells")
def seq_fixed(spark, folder):
    return condensed(Q.make_sequences(stage2(spark, folder), WEEKLY_FEATURES, L))


@query("seq_no_summer", CONDENSED, condensed_sql("ll_cells", ALL, "not is_summer"), "ll_cells")
def seq_no_summer(spark, folder):
    return condensed(Q.make_sequences(stage2(spark, folder), ALL, L, drop_summer=True))


def _multi_window_sql(cols: list[str]) -> str:
    """The week k before the target takes position 12 - k in every window of at least k weeks, and also fills the
    padding of the window of exactly k weeks: its weight is summed over the windows instead of building them."""
    width = len(cols)

    def padding(f: int) -> str:
        return "[" + ", ".join(str(sum((p * width + f) % 97 + 1 for p in range(12 - k)) if k >= 2 else 0) for k in range(1, 13)) + "]"

    terms = " + ".join(
        f"{c} * ((longest - greatest(k, 2) + 1) * (((12 - k) * {width} + {f}) % 97 + 1) + {padding(f)}[k])" for f, c in enumerate(cols)
    )
    return f"""select user_id, sum(case when k = 1 then longest - 1 end) as n_sequences, sum(case when k = 1 then label * (longest - 1) end) as n_positive,
        min(target) as first_week, max(target) as last_week, sum({terms}) / {SCALE} as checksum
        from (select q.user_id, q.idx as target, label, longest, k, {', '.join('s.' + c for c in cols)}
              from (select user_id, idx, is_dropout_point as label, least(12, idx) as longest from ll_stage2
                    where is_dropout_point is not null and idx >= 2) q
              cross join range(1, 13) r(k) join ll_stage2 s on s.user_id = q.user_id and s.idx = q.idx - k where k <= longest)
        group by user_id"""


@query("seq_multi_window", CONDENSED, _multi_window_sql(ALL), "ll_stage2")
def seq_multi_window(spark, folder):
    return condensed(Q.make_sequences_multi_window(stage2(spark, folder), ALL, L))


@query(
    "seq_flat",
    "user_id:i target_week:i label:i first_value:f last_value:f width:i",
    f"""select user_id, target_week, label, max(case when t = 0 then {ALL[0]} end) as first_value,
       max(case when t = 11 then {ALL[-1]} end) as last_value, {12 * len(ALL)} as width from ll_cells group by all""",
    "ll_cells",
)
def seq_flat(spark, folder):
    from pyspark.ml.functions import vector_to_array

    df = Q.with_vector(Q.make_sequences(stage2(spark, folder), ALL, L))
    values = vector_to_array("features")
    return df.select(
        "user_id", "target_week", "label", values[0].alias("first_value"), values[L * len(ALL) - 1].alias("last_value"), F.size(values).alias("width")
    )


@query(
    "drop_feature_all_timesteps",
    CONDENSED,
    condensed_sql("ll_cells", ["n_events", "mean_hour", "activity_score"]),
    "ll_cells",
)
def drop_feature_all_timesteps(spark, folder):
    """Calendar features removed from every step of five-feature sequences."""
    cols = ["year", "n_events", "mean_hour", "day", "activity_score"]
    reduced, left = Q.drop_features(Q.make_sequences(stage2(spark, folder), cols, L), cols, ["year", "day"])
    assert left == ["n_events", "mean_hour", "activity_score"]
    return condensed(reduced)


@query(
    "seq_with_demographics",
    "canton:s n_sequences:i n_positive:i class_year_sum:i study_sum:i",
    """select canton, count(*) as n_sequences, sum(label) as n_positive, sum(d.class_year) as class_year_sum, sum(d.study) as study_sum
       from ll_targets join demo d using (user_id) join users_c using (user_id) group by canton""",
    "ll_targets demo users_c",
)
def seq_with_demographics(spark, folder):
    users = clean.clean_users(star.star_users(spark, folder))
    block = demographics.demographic_features(users, CATEGORIES)
    df = Q.attach_demographics(Q.make_sequences(stage2(spark, folder), ALL, L), block)
    return (
        df.withColumn("canton", demographics.one_hot_label(df, "canton_"))
        .groupBy("canton")
        .agg(
            F.count(F.lit(1)).alias("n_sequences"),
            F.sum("label").alias("n_positive"),
            F.sum("class_year").alias("class_year_sum"),
            F.sum("study").alias("study_sum"),
        )
    )


@query(
    "demographic_index",
    "user_id:i canton_index:i class_level_index:i gender_FEMALE:i gender_MALE:i gender_Other:i gender_Unknown:i",
    """select user_id, dense_rank() over (order by canton) - 1 as canton_index, dense_rank() over (order by class_level) - 1 as class_level_index,
       (gender = 'FEMALE')::int as "gender_FEMALE", (gender = 'MALE')::int as "gender_MALE", (gender = 'Other')::int as "gender_Other",
       (gender = 'Unknown')::int as "gender_Unknown" from users_c""",
    "users_c",
)
def demographic_index(spark, folder):
    return demographics.demographic_index(clean.clean_users(star.star_users(spark, folder)))


@query(
    "fairness_frame",
    "gender:s canton:s n_rows:i n_users:i n_positive:i",
    """select gender, canton, count(*) as n_rows, count(distinct user_id) as n_users, sum(label) as n_positive
       from ll_targets join users_c using (user_id) group by gender, canton""",
    "ll_targets users_c",
)
def fairness_frame(spark, folder):
    users = clean.clean_users(star.star_users(spark, folder))
    df = Q.fairness_frame(stage2(spark, folder), users, L)
    return df.groupBy("gender", "canton").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_distinct("user_id").alias("n_users"), F.sum("true_label").alias("n_positive")
    )


# --- trajectories --------------------------------------------------------------------------------------------------

cte(
    "ll_labelled",
    "select *, row_number() over (partition by user_id order by relative_week) - 1 as pos from ll_stage2 where is_dropout_point is not null",
    "ll_stage2",
)
STATS = ", ".join(f"avg({c}) as m_{c}, coalesce(nullif(stddev_pop({c}), 0), 1) as s_{c}" for c in BEHAVIOUR_FEATURES)
cte("ll_stats", f"select {STATS} from ll_labelled", "ll_labelled")
cte(
    "ll_scaled",
    f"""select user_id, relative_week, pos, is_dropout_point, {', '.join(f'({c} - m_{c}) / s_{c} as {c}' for c in BEHAVIOUR_FEATURES)}
        from ll_labelled cross join ll_stats""",
    "ll_labelled",
    "ll_stats",
)
cte(
    "ll_traj",
    """select e.user_id, e.relative_week as target_week, e.is_dropout_point as label, t::int as t, s.* exclude (user_id, relative_week, pos, is_dropout_point)
       from ll_scaled e cross join range(0, 12) r(t) join ll_scaled s on s.user_id = e.user_id and s.pos = e.pos - 11 + t
       where e.pos >= 11""",
    "ll_scaled",
)


def trajectories(spark, folder, cols=BEHAVIOUR_FEATURES):
    """Scaled labelled weeks in windows of twelve; the scaler sees every labelled week."""
    weeks = durable(stage2(spark, folder).filter("is_dropout_point is not null").select("user_id", "relative_week", "is_dropout_point", *cols))
    scaled, _ = sampling.impute_scale(weeks, cols)
    return Q.trajectory_sequences(scaled, cols, L)


@query(
    "impute_scale",
    "user_id:i n_weeks:i " + " ".join(f"{c}:d" for c in ("avg_response_time", "mean_hour", "activity_score")),
    """with filled as (select user_id, relative_week, coalesce(avg_response_time, (select median(avg_response_time) from ll_weekly)) as avg_response_time,
                              coalesce(mean_hour, (select median(mean_hour) from ll_weekly)) as mean_hour, activity_score from ll_weekly),
            m as (select avg(avg_response_time) as a1, coalesce(nullif(stddev_pop(avg_response_time), 0), 1) as b1, avg(mean_hour) as a2,
                         coalesce(nullif(stddev_pop(mean_hour), 0), 1) as b2, avg(activity_score) as a3,
                         coalesce(nullif(stddev_pop(activity_score), 0), 1) as b3 from filled)
       select user_id, count(*) as n_weeks, sum((avg_response_time - a1) / b1) as avg_response_time, sum((mean_hour - a2) / b2) as mean_hour,
              sum((activity_score - a3) / b3) as activity_score from filled cross join m group by user_id""",
    "ll_weekly",
)
def impute_scale(spark, folder):
    from weekspan.catalog.logs import long_logs
    from weekspan.operators.features import weekly_features

    logs = long_logs(spark, folder)
    cols = ["avg_response_time", "mean_hour", "activity_score"]
    weeks = durable(weekly_features(logs.events, logs.transactions).select("user_id", *cols))
    scaled, _ = sampling.impute_scale(weeks, cols)
    return scaled.groupBy("user_id").agg(F.count(F.lit(1)).alias("n_weeks"), *[F.sum(c).alias(c) for c in cols])


@query("trajectory_sequences", CONDENSED, condensed_sql("ll_traj", BEHAVIOUR_FEATURES), "ll_traj")
def trajectory_sequences(spark, folder):
    return condensed(trajectories(spark, folder), label="is_dropout_point", week="end_week")


@query(
    "l2_normalize_sequences",
    CONDENSED,
    condensed_sql(
        f"""(select user_id, target_week, label, t, {', '.join(
            f'{c} / coalesce(nullif(sqrt(sum({c} * {c}) over (partition by user_id, target_week)), 0), 1) as {c}' for c in BEHAVIOUR_FEATURES)} from ll_traj)""",
        BEHAVIOUR_FEATURES,
    ),
    "ll_traj",
)
def l2_normalize_sequences(spark, folder):
    df = trajectories(spark, folder)
    return condensed(df.withColumn("seq", arrays.l2_normalize("seq", len(BEHAVIOUR_FEATURES))), label="is_dropout_point", week="end_week")


@query(
    "trajectory_mean",
    "user_id:i n_sequences:i " + " ".join(f"{c}:d" for c in BEHAVIOUR_FEATURES),
    f"select user_id, count(*) / 12 as n_sequences, {', '.join(f'avg({c}) as {c}' for c in BEHAVIOUR_FEATURES)} from ll_traj group by user_id",
    "ll_traj",
)
def trajectory_mean(spark, folder):
    df = trajectories(spark, folder).withColumn("pooled", arrays.mean_over_time("seq", len(BEHAVIOUR_FEATURES)))
    return df.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("n_sequences"), *[F.avg(F.col("pooled")[i]).alias(c) for i, c in enumerate(BEHAVIOUR_FEATURES)]
    )


DIMENSIONS = {d: f"({' + '.join(cols)}) / {len(cols)}" for d, cols in TRAJECTORY_GROUPS.items()}
DIMENSION_SQL = ", ".join(f"avg({e}) as {d}" for d, e in DIMENSIONS.items())
DIMENSION_SPEC = " ".join(f"{d}:d" for d in DIMENSIONS)


@query(
    "trajectory_dimension_curves",
    f"end_year:i week:i n:i {DIMENSION_SPEC}",
    f"select target_week // 52 as end_year, t as week, count(*) as n, {DIMENSION_SQL} from ll_traj group by all",
    "ll_traj",
)
def trajectory_dimension_curves(spark, folder):
    curves = Q.dimension_curves(trajectories(spark, folder), BEHAVIOUR_FEATURES, TRAJECTORY_GROUPS)
    weeks = curves.select(F.floor(F.col("end_week") / 52).alias("end_year"), F.posexplode(F.arrays_zip(*DIMENSIONS)).alias("week", "v"))
    return weeks.groupBy("end_year", "week").agg(F.count(F.lit(1)).alias("n"), *[F.avg(f"v.{d}").alias(d) for d in DIMENSIONS])


@query(
    "trajectory_profiles",
    f"cluster:i week:i n:i {DIMENSION_SPEC}",
    f"select user_id % 4 as cluster, t as week, count(*) as n, {DIMENSION_SQL} from ll_traj group by all",
    "ll_traj",
)
def trajectory_profiles(spark, folder):
    from weekspan.operators.clusters import curve_profiles

    df = trajectories(spark, folder).withColumn("cluster", F.col("user_id") % 4)
    return curve_profiles(df, BEHAVIOUR_FEATURES, TRAJECTORY_GROUPS, "cluster")


@query(
    "trajectory_shape_summary",
    "cluster:i n_sequences:i n_users:i interruption_rate:d "
    + " ".join(f"{d}_{s}:d" for d in DIMENSIONS for s in ("mean", "start", "end", "change")),
    "select user_id % 4 as cluster, count(*) / 12 as n_sequences, count(distinct user_id) as n_users, avg(label) as interruption_rate, "
    + ", ".join(
        f"avg({e}) as {d}_mean, avg({e}) filter (t = 0) as {d}_start, avg({e}) filter (t = 11) as {d}_end, "
        f"avg({e}) filter (t = 11) - avg({e}) filter (t = 0) as {d}_change"
        for d, e in DIMENSIONS.items()
    )
    + " from ll_traj group by all",
    "ll_traj",
)
def trajectory_shape_summary(spark, folder):
    from weekspan.operators.clusters import shape_summary

    df = trajectories(spark, folder).withColumn("cluster", F.col("user_id") % 4)
    return shape_summary(df, BEHAVIOUR_FEATURES, TRAJECTORY_GROUPS, "cluster")


@query(
    "trajectory_demographics",
    "gender:s canton:s n_rows:i n_users:i n_positive:i",
    """select coalesce(gender, 'Unknown') as gender, coalesce(canton, 'Unknown') as canton, count(*) as n_rows,
       count(distinct user_id) as n_users, sum(is_dropout_point) as n_positive
       from ll_labelled left join (select user_id, gender, canton from users_c where user_id in (select user_id from events)) using (user_id)
       where pos >= 11 group by all""",
    "ll_labelled users_c",
)
def trajectory_demographics(spark, folder):
    """Trajectories joined to the demographics of the users on the event stream; the others are Unknown."""
    from weekspan.operators.clusters import attach_groups

    users = clean.clean_users(star.star_users(spark, folder)).select("user_id", "gender", "canton")
    known = users.join(star.table(spark, folder, "events").select("user_id").distinct(), "user_id", "left_semi")
    weeks = stage2(spark, folder).filter("is_dropout_point is not null")
    df = attach_groups(Q.trajectory_sequences(weeks, BEHAVIOUR_FEATURES, L), known, ["gender", "canton"])
    return df.groupBy("gender", "canton").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_distinct("user_id").alias("n_users"), F.sum("is_dropout_point").alias("n_positive")
    )


# --- augmentation of sequences -------------------------------------------------------------------------------------

SEQ_KEYS = ["user_id", "target_week"]


def u_sql(key: str, seed: str) -> str:
    return f"(cast('0x' || substr(md5({key} || '|{seed}'), 1, 8) as bigint) / 4294967296.0::double)"


ROW = "user_id || '|' || target_week"


def base_sequences(spark, folder):
    return Q.make_sequences(stage2(spark, folder), ALL, L)


cte(
    "masked",
    f"""select user_id, target_week, label, t, {', '.join(ALL)},
        row_number() over (partition by user_id, target_week order by {u_sql(ROW + " || '|' || t", 's|mask')}, t) as mask_order
        from ll_cells""",
    "ll_cells",
)


def zeroed(n: str) -> str:
    return ", ".join(f"case when mask_order <= {n} then 0 else {c} end as {c}" for c in ALL)


@query(
    "mask_timesteps",
    CONDENSED,
    condensed_sql(f"(select user_id, target_week, label, t, {zeroed('3')} from masked)", ALL),
    "masked",
)
def mask_timesteps(spark, folder):
    df = base_sequences(spark, folder)
    return condensed(df.withColumn("seq", A.mask_weeks(F.col("seq"), SEQ_KEYS, "s", L, len(ALL), 3)))


@query(
    "week_dropout",
    CONDENSED,
    condensed_sql(f"(select user_id, target_week, label, t, {zeroed('2')} from masked)", ALL),
    "masked",
)
def week_dropout(spark, folder):
    df = base_sequences(spark, folder)
    n = max(1, round(L * 0.2))
    return condensed(df.withColumn("seq", A.mask_weeks(F.col("seq"), SEQ_KEYS, "s", L, len(ALL), n)))


CROP = f"(6 + floor({u_sql(ROW, 's|crop')} * 6))::int"
cte("cropped", f"select *, {CROP} as crop from ll_cells", "ll_cells")
cte("started", f"select *, floor({u_sql(ROW, 's|start')} * (12 - crop + 1))::int as start from cropped", "cropped")


@query(
    "crop_pad",
    CONDENSED,
    f"""select user_id, count(distinct target_week) as n_sequences, sum(label) filter (t = 0) as n_positive, min(target_week) as first_week,
        max(target_week) as last_week,
        sum(case when t >= start and t < start + crop then {weighted(ALL, 't - start + 12 - crop')} else 0 end) / {SCALE} as checksum
        from started group by user_id""",
    "started",
)
def crop_pad(spark, folder):
    df = base_sequences(spark, folder)
    return condensed(df.withColumn("seq", A.crop_and_pad(F.col("seq"), SEQ_KEYS, "s", L, len(ALL))))


def _swap_sql() -> str:
    first = f"""select *, 1 + floor({u_sql(ROW, 's|swaps')} * 2) as n, floor({u_sql(ROW, 's|i0')} * 12)::int as i0,
        floor({u_sql(ROW, 's|i1')} * 12)::int as i1 from ll_cells"""
    second = f"""select *, greatest(0, i0 - 2) + floor({u_sql(ROW, 's|j0')} * (least(11, i0 + 2) - greatest(0, i0 - 2) + 1))::int as j0,
        greatest(0, i1 - 2) + floor({u_sql(ROW, 's|j1')} * (least(11, i1 + 2) - greatest(0, i1 - 2) + 1))::int as j1 from ({first})"""
    third = f"select *, case when t = i0 then j0 when t = j0 then i0 else t end as t1 from ({second})"
    return f"select *, case when n < 2 then t1 when t1 = i1 then j1 when t1 = j1 then i1 else t1 end as t2 from ({third})"


@query("local_swap", CONDENSED, condensed_sql(f"({_swap_sql()})", ALL, t="t2"), "ll_cells")
def local_swap(spark, folder):
    df = base_sequences(spark, folder)
    return condensed(df.withColumn("seq", A.swap_nearby(F.col("seq"), SEQ_KEYS, "s", L)))


cte(
    "policy",
    f"""select *, {u_sql(ROW, 's|do_mask')} < 0.5 as m, {u_sql(ROW, 's|do_crop')} < 0.5 as c, {u_sql(ROW, 's|fallback')} < 0.5 as f
        from (select s.*, masked.mask_order from started s join masked using (user_id, target_week, t))""",
    "started",
    "masked",
)
cte(
    "policy_cells",
    """select user_id, target_week, label, t, case when (m or (not m and not c and f)) and mask_order <= 3 then 0 else 1 end as kept,
       case when c or (not m and not c and not f) then case when t >= start and t < start + crop then t - start + 12 - crop end else t end as t2,
       """
    + ", ".join(ALL)
    + " from policy",
    "policy",
)


@query(
    "augment_policy_mask_crop",
    "user_id:i copy:i n_sequences:i n_positive:i checksum:f",
    f"""select user_id, 0 as copy, count(*) / 12 as n_sequences, sum(label) / 12 as n_positive, sum({weighted(ALL)}) / {SCALE} as checksum
        from ll_cells group by user_id
        union all
        select user_id, 1, count(*) / 12, sum(label) / 12,
               sum(case when t2 is null then 0 else kept * ({weighted(ALL, 't2')}) end) / {SCALE} from policy_cells group by user_id""",
    "ll_cells policy_cells",
)
def augment_policy_mask_crop(spark, folder):
    df = base_sequences(spark, folder)

    def policy(df, seed, **options):
        return A.policy_mask_crop(df, SEQ_KEYS, L, len(ALL), "s")

    both = A.augmented_train_set(df, policy)
    parts = [condensed(both.filter(F.col("copy") == c)).withColumn("copy", F.lit(c)) for c in (0, 1)]
    return parts[0].unionByName(parts[1])


@query(
    "augmentation_audit",
    "changed_ratio:d mean_changed:d median_changed:d min_changed:i max_changed:i",
    f"""select avg((n > 0)::int) as changed_ratio, avg(n) as mean_changed, median(n) as median_changed, min(n) as min_changed, max(n) as max_changed
       from (select user_id, target_week, sum({' + '.join(f'(mask_order <= 3 and {c} <> 0)::int' for c in ALL)}) as n from masked group by all)""",
    "masked",
)
def augmentation_audit(spark, folder):
    df = base_sequences(spark, folder)
    return A.augmentation_audit(df.withColumn("augmented", A.mask_weeks(F.col("seq"), SEQ_KEYS, "s", L, len(ALL), 3)))


MOVED = "user_id:i n_sequences:i n_positive:i n_cells:i n_moved:i n_far:i"


def moved(df, keys=("user_id",), bound=0.03 * 9):
    """Sequences, cells, cells that changed and cells that moved by more than nine deviations, from ``before`` to ``seq``."""
    counted = df.select(*keys, "label", F.size(F.flatten("seq")).alias("_cells"), cells_apart(F.flatten("before"), F.flatten("seq"), [0.0, bound]).alias("_apart"))
    return counted.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_sequences"), F.sum("label").alias("n_positive"), F.sum("_cells").alias("n_cells"),
        F.sum(F.col("_apart")[0]).alias("n_moved"), F.sum(F.col("_apart")[1]).alias("n_far"),
    )


@query(
    "gaussian_jitter",
    MOVED,
    f"""select user_id, count(*) / 12 as n_sequences, sum(label) / 12 as n_positive, count(*) * {len(ALL)} as n_cells, count(*) * {len(ALL)} as n_moved, 0 as n_far
        from ll_cells group by user_id""",
    "ll_cells",
)
def gaussian_jitter(spark, folder):
    """The draws are hashed and cannot be repeated in SQL; every cell must move, and none by more than nine deviations."""
    df = base_sequences(spark, folder).withColumn("before", F.col("seq"))
    return moved(df.withColumn("seq", A.jitter(F.col("seq"), SEQ_KEYS, "s")))


@query(
    "augment_policy_conservative",
    "user_id:i copy:i n_sequences:i n_positive:i n_same:i",
    """select user_id, copy, n as n_sequences, positive as n_positive, case when copy = 0 then n else 0 end as n_same
       from (select user_id, count(*) / 12 as n, sum(label) / 12 as positive from ll_cells group by user_id) cross join (select unnest([0, 1]) as copy)""",
    "ll_cells",
)
def augment_policy_conservative(spark, folder):
    """Originals stay as they are and every sequence has one copy; what the copy holds is drawn by hash."""
    df = base_sequences(spark, folder).withColumn("before", F.col("seq"))
    both = A.augmented_train_set(df, A.policy_conservative, keys=SEQ_KEYS, length=L, features=len(ALL))
    same = (F.col("seq") == F.col("before")) & (F.col("copy") == 0)
    return both.groupBy("user_id", "copy").agg(F.count(F.lit(1)).alias("n_sequences"), F.sum("label").alias("n_positive"), F.count_if(same).alias("n_same"))
