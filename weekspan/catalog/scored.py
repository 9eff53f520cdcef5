"""Queries over scored rows, cluster assignments and group statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from weekspan.catalog.base import cte, query
from weekspan.catalog.logs import CATEGORIES, stage1
from weekspan.functions.hashing import uniform
from weekspan.operators import evaluate as E
from weekspan.operators import fairness as G
from weekspan.sources import star

cte(
    "scored",
    """
select doc_id as user_id, quality as y_true, round(n_chars / (n_chars + 500.0::double), 6) as y_prob,
       case when round(n_chars / (n_chars + 500.0::double), 6) > 0.5 then 1 else 0 end as y_pred,
       lang as gender, source as canton, toxic,
       cast('0x' || substr(md5(doc_id || '|half'), 1, 8) as bigint) / 4294967296.0::double < 0.5 as in_validation
from documents join labels using (doc_id)
""",
)
cte(
    "clusters",
    """
select o_orderkey as row_index, o_custkey as user_id, o_custkey % 4 as spectral_eucl, o_orderkey % 4 as kmeans_flat,
       (o_custkey % 4 + case when o_orderkey % 5 = 0 then 1 else 0 end) % 4 as kmeans_eucl,
       o_orderpriority as gender, o_orderstatus as school_type, case when o_totalprice > 200000 then 1 else 0 end as is_dropout_point
from orders
""",
)
cte(
    "canton_cells",
    """select c.*, case when row_index % 13 < 3 then 'Unknown' else cast(row_index % 13 * 10 + is_dropout_point * (row_index % 3) as varchar) end as canton
       from clusters c""",
    "clusters",
)


METHODS = ["spectral_eucl", "kmeans_flat", "kmeans_eucl"]
ATTRIBUTES = ["gender", "school_type"]


def scored(spark, folder):
    return star.scored_view(spark, folder)


def halves(spark, folder):
    df = scored(spark, folder).withColumn("_v", uniform("user_id", "half") < 0.5)
    return df.filter("_v"), df.filter("not _v")


# --- evaluation ----------------------------------------------------------------------------------------------------


def points_sql(thresholds) -> str:
    rows = ", ".join(f"({i}, {t!r}e0)" if "e" not in repr(t) else f"({i}, {t!r})" for i, t in enumerate(thresholds))
    return f"(values {rows}) p(position, threshold)"


def sweep_sql(thresholds, operator: str, source: str = "scored", by: str = "") -> str:
    keys = f"{by}, " if by else ""
    return f"""
select *, case when 2 * tp + fp + fn > 0 then 2 * tp / (2 * tp + fp + fn)::double else 0 end as f1,
       case when tp + fp > 0 then tp / (tp + fp)::double else 0 end as precision,
       case when tp + fn > 0 then tp / (tp + fn)::double else 0 end as recall
from (select {keys}position, threshold, sum((y_true = 1 and y_prob {operator} threshold)::int) as tp,
             sum((y_true = 0 and y_prob {operator} threshold)::int) as fp,
             sum((y_true = 1 and not y_prob {operator} threshold)::int) as fn,
             sum((y_true = 0 and not y_prob {operator} threshold)::int) as tn
      from {source} cross join {points_sql(thresholds)} group by all)"""


AUC = """(select {0} sum(case when a.y_prob > b.y_prob then 1.0::double when a.y_prob = b.y_prob then 0.5 else 0 end)
          / nullif(count(*), 0) as roc_auc, count(distinct a.user_id) as n_pos, count(distinct b.user_id) as n_neg
          from {1} a join {1} b on a.y_true = 1 and b.y_true = 0 {2} {3})"""
AUC_ALL = AUC.format("", "{0}", "", "")


@query(
    "best_threshold_f1",
    "gender:s threshold:d f1:d",
    f"""select gender, threshold, f1 from ({sweep_sql(E.DEFAULT_GRID, '>', by='gender')})
        qualify row_number() over (partition by gender order by f1 desc, position) = 1""",
    "scored",
)
def best_threshold_f1(spark, folder):
    return E.best_threshold(scored(spark, folder), by=["gender"])


@query(
    "threshold_sweep",
    "grid:s position:i threshold:d tp:i fp:i fn:i tn:i f1:d precision:d recall:d",
    " union all ".join(
        f"select '{n}' as grid, * from ({sweep_sql(g, '>=')})"
        for n, g in (("fine", E.FINE_GRID), ("wide", E.WIDE_GRID), ("percent", E.PERCENT_GRID))
    ),
    "scored",
)
def threshold_sweep(spark, folder):
    grids = {"fine": E.FINE_GRID, "wide": E.WIDE_GRID, "percent": E.PERCENT_GRID}
    df = scored(spark, folder)
    return E.stack_results({n: E.threshold_sweep(df, thresholds=g, strict=False) for n, g in grids.items()}, "grid")


METRICS_SQL = """
select {keys} case when 2 * tp + fp + fn > 0 then 2 * tp / (2 * tp + fp + fn)::double else 0 end as f1,
       case when tp + fp > 0 then tp / (tp + fp)::double else 0 end as precision,
       case when tp + fn > 0 then tp / (tp + fn)::double else 0 end as recall, {threshold} as threshold
from (select {keys} sum((y_true = 1 and y_prob >= {threshold})::int) as tp, sum((y_true = 0 and y_prob >= {threshold})::int) as fp,
             sum((y_true = 1 and y_prob < {threshold})::int) as fn from {source} {group})"""


@query(
    "binary_metrics",
    "gender:s roc_auc:d f1:d precision:d recall:d threshold:d",
    f"""select * from ({METRICS_SQL.format(keys='gender,', threshold='0.6::double', source='scored', group='group by gender')})
        join {AUC.format('a.gender,', 'scored', 'and a.gender = b.gender', 'group by a.gender')} using (gender)""",
    "scored",
)
def binary_metrics(spark, folder):
    return E.binary_metrics(scored(spark, folder), 0.6, by=["gender"])


@query(
    "roc_auc",
    "scope:s roc_auc:d n_pos:i n_neg:i",
    f"""select 'all' as scope, * from {AUC_ALL.format('scored')} union all
        select 'toxic', * from {AUC_ALL.format("(select user_id, toxic as y_true, y_prob from scored)")}""",
    "scored",
)
def roc_auc(spark, folder):
    df = scored(spark, folder)
    return E.stack_results({"all": E.roc_auc(df), "toxic": E.roc_auc(df, label="toxic")}, "scope")


cte("validation_rows", "select * from scored where in_validation", "scored")
cte("test_rows", "select * from scored where not in_validation", "scored")
cte(
    "tuned",
    f"select threshold as t, f1 as val_f1 from ({sweep_sql(E.DEFAULT_GRID, '>', 'validation_rows')}) order by f1 desc, position limit 1",
    "validation_rows",
)
cte("test_tuned", "select * from test_rows cross join tuned", "test_rows", "tuned")


@query(
    "validation_tuned_metrics",
    "roc_auc:d f1:d precision:d recall:d threshold:d val_f1:d",
    f"""select m.*, a.roc_auc, val_f1 from ({METRICS_SQL.format(keys='', threshold='t', source='test_tuned', group='group by t').replace('(select  sum', '(select t, sum')}) m
        cross join {AUC_ALL.format('test_rows')} a cross join tuned""",
    "test_tuned test_rows tuned",
)
def validation_tuned_metrics(spark, folder):
    return E.validation_tuned_metrics(*halves(spark, folder))


@query(
    "confusion_matrix",
    "canton:s tn:i fp:i fn:i tp:i accuracy:d",
    """select canton, sum((y_true = 0 and y_prob < 0.55)::int) as tn, sum((y_true = 0 and y_prob >= 0.55)::int) as fp,
       sum((y_true = 1 and y_prob < 0.55)::int) as fn, sum((y_true = 1 and y_prob >= 0.55)::int) as tp,
       avg((y_true = (y_prob >= 0.55)::int)::int) as accuracy from scored group by canton""",
    "scored",
)
def confusion_matrix(spark, folder):
    return E.confusion_matrix(scored(spark, folder), 0.55, by=["canton"])


@query(
    "classification_report",
    "row:s precision:d recall:d f1:d support:i",
    """with per as (
         select c as row, coalesce(sum((y_pred = c and y_true = c)::int) / nullif(sum((y_pred = c)::int), 0)::double, 0) as precision,
                coalesce(sum((y_pred = c and y_true = c)::int) / nullif(sum((y_true = c)::int), 0)::double, 0) as recall,
                coalesce(2 * sum((y_pred = c and y_true = c)::int) / nullif(sum((y_true = c)::int) + sum((y_pred = c)::int), 0)::double, 0) as f1,
                sum((y_true = c)::int) as support
         from scored cross join (values (0), (1)) k(c) group by c)
       select cast(row as varchar) as row, precision, recall, f1, support from per
       union all select 'macro avg', avg(precision), avg(recall), avg(f1), sum(support) from per
       union all select 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support),
                        sum(f1 * support) / sum(support), sum(support) from per
       union all select 'accuracy', null, null, (select avg((y_true = y_pred)::int) from scored), sum(support) from per""",
    "scored",
)
def classification_report(spark, folder):
    return E.classification_report(scored(spark, folder))


cte("inverted", "select user_id, y_true, 1 - y_prob as y_prob from scored", "scored")
cte("toxicity", "select user_id, toxic as y_true, y_prob from scored", "scored")


@query(
    "experiment_comparison",
    "experiment:s rank:i roc_auc:d f1:d precision:d recall:d threshold:d n_pos:i",
    """select *, row_number() over (order by f1 desc, roc_auc desc) as rank from ("""
    + " union all ".join(
        f"select '{name}' as experiment, m.*, a.roc_auc, {pos} as n_pos from ({METRICS_SQL.format(keys='', threshold=t + '::double', source=src, group='')}) m cross join {AUC_ALL.format(src)} a"
        for name, src, t, pos in (
            ("length", "scored", "0.5", "a.n_pos"),
            ("inverted", "inverted", "0.5", "null"),
            ("toxicity", "toxicity", "0.6", "null"),
        )
    )
    + ")",
    "scored inverted toxicity",
)
def experiment_comparison(spark, folder):
    """Metric tables of three scorings with different columns, stacked and sorted."""
    df = scored(spark, folder)
    counted = E.binary_metrics(df, 0.5).withColumn("n_pos", F.lit(E.roc_auc(df).first()["n_pos"]))
    toxic = df.select("user_id", F.col("toxic").alias("y_true"), "y_prob")
    tables = {
        "length": counted,
        "inverted": E.binary_metrics(df.withColumn("y_prob", 1 - F.col("y_prob")), 0.5),
        "toxicity": E.binary_metrics(toxic, 0.6),
    }
    return E.rank_rows(E.experiment_comparison(tables), [F.desc("f1"), F.desc("roc_auc")])


@query(
    "metric_deltas",
    "model:s augmentation:s accuracy:d positive_rate:d accuracy_delta:d positive_rate_delta:d",
    """with m as (select gender as model, canton as augmentation, avg((y_true = y_pred)::int) as accuracy, avg(y_pred) as positive_rate
                  from scored group by all)
       select m.*, m.accuracy - b.accuracy as accuracy_delta, m.positive_rate - b.positive_rate as positive_rate_delta
       from m left join m b on b.model = m.model and b.augmentation = 'src0'""",
    "scored",
)
def metric_deltas(spark, folder):
    results = scored(spark, folder).groupBy(F.col("gender").alias("model"), F.col("canton").alias("augmentation")).agg(
        F.avg((F.col("y_true") == F.col("y_pred")).cast("int")).alias("accuracy"), F.avg("y_pred").alias("positive_rate")
    )
    return E.metric_deltas(results, ["accuracy", "positive_rate"], baseline="src0")


@query(
    "ranked_feature_groups",
    "original_feature:s total_importance:d mean_importance:d max_importance:d std_mean:d rank:i",
    """with flat as (select 't' || topic || '_' || lower(event_type) as name, lower(event_type) as feature, avg(n) as m, stddev_pop(n) as s
                     from (select user_id, event_type, coalesce(topic_id, 0) as topic, count(*) as n from lx_events group by all)
                     group by topic, event_type)
       select feature as original_feature, sum(m) as total_importance, avg(m) as mean_importance, max(m) as max_importance,
              avg(s) as std_mean, row_number() over (order by sum(m) desc, feature) as rank from flat group by feature""",
    "lx_events",
)
def ranked_feature_groups(spark, folder):
    """Roll-up of per-step values named t<step>_<feature>, here mean counts per topic and event type."""
    from weekspan.operators.sequences import original_feature

    events = star.short_events(spark, folder).withColumn("topic", F.coalesce("topic_id", F.lit(0)))
    counts = events.groupBy("user_id", "event_type", "topic").count()
    flat = counts.groupBy("event_type", "topic").agg(
        F.avg("count").alias("importance_mean"), F.stddev_pop("count").alias("importance_std")
    )
    name = F.concat(F.lit("t"), F.col("topic").cast("string"), F.lit("_"), F.lower("event_type"))
    return E.roll_up_importance(flat.withColumn("flat_feature", name), original_feature(F.col("flat_feature")))


# --- fairness ------------------------------------------------------------------------------------------------------

GROUP_SQL = """select '{0}' as attribute, {0} as "group", count(*) as n_samples,
    sum((y_true = 1 and y_pred = 1)::int) / nullif(sum((y_true = 1)::int), 0)::double as "TPR",
    sum((y_true = 0 and y_pred = 1)::int) / nullif(sum((y_true = 0)::int), 0)::double as "FPR",
    sum((y_true = 1 and y_pred = 1)::int) / nullif(sum((y_pred = 1)::int), 0)::double as "PPV",
    sum((y_true = 0 and y_pred = 0)::int) / nullif(sum((y_pred = 0)::int), 0)::double as "NPV"
    from scored where {0} is not null group by {0}"""
cte("group_rates", GROUP_SQL.format("gender") + " union all " + GROUP_SQL.format("canton"), "scored")


def group_rates(spark, folder):
    df = scored(spark, folder)
    return E.stack_results({a: G.group_confusion(df, a) for a in ("gender", "canton")}, "attribute")


@query("group_confusion", "attribute:s group:s n_samples:i TPR:d FPR:d PPV:d NPV:d", "select * from group_rates", "group_rates")
def group_confusion(spark, folder):
    return group_rates(spark, folder)


@query(
    "parity_gaps",
    "attribute:s TPR_gap:d FPR_gap:d PPV_gap:d NPV_gap:d",
    "select attribute, "
    + ", ".join(f'case when count("{m}") >= 2 then max("{m}") - min("{m}") end as "{m}_gap"' for m in G.RATES)
    + " from group_rates group by attribute",
    "group_rates",
)
def parity_gaps(spark, folder):
    return G.parity_gaps(group_rates(spark, folder), ["attribute"])


CELL_SPEC = "n_rows:i n_unique_users:i dropout_point_rate:d cluster_rate:d rate_gap_vs_cluster:d disparity_ratio_vs_cluster:d"


def cells_sql(group: str, min_n: int) -> str:
    return f"""select t.*, c.cluster_rate, dropout_point_rate - cluster_rate as rate_gap_vs_cluster,
        dropout_point_rate / nullif(cluster_rate, 0) as disparity_ratio_vs_cluster,
        case when n_unique_users < {min_n} then 'low unique-user support' else '' end as support_note
        from (select spectral_eucl, {group}, count(*) as n_rows, count(distinct user_id) as n_unique_users,
                     avg(is_dropout_point) as dropout_point_rate from clusters group by all having count(*) >= {min_n}) t
        join (select spectral_eucl, avg(is_dropout_point) as cluster_rate from clusters group by all) c using (spectral_eucl)"""


@query(
    "outcome_by_cluster_group",
    f"spectral_eucl:i gender:s {CELL_SPEC} support_note:s",
    cells_sql("gender", 450),
    "clusters",
)
def outcome_by_cluster_group(spark, folder):
    return G.outcome_by_cluster_group(star.clusters_view(spark, folder), "gender", min_n=450)


@query(
    "disparity_flags",
    f"spectral_eucl:i attribute:s group:s {CELL_SPEC} interpretation_note:s",
    """select *, case when lower("group") = 'unknown' then 'Unknown category: interpret mainly as missingness / data-quality signal'
                      when support_note <> '' then 'Small unique-user support: interpret cautiously' else '' end as interpretation_note
       from ("""
    + " union all ".join(
        f"""select spectral_eucl, '{a}' as attribute, {a} as "group", n_rows, n_unique_users, dropout_point_rate, cluster_rate,
            rate_gap_vs_cluster, disparity_ratio_vs_cluster, support_note from ({cells_sql(a, 30).replace('from clusters', 'from canton_cells')})"""
        for a in ("canton", "gender")
    )
    + ") where disparity_ratio_vs_cluster < 0.8 or disparity_ratio_vs_cluster > 1.25",
    "canton_cells",
)
def disparity_flags(spark, folder):
    """Outcome cells of an imbalanced attribute (many small groups) and of a balanced one."""
    df = canton_cells(spark, folder)
    return G.disparity_flags({a: G.outcome_by_cluster_group(df, a) for a in ("canton", "gender")})


def canton_cells(spark, folder):
    return star.clusters_view(spark, folder).selectExpr(
        "*",
        "case when row_index % 13 < 3 then 'Unknown' "
        "else cast(row_index % 13 * 10 + is_dropout_point * (row_index % 3) as string) end as canton",
    )


@query(
    "disparate_impact",
    "spectral_eucl:i gender:s n_users:i outcome_rate:d disparity_ratio:d cluster_overall_rate:d",
    """select t.*, outcome_rate / (select avg(is_dropout_point) from clusters) as disparity_ratio, cluster_overall_rate
       from (select spectral_eucl, gender, count(*) as n_users, avg(is_dropout_point) as outcome_rate from clusters group by all) t
       join (select spectral_eucl, avg(is_dropout_point) as cluster_overall_rate from clusters group by all) using (spectral_eucl)""",
    "clusters",
)
def disparate_impact(spark, folder):
    return G.disparate_impact(star.clusters_view(spark, folder), "spectral_eucl", "gender")


@query(
    "composition",
    "spectral_eucl:i gender:s n:i pct:d",
    """select *, n * 100.0 / sum(n) over (partition by spectral_eucl) as pct
       from (select spectral_eucl, gender, count(*) as n from clusters group by all)""",
    "clusters",
)
def composition(spark, folder):
    return G.composition(star.clusters_view(spark, folder), "gender", "spectral_eucl")


@query(
    "intersectional_outcome",
    "gender:s school_type:s spectral_eucl:i n_rows:i n_unique_users:i dropout_point_rate:d",
    """select gender, school_type, spectral_eucl, count(*) as n_rows, count(distinct user_id) as n_unique_users,
       avg(is_dropout_point) as dropout_point_rate from clusters group by all having count(*) >= 200""",
    "clusters",
)
def intersectional_outcome(spark, folder):
    df = star.clusters_view(spark, folder)
    return G.intersectional_outcome(df, ["gender", "school_type", "spectral_eucl"], min_n=200)


@query(
    "fairness_cluster_summary",
    "spectral_eucl:i n_rows:i n_unique_users:i dropout_point_rate:d non_dropout_point_rate:d rows_per_user:d",
    """select spectral_eucl, count(*) as n_rows, count(distinct user_id) as n_unique_users, avg(is_dropout_point) as dropout_point_rate,
       1 - avg(is_dropout_point) as non_dropout_point_rate, count(*) / count(distinct user_id)::double as rows_per_user
       from clusters group by spectral_eucl""",
    "clusters",
)
def fairness_cluster_summary(spark, folder):
    return G.cluster_summary(star.clusters_view(spark, folder), "spectral_eucl")


cte("buyers", "select user_id, canton from lx_users where user_id in (select distinct user_id from clusters)", "lx_users", "clusters")


@query(
    "sample_representativeness",
    "canton:s full_pct:d sample_pct:d percentage_point_gap:d",
    """select canton, coalesce(f.p, 0) as full_pct, coalesce(s.p, 0) as sample_pct, coalesce(s.p, 0) - coalesce(f.p, 0) as percentage_point_gap
       from (select canton, count(*) * 100.0 / sum(count(*)) over () as p from lx_users where canton is not null group by canton) f
       full join (select canton, count(*) * 100.0 / sum(count(*)) over () as p from lx_users
                  where user_id in (select user_id from events) and canton is not null group by canton) s using (canton)""",
    "lx_users",
)
def sample_representativeness(spark, folder):
    """Cantons of all users against those of the users on the event stream."""
    users = star.star_users(spark, folder)
    active = star.table(spark, folder, "events").select("user_id").distinct()
    return G.sample_representativeness(users, users.join(active, "user_id", "left_semi"), "canton")


@query(
    "coverage_summary",
    "metric:s value:d",
    """with a as (select count(*) as n, count(distinct user_id) as u from lx_users), b as (select count(*) as n, count(distinct user_id) as u from clusters)
       select 'Stage 1 demographic rows' as metric, a.n::double as value from a union all select 'Stage 1 unique users', a.u from a
       union all select 'Stage 2 clustered trajectory rows', b.n from b union all select 'Stage 2 clustered unique users', b.u from b
       union all select 'Unique-user coverage rate', b.u / a.u::double from a, b
       union all select 'Mean trajectory rows per clustered user', b.n / b.u::double from b""",
    "lx_users clusters",
)
def coverage_summary(spark, folder):
    return G.coverage_summary(star.star_users(spark, folder), star.clusters_view(spark, folder))


CHI_TESTS = [(m, a) for m in METHODS for a in [*ATTRIBUTES, "is_dropout_point"]] + [("is_upper", "is_dropout_point")]


def chi_sql(method: str, attribute: str) -> str:
    return f"""select '{method}' as method, '{attribute}' as attribute, count(distinct c) as nr, count(distinct g) as nc, max(n) as n,
        sum((o - e) * (o - e) / e) as plain, sum(power(abs(o - e) - least(0.5, abs(o - e)), 2) / e) as yates
        from (select r.c, k.g, coalesce(x.o, 0) as o, r.t * k.t / n::double as e, n
              from (select {method} as c, count(*) as t from chi_rows group by all) r
              cross join (select {attribute} as g, count(*) as t from chi_rows group by all) k
              cross join (select count(*) as n from chi_rows)
              left join (select {method} as c, {attribute} as g, count(*) as o from chi_rows group by all) x on x.c = r.c and x.g = k.g)"""


cte("chi_rows", 'select *, spectral_eucl >= 2 as is_upper from clusters', "clusters")
def chi_table(tests) -> str:
    return (
        """select method, attribute, case when (nr - 1) * (nc - 1) = 1 then yates else plain end as chi2, (nr - 1) * (nc - 1) as dof, n,
       least(nr, nc) - 1 as smaller from ("""
        + " union all ".join(chi_sql(m, a) for m, a in tests)
        + ")"
    )


cte("chi", chi_table(CHI_TESTS), "chi_rows")
cte("chi_all", chi_table([(m, a) for m in [*METHODS, "is_upper"] for a in [*ATTRIBUTES, "is_dropout_point"]]), "chi_rows")
cte(
    "chi_halves",
    """select method, attribute, chi2, dof, chi2 / 2 as h,
       list_reduce([chi2 / 2 + 400.5] || list_transform(range(1, 201), lambda k: cast(k as double)),
                   lambda f, k: chi2 / 2 + 2 * (200 - k) + 0.5 - (201 - k) * (200.5 - k) / f) as fraction
       from chi_all""",
    "chi_all",
)


def chi_rows(spark, folder):
    return star.clusters_view(spark, folder).withColumn("is_upper", F.col("spectral_eucl") >= 2)


def chi_tests(spark, folder):
    wanted = [F.struct(F.lit(m).alias("method"), F.lit(a).alias("attribute")) for m, a in CHI_TESTS]
    cells = G.contingency(chi_rows(spark, folder), [*METHODS, "is_upper"], [*ATTRIBUTES, "is_dropout_point"])
    return G.chi_square(cells.filter(F.struct("method", "attribute").isin(*wanted)))


@query("chi_square", "method:s attribute:s chi2:d dof:i", "select * from chi", "chi")
def chi_square(spark, folder):
    return chi_tests(spark, folder)


@query("cramers_v", "method:s attribute:s cramers_v:d", "select *, sqrt(chi2 / (n * smaller)) as cramers_v from chi", "chi")
def cramers_v(spark, folder):
    return chi_tests(spark, folder)


#: P(X >= chi2): for odd dof the complementary error function by its continued fraction, then terms h^a exp(-h) / Gamma(a + 1).
CHI_P = """select method, attribute, chi2, dof, p_value, p_value < 0.05 as significant from (
    select method, attribute, chi2, dof, case when dof <= 0 or h <= 0 then 1.0 else least(1.0,
        case when dof % 2 = 1 then sqrt(h / pi()) * exp(-h) / fraction else 0 end
        + coalesce(list_sum(list_transform(range(0, dof // 2), lambda i: exp((i + (dof % 2) / 2.0) * ln(h) - h - lgamma(i + (dof % 2) / 2.0 + 1)))), 0)) end as p_value
    from chi_halves)"""


@query("chi_square_p", "method:s attribute:s chi2:d dof:i p_value:d significant:b", CHI_P, "chi_halves")
def chi_square_p(spark, folder):
    return G.chi_square_test(chi_rows(spark, folder), [*METHODS, "is_upper"], [*ATTRIBUTES, "is_dropout_point"])


@query(
    "method_robustness",
    "method:s cluster_label:i n_rows:i n_unique_users:i dropout_point_rate:d",
    " union all ".join(
        f"""select '{m}' as method, {m} as cluster_label, count(*) as n_rows, count(distinct user_id) as n_unique_users,
            avg(is_dropout_point) as dropout_point_rate from clusters group by {m}"""
        for m in METHODS
    ),
    "clusters",
)
def method_robustness(spark, folder):
    return G.method_cluster_summary(star.clusters_view(spark, folder), METHODS)


@query(
    "top_category_bucket",
    "row_index:i canton:s canton_top:s",
    """select row_index, canton, case when canton in (select canton from canton_cells group by canton order by count(*) desc, canton limit 8)
       then canton else 'Other' end as canton_top from canton_cells""",
    "canton_cells",
)
def top_category_bucket(spark, folder):
    return G.top_category_bucket(canton_cells(spark, folder), "canton", "canton_top")


# --- engagement of the stage 1 table, joined to the assignments ----------------------------------------------------

ENGAGEMENT = ["total_events_0_2", "n_active_days_0_2", "n_sessions_0_2", "n_click_events_0_2", "n_view_events_0_2"]
cte(
    "engaged",
    f"""select *, case when s <= quantile_cont(s, 1.0 / 3) over () then 'Low' when s <= quantile_cont(s, 2.0 / 3) over () then 'Medium'
                     else 'High' end as engagement_level
        from (select user_id, ({' + '.join(f'{c} / max({c}) over ()' for c in ENGAGEMENT)}) / 5 as s, user_id % 4 as cluster,
                     came_back as is_dropout_point, case when "gender_FEMALE" = 1 then 'FEMALE' when "gender_MALE" = 1 then 'MALE'
                     when "gender_Other" = 1 then 'Other' else 'Unknown' end as gender from lx_stage1)""",
    "lx_stage1",
)


def engaged(spark, folder):
    from weekspan.operators.demographics import one_hot_label
    from weekspan.session import durable

    table = stage1(spark, folder, categories=CATEGORIES).df
    table = durable(
        table.select(
            "user_id", *ENGAGEMENT, (F.col("user_id") % 4).alias("cluster"), F.col("came_back").alias("is_dropout_point"),
            one_hot_label(table, "gender_").alias("gender"),
        )
    )
    return G.tercile_level(G.engagement_score(table, ENGAGEMENT), "engagement_score")


@query("engagement_score", "user_id:i engagement_score:d", "select *, s as engagement_score from engaged", "engaged")
def engagement_score(spark, folder):
    return engaged(spark, folder)


@query("engagement_level", "user_id:i engagement_level:s", "select * from engaged", "engaged")
def engagement_level(spark, folder):
    return engaged(spark, folder)


@query(
    "engagement_by_cluster",
    "cluster:i count:i mean:d std:d cv:d",
    """select cluster, count(s) as count, avg(s) as mean, stddev_samp(s) as std, stddev_samp(s) / nullif(avg(s), 0) as cv
       from engaged group by cluster""",
    "engaged",
)
def engagement_by_cluster(spark, folder):
    return G.engagement_by_cluster(engaged(spark, folder), "cluster")


@query(
    "outcome_crosstab",
    "engagement_level:s FEMALE:d MALE:d Other:d Unknown:d",
    "select engagement_level, "
    + ", ".join(f"avg(is_dropout_point) filter (gender = '{g}') as \"{g}\"" for g in CATEGORIES["gender"])
    + " from engaged group by engagement_level",
    "engaged",
)
def outcome_crosstab(spark, folder):
    return G.outcome_crosstab(engaged(spark, folder), "engagement_level", "gender", CATEGORIES["gender"])


PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


@query(
    "outcome_pivot",
    ["spectral_eucl:i", *[f"{p}:d" for p in PRIORITIES]],
    "select spectral_eucl, "
    + ", ".join(f"max(dropout_point_rate) filter (gender = '{p}') as \"{p}\"" for p in PRIORITIES)
    + f" from ({cells_sql('gender', 30)}) group by spectral_eucl",
    "clusters",
)
def outcome_pivot(spark, folder):
    table = G.outcome_by_cluster_group(star.clusters_view(spark, folder), "gender")
    return G.outcome_pivot(table, "spectral_eucl", "gender", PRIORITIES)
