"""Queries over clusterings: vectors, assignments, and clusters of the stage 1 table."""

from __future__ import annotations

from pyspark.sql import functions as F

from weekspan.catalog.base import cte, query
from weekspan.catalog.logs import CATEGORIES, stage1
from weekspan.catalog.sequences import stage2
from weekspan.operators import clusters as C
from weekspan.operators import sampling
from weekspan.operators import sequences as Q
from weekspan.operators.ward import run_ward
from weekspan.operators.features import BEHAVIOUR_FEATURES, STAGE1_FEATURES, STAGE1_GROUPS
from weekspan.session import durable
from weekspan.sources import star

METHODS = ["spectral_eucl", "kmeans_flat", "kmeans_eucl"]
LANDMARKS = 40
KS = range(2, 9)


def vectors(spark, folder):
    return star.vectors_view(spark, folder)


# --- similarity ----------------------------------------------------------------------------------------------------

cte("vecs", "select vec_id, embedding::double[] as v, label from embeddings")
cte(
    "similarities",
    f"""select a.vec_id as row, b.vec_id as landmark, exp(-power(list_distance(a.v, b.v), 2) / len(a.v)) as similarity
        from vecs a cross join (select * from vecs order by cast('0x' || substr(md5(vec_id || '|42'), 1, 8) as bigint), vec_id limit {LANDMARKS}) b""",
    "vecs",
)


@query("rbf_similarity", "row:i landmark:i similarity:d", "select * from similarities", "similarities")
def rbf_similarity(spark, folder):
    return C.rbf_similarity(vectors(spark, folder), "vec_id", LANDMARKS)


SPREAD = 28.0  #: base gamma of the graphs: similarity one half at a cosine of about 0.2 between unit vectors of 64 values


@query(
    "epsilon_graph",
    "row:i neighbour:i weight:d",
    f"""select a.vec_id as row, b.vec_id as neighbour, 1.0 as weight from vecs a join vecs b
        on exp(-{SPREAD} * power(list_distance(a.v, b.v), 2) / len(a.v)) > 0.5""",
    "vecs",
)
def epsilon_graph(spark, folder):
    return C.epsilon_graph(vectors(spark, folder), "vec_id", base_gamma=SPREAD)


@query(
    "nearest_neighbours",
    "key:i neighbour:i rank:i squared:d",
    """select * from (select a.vec_id as key, b.vec_id as neighbour, row_number() over (partition by a.vec_id order by list_distance(a.v, b.v), b.vec_id) as rank,
       power(list_distance(a.v, b.v), 2) as squared from vecs a join vecs b on a.vec_id <> b.vec_id) where rank <= 5""",
    "vecs",
)
def nearest_neighbours(spark, folder):
    """The rows between which synthetic rows are placed."""
    return C.nearest_neighbours(vectors(spark, folder), "vec_id", 5)


@query(
    "silhouette_exact",
    "vec_id:i label:i silhouette:d",
    """with d as (select a.vec_id, a.label, b.label as other, sum(power(list_distance(a.v, b.v), 2)) as total, count(*) as n
                  from vecs a cross join vecs b group by all),
            s as (select vec_id, label, max(case when other = label then total / nullif(n - 1, 0) end) as inner_d, max(case when other = label then n end) as own,
                         min(case when other <> label then total / n end) as outer_d from d group by all)
       select vec_id, label, case when own = 1 or greatest(inner_d, outer_d) = 0 then 0 else (outer_d - inner_d) / greatest(inner_d, outer_d) end as silhouette from s""",
    "vecs",
)
def silhouette_exact(spark, folder):
    """Every vector; the label is the partition. The oracle sums all squared distances."""
    return C.silhouette_rows(vectors(spark, folder), "vec_id", "label")


@query(
    "silhouette_euclidean",
    "vec_id:i label:i silhouette:d",
    """with d as (select a.vec_id, a.label, b.label as other, sum(list_distance(a.v, b.v)) as total, count(*) as n
                  from (select * from vecs order by cast('0x' || substr(md5(vec_id || '|42'), 1, 8) as bigint), vec_id limit 300) a cross join vecs b group by all),
            s as (select vec_id, label, max(case when other = label then total / nullif(n - 1, 0) end) as inner_d, max(case when other = label then n end) as own,
                         min(case when other <> label then total / n end) as outer_d from d group by all)
       select vec_id, label, case when own = 1 or greatest(inner_d, outer_d) = 0 then 0 else (outer_d - inner_d) / greatest(inner_d, outer_d) end as silhouette from s""",
    "vecs",
)
def silhouette_euclidean(spark, folder):
    """A sample of rows, as the feature, each against all rows."""
    return C.silhouette_euclidean(vectors(spark, folder), "vec_id", "label", 300)


# --- partitions ----------------------------------------------------------------------------------------------------


@query("spectral_landmark", "vec_id:i cluster:i")
def spectral_landmark(spark, folder):
    labelled, _ = C.run_spectral(durable(vectors(spark, folder)), "vec_id", 4)
    return labelled.drop("embedding")


@query("spectral_pic", "row:i cluster:i")
def spectral_pic(spark, folder):
    similarity = C.rbf_similarity(vectors(spark, folder), "vec_id", LANDMARKS, base_gamma=10.0)
    return C.run_power_iteration(durable(similarity), 4)


@query("spectral_k_diagnostics", "k:i silhouette:d eigenvalue:d eigengap:d")
def spectral_k_diagnostics(spark, folder):
    return C.spectral_k_diagnostics(durable(vectors(spark, folder)), "vec_id", KS)


@query("spectral_graph", "row:i cluster:i")
def spectral_graph(spark, folder):
    """Eigenvectors of the complete epsilon graph, clustered."""
    rows = vectors(spark, folder)
    edges = C.epsilon_graph(rows, "vec_id", base_gamma=SPREAD)
    return C.run_spectral_graph(edges, rows.select(F.col("vec_id").alias("row")), 4)[0].drop("embedding")


@query("spectral_graph_diagnostics", "k:i silhouette:d eigenvalue:d eigengap:d")
def spectral_graph_diagnostics(spark, folder):
    rows = vectors(spark, folder)
    edges = C.epsilon_graph(rows, "vec_id", base_gamma=SPREAD)
    return C.spectral_graph_diagnostics(edges, rows.select(F.col("vec_id").alias("row")), KS)


@query("kmeans_k_sweep", "k:i silhouette:d inertia:d")
def kmeans_k_sweep(spark, folder):
    return C.kmeans_k_sweep(durable(vectors(spark, folder)), "vec_id", KS)


@query("kmeans_trajectories", "representation:s cluster:i n_sequences:i n_users:i dropout_point_rate:d share_sequences:d")
def kmeans_trajectories(spark, folder):
    """Trajectories of the long view, clustered by level, by form and by raw values."""
    weeks = durable(stage2(spark, folder).filter("is_dropout_point is not null").select("user_id", "relative_week", "is_dropout_point", *BEHAVIOUR_FEATURES))
    scaled, _ = sampling.impute_scale(weeks, BEHAVIOUR_FEATURES)
    df = Q.trajectory_sequences(scaled, BEHAVIOUR_FEATURES, 12)
    df = durable(df)
    n = len(BEHAVIOUR_FEATURES)
    shapes = {
        "pooled": C.pooled_vector(df, n),
        "shape": C.shape_vector(df, n),
        "raw": df.withColumn("vector", F.flatten("seq")),
    }
    out = None
    for name, view in shapes.items():
        labelled, _ = C.run_kmeans(durable(view.drop("seq")), 4)
        part = C.trajectory_overview(labelled, "cluster").withColumn("representation", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


def stage1_vectors(spark, folder):
    table = durable(stage1(spark, folder, include_demographics=False, return_from=4).df)
    scaled, _ = sampling.impute_scale(table, STAGE1_FEATURES)
    return scaled.withColumn("vector", F.array(*STAGE1_FEATURES))


@query("gmm_profiles", "cluster:i n_users:i continuation_rate:d dropout_rate:d share_users:d")
def gmm_profiles(spark, folder):
    return C.cluster_overview(C.run_gaussian_mixture(stage1_vectors(spark, folder), 3), "cluster")


@query("ward_profiles", "cluster:i n_users:i continuation_rate:d dropout_rate:d share_users:d")
def ward_profiles(spark, folder):
    """Bottom-up merging by Ward's cost, four clusters."""
    return C.cluster_overview(run_ward(stage1_vectors(spark, folder), 4), "cluster")


@query("hierarchical_profiles", "cluster:i n_users:i continuation_rate:d dropout_rate:d share_users:d")
def hierarchical_profiles(spark, folder):
    return C.cluster_overview(C.run_hierarchical(stage1_vectors(spark, folder), 4), "cluster")


# --- descriptive tables --------------------------------------------------------------------------------------------

OVERVIEW = "n_sequences:i n_users:i dropout_point_rate:d share_sequences:d"


def overview_sql(method: str) -> str:
    return f"""select {method} as cluster, count(user_id) as n_sequences, count(distinct user_id) as n_users, avg(is_dropout_point) as dropout_point_rate,
        count(*) / sum(count(*)) over ()::double as share_sequences from clusters group by {method}"""


@query("trajectory_overview", f"cluster:i {OVERVIEW}", overview_sql("spectral_eucl"), "clusters")
def trajectory_overview(spark, folder):
    table = C.trajectory_overview(star.clusters_view(spark, folder), "spectral_eucl")
    return table.withColumnRenamed("spectral_eucl", "cluster")


@query(
    "cluster_method_summary",
    f"method:s cluster:i {OVERVIEW}",
    " union all ".join(f"select '{m}' as method, * from ({overview_sql(m)})" for m in METHODS),
    "clusters",
)
def cluster_method_summary(spark, folder):
    return C.cluster_method_summary(star.clusters_view(spark, folder), METHODS)


def rand_sql(a: str, b: str) -> str:
    return f"""select '{a}' as method_a, '{b}' as method_b, (b - x * y / t) / ((x + y) / 2 - x * y / t) as adjusted_rand from
        (select (select sum(n * (n - 1) / 2.0::double) from (select count(*) as n from clusters group by {a}, {b})) as b,
                (select sum(n * (n - 1) / 2.0::double) from (select count(*) as n from clusters group by {a})) as x,
                (select sum(n * (n - 1) / 2.0::double) from (select count(*) as n from clusters group by {b})) as y,
                (select count(*) * (count(*) - 1) / 2.0::double from clusters) as t)"""


@query(
    "adjusted_rand",
    "method_a:s method_b:s adjusted_rand:d",
    " union all ".join(rand_sql(a, b) for a, b in (METHODS[:2], METHODS[::2], METHODS[1:])),
    "clusters",
)
def adjusted_rand(spark, folder):
    return C.adjusted_rand(star.clusters_view(spark, folder), METHODS)


cte("s1c", "select *, user_id % 4 as cluster from lx_stage1", "lx_stage1")


def clustered_stage1(spark, folder):
    table = stage1(spark, folder, categories=CATEGORIES).df
    return durable(table.select("user_id", "came_back", *STAGE1_FEATURES, (F.col("user_id") % 4).alias("cluster")))


@query(
    "cluster_overview",
    "cluster:i n_users:i continuation_rate:d dropout_rate:d share_users:d",
    """select cluster, count(user_id) as n_users, avg(came_back) as continuation_rate, 1 - avg(came_back) as dropout_rate,
       count(*) / sum(count(*)) over ()::double as share_users from s1c group by cluster""",
    "s1c",
)
def cluster_overview(spark, folder):
    return C.cluster_overview(clustered_stage1(spark, folder), "cluster")


@query(
    "cluster_feature_means",
    "cluster:i " + " ".join(f"{c}:f" for c in STAGE1_FEATURES),
    f"select cluster, {', '.join(f'avg({c}) as {c}' for c in STAGE1_FEATURES)} from s1c group by cluster",
    "s1c",
)
def cluster_feature_means(spark, folder):
    return C.cluster_feature_means(clustered_stage1(spark, folder), "cluster", STAGE1_FEATURES)


cte(
    "z",
    " union all ".join(
        f"""select cluster, '{c}' as feature, avg({c}) as cluster_mean, (select avg({c}) from s1c) as global_mean,
            (avg({c}) - (select avg({c}) from s1c)) / nullif((select stddev_samp({c}) from s1c), 0) as z_difference from s1c group by cluster"""
        for c in STAGE1_FEATURES
    ),
    "s1c",
)
Z = "cluster:i feature:s cluster_mean:f global_mean:f z_difference:d rank:i"


@query(
    "top_z_features",
    Z,
    """select * from (select *, row_number() over (partition by cluster order by abs(z_difference) desc, feature) as rank from z
       where z_difference is not null) where rank <= 8""",
    "z",
)
def top_z_features(spark, folder):
    return C.top_z_features(clustered_stage1(spark, folder), "cluster", STAGE1_FEATURES)


@query(
    "extreme_z_features",
    Z + " side:s",
    """select * from (select *, 'above' as side, row_number() over (partition by cluster order by z_difference desc, feature) as rank from z where z_difference is not null
       union all select *, 'below', row_number() over (partition by cluster order by z_difference, feature) from z where z_difference is not null) where rank <= 15""",
    "z",
)
def extreme_z_features(spark, folder):
    return C.extreme_z_features(clustered_stage1(spark, folder), "cluster", STAGE1_FEATURES)


def _dimension_sql(cols) -> str:
    parts = [
        f"({c} - (select avg({c}) from s1c)) / coalesce(nullif((select stddev_pop({c}) from s1c), 0), 1)" for c in cols
    ]
    return f"({' + '.join(parts)}) / {len(cols)}"


cte("dims", "select user_id, cluster, came_back, " + ", ".join(f"{_dimension_sql(cols)} as {g}" for g, cols in STAGE1_GROUPS.items()) + " from s1c", "s1c")
DIMS = " ".join(f"{g}:d" for g in STAGE1_GROUPS)


@query("dimension_scores", f"user_id:i {DIMS}", "select * from dims", "dims")
def dimension_scores(spark, folder):
    return C.dimension_scores(clustered_stage1(spark, folder), STAGE1_GROUPS)


@query(
    "dimension_summary",
    f"cluster:i n_users:i continuation_rate:d {DIMS}",
    f"select cluster, count(user_id) as n_users, avg(came_back) as continuation_rate, {', '.join(f'avg({g}) as {g}' for g in STAGE1_GROUPS)} from dims group by cluster",
    "dims",
)
def dimension_summary(spark, folder):
    scores = C.dimension_scores(clustered_stage1(spark, folder), STAGE1_GROUPS)
    return C.dimension_summary(scores, "cluster", list(STAGE1_GROUPS))
