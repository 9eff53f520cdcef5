"""Clustering of vectors and trajectories, its diagnostics, and descriptive tables of the clusters.

Nothing here builds an all-pairs matrix. Landmark similarities are taken to a chosen number of rows, which are broadcast;
the epsilon graph holds the edges between all rows, found by a join within a radius; silhouettes need only the sums of
each cluster and cover every row.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.ml.clustering import BisectingKMeans, GaussianMixture, PowerIterationClustering
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weekspan.functions.arrays import flatten_sequence, l2_normalize, mean_over_time
from weekspan.functions.hashing import hash32
from weekspan.operators.kmeans import assign, joint_kmeans, pack, silhouette_values, silhouettes, squared_distances
from weekspan.operators.neighbours import near_pairs, nearest_neighbours
from weekspan.operators.profile import unpivot
from weekspan.operators.sampling import SEED, fit_scaler, hash_sample
from weekspan.operators.spectral import graph_embedding
from weekspan.session import durable

EDGE_SIMILARITY = 0.5


# --- representations -----------------------------------------------------------------------------------------------


def pooled_vector(df: DataFrame, features: int, out: str = "vector") -> DataFrame:
    """Mean of every feature over the weeks."""
    return df.withColumn(out, mean_over_time("seq", features))


def shape_vector(df: DataFrame, features: int, out: str = "vector") -> DataFrame:
    """Weeks after dividing every feature by its norm over the sequence: form without level."""
    return df.withColumn(out, flatten_sequence(l2_normalize("seq", features)))


# --- landmark similarity -------------------------------------------------------------------------------------------


def landmarks(df: DataFrame, key: str, count: int, values: str = "vector", seed=SEED) -> tuple[np.ndarray, np.ndarray]:
    """``count`` rows drawn by hashed key: their keys and a matrix. ``count`` rows are sent to the driver and all tasks."""
    rows = hash_sample(df.select(key, values), key, count, seed).orderBy(hash32(key, seed), key).collect()
    return np.array([r[0] for r in rows]), np.array([r[1] for r in rows], dtype=float)


def _kernel(block: np.ndarray, points: np.ndarray, gamma: float) -> np.ndarray:
    squared = (block**2).sum(axis=1)[:, None] - 2 * block @ points.T + (points**2).sum(axis=1)[None, :]
    return np.exp(-gamma * np.maximum(squared, 0.0))


def rbf_similarity(
    df: DataFrame, key: str, count: int, values: str = "vector", base_gamma: float = 1.0, seed=SEED
) -> DataFrame:
    """exp(-gamma d^2) of every row to every landmark, gamma = base / width, as (row, landmark, similarity)."""
    keys, points = landmarks(df, key, count, values, seed)
    gamma = base_gamma / max(points.shape[1], 1)
    shared = df.sparkSession.sparkContext.broadcast((keys, points))

    def similar(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names, matrix = shared.value
        for batch in batches:
            for start in range(0, len(batch), 4096):
                part = batch.iloc[start : start + 4096]
                block = _kernel(np.stack(part[values].to_numpy()), matrix, gamma)
                yield pd.DataFrame(
                    {"row": np.repeat(part[key].to_numpy(), len(names)), "landmark": np.tile(names, len(part)), "similarity": block.ravel()}
                )

    return df.select(key, values).mapInPandas(similar, "row long, landmark long, similarity double")


def adjacency(similarity: DataFrame, connectivity: str = "full") -> DataFrame:
    """Weighted edges, or unit edges where the similarity exceeds one half."""
    if connectivity == "full":
        return similarity.withColumnRenamed("similarity", "weight")
    if connectivity == "epsilon":
        near = similarity.filter(F.col("similarity") > EDGE_SIMILARITY)
        return near.select("row", "landmark", F.lit(1.0).alias("weight"))
    raise ValueError(f"unknown connectivity: {connectivity}")


def epsilon_graph(df: DataFrame, key: str, values: str = "vector", base_gamma: float = 1.0) -> DataFrame:
    """(row, neighbour, weight 1) wherever the similarity exp(-gamma d^2), gamma = base / width, exceeds one half.

    All rows, both directions and every row with itself; the pairs come from an exact join within the radius at which the
    similarity is one half.
    """
    first = df.filter(F.col(values).isNotNull()).select(F.size(values)).first()
    gamma = base_gamma / max(first[0] if first else 1, 1)
    found = near_pairs(df, key, math.sqrt(math.log(1 / EDGE_SIMILARITY) / gamma), values)
    pairs = durable(found.filter(F.exp(-F.lit(gamma) * F.col("squared")) > EDGE_SIMILARITY).select("a", "b"))
    both = F.explode(F.array(F.struct(F.col("a").alias("row"), F.col("b").alias("neighbour")), F.struct(F.col("b").alias("row"), F.col("a").alias("neighbour"))))
    own = df.filter(F.col(values).isNotNull()).select(F.col(key).cast("long").alias("row")).withColumn("neighbour", F.col("row"))
    return pairs.select(both.alias("e")).select("e.*").unionByName(own).withColumn("weight", F.lit(1.0))


def spectral_embedding(
    df: DataFrame, key: str, components: int, count: int = 200, values: str = "vector", base_gamma: float = 1.0, seed=SEED
) -> tuple[DataFrame, np.ndarray]:
    """Leading spectral coordinates from a landmark kernel, and the eigenvalues of the normalised Laplacian.

    Rows of the kernel are normalised to sum one. The landmark-by-landmark Gram matrix is summed up in Spark, only
    that matrix is decomposed on the driver, and every row is projected onto the leading directions.
    """
    _, points = landmarks(df, key, count, values, seed)
    m = len(points)
    components = min(components, m)
    gamma = base_gamma / max(points.shape[1], 1)
    shared = df.sparkSession.sparkContext.broadcast(points)

    def weights(batch: pd.DataFrame) -> np.ndarray:
        kernel = _kernel(np.stack(batch[values].to_numpy()), shared.value, gamma)
        return kernel / np.maximum(kernel.sum(axis=1, keepdims=True), 1e-300)

    def partial_gram(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((m + 1, m))
        for batch in batches:
            if len(batch):
                z = weights(batch)
                total[:m] += z.T @ z
                total[m] += z.sum(axis=0)
        yield pd.DataFrame({"i": np.arange(m + 1), "part": list(total)})

    parts = df.select(key, values).mapInPandas(partial_gram, "i int, part array<double>")
    sums = parts.groupBy("i").agg(Summarizer.sum(array_to_vector("part")).alias("s")).collect()  # m + 1 rows of m values
    gram = np.zeros((m + 1, m))
    for r in sums:
        gram[r["i"]] = r["s"].toArray()
    scale = 1 / np.sqrt(np.maximum(gram[m], 1e-300))
    values_, vectors = np.linalg.eigh(scale[:, None] * gram[:m] * scale[None, :])
    order = np.argsort(values_)[::-1]
    lead = values_[order]
    basis = vectors[:, order[:components]]
    basis = basis * np.where(basis[np.abs(basis).argmax(axis=0), np.arange(components)] < 0, -1, 1)
    projection = df.sparkSession.sparkContext.broadcast(
        scale[:, None] * basis / np.sqrt(np.maximum(lead[:components], 1e-12))[None, :]
    )

    def project(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                yield pd.DataFrame({key: batch[key], "embedding": list(weights(batch) @ projection.value)})

    embedded = df.select(key, values).mapInPandas(project, f"{key} long, embedding array<double>")
    return embedded, 1 - np.clip(lead, 0.0, 1.0)


# --- partitions ----------------------------------------------------------------------------------------------------


def _as_vectors(df: DataFrame, values: str) -> DataFrame:
    return df.withColumn("_vector", array_to_vector(F.col(values).cast("array<double>")))


def run_kmeans(df: DataFrame, k: int, values: str = "vector", restarts: int = 10, seed: int = SEED, out: str = "cluster"):
    """Best of several seeded K-Means runs by cost; returns the labelled table and that cost."""
    best = joint_kmeans(df, [k], values, restarts, seed)[0]
    return assign(df, best.centres, values, out), best.cost


def run_gaussian_mixture(df: DataFrame, k: int, values: str = "vector", seed: int = SEED, out: str = "cluster", iterations: int = 100):
    data = _as_vectors(df, values)
    model = GaussianMixture(k=k, seed=seed, featuresCol="_vector", predictionCol=out, maxIter=iterations).fit(data)
    return model.transform(data).drop("_vector", "probability")


def run_hierarchical(df: DataFrame, k: int, values: str = "vector", seed: int = SEED, out: str = "cluster"):
    """Top-down hierarchical clustering by repeated bisection.

    A split starts from small offsets in proportion to the length of the centre, which is zero for standardised data;
    moving all points by the same vector leaves their distances alone and gives the first split a start.
    """
    moved = df.withColumn("_moved", F.transform(values, lambda v: v + F.lit(1.0)))
    data = _as_vectors(moved, "_moved").drop("_moved")
    return BisectingKMeans(k=k, seed=seed, featuresCol="_vector", predictionCol=out).fit(data).transform(data).drop("_vector")


def run_power_iteration(similarity: DataFrame, k: int, iterations: int = 20, seed: int = SEED) -> DataFrame:
    """Clusters of the graph between rows and landmarks; each undirected edge is used once."""
    edges = similarity.filter(F.col("row") != F.col("landmark")).select(
        F.least("row", "landmark").alias("src"), F.greatest("row", "landmark").alias("dst"), F.col("similarity").alias("weight")
    )
    edges = edges.groupBy("src", "dst").agg(F.max("weight").alias("weight"))
    model = PowerIterationClustering(k=k, maxIter=iterations, initMode="degree", weightCol="weight")
    return model.assignClusters(edges).withColumnRenamed("id", "row")


def run_spectral(df: DataFrame, key: str, k: int, restarts: int = 10, seed: int = SEED, out: str = "cluster", **options):
    """Landmark embedding in k coordinates followed by K-Means; returns labels and Laplacian eigenvalues."""
    embedded, eigenvalues = spectral_embedding(df, key, k, seed=seed, **options)
    labelled, _ = run_kmeans(durable(embedded), k, "embedding", restarts, seed, out)
    return labelled, eigenvalues


def run_spectral_graph(edges: DataFrame, nodes: DataFrame, k: int, restarts: int = 10, seed: int = SEED, out: str = "cluster"):
    """K-Means on the first k eigenvectors of a graph of any rows; returns (row, embedding, label) and k + 1 eigenvalues.

    ``edges`` has row, neighbour and weight in both directions, ``nodes`` every row.
    """
    embedded, eigenvalues = graph_embedding(edges, nodes, k + 1)
    labelled, _ = run_kmeans(durable(embedded.withColumn("embedding", F.slice("embedding", 1, k))), k, "embedding", restarts, seed, out)
    return labelled, eigenvalues


def spectral_graph_diagnostics(edges: DataFrame, nodes: DataFrame, ks: Sequence[int], restarts: int = 10, seed: int = SEED) -> DataFrame:
    """Silhouette on the embedding per k, with the Laplacian eigenvalue and gap at that position."""
    embedded, eigenvalues = graph_embedding(edges, nodes, max(ks) + 1)
    return _diagnose(embedded, eigenvalues, ks, restarts, seed)


def _diagnose(embedded: DataFrame, eigenvalues: np.ndarray, ks: Sequence[int], restarts: int, seed: int) -> DataFrame:
    """The first k coordinates clustered for every k; all runs share the scans of the embedding."""
    ks = [k for k in ks if k <= len(eigenvalues)]
    blocks = pack(embedded, "embedding")
    runs = joint_kmeans(embedded, ks, "embedding", restarts, seed, blocks=blocks, widths=ks)
    rows = []
    for r, score in zip(runs, silhouettes(blocks, runs), strict=True):
        gap = float(eigenvalues[r.k] - eigenvalues[r.k - 1]) if r.k < len(eigenvalues) else None
        rows.append((r.k, score, float(eigenvalues[r.k - 1]), gap))
    return embedded.sparkSession.createDataFrame(rows, "k int, silhouette double, eigenvalue double, eigengap double")


# --- diagnostics ---------------------------------------------------------------------------------------------------


def silhouette_rows(df: DataFrame, key: str, cluster: str, values: str = "vector") -> DataFrame:
    """Silhouette of every clustered row by squared Euclidean distance.

    The mean squared distance of a row x to a cluster of n rows with sum S and sum of squared norms Q is
    |x|^2 - 2 x.S / n + Q / n, so one aggregation per cluster and one pass over the rows are exact. A row alone in its
    cluster has 0, and so has every row where there is a single cluster.
    """
    rows = df.select(key, cluster, values).filter(F.col(cluster).isNotNull())
    summed = rows.select(cluster, array_to_vector(F.col(values).cast("array<double>")).alias("v"), F.aggregate(values, F.lit(0.0), lambda a, x: a + x * x).alias("q"))
    totals = summed.groupBy(cluster).agg(F.count(F.lit(1)).alias("n"), Summarizer.sum(F.col("v")).alias("s"), F.sum("q").alias("q"))
    found = sorted(totals.collect(), key=lambda r: str(r[0]))  # one row per cluster
    place = {r[0]: i for i, r in enumerate(found)}
    n = np.array([r["n"] for r in found], dtype=float)
    s = np.array([r["s"].toArray() for r in found]).reshape(len(found), -1)
    q = np.array([r["q"] for r in found], dtype=float)

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            block = np.stack(batch[values].to_numpy()).astype(float)
            own = batch[cluster].map(place).to_numpy()
            value = silhouette_values(block, own, n, s, q)
            yield pd.DataFrame({key: batch[key], cluster: batch[cluster], "silhouette": value})

    cluster_type = df.schema[cluster].dataType.simpleString()
    return rows.mapInPandas(score, f"{key} {df.schema[key].dataType.simpleString()}, {cluster} {cluster_type}, silhouette double")


def silhouette_euclidean(df: DataFrame, key: str, cluster: str, count: int = 5_000, values: str = "vector", seed=SEED) -> DataFrame:
    """Silhouette by Euclidean distance of ``count`` rows drawn by hashed key, each against all clustered rows.

    The drawn rows are broadcast; tasks return their sums of distances to each cluster. The whole column would need every
    distance between two rows; ``silhouette_rows`` covers all rows by squared distance.
    """
    rows = df.select(key, cluster, values).filter(F.col(cluster).isNotNull() & F.col(values).isNotNull())
    drawn = hash_sample(rows, key, count, seed).collect()  # at most ``count`` rows
    sizes = {r[0]: r[1] for r in rows.groupBy(cluster).count().collect()}  # one row per cluster
    names = sorted(sizes, key=str)
    place = {c: i for i, c in enumerate(names)}
    points = np.array([r[values] for r in drawn], float).reshape(len(drawn), -1)
    shared = df.sparkSession.sparkContext.broadcast(points)

    def distances(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((len(names), len(drawn)))
        for batch in batches:
            for start in range(0, len(batch), 1024):
                part = batch.iloc[start : start + 1024]
                block = np.stack(part[values].to_numpy()).astype(float)
                far = np.sqrt(squared_distances(block, shared.value))
                np.add.at(total, part[cluster].map(place).to_numpy(), far)
        yield pd.DataFrame({"i": np.arange(len(names)), "part": list(total)})

    sums = np.zeros((len(names), len(drawn)))
    if drawn:
        parts = rows.mapInPandas(distances, "i int, part array<double>").groupBy("i").agg(Summarizer.sum(array_to_vector("part")).alias("s"))
        for r in parts.collect():  # a row per cluster
            sums[r["i"]] = r["s"].toArray()
    n = np.array([sizes[c] for c in names], float)
    out = []
    for j, r in enumerate(drawn):
        own = place[r[cluster]]
        others = [sums[c, j] / n[c] for c in range(len(names)) if c != own]
        inner, outer = sums[own, j] / max(n[own] - 1, 1), min(others, default=0.0)
        top = max(inner, outer)
        out.append((r[key], r[cluster], 0.0 if n[own] <= 1 or not others or top == 0 else float((outer - inner) / top)))
    kind = lambda c: df.schema[c].dataType.simpleString()
    return df.sparkSession.createDataFrame(out, f"{key} {kind(key)}, {cluster} {kind(cluster)}, silhouette double")


def silhouette(df: DataFrame, key: str, cluster: str, **options) -> float:
    return silhouette_rows(df, key, cluster, **options).agg(F.avg("silhouette")).first()[0]


def kmeans_k_sweep(df: DataFrame, key: str, ks: Sequence[int], values: str = "vector", restarts: int = 10, seed: int = SEED) -> DataFrame:
    """Silhouette and cost per number of clusters, best first; all k and restarts share the scans of the table."""
    blocks = pack(df, values)
    runs = joint_kmeans(df, ks, values, restarts, seed, blocks=blocks)
    rows = [(r.k, score, r.cost) for r, score in zip(runs, silhouettes(blocks, runs), strict=True)]
    return df.sparkSession.createDataFrame(rows, "k int, silhouette double, inertia double").orderBy(F.desc("silhouette"))


def spectral_k_diagnostics(
    df: DataFrame, key: str, ks: Sequence[int], restarts: int = 10, seed: int = SEED, **options
) -> DataFrame:
    """Silhouette on the embedding per k, with the Laplacian eigenvalue and gap at that position."""
    embedded, eigenvalues = spectral_embedding(df, key, max(ks) + 1, seed=seed, **options)
    return _diagnose(durable(embedded), eigenvalues, ks, restarts, seed)


def adjusted_rand(df: DataFrame, methods: Sequence[str]) -> DataFrame:
    """Adjusted Rand index of every pair of partitions, from one aggregation of the rows."""
    base = df.groupBy(*methods).agg(F.count(F.lit(1)).alias("n"))
    pairs = [
        F.struct(
            F.lit(a).alias("method_a"), F.lit(b).alias("method_b"), F.col(a).cast("string").alias("x"),
            F.col(b).cast("string").alias("y"), F.col("n").alias("n"),
        )
        for i, a in enumerate(methods)
        for b in methods[i + 1 :]
    ]
    pair = ["method_a", "method_b"]
    cells = base.select(F.explode(F.array(*pairs)).alias("p")).select("p.*").groupBy(*pair, "x", "y").agg(F.sum("n").alias("n"))

    def couples(n: str) -> Column:
        c = F.col(n).cast("double")
        return F.sum(c * (c - 1) / 2)

    both = cells.groupBy(*pair).agg(couples("n").alias("both"), F.sum("n").alias("total"))
    left = cells.groupBy(*pair, "x").agg(F.sum("n").alias("n")).groupBy(*pair).agg(couples("n").alias("left"))
    right = cells.groupBy(*pair, "y").agg(F.sum("n").alias("n")).groupBy(*pair).agg(couples("n").alias("right"))
    total = F.col("total").cast("double") * (F.col("total") - 1) / 2
    chance = F.col("left") * F.col("right") / F.nullif(total, F.lit(0.0))
    spread = (F.col("left") + F.col("right")) / 2 - chance
    index = F.when(spread == 0, F.lit(1.0)).otherwise((F.col("both") - chance) / F.nullif(spread, F.lit(0.0)))
    joined = both.join(left, pair).join(right, pair)
    return joined.select(*pair, F.coalesce(index, F.lit(1.0)).alias("adjusted_rand")).orderBy(F.desc("adjusted_rand"))


# --- descriptive tables --------------------------------------------------------------------------------------------


def _share_of_all(n: str, by: Sequence[str] = ()) -> Column:
    scope = list(by) or [F.lit(0)]
    return F.col(n) / F.sum(n).over(Window.partitionBy(*scope))  # one row per cluster


def trajectory_overview(df: DataFrame, cluster: str, label: str = "is_dropout_point", user: str = "user_id") -> DataFrame:
    sizes = df.groupBy(cluster).agg(
        F.count(user).alias("n_sequences"), F.count_distinct(user).alias("n_users"), F.avg(label).alias("dropout_point_rate")
    )
    return sizes.withColumn("share_sequences", _share_of_all("n_sequences"))


def cluster_method_summary(df: DataFrame, methods: Sequence[str], label: str = "is_dropout_point") -> DataFrame:
    """Overviews of several partitions under each other."""
    out = None
    for m in methods:
        part = trajectory_overview(df, m, label).withColumnRenamed(m, "cluster").withColumn("method", F.lit(m))
        out = part if out is None else out.unionByName(part)
    return out


def cluster_overview(df: DataFrame, cluster: str, label: str = "came_back") -> DataFrame:
    sizes = df.groupBy(cluster).agg(F.count("user_id").alias("n_users"), F.avg(label).alias("continuation_rate"))
    return sizes.withColumn("dropout_rate", 1 - F.col("continuation_rate")).withColumn("share_users", _share_of_all("n_users"))


def cluster_feature_means(df: DataFrame, cluster: str, columns: Sequence[str]) -> DataFrame:
    return df.groupBy(cluster).agg(*[F.avg(c).alias(c) for c in columns])


def feature_z(df: DataFrame, cluster: str, columns: Sequence[str]) -> DataFrame:
    """Standardised difference of every cluster mean to the overall mean; constant features drop out."""
    named = df.filter(F.col(cluster).isNotNull())
    overall = df.agg(
        *[F.avg(c).alias(f"m|{c}") for c in columns], *[F.stddev_samp(c).alias(f"s|{c}") for c in columns]
    ).first()
    stats = [
        F.when(F.col("feature") == c, F.struct(F.lit(overall[f"m|{c}"]).alias("mean"), F.lit(overall[f"s|{c}"]).alias("std")))
        for c in columns
        if overall[f"s|{c}"]
    ]
    long = unpivot(cluster_feature_means(named, cluster, columns), [cluster], columns, "feature", "cluster_mean")
    if not stats:
        return long.withColumn("global_mean", F.lit(None).cast("double")).withColumn("z_difference", F.lit(None).cast("double")).limit(0)
    long = long.withColumn("_g", F.coalesce(*stats)).filter(F.col("_g").isNotNull() & F.col("cluster_mean").isNotNull())
    return long.select(
        cluster,
        "feature",
        "cluster_mean",
        F.col("_g.mean").alias("global_mean"),
        ((F.col("cluster_mean") - F.col("_g.mean")) / F.col("_g.std")).alias("z_difference"),
    )


def top_z_features(df: DataFrame, cluster: str, columns: Sequence[str], n: int = 8) -> DataFrame:
    """The ``n`` features with the largest absolute difference per cluster."""
    strongest = Window.partitionBy(cluster).orderBy(F.desc(F.abs("z_difference")), "feature")
    return feature_z(df, cluster, columns).withColumn("rank", F.row_number().over(strongest)).filter(F.col("rank") <= n)


def extreme_z_features(df: DataFrame, cluster: str, columns: Sequence[str], n: int = 15) -> DataFrame:
    """The ``n`` features furthest above and the ``n`` furthest below average per cluster."""
    scope = Window.partitionBy(cluster)
    ranked = feature_z(df, cluster, columns).withColumns(
        {
            "above": F.row_number().over(scope.orderBy(F.desc("z_difference"), "feature")),
            "below": F.row_number().over(scope.orderBy(F.asc("z_difference"), "feature")),
        }
    )
    sides = F.array(
        F.struct(F.lit("above").alias("side"), F.col("above").alias("rank")),
        F.struct(F.lit("below").alias("side"), F.col("below").alias("rank")),
    )
    return (
        ranked.withColumn("_s", F.explode(sides))
        .select(cluster, "feature", "cluster_mean", "global_mean", "z_difference", "_s.side", "_s.rank")
        .filter(F.col("rank") <= n)
    )


def dimension_scores(df: DataFrame, groups: dict[str, Sequence[str]]) -> DataFrame:
    """Mean of the median-imputed, standardised columns of each group."""
    columns = sorted({c for cols in groups.values() for c in cols})
    scaler = fit_scaler(df, columns, impute=True)

    def z(c: str) -> str:
        value = f"cast(`{c}` as double)"
        if c in scaler.fill:
            value = f"coalesce({value}, {scaler.fill[c]!r}D)"
        return f"({value} - {scaler.mean[c]!r}D) / {scaler.std[c]!r}D"

    return df.selectExpr("*", *[f"({' + '.join(z(c) for c in cols)}) / {len(cols)} as `{g}`" for g, cols in groups.items()])


def dimension_summary(scores: DataFrame, cluster: str, dimensions: Sequence[str], label: str = "came_back") -> DataFrame:
    return scores.groupBy(cluster).agg(
        F.count("user_id").alias("n_users"), F.avg(label).alias("continuation_rate"), *[F.avg(d).alias(d) for d in dimensions]
    )


def _group_means(week: str, columns: Sequence[str], groups: dict[str, Sequence[str]]) -> dict[str, str]:
    index = {c: i for i, c in enumerate(columns)}
    out = {}
    for name, members in groups.items():
        used = [f"{week}[{index[c]}]" for c in members if c in index]
        if used:
            out[name] = f"({' + '.join(used)}) / {len(used)}"
    return out


def curve_profiles(df: DataFrame, columns: Sequence[str], groups: dict[str, Sequence[str]], cluster: str) -> DataFrame:
    """Average of each feature group per cluster and week of the sequence."""
    weeks = df.select(cluster, F.posexplode("seq").alias("week", "values"))
    means = _group_means("values", columns, groups)
    return weeks.groupBy(cluster, "week").agg(F.count(F.lit(1)).alias("n"), *[F.expr(f"avg({e})").alias(g) for g, e in means.items()])


def shape_summary(
    df: DataFrame, columns: Sequence[str], groups: dict[str, Sequence[str]], cluster: str, label: str = "is_dropout_point"
) -> DataFrame:
    """Sizes, interruption rate, and mean, start, end and change of each dimension per cluster."""
    first, last = _group_means("seq[0]", columns, groups), _group_means("element_at(seq, -1)", columns, groups)
    weekly = _group_means("w", columns, groups)
    flat = df.selectExpr(
        "user_id",
        f"`{cluster}`",
        f"`{label}`",
        *[f"{e} as `{g}_start`" for g, e in first.items()],
        *[f"{e} as `{g}_end`" for g, e in last.items()],
        *[f"aggregate(seq, 0D, (a, w) -> a + {e}) / size(seq) as `{g}_mean`" for g, e in weekly.items()],
    )
    aggs = []
    for g in weekly:
        aggs += [F.expr(f"avg({g}_{s})").alias(f"{g}_{s}") for s in ("mean", "start", "end")]
        aggs.append(F.expr(f"avg({g}_end - {g}_start)").alias(f"{g}_change"))
    return flat.groupBy(cluster).agg(
        F.count("user_id").alias("n_sequences"),
        F.count_distinct("user_id").alias("n_users"),
        F.avg(label).alias("interruption_rate"),
        *aggs,
    )


def attach_groups(df: DataFrame, demographics: DataFrame, groups: Sequence[str], keep_unknown: bool = True) -> DataFrame:
    """Join group columns to trajectories; users without demographics are Unknown, or dropped."""
    joined = df.join(demographics.withColumn("_found", F.lit(1)), "user_id", "left")
    if not keep_unknown:
        return joined.filter(F.col("_found").isNotNull()).drop("_found")
    return joined.fillna("Unknown", subset=list(groups)).drop("_found")
