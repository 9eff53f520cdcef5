"""Distributed forms against brute force: ranks, running totals, quantiles, medians, AUC, silhouettes, neighbours."""

import math
import random

import duckdb
import numpy as np
import pytest
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.sql import functions as F

from weekspan.functions.ordered import grouped_median, hash_rank, previous_value
from weekspan.functions.quantiles import exact_medians, exact_quantiles
from weekspan.functions.skew import attach
from weekspan.operators import augment as A
from weekspan.operators import clusters as C
from weekspan.operators import evaluate as E
from weekspan.operators import fairness as G
from weekspan.operators import sampling as P
from weekspan.operators.models import best_round


@pytest.fixture(scope="module")
def skewed(spark):
    """One user owns a third of all rows."""
    rng = random.Random(1)
    data = []
    for i in range(3000):
        user = 0 if i % 3 == 0 else rng.randrange(1, 60)
        data.append((i, user, rng.randrange(0, 400), rng.choice([None, round(rng.random() * 50, 2)]), rng.random(), i % 7 == 0))
    return spark.createDataFrame(data, "id long, user long, t long, v double, p double, y boolean").persist()


def test_hash_rank_is_a_permutation_per_stratum(skewed):
    got = hash_rank(skewed, "id", 5, ["user"]).select("user", "rank", "rank_of").collect()
    per = {}
    for r in got:
        per.setdefault(r["user"], []).append(r["rank"])
    assert all(sorted(v) == list(range(len(v))) for v in per.values())
    assert all(r["rank_of"] == len(per[r["user"]]) for r in got)


def test_hash_rank_does_not_depend_on_partitioning(skewed):
    a = {r["id"]: r["rank"] for r in hash_rank(skewed.repartition(1), "id", 5).collect()}
    b = {r["id"]: r["rank"] for r in hash_rank(skewed.repartition(13), "id", 5, bits=4).collect()}
    assert a == b


def test_previous_value(skewed):
    bucket = F.floor(F.col("t") / 20)
    got = previous_value(skewed, ["user"], bucket, ["t", "id"], "id", "prev")
    rows = sorted(got.collect(), key=lambda r: (r["user"], r["t"], r["id"]))
    last = {}
    for r in rows:
        assert r["prev"] == last.get(r["user"])
        last[r["user"]] = r["id"]


def test_grouped_median(skewed):
    got = {r["user"]: r["m"] for r in grouped_median(skewed, ["user"], "v", 1.0, "m").collect()}
    want = {r["user"]: r["m"] for r in skewed.groupBy("user").agg(F.median("v").alias("m")).filter("m is not null").collect()}
    assert got.keys() == want.keys() and all(math.isclose(got[u], want[u]) for u in want)


@pytest.mark.parametrize("limit, accuracy", [(200_000, 10_000), (50, 20), (5, 100)])
def test_exact_quantiles(skewed, limit, accuracy):
    probs = [0.0, 0.1, 1 / 3, 0.5, 0.9, 1.0]
    got = exact_quantiles(skewed, ["v", "p", "t"], probs, accuracy=accuracy, limit=limit)
    pdf = skewed.toPandas()
    for c in ("v", "p", "t"):
        assert np.allclose(got[c], np.quantile(pdf[c].dropna().astype(float), probs))


def test_median_of_empty_column(spark):
    df = spark.createDataFrame([(None, 1.0), (None, 1.0)], "a double, b double")
    assert exact_medians(df, ["a", "b"]) == {"a": None, "b": 1.0}


def test_attach_slices_hot_keys(skewed, spark):
    lookup = spark.createDataFrame([(u, u * 10) for u in range(0, 50)], "user long, w long")
    got = attach(skewed, lookup, "user", ["id"], rows_per_task=100)
    assert got.count() == skewed.count()
    assert got.filter("w is null and user < 50 or w <> user * 10").count() == 0


def test_auc_equals_builtin_and_pairs(skewed):
    df = skewed.select(F.col("y").cast("int").alias("y_true"), F.round("p", 2).alias("y_prob"))
    ours = E.roc_auc(df, scores_a_bucket=7).first()["roc_auc"]
    builtin = BinaryClassificationEvaluator(rawPredictionCol="y_prob", labelCol="label", numBins=0)
    assert math.isclose(ours, builtin.evaluate(df.withColumn("label", F.col("y_true").cast("double"))), abs_tol=1e-9)
    assert E.roc_auc(df.filter("y_true = 1")).first()["roc_auc"] is None


def test_threshold_conventions(spark):
    df = spark.createDataFrame([(1, 0.5), (0, 0.5), (1, 0.9)], "y_true int, y_prob double")
    strict = E.threshold_sweep(df, thresholds=[0.5], strict=True).first()
    loose = E.threshold_sweep(df, thresholds=[0.5], strict=False).first()
    assert (strict["tp"], strict["fp"]) == (1, 0) and (loose["tp"], loose["fp"]) == (2, 1)
    tied = E.best_threshold(df, thresholds=[0.1, 0.2, 0.6]).first()
    assert tied["threshold"] == 0.1  # the first of equal scores
    none = E.threshold_sweep(df.filter("y_true = 0"), thresholds=[0.95]).first()
    assert none["f1"] == none["precision"] == none["recall"] == 0.0


def test_published_confusion_numbers(spark):
    # A published disparity row and test statistics
    assert math.isclose(0.48214285714285715 / 0.4806451612903226, 1.0031160115052733)
    tests = spark.createDataFrame([(480.12067346261637, 48), (37.87750913833098, 12)], "x double, dof long")
    found = [r["p"] for r in tests.select("dof", G.chi_square_survival(F.col("x"), F.col("dof")).alias("p")).orderBy(F.desc("dof")).collect()]
    assert math.isclose(found[0], 1.3228955783361303e-72, rel_tol=1e-6)
    assert math.isclose(found[1], 0.00016080335285455772, rel_tol=1e-6)
    assert math.isclose(math.sqrt(480.12067346261637 / (7498 * 3)), 0.1460971883208386, rel_tol=1e-9)


def test_chi_square_degenerate_tables(spark):
    df = spark.createDataFrame([("a", "x", "k")] * 5 + [("b", "x", "l")] * 4 + [("b", "x", "k")] * 3, "m string, one string, two string")
    got = {r["attribute"]: r for r in G.chi_square_test(df, ["m"], ["one", "two"]).collect()}
    assert got["one"]["dof"] == 0 and got["one"]["cramers_v"] is None and got["one"]["p_value"] == 1.0
    assert got["two"]["dof"] == 1 and math.isclose(got["two"]["chi2"], 12 * (abs(5 * 4 - 0) - 6) ** 2 / (5 * 7 * 8 * 4))


def test_group_confusion_without_positives(spark):
    df = spark.createDataFrame([("a", 0, 0), ("a", 0, 1), ("b", 1, 1), (None, 1, 1)], "g string, y_true int, y_pred int")
    got = {r["group"]: r for r in G.group_confusion(df, "g").collect()}
    assert set(got) == {"a", "b"} and got["a"]["TPR"] is None and got["a"]["FPR"] == 0.5
    assert G.parity_gaps(G.group_confusion(df, "g")).first()["TPR_gap"] is None
    assert G.parity_gaps(G.group_confusion(df, "g"), min_groups=1).first()["TPR_gap"] == 0.0


def test_adjusted_rand_ignores_names(spark):
    df = spark.range(100).selectExpr("id % 4 as a", "(id % 4 + 1) % 4 * 10 as b", "0 as c")
    got = {(r["method_a"], r["method_b"]): r["adjusted_rand"] for r in C.adjusted_rand(df, ["a", "b", "c"]).collect()}
    assert got["a", "b"] == 1.0 and abs(got["a", "c"]) < 1e-12


def test_splits_are_disjoint_and_sized(spark):
    users = spark.range(101).withColumnRenamed("id", "user_id")
    parts = {r["part"]: r["count"] for r in P.split_users(users).groupBy("part").count().collect()}
    assert parts == {"test": math.ceil(101 * 0.15), "validation": math.ceil(85 * 0.2), "train": 101 - 16 - 17}


def test_scaler_treats_constant_columns(spark):
    df = spark.createDataFrame([(1.0, 0.1, None), (3.0, 0.1, 5.0)], "a double, b double, c double")
    scaler = P.fit_scaler(df, ["a", "b", "c"], impute=True)
    assert scaler.std["b"] == 1.0 and scaler.fill["c"] == 5.0
    assert [tuple(r) for r in scaler.apply(df).collect()] == [(-1.0, 0.0, 0.0), (1.0, 0.0, 0.0)]


@pytest.mark.parametrize("counts, size", [({0: 70, 1: 30}, 11), ({0: 999, 1: 1}, 10), ({0: 5, 1: 5}, 100)])
def test_quotas(counts, size):
    for quota in (P.floor_quota(counts, size), P.largest_remainder(counts, size)):
        assert sum(quota.values()) == min(size, sum(counts.values()))
    assert P.floor_quota({0: 999, 1: 1}, 10) == {0: 9, 1: 1}


@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.default_rng(3)
    data = [(i, 0 if i < 40 else 1, [float(x) for x in rng.normal(6 * (i >= 40), 1, 3)]) for i in range(55)]
    return spark.createDataFrame(data, "id long, label int, x array<double>").persist()


def test_nearest_rows_and_smote(points):
    minority = A._ranked(points.filter("label = 1"), ["id"], 1)
    got = {}
    for r in A.nearest_neighbours(minority, "rank", 4, "x").orderBy("key", "rank").collect():
        got.setdefault(r["key"], []).append(r["neighbour"])
    local = {r["rank"]: np.array(r["x"]) for r in minority.collect()}
    for rank, x in local.items():
        others = sorted((np.linalg.norm(x - y), r) for r, y in local.items() if r != rank)
        assert got[rank] == [r for _, r in others[:4]]
    made = A.smote(points, ["id"], "label", k=4)
    sizes = {r["label"]: r["count"] for r in made.groupBy("label").count().collect()}
    assert sizes == {0: 40, 1: 40}
    low, high = np.min(list(local.values()), axis=0), np.max(list(local.values()), axis=0)
    for r in made.filter("draw is not null").collect():
        assert np.all(np.array(r["x"]) >= low - 1e-9) and np.all(np.array(r["x"]) <= high + 1e-9)


def test_smote_falls_back_to_copies(points):
    lone = points.filter("label = 0 or id = 40")
    made = A.smote(lone, ["id"], "label")
    assert {r["label"]: r["count"] for r in made.groupBy("label").count().collect()} == {0: 40, 1: 40}


def test_noise_and_mixup_keep_originals(points):
    for made in (A.continuous_noise(points, ["id"], width=3, min_distinct=10), A.mixup(points, ["id"], "label"), A.masking(points, ["id"], width=3)):
        originals = {r["id"]: list(r["x"]) for r in made.filter("draw is null").collect()}
        assert originals == {r["id"]: list(r["x"]) for r in points.collect()}
        assert made.filter("draw is not null").count() == 27


def test_gaussian_draws(spark):
    from weekspan.functions.hashing import gaussian, uniform

    row = spark.range(20000).select(gaussian(["id"], "g").alias("g"), uniform("id", "u").alias("u")).agg(
        F.avg("g"), F.stddev("g"), F.avg("u"), F.min("u"), F.max("u")
    ).first()
    assert abs(row[0]) < 0.03 and abs(row[1] - 1) < 0.03 and abs(row[2] - 0.5) < 0.01 and 0 <= row[3] and row[4] < 1


def test_policies_always_change_something(spark):
    seq = [[float(t * 3 + f + 1) for f in range(3)] for t in range(12)]
    df = spark.createDataFrame([(i, seq) for i in range(300)], "k long, seq array<array<double>>")
    for policy in (A.policy_mask_crop, A.policy_conservative):
        changed = policy(df.withColumn("old", F.col("seq")), ["k"], 12, 3)
        audit = A.augmentation_audit(changed, "old", "seq").first()
        assert audit["changed_ratio"] > 0.97  # a swap of a week with itself changes nothing
        assert changed.filter("size(seq) <> 12 or exists(seq, w -> size(w) <> 3)").count() == 0


def test_silhouette_against_brute_force(points):
    got = {r["id"]: r["silhouette"] for r in C.silhouette_rows(points, "id", "label", values="x").collect()}
    local = [(r["id"], r["label"], np.array(r["x"])) for r in points.collect()]
    for i, lab, x in local:
        same = [np.linalg.norm(x - y) ** 2 for j, l2, y in local if l2 == lab and j != i]
        rest = [np.linalg.norm(x - y) ** 2 for _, l2, y in local if l2 != lab]
        a, b = np.mean(same), np.mean(rest)
        assert math.isclose(got[i], (b - a) / max(a, b), abs_tol=1e-9)


def test_spectral_separates_two_groups(points):
    labelled, eigenvalues = C.run_spectral(points, "id", 2, restarts=2, count=30, values="x")
    got = {r["id"]: r["cluster"] for r in labelled.collect()}
    table = points.sparkSession.createDataFrame([(got[i], int(i >= 40)) for i in got], "a int, b int")
    assert C.adjusted_rand(table, ["a", "b"]).first()["adjusted_rand"] >= 0.9
    assert abs(eigenvalues[0]) < 1e-9 and np.all(np.diff(eigenvalues) >= -1e-12)


def test_hierarchical_splits_centred_data(points):
    centred = points.withColumn("x", F.transform("x", lambda v: v - 15 * 6 / 55))
    assert C.run_hierarchical(centred, 3, "x").select("cluster").distinct().count() == 3


def test_best_round():
    assert best_round([-5, -4, -3, -3.5, -3.6, -2], patience=2) == 3
    assert best_round([-5, -4, -3, -3.5, -3.6, -2], patience=50) == 6
    assert best_round([0.5, 0.7, 0.7], patience=1) == 2


def test_boosted_trees_are_cut_at_the_best_area(spark):
    """The cut ensemble equals a shorter fit, and the best round is neither the first nor the last."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.linalg import Vectors

    from weekspan.operators import models as M

    rng = np.random.default_rng(4)
    x = rng.normal(size=(400, 4))
    y = (x[:, 0] + 0.7 * x[:, 1] * x[:, 2] + rng.normal(size=400) > 0).astype(int)
    rows = [(int(c), Vectors.dense(v)) for c, v in zip(y, x)]
    train, validation = (spark.createDataFrame(part, ["label", "features"]).repartition(2).persist() for part in (rows[:250], rows[250:]))
    full = GBTClassifier(maxIter=6, maxDepth=3, stepSize=0.3, seed=1).fit(train)
    short = GBTClassifier(maxIter=4, maxDepth=3, stepSize=0.3, seed=1).fit(train)
    cut = M.first_trees(full, 4)
    probabilities = lambda m: [r["y_prob"] for r in M.score(m, validation).collect()]
    assert np.allclose(probabilities(cut), probabilities(short)) and not np.allclose(probabilities(cut), probabilities(full))
    rounds = 25
    model = M.fit_gbt(train, validation, rounds, depth=4, step=0.5, patience=rounds)
    whole = M.fit_gbt(train, train, rounds, depth=4, step=0.5, patience=rounds)
    areas = [E.roc_auc(M.score(M.first_trees(whole, n), validation)).first()["roc_auc"] for n in range(1, len(whole.treeWeights) + 1)]
    kept = len(model.treeWeights)
    assert areas[kept - 1] == max(areas[: len(whole.treeWeights)]) and 1 < kept < rounds


def test_duckdb_draws_equal_ours(spark):
    from weekspan.functions.hashing import uniform

    ours = [r[0] for r in spark.range(50).select(uniform("id", "s")).collect()]
    sql = "select cast('0x' || substr(md5(i || '|s'), 1, 8) as bigint) / 4294967296.0::double from range(50) t(i)"
    assert ours == [r[0] for r in duckdb.connect().execute(sql).fetchall()]


def test_thresholds_in_any_order(spark):
    df = spark.createDataFrame([(1, 0.5), (0, 0.4), (1, 0.95), (0, 0.1)], "y_true int, y_prob double")
    ordered = {r["threshold"]: (r["tp"], r["fp"]) for r in E.threshold_sweep(df, thresholds=[0.1, 0.45, 0.9]).collect()}
    mixed = E.threshold_sweep(df, thresholds=[0.9, 0.1, 0.45]).orderBy("position").collect()
    assert [r["threshold"] for r in mixed] == [0.9, 0.1, 0.45]
    assert {r["threshold"]: (r["tp"], r["fp"]) for r in mixed} == ordered == {0.1: (2, 1), 0.45: (2, 0), 0.9: (1, 0)}


def test_false_in_any_case(spark):
    from weekspan.functions.scalars import truthy

    df = spark.createDataFrame([("FALSE",), ("False",), ("false",), ("",), (None,), ("TRUE",), ("yes",)], "v string")
    assert [r[0] for r in df.select(truthy("v")).collect()] == [False] * 5 + [True] * 2


def test_quota_levels():
    """One by one to the smallest, or from the largest, equals the closed form."""
    for counts, size in (({0: 1, 1: 1, 2: 1, 3: 997}, 3), ({0: 5, 1: 9, 2: 300}, 100), ({0: 2, 1: 2, 2: 2}, 5), ({c: c + 1 for c in range(30)}, 40)):
        want = {c: max(1, n * size // sum(counts.values())) for c, n in counts.items()}
        while sum(want.values()) > size:
            want[max(sorted(want), key=want.get)] -= 1
        while sum(want.values()) < size:
            want[min(sorted(want), key=want.get)] += 1
        assert P.floor_quota(counts, size) == want


def test_silhouette_covers_every_row(spark):
    """More rows than the former cap, against all pairs."""
    import numpy as np

    from weekspan.operators import clusters as C

    rng = np.random.default_rng(0)
    points = np.concatenate([rng.normal(size=(300, 3)), rng.normal(size=(150, 3)) + 2, [[9.0, 9.0, 9.0]]])
    labels = [0] * 300 + [1] * 150 + [2]
    df = spark.createDataFrame([(i, c, p.tolist()) for i, (c, p) in enumerate(zip(labels, points))], "id long, cluster int, vector array<double>")
    got = {r["id"]: r["silhouette"] for r in C.silhouette_rows(df, "id", "cluster").collect()}
    squared = ((points[:, None, :] - points[None, :, :]) ** 2).sum(2)
    member = np.array(labels)
    for i in range(0, len(points), 37):
        inner = squared[i, member == member[i]].sum() / max((member == member[i]).sum() - 1, 1)
        outer = min(squared[i, member == c].mean() for c in set(labels) if c != member[i])
        assert math.isclose(got[i], (outer - inner) / max(outer, inner), abs_tol=1e-9)
    assert got[450] == 0.0
    many = spark.range(6_001).selectExpr("id", "cast(id % 3 as int) as cluster", "array(cast(id % 7 as double), cast(id % 3 as double)) as vector")
    assert C.silhouette_rows(many, "id", "cluster").count() == 6_001


def test_cluster_queries_run_the_full_settings(monkeypatch):
    from weekspan.catalog import clusters

    calls = []
    monkeypatch.setattr(clusters, "vectors", lambda *a: "vectors")
    monkeypatch.setattr(clusters, "durable", lambda df: df)
    for name in ("kmeans_k_sweep", "spectral_k_diagnostics"):
        monkeypatch.setattr(clusters.C, name, lambda *a, **options: calls.append((a, options)))
        getattr(clusters, name)(None, "")
    assert calls == [(("vectors", "vec_id", range(2, 9)), {})] * 2
