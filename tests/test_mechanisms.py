"""Joint K-Means, exact neighbours, graph eigenvectors, Ward merging, staged boosting, cuts in hashed order."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from weekspan.functions import ordered
from weekspan.functions.hashing import hash32
from weekspan.operators import augment as A
from weekspan.operators import clusters as C
from weekspan.operators import evaluate as E
from weekspan.operators import kmeans, models, neighbours, spectral, ward


def table(spark, points, parts=4):
    rows = [(i, [float(x) for x in p]) for i, p in enumerate(points)]
    return spark.createDataFrame(rows, "id long, vector array<double>").repartition(parts)


# K-Means


def test_joint_runs_equal_separate_runs(spark):
    draw = np.random.default_rng(0)
    points = np.concatenate([draw.normal(size=(60, 3)) + c for c in ([0, 0, 0], [9, 0, 0], [0, 9, 0], [5, 5, 9])])
    df = table(spark, points)
    joint = kmeans.joint_kmeans(df, [2, 3, 4, 5], restarts=3)
    alone = [kmeans.joint_kmeans(df, [k], restarts=1, seed=42 + r)[0] for k in (2, 4) for r in range(3)]
    for run in joint:
        same = [a for a in alone if a.k == run.k]
        if same:
            assert math.isclose(run.cost, min(a.cost for a in same), rel_tol=1e-9)
        label = ((points[:, None] - run.centres[None]) ** 2).sum(2)
        assert math.isclose(run.cost, label.min(1).sum(), rel_tol=1e-9)
    assert joint[2].cost < joint[1].cost < joint[0].cost
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    data = df.withColumn("f", array_to_vector("vector"))
    other = min(KMeans(k=4, seed=s, featuresCol="f").fit(data).summary.trainingCost for s in range(5))
    assert joint[2].cost <= other * 1.001


def test_sweep_scans_and_scores(spark, monkeypatch):
    draw = np.random.default_rng(1)
    points = np.concatenate([draw.normal(size=(50, 2)) + c for c in ([0, 0], [8, 0], [0, 8])])
    df = table(spark, points)
    scans = []
    monkeypatch.setattr(kmeans, "_sums", lambda *a, f=kmeans._sums: (scans.append(len(a[1])), f(*a))[1])
    rows = C.kmeans_k_sweep(df, "id", range(2, 9)).collect()
    assert rows[0]["k"] == 3 and len(rows) == 7 and len(scans) <= 37 and scans[0] == 70
    labelled, cost = C.run_kmeans(df, 3)
    by_hand = C.silhouette(labelled, "id", "cluster")
    assert math.isclose(rows[0]["silhouette"], by_hand, rel_tol=1e-9) and math.isclose(rows[0]["inertia"], cost, rel_tol=1e-9)


def test_stored_blocks_are_small_whatever_the_width(spark):
    rng = np.random.default_rng(5)
    for rows, width in ((700, 3), (300, 204), (40, 700)):
        x = rng.normal(size=(rows, width))
        blocks = kmeans.pack(table(spark, x.tolist()))
        sizes = [len(r.body) for r in blocks.collect()]
        assert sum(sizes) == x.nbytes and max(sizes) <= max(2_048, 8 * width)
        found = [m for b in blocks.toArrow().to_batches() for m in kmeans.matrices(b)]
        assert max(len(m) for m in found) <= kmeans.ROWS_A_BLOCK
        assert np.array_equal(np.sort(np.concatenate(found), axis=0), np.sort(x, axis=0))


def test_kmeans_of_odd_tables(spark):
    same = table(spark, [[1.0, 2.0]] * 50 + [[3.0, 4.0]])
    labelled, cost = C.run_kmeans(same, 4)
    assert cost == 0 and labelled.select("cluster").distinct().count() == 2
    gap = spark.createDataFrame([(1, [0.0]), (2, None), (3, [5.0])], "id long, vector array<double>")
    rows = {r["id"]: r["cluster"] for r in C.run_kmeans(gap, 2)[0].collect()}
    assert rows[2] is None and rows[1] != rows[3]
    empty = spark.createDataFrame([], "id long, vector array<double>")
    assert C.run_kmeans(empty, 3)[0].collect() == []
    widths = kmeans.joint_kmeans(table(spark, [[0.0, 9.0], [0.1, -9.0], [5.0, 3.0]]), [2], widths=[1], restarts=2)[0]
    assert widths.centres.shape == (2, 1) and math.isclose(widths.cost, 0.005, rel_tol=1e-6)


def test_euclidean_silhouette(spark):
    draw = np.random.default_rng(2)
    points = np.concatenate([draw.normal(size=(40, 3)), draw.normal(size=(30, 3)) + 2, [[50.0, 0, 0]]])
    member = np.array([0] * 40 + [1] * 30 + [2])
    df = table(spark, points).withColumn("cluster", F.when(F.col("id") < 40, 0).when(F.col("id") < 70, 1).otherwise(2))
    got = {r["id"]: r["silhouette"] for r in C.silhouette_euclidean(df, "id", "cluster", 1000).collect()}
    far = np.sqrt(((points[:, None] - points[None]) ** 2).sum(2))
    for i in range(70):
        inner = far[i, member == member[i]].sum() / ((member == member[i]).sum() - 1)
        outer = min(far[i, member == c].mean() for c in range(3) if c != member[i])
        assert math.isclose(got[i], (outer - inner) / max(outer, inner), abs_tol=1e-9)
    assert got[70] == 0 and C.silhouette_euclidean(df, "id", "cluster", 7).count() == 7


# neighbours


@pytest.fixture
def small_cells(monkeypatch):
    monkeypatch.setattr(neighbours, "CELL_ROWS", 20)
    monkeypatch.setattr(neighbours, "BLOCK", 8)
    monkeypatch.setattr(neighbours, "BLOCKS_A_TASK", 2)


def clumps(seed=3):
    draw = np.random.default_rng(seed)
    parts = [draw.normal(size=(60, 3)) * s + c for s, c in ((0.1, 0), (1, 3), (3, -4))]
    return np.concatenate([*parts, np.repeat([[1.0, 1, 1]], 50, 0)])  # the last rows are one point


def test_all_pairs_within_a_radius(spark, small_cells):
    points = clumps()
    far = ((points[:, None] - points[None]) ** 2).sum(2)
    for radius in (0.0, 0.3, 2.0, 100.0):
        got = sorted((r["a"], r["b"]) for r in neighbours.near_pairs(table(spark, points), "id", radius).collect())
        i, j = np.nonzero(np.triu(far <= radius * radius, 1))
        assert got == sorted(zip(i.tolist(), j.tolist()))


def test_nearest_rows(spark, small_cells):
    points = clumps(5)
    far = ((points[:, None] - points[None]) ** 2).sum(2)
    for k in (1, 5, 400):
        got = {}
        for r in neighbours.nearest_neighbours(table(spark, points), "id", k).collect():
            got.setdefault(r["key"], []).append((r["rank"], r["neighbour"], r["squared"]))
        for i in range(len(points)):
            want = sorted((far[i, j], j) for j in range(len(points)) if j != i)[:k]
            found = sorted(got[i])
            assert [x[1] for x in found] == [j for _, j in want] and np.allclose([x[2] for x in found], [d for d, _ in want])


def test_neighbours_of_odd_tables(spark):
    empty = spark.createDataFrame([], "id long, vector array<double>")
    assert neighbours.near_pairs(empty, "id", 1.0).collect() == [] and neighbours.nearest_neighbours(empty, "id", 3).collect() == []
    rows = spark.createDataFrame([(1, [0.0]), (2, None)], "id long, vector array<double>")
    assert neighbours.near_pairs(rows, "id", 1.0).collect() == [] and neighbours.nearest_neighbours(rows, "id", 3).collect() == []


def test_epsilon_graph_holds_every_edge(spark):
    points = clumps(7)
    edges = {(r["row"], r["neighbour"]) for r in C.epsilon_graph(table(spark, points), "id", base_gamma=2.0).collect()}
    similarity = np.exp(-2 / 3 * ((points[:, None] - points[None]) ** 2).sum(2))
    assert edges == set(zip(*(x.tolist() for x in np.nonzero(similarity > 0.5))))


def test_synthetic_rows_lie_between_neighbours(spark):
    draw = np.random.default_rng(4)
    rows = [(i, float(i < 12), draw.normal(size=2).tolist()) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, label double, x array<double>")
    made = A.smote(df, ["id"], "label", k=3).filter("draw is not null").collect()
    minority = {i: np.array(x) for i, y, x in rows if y == 1}
    assert len(made) == 36 and {r["label"] for r in made} == {1.0}
    for r in made:
        base, x = minority[r["id"]], np.array(r["x"])
        near = sorted((np.linalg.norm(base - p), i) for i, p in minority.items() if i != r["id"])[:3]
        ends = [minority[i] for _, i in near]
        assert any(np.isclose(np.linalg.norm(x - base) + np.linalg.norm(x - e), np.linalg.norm(base - e)) for e in ends)


# graph eigenvectors


def graph(spark, weights):
    i, j = np.nonzero(weights)
    edges = spark.createDataFrame([(int(a), int(b), float(weights[a, b])) for a, b in zip(i, j)], "row long, neighbour long, weight double")
    return edges, spark.range(len(weights)).withColumnRenamed("id", "row")


def laplacian_values(weights):
    plain = weights * (1 - np.eye(len(weights)))
    degree = plain.sum(1)
    root = np.where(degree > 0, np.sqrt(np.maximum(degree, 1e-300)), 1)
    return np.linalg.eigvalsh(np.diag((degree > 0).astype(float)) - plain / root[:, None] / root[None, :])


def test_eigenvalues_of_500_rows(spark):
    draw = np.random.default_rng(6)
    points = np.concatenate([draw.normal(size=(n, 4)) * 0.6 + c for n, c in ((200, 0), (180, 1.2), (119, -1.5))] + [np.full((1, 4), 40.0)])
    similarity = np.exp(-((points[:, None] - points[None]) ** 2).sum(2) / 4)
    weights = np.where(similarity > 0.5, 1.0, 0.0)
    edges, nodes = graph(spark, weights)
    _, values = spectral.graph_embedding(edges, nodes, 5)
    assert np.allclose(values, laplacian_values(weights)[:5], atol=1e-6)


def test_separated_groups_get_their_labels(spark):
    draw = np.random.default_rng(8)
    group = np.repeat([0, 1, 2], [30, 25, 20])
    weights = (group[:, None] == group[None, :]) * np.triu(draw.random((75, 75)) < 0.5, 1)
    weights = (weights | weights.T).astype(float)
    edges, nodes = graph(spark, weights)
    labelled, values = C.run_spectral_graph(edges, nodes, 3)
    got = {r["row"]: r["cluster"] for r in labelled.collect()}
    assert len({(got[i], g) for i, g in enumerate(group.tolist())}) == 3 and np.allclose(values[:3], 0, atol=1e-9)
    rows = C.spectral_graph_diagnostics(edges, nodes, [2, 3, 4]).collect()
    assert max(rows, key=lambda r: r["silhouette"])["k"] == 3


def test_graphs_without_edges(spark):
    none = spark.createDataFrame([], "row long, neighbour long, weight double")
    _, values = spectral.graph_embedding(none, spark.range(3).withColumnRenamed("id", "row"), 2)
    assert np.allclose(values, 0)
    embedded, values = spectral.graph_embedding(none, spark.range(0).withColumnRenamed("id", "row"), 2)
    assert embedded.collect() == [] and len(values) == 0


# Ward


def plain_ward(points, k):
    members = {i: [i] for i in range(len(points))}
    while len(members) > k:
        def cost(a, b):
            x, y = points[members[a]], points[members[b]]
            return len(x) * len(y) / (len(x) + len(y)) * ((x.mean(0) - y.mean(0)) ** 2).sum()

        a, b = min(itertools.combinations(sorted(members), 2), key=lambda p: cost(*p))
        members[a] += members.pop(b)
    return {frozenset(m) for m in members.values()}


def test_ward_equals_plain_merging(spark):
    draw = np.random.default_rng(9)
    points = np.concatenate([draw.normal(size=(25, 2)), draw.normal(size=(15, 2)) + 3, [[0.5, 0.5]] * 4])
    for k in (1, 3, 7):
        got = {}
        for r in ward.run_ward(table(spark, points), k).collect():
            got.setdefault(r["cluster"], set()).add(r["id"])
        assert {frozenset(m) for m in got.values()} == plain_ward(points, k)


def test_ward_over_summaries(spark):
    draw = np.random.default_rng(10)
    points = np.concatenate([draw.normal(size=(400, 2)) * 0.5 + c for c in ([0, 0], [9, 0], [0, 9])])
    got = {r["id"]: r["cluster"] for r in ward.run_ward(table(spark, points, 20), 3, limit=40).collect()}
    assert len({(got[i], i // 400) for i in range(1200)}) == 3
    empty = spark.createDataFrame([], "id long, vector array<double>")
    assert ward.run_ward(empty, 3).collect() == []


# boosted trees


@pytest.fixture(scope="module")
def boosted(spark):
    draw = np.random.default_rng(11)
    x = draw.normal(size=(900, 4))
    y = (x[:, 0] + x[:, 1] ** 2 + draw.normal(size=900) > 0.8).astype(float)
    rows = [(i, float(y[i]), *map(float, x[i])) for i in range(900)]
    df = models.vector_of(spark.createDataFrame(rows, "id long, label double, a double, b double, c double, d double"), ["a", "b", "c", "d"], keep=["id"])
    train, validation = df.filter("id < 600").persist(), df.filter("id >= 600").persist()
    from pyspark.ml.classification import GBTClassifier

    return GBTClassifier(maxIter=25, maxDepth=3, stepSize=0.3, seed=1).fit(train), train, validation


def test_staged_areas_hold_every_round(boosted):
    model, _, validation = boosted
    plain = [E.roc_auc(models.score(models.first_trees(model, n), validation)).first()["roc_auc"] for n in range(1, 26)]
    low, high = models.staged_areas(model, validation)
    assert all(a - 1e-12 <= p <= b + 1e-12 for a, p, b in zip(low, plain, high))
    exact = models.exact_areas(model, validation, range(25))
    assert np.allclose([exact[i] for i in range(25)], plain, atol=1e-12)
    for bins, patience in ((4096, 3), (8, 3), (8, 50), (1, 50)):
        low, high = models.staged_areas(model, validation, bins)
        asked = []
        got = models.decided_round(low, high, patience, lambda r: (asked.append(r), {i: plain[i] for i in r})[1])
        best = models.best_round(plain, patience)
        assert got == (best, best + patience <= 25) and len(asked) <= 4


def test_boosting_is_cut_at_the_best_round(boosted):
    _, train, validation = boosted
    kept = models.fit_gbt(train, validation, rounds=20, depth=3, step=0.5, patience=4)
    from pyspark.ml.classification import GBTClassifier

    whole = GBTClassifier(maxIter=20, maxDepth=3, stepSize=0.5, weightCol="weight", seed=42).fit(models.balanced_class_weights(train, "label"))
    plain = [E.roc_auc(models.score(models.first_trees(whole, n), validation)).first()["roc_auc"] for n in range(1, 21)]
    assert len(kept.treeWeights) == models.best_round(plain, 4)
    one_class = validation.filter("label = 1")
    assert len(models.fit_gbt(train, one_class, rounds=2, depth=2).treeWeights) == 2


# cuts in hashed order, spreads


@pytest.mark.parametrize("limit", [3, 10_000])
def test_parts_equal_ranks(spark, limit, monkeypatch):
    monkeypatch.setattr(ordered, "SLICE_BITS", 3)
    df = spark.range(700).selectExpr("id", "case when id % 3 > 0 then 'big' when id % 2 = 0 then 'small' end as kind")
    cuts = lambda stratum, n: [n // 7, n // 2, n]
    got = {r["id"]: r["part"] for r in ordered.hash_parts(df, "id", 5, cuts, ["kind"], rows_a_slice=limit).collect()}
    ranked = ordered.hash_rank(df, "id", 5, ["kind"]).collect()
    assert got == {r["id"]: sum(r["rank"] >= c for c in cuts(None, r["rank_of"])) for r in ranked}
    whole = ordered.hash_parts(df, "id", 5, lambda s, n: [0, 10], rows_a_slice=limit)
    first = [r["id"] for r in df.withColumn("h", hash32("id", 5)).orderBy("h", "id").limit(10).collect()]
    assert sorted(r["id"] for r in whole.filter("part = 1").collect()) == sorted(first) and whole.filter("part = 0").count() == 0
    assert ordered.hash_parts(df.limit(0), "id", 5, lambda s, n: [3]).collect() == []


def test_column_spread(spark):
    draw = np.random.default_rng(12)
    x = np.stack([1e6 + draw.normal(size=300), np.arange(300) % 49, np.arange(300) % 50, np.full(300, 3.0)], 1)
    df = spark.createDataFrame([([float(v) for v in row],) for row in x], "x array<double>").repartition(7)
    assert np.allclose(A.column_spread(df, "x", 4), [x[:, 0].std(), 0, x[:, 2].std(), 0])
    assert A.column_spread(df.limit(0), "x", 2) == [0.0, 0.0]


def plain_auc(rows):
    pos, neg = [s for y, s in rows if y == 1], [s for y, s in rows if y == 0]
    return sum((p > n) + (p == n) / 2 for p in pos for n in neg) / (len(pos) * len(neg))


def test_auc_of_tiny_scores_uses_many_buckets(spark):
    draw = np.random.default_rng(13)
    rows = [(int(y), float(s) / 70_000 / 1000) for y, s in zip(draw.random(600) < 0.4, draw.integers(0, 300, 600))]
    df = spark.createDataFrame(rows, "y_true int, y_prob double")
    scores = df.groupBy(F.col("y_prob").alias("_s")).agg(F.count(F.lit(1)).alias("n"))
    assert len(E.score_bounds(scores, 20)) >= 10
    assert math.isclose(E.roc_auc(df, scores_a_bucket=20).first()["roc_auc"], plain_auc(rows), rel_tol=1e-12)
    parted = df.withColumn("g", F.when(F.col("y_prob") > 0.000002, "b"))
    got = {r["g"]: r["roc_auc"] for r in E.roc_auc(parted, by=["g"], scores_a_bucket=20).collect()}
    assert math.isclose(got["b"], plain_auc([r for r in rows if r[1] > 0.000002]), rel_tol=1e-12)
    assert math.isclose(got[None], plain_auc([r for r in rows if r[1] <= 0.000002]), rel_tol=1e-12)


def test_sessions_of_a_user_with_one_full_hour(spark):
    from weekspan.sources import star

    draw = np.random.default_rng(14)
    rows = [(i, 7, 1_700_000_000 + float(t)) for i, t in enumerate(np.sort(draw.random(400) * 3000))]
    rows += [(1000 + i, int(u), 1_700_000_000 + float(t)) for i, (u, t) in enumerate(zip(draw.integers(0, 5, 300), draw.random(300) * 400_000))]
    rows += [(2000 + i, 7, 1_700_001_500.0) for i in range(30)]
    df = spark.createDataFrame(rows, "event_id long, user_id long, t double").withColumn("ts", F.timestamp_micros((F.col("t") * 1_000_000).cast("long")))
    gap = 20_000_000
    plain = {r["event_id"]: r["sid"] for r in star.number_sessions(df, "ts", "event_id", gap).collect()}
    cut = star.number_sessions(df, "ts", "event_id", gap, rows_a_slice=20)
    assert {r["event_id"]: r["sid"] for r in cut.collect()} == plain
    assert star.time_slices(df, "ts", 20).filter("user_id = 7").select("_hour").distinct().count() > 15
    order = sorted(rows, key=lambda r: (r[1], r[2], r[0]))
    want, before = {}, None
    for i, u, t in order:
        want[i] = 1 if before is None or before[0] != u else want[before[2]] + (round(t * 1e6) - round(before[1] * 1e6) > gap)
        before = (u, t, i)
    assert sum(plain[i] != want[i] for i in want) <= 2  # microseconds are rounded


def test_vocabularies_are_checked(spark):
    from weekspan.operators.features import categories_of

    df = spark.range(50).selectExpr("cast(id % 12 as string) as v")
    assert len(categories_of(df, "v")) == 12
    with pytest.raises(ValueError):
        categories_of(df, "v", 11)
