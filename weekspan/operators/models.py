"""Classifiers on Spark ML: boosted trees, logistic regression, a feed-forward sequence network, and their studies.

Every split is a table with a vector column ``features``, a 0/1 column ``label`` and a key. Fitting reads a table many
times, so pass stored tables.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import SparkContext
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier, LogisticRegression, MultilayerPerceptronClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weekspan.operators import evaluate as E
from weekspan.operators.sampling import SEED, balanced_class_weights, fit_scaler
from weekspan.functions.ordered import hash_rank


@dataclass(frozen=True)
class Splits:
    train: DataFrame
    validation: DataFrame
    test: DataFrame

    @classmethod
    def of(cls, df: DataFrame) -> Splits:
        """From a table tagged with ``part``."""
        return cls(*[df.filter(F.col("part") == p) for p in ("train", "validation", "test")])

    def map(self, change: Callable[[DataFrame], DataFrame]) -> Splits:
        return Splits(change(self.train), change(self.validation), change(self.test))

    def release(self) -> None:
        """Drop stored copies of parts that were persisted."""
        for part in (self.train, self.validation, self.test):
            part.unpersist()


def vector_of(df: DataFrame, columns: Sequence[str], label: str = "label", keep: Sequence[str] = ()) -> DataFrame:
    values = F.expr("array(" + ", ".join(f"coalesce(cast(`{c}` as double), 0D)" for c in columns) + ")")
    return df.select(*keep, F.col(label).cast("double").alias("label"), array_to_vector(values).alias("features"))


def score(model, df: DataFrame) -> DataFrame:
    """Add ``y_true`` and ``y_prob``."""
    out = model.transform(df).withColumn("y_prob", vector_to_array("probability")[1])
    return out.withColumn("y_true", F.col("label").cast("int")).drop("rawPrediction", "probability", "prediction")


# --- learners ------------------------------------------------------------------------------------------------------


def best_round(scores: Iterable[float], patience: int) -> int:
    """Number of rounds up to the first highest score, looking at most ``patience`` rounds past the best one so far."""
    best, at = float("-inf"), 0
    for i, value in enumerate(scores):
        if value > best:
            best, at = value, i
        elif i - at >= patience:
            break
    return at + 1


def first_trees(model: GBTClassificationModel, rounds: int) -> GBTClassificationModel:
    """The ensemble after its first rounds; nothing is fitted."""
    java, gateway = model._java_obj, SparkContext._active_spark_context._gateway
    trees = gateway.new_array(gateway.jvm.org.apache.spark.ml.regression.DecisionTreeRegressionModel, rounds)
    weights = gateway.new_array(gateway.jvm.double, rounds)
    for i in range(rounds):
        trees[i], weights[i] = java.trees()[i], java.treeWeights()[i]
    name = gateway.jvm.org.apache.spark.ml.classification.GBTClassificationModel
    cut = GBTClassificationModel(name(model.uid, trees, weights, model.numFeatures, model.numClasses))
    cut._resetUid(model.uid)
    return model._copyValues(cut)


def leaf_values(model: GBTClassificationModel) -> np.ndarray:
    """Weighted prediction of every leaf, from left to right, in one row per tree; read from the model's printed form."""
    trees: list[list[float]] = []
    weights: list[float] = []
    for line in model.toDebugString.splitlines():
        text = line.strip()
        if text.startswith("Tree "):
            weights.append(float(text[text.index("weight ") + 7 : text.index(")")]))
            trees.append([])
        elif text.startswith("Predict: "):
            trees[-1].append(float(text[9:]))
    out = np.zeros((len(trees), max(map(len, trees), default=0)))
    for t, (w, values) in enumerate(zip(weights, trees, strict=True)):
        out[t, : len(values)] = np.array(values) * w
    return out


def staged_scores(table: np.ndarray, leaves: np.ndarray) -> np.ndarray:
    """Probability of class 1 after every round, one row per table row, from ``leaf_values`` and each row's leaf numbers."""
    margins = np.cumsum(table[np.arange(len(table)), leaves.astype(np.int64)], 1)
    return 1 / (1 + np.exp(np.clip(-2 * margins, -700, 700)))


def _leaf_rows(model: GBTClassificationModel, df: DataFrame) -> DataFrame:
    found = model.copy().setLeafCol("leaf").transform(df)
    return found.select(F.col("label").cast("int").alias("y"), vector_to_array("leaf").alias("leaf"))


def staged_areas(model: GBTClassificationModel, df: DataFrame, bins: int = 4096) -> tuple[np.ndarray, np.ndarray] | None:
    """Lower and upper bounds of the ROC-AUC after every round, from one scoring pass; None without both classes.

    A row's leaves give its probability after every round at once. Tasks count the classes by round and probability bin,
    Spark chains the bins; pairs of rows that share a bin make the difference between the bounds.
    """
    table = df.sparkSession.sparkContext.broadcast(leaf_values(model))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rounds = len(table.value)
        total = np.zeros((rounds, bins, 2), np.int64)
        for batch in batches:
            for a in range(0, batch.num_rows, 1024):
                part = batch.slice(a, 1024)
                y = part.column(0).to_numpy()
                leaves = np.asarray(part.column(1).flatten().to_numpy(zero_copy_only=False)).reshape(part.num_rows, -1)
                at = np.minimum((staged_scores(table.value, leaves) * bins).astype(np.int64), bins - 1)
                np.add.at(total, (np.arange(rounds)[None, :], at, y[:, None]), 1)
        r, b = np.nonzero(total.any(2))
        yield pa.RecordBatch.from_arrays([pa.array(r.astype(np.int32)), pa.array(b.astype(np.int32)), pa.array(total[r, b, 0]), pa.array(total[r, b, 1])], ["round", "bin", "neg", "pos"])

    cells = _leaf_rows(model, df).mapInArrow(count, "round int, bin int, neg long, pos long").groupBy("round", "bin").agg(F.sum("neg").alias("neg"), F.sum("pos").alias("pos"))
    below = F.sum("neg").over(Window.partitionBy("round").orderBy("bin")) - F.col("neg")
    pairs = F.sum("pos").cast("double") * F.sum("neg")
    areas = cells.withColumn("below", below).groupBy("round").agg(
        (F.sum(F.col("pos").cast("double") * F.col("below")) / F.nullif(pairs, F.lit(0.0))).alias("low"),
        (F.sum(F.col("pos").cast("double") * (F.col("below") + F.col("neg"))) / F.nullif(pairs, F.lit(0.0))).alias("high"),
    )
    rows = sorted((r["round"], r["low"], r["high"]) for r in areas.collect())  # a row per round
    if not rows or rows[0][1] is None:
        return None
    return np.array([r[1] for r in rows]), np.array([r[2] for r in rows])


def exact_areas(model: GBTClassificationModel, df: DataFrame, rounds: Sequence[int]) -> dict[int, float]:
    """ROC-AUC after the given rounds (0-based), in one pass."""
    wanted = np.array(sorted(rounds))
    table = df.sparkSession.sparkContext.broadcast(leaf_values(model))

    def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaves = np.asarray(batch.column(1).flatten().to_numpy(zero_copy_only=False)).reshape(batch.num_rows, -1)
            found = staged_scores(table.value, leaves)[:, wanted]
            yield pa.RecordBatch.from_arrays([pa.array(np.tile(wanted.astype(np.int32), len(found))), pa.array(np.repeat(batch.column(0).to_numpy(), len(wanted))), pa.array(found.ravel())], ["round", "y_true", "y_prob"])

    rows = _leaf_rows(model, df).mapInArrow(scores, "round int, y_true int, y_prob double")
    return {r["round"]: r["roc_auc"] for r in E.roc_auc(rows, by=["round"]).collect()}


def decided_round(low: Sequence[float], high: Sequence[float], patience: int, exact: Callable[[Sequence[int]], dict[int, float]]) -> tuple[int, bool]:
    """``best_round`` of values known within bounds, and whether patience ended the search; values whose bounds leave a
    comparison open are asked for."""
    known: dict[int, tuple[float, float]] = {}
    while True:
        best, at, unsure, ended = (float("-inf"), float("-inf")), 0, set(), False
        for i, bounds in enumerate(zip(low, high, strict=True)):
            a, b = known.get(i, bounds)
            if a > best[1]:
                best, at = (a, b), i
            elif b > best[0]:
                unsure |= {i, at} - known.keys()
                if (a + b) > sum(best):
                    best, at = (a, b), i
            if i - at >= patience:
                ended = True
                break
        if not unsure:
            return at + 1, ended
        known |= {i: (v, v) for i, v in exact(sorted(unsure)).items()}


def fit_gbt(
    train: DataFrame, validation: DataFrame, rounds: int = 500, depth: int = 6, step: float = 0.05, patience: int = 50, seed: int = SEED
):
    """Boosted trees with balanced weights, cut at the round with the best validation ROC-AUC.

    The search ends when ``patience`` further rounds brought nothing better. Twice the patience is fitted first; only if
    the search has not ended there, twice as many rounds are (the first ones come out the same), up to ``rounds``. One pass
    scores every round; a second one settles the rounds that the first leaves open. Without both classes in the
    validation rows all rounds are kept.
    """
    weighted = balanced_class_weights(train, "label").persist()
    count = min(rounds, 2 * patience)
    try:
        while True:
            model = GBTClassifier(maxIter=count, maxDepth=depth, stepSize=step, weightCol="weight", seed=seed).fit(weighted)
            fitted = len(model.treeWeights)
            areas = staged_areas(model, validation)
            if areas is None:
                if count >= rounds:
                    return model
                count = rounds
                continue
            keep, ended = decided_round(*areas, patience, lambda open_rounds, model=model: exact_areas(model, validation, open_rounds))
            if ended or count >= rounds or fitted < count:
                return model if keep == fitted else first_trees(model, keep)
            count = min(rounds, 2 * count)
    finally:
        weighted.unpersist()


def fit_logistic(train: DataFrame, max_iter: int = 1000):
    """Balanced logistic regression with the penalty of C = 1, on features scaled beforehand."""
    weighted = balanced_class_weights(train, "label")
    n = weighted.count()
    return LogisticRegression(maxIter=max_iter, regParam=1.0 / n, standardization=False, weightCol="weight").fit(weighted)


def fit_mlp(
    train: DataFrame, validation: DataFrame, hidden: int = 64, epochs: int = 30, block: int = 1, patience: int = 5, seed: int = SEED
):
    """Feed-forward network trained in blocks; after each the best validation F1 is noted and the best model kept.

    Returns the model and history rows (epoch, train_loss, val_f1, val_threshold).
    """
    width = len(train.select(vector_to_array("features")).first()[0])
    weights, best, history, stale = None, None, [], 0
    for epoch in range(epochs):
        learner = MultilayerPerceptronClassifier(layers=[width, hidden, 2], maxIter=block, seed=seed, blockSize=64)
        if weights is not None:
            learner = learner.setInitialWeights(weights)
        model = learner.fit(train)
        weights = model.weights
        tuned = E.best_threshold(score(model, validation)).first()
        loss = model.summary().objectiveHistory[-1]
        history.append((epoch + 1, float(loss), float(tuned["f1"]), float(tuned["threshold"])))
        if best is None or tuned["f1"] > best[0]:
            best, stale = (tuned["f1"], model), 0
        else:
            stale += 1
            if stale >= patience:
                break
    return best[1], history


def scaled_splits(splits: Splits, columns: Sequence[str]) -> Splits:
    """All parts scaled by the train part's means and population deviations."""
    scaler = fit_scaler(splits.train, columns)
    return splits.map(scaler.apply)


# --- results -------------------------------------------------------------------------------------------------------

RESULT = "experiment string, n_features int, roc_auc double, f1 double, precision double, recall double, threshold double, val_f1 double"


def evaluate_model(name: str, model, splits: Splits, n_features: int) -> tuple:
    """One result row: test metrics at the threshold tuned on validation."""
    m = E.validation_tuned_metrics(score(model, splits.validation), score(model, splits.test)).first()
    return (name, n_features, *(m[c] for c in ("roc_auc", "f1", "precision", "recall", "threshold", "val_f1")))


def results(spark: SparkSession, rows: Sequence[tuple], schema: str = RESULT) -> DataFrame:
    return spark.createDataFrame(list(rows), schema)


def predictions(model, df: DataFrame, threshold: float, key: Sequence[str], label: str, strict: bool = True) -> DataFrame:
    """Key, label, probability and 0/1 prediction."""
    prob = F.col("y_prob")
    hit = prob > threshold if strict else prob >= threshold
    return score(model, df).select(*key, F.col("y_true").alias(label), prob.alias(f"{label}_probability"), hit.cast("int").alias("prediction"))


def feature_importance(spark: SparkSession, model, columns: Sequence[str]) -> DataFrame:
    rows = [(c, float(v)) for c, v in zip(columns, model.featureImportances.toArray())]
    table = spark.createDataFrame(rows, "feature string, importance double")
    return E.rank_rows(table, [F.desc("importance"), F.col("feature")])


def permutation_importance(
    model, df: DataFrame, key: Sequence[str], columns: Sequence[str], repeats: int = 3, seed: int = SEED
) -> DataFrame:
    """Loss of ROC-AUC when one column is shuffled among the rows; mean and spread over repeats.

    Each repeat pairs every row with another row by hashed rank; one pass then scores all single-column exchanges.
    """
    rows = df.select(*key, "label", vector_to_array("features").alias("x"))
    home = hash_rank(rows, key, f"{seed}|home").drop("rank_of")
    pairs = None
    for r in range(repeats):
        donor = hash_rank(rows, key, f"{seed}|{r}").select("rank", F.col("x").alias("x2"))
        part = home.join(donor, "rank").withColumn("repeat", F.lit(r))
        pairs = part if pairs is None else pairs.unionByName(part)
    swapped = F.transform("x", lambda v, i: F.when(i == F.col("position"), F.get("x2", i)).otherwise(v))
    exchanged = (
        pairs.withColumn("position", F.explode(F.sequence(F.lit(0), F.lit(len(columns) - 1))))
        .withColumn("features", array_to_vector(swapped))
        .drop("x", "x2", "rank")
    )
    base = E.roc_auc(score(model, rows.withColumn("features", array_to_vector("x")))).first()["roc_auc"]
    drops = E.roc_auc(score(model, exchanged), by=["position", "repeat"]).withColumn("drop", F.lit(base) - F.col("roc_auc"))
    names = F.array(*[F.lit(c) for c in columns])
    return drops.groupBy("position").agg(F.avg("drop").alias("importance_mean"), F.stddev_pop("drop").alias("importance_std")).select(
        F.get(names, F.col("position")).alias("flat_feature"), "importance_mean", "importance_std"
    )


# --- studies -------------------------------------------------------------------------------------------------------


def ablation_cumulative(splits: Splits, groups: dict[str, Sequence[str]], label: str, rounds: int = 500, depth: int = 6) -> DataFrame:
    """Feature groups added one after the other, for both tabular learners."""
    rows, columns = [], []
    for name, cols in groups.items():
        columns = columns + list(cols)
        trees = splits.map(lambda df: vector_of(df, columns, label).persist())
        linear = scaled_splits(splits, columns).map(lambda df: vector_of(df, columns, label).persist())
        rows.append(evaluate_model(f"boosted trees + {name}", fit_gbt(trees.train, trees.validation, rounds, depth), trees, len(columns)))
        rows.append(evaluate_model(f"logistic + {name}", fit_logistic(linear.train), linear, len(columns)))
        trees.release()
        linear.release()
    return results(splits.train.sparkSession, rows)


def ablation_leave_out(
    splits: Splits, columns: Sequence[str], removals: dict[str, Sequence[str]], label: str = "label", rounds: int = 300,
    depth: int = 6, tune_on: str = "validation",
) -> DataFrame:
    """Drop feature sets one at a time and report the loss against the full model.

    The threshold is tuned on validation; ``tune_on="test"`` gives the optimistic variant.
    """
    rows = []
    for name, removed in {"baseline": [], **removals}.items():
        left = [c for c in columns if c not in set(removed)]
        parts = splits.map(lambda df: vector_of(df, left, label).persist())
        if tune_on == "test":
            parts = Splits(parts.train, parts.test, parts.test)
        model = fit_gbt(parts.train, parts.validation, rounds, depth)
        row = evaluate_model(name, model, parts, len(left))
        base = rows[0] if rows else row
        rows.append((*row, ", ".join(removed), base[2] - row[2], base[3] - row[3]))
        parts.release()
    schema = RESULT + ", removed_features string, roc_auc_drop double, f1_drop double"
    return results(splits.train.sparkSession, rows, schema)


def compare_augmentations(splits: Splits, variants: dict[str, Callable[[DataFrame], DataFrame]], fit, n_features: int) -> DataFrame:
    """The same learner on differently augmented train rows; validation and test stay untouched."""
    rows = []
    for name, change in variants.items():
        train = change(splits.train).persist()
        model = fit(train, splits.validation)
        row = evaluate_model(name, model, splits, n_features)
        c = E.confusion_matrix(score(model, splits.test), row[6]).first()
        rows.append((*row, train.count(), c["tn"], c["fp"], c["fn"], c["tp"], c["accuracy"]))
        train.unpersist()
    schema = RESULT + ", train_rows long, tn long, fp long, fn long, tp long, accuracy double"
    return results(splits.train.sparkSession, rows, schema)


def evaluation_summary(ablation: DataFrame, by_feature: DataFrame, top: int = 5) -> DataFrame:
    """Ablations and the leading permutation importances in one table."""
    first = ablation.select(
        F.lit("ablation").alias("analysis_type"), "experiment", "removed_features", "roc_auc", "f1", "roc_auc_drop", "f1_drop"
    )
    second = by_feature.filter(F.col("rank") <= top).select(
        F.lit("permutation importance").alias("analysis_type"),
        F.concat(F.lit("permute "), F.col("original_feature")).alias("experiment"),
        F.col("original_feature").alias("removed_features"),
        F.col("total_importance").alias("roc_auc_drop"),
    )
    return first.unionByName(second, allowMissingColumns=True)
