"""Evaluation of scored tables: threshold sweeps, exact ROC-AUC, metrics, reports, experiment tables.

Scores are condensed to counts first; everything ordered runs on those counts.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weekspan.functions.scalars import col
from weekspan.session import durable

MOST_BUCKETS = 1_000
SCORES_A_BUCKET = 100_000


def grid(start: float, stop: float, count: int) -> list[float]:
    """Evenly spaced thresholds, both ends included."""
    step = (stop - start) / (count - 1)
    return [start + i * step for i in range(count - 1)] + [stop]


# The threshold grids in use.
DEFAULT_GRID = grid(0.1, 0.9, 50)
FINE_GRID = grid(0.1, 0.9, 81)
WIDE_GRID = grid(0.05, 0.95, 100)
PERCENT_GRID = [0.01 + i * 0.01 for i in range(99)]


def f1_score(tp: Column, fp: Column, fn: Column) -> Column:
    total = 2 * tp + fp + fn
    return F.when(total > 0, 2 * tp / total).otherwise(F.lit(0.0))


def ratio_or_zero(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def threshold_sweep(
    df: DataFrame,
    label: str = "y_true",
    prob: str = "y_prob",
    thresholds: Sequence[float] = DEFAULT_GRID,
    strict: bool = True,
    by: Sequence[str] = (),
) -> DataFrame:
    """tp, fp, fn, tn, F1, precision and recall at every threshold (``prob > t``, or ``>=`` if not strict).

    Each row is reduced to the number of thresholds it passes, so the table is read once whatever the grid. The
    thresholds may come in any order: a row that passes n of them passes those of the n lowest ranks.
    """
    operator = ">" if strict else ">="
    passed = " + ".join(f"cast({prob} {operator} {t!r}D as int)" for t in thresholds)
    counts = (
        df.select(*by, (F.col(label) == 1).cast("int").alias("_y"), F.expr(passed).alias("_passed"))
        .groupBy(*by, "_passed")
        .agg(F.sum("_y").alias("pos"), F.sum(1 - F.col("_y")).alias("neg"))
    )
    per_group = counts.groupBy(*by).agg(
        F.collect_list(F.struct("_passed", "pos", "neg")).alias("_h"), F.sum("pos").alias("_p"), F.sum("neg").alias("_n")
    )
    rank = {p: r for r, p in enumerate(sorted(range(len(thresholds)), key=lambda p: thresholds[p]))}
    points = F.array(*[F.struct(F.lit(float(t)).alias("threshold"), F.lit(rank[p]).alias("rank")) for p, t in enumerate(thresholds)])

    def above(field: str) -> Column:
        return F.expr(f"aggregate(filter(_h, x -> x._passed > point.rank), 0L, (a, x) -> a + x.{field})")

    tp, fp = F.col("tp"), F.col("fp")
    return (
        per_group.select(*by, "_h", "_p", "_n", F.posexplode(points).alias("position", "point"))
        .withColumns({"tp": above("pos"), "fp": above("neg")})
        .withColumn("threshold", F.col("point.threshold"))
        .drop("point")
        .withColumns({"fn": F.col("_p") - tp, "tn": F.col("_n") - fp})
        .withColumns(
            {
                "f1": f1_score(tp, fp, F.col("fn")),
                "precision": ratio_or_zero(tp, tp + fp),
                "recall": ratio_or_zero(tp, F.col("_p")),
            }
        )
        .drop("_h", "_p", "_n")
    )


def best_threshold(df: DataFrame, by: Sequence[str] = (), **options) -> DataFrame:
    """First threshold with the highest F1 (per group)."""
    best = F.max_by(
        F.struct("threshold", "f1", "precision", "recall"), F.struct("f1", -F.col("position"))
    ).alias("best")
    return threshold_sweep(df, by=by, **options).groupBy(*by).agg(best).select(*by, "best.*")


def score_bounds(scores: DataFrame, scores_a_bucket: int = SCORES_A_BUCKET) -> list[float]:
    """Increasing bounds that cut the distinct scores ``_s`` into buckets of about equal numbers, from a quantile sketch."""
    probs = F.lit([i / MOST_BUCKETS for i in range(1, MOST_BUCKETS)])
    found = scores.agg(F.count("_s"), F.percentile_approx("_s", probs, F.lit(10 * MOST_BUCKETS))).first()
    wanted = min(MOST_BUCKETS, -(-found[0] // scores_a_bucket))
    if wanted <= 1:
        return []
    return sorted({found[1][i * MOST_BUCKETS // wanted - 1] for i in range(1, wanted)})


def roc_auc(
    df: DataFrame, label: str = "y_true", prob: str = "y_prob", by: Sequence[str] = (), scores_a_bucket: int = SCORES_A_BUCKET
) -> DataFrame:
    """Exact area under the ROC curve with ties counted half; null when a class is absent.

    Counts per distinct score are ranked inside buckets of about ``scores_a_bucket`` distinct scores, whatever their
    distribution, and the buckets are chained by their totals, so the distinct scores are never ordered in a single task.
    """
    y = F.col(label) == 1
    scores = durable(df.groupBy(*by, F.col(prob).cast("double").alias("_s")).agg(F.count_if(y).alias("_p"), F.count_if(~y).alias("_n")), "scores")
    bounds = score_bounds(scores, scores_a_bucket)
    scope = list(by) or [F.lit(0)]
    if bounds:
        scores = scores.withColumn("_bucket", F.size(F.filter(F.lit(bounds), lambda b: b <= F.col("_s"))))
        before = Window.partitionBy(*scope).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
        sums = scores.groupBy(*by, "_bucket").agg(F.sum("_n").alias("_bn"))
        offsets = sums.select(F.col("_bucket").alias("_at"), F.coalesce(F.sum("_bn").over(before), F.lit(0)).alias("_below"), *[F.col(b).alias(f"_by_{b}") for b in by])
        inside = Window.partitionBy(*by, "_bucket").orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
        match = F.col("_bucket") == F.col("_at")
        for b in by:
            match = match & F.col(b).eqNullSafe(F.col(f"_by_{b}"))
        ranked = scores.withColumn("_inner", F.coalesce(F.sum("_n").over(inside), F.lit(0))).join(offsets, match)
    else:  # few distinct scores
        inside = Window.partitionBy(*scope).orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
        ranked = scores.withColumn("_inner", F.coalesce(F.sum("_n").over(inside), F.lit(0))).withColumn("_below", F.lit(0))
    wins = F.sum(F.col("_p").cast("double") * (F.col("_below") + F.col("_inner") + F.col("_n") / 2))
    area = wins / F.nullif(F.sum("_p").cast("double") * F.sum("_n"), F.lit(0.0))
    return ranked.groupBy(*by).agg(area.alias("roc_auc"), F.sum("_p").alias("n_pos"), F.sum("_n").alias("n_neg"))


def confusion(df: DataFrame, predicted: Column, label: str = "y_true", by: Sequence[str] = ()) -> DataFrame:
    y = F.col(label) == 1
    return df.groupBy(*by).agg(
        F.count_if(~y & ~predicted).alias("tn"),
        F.count_if(~y & predicted).alias("fp"),
        F.count_if(y & ~predicted).alias("fn"),
        F.count_if(y & predicted).alias("tp"),
    )


def confusion_matrix(df: DataFrame, threshold: float, label="y_true", prob="y_prob", strict=False, by=()) -> DataFrame:
    hit = F.col(prob) > threshold if strict else F.col(prob) >= threshold
    counts = confusion(df, hit, label, by)
    total = F.col("tn") + F.col("fp") + F.col("fn") + F.col("tp")
    return counts.withColumn("accuracy", (F.col("tp") + F.col("tn")) / total)


def binary_metrics(df: DataFrame, threshold: float, label="y_true", prob="y_prob", by: Sequence[str] = ()) -> DataFrame:
    """roc_auc, f1, precision and recall at ``prob >= threshold``."""
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    rates = confusion(df, F.col(prob) >= threshold, label, by).select(
        *by,
        f1_score(tp, fp, fn).alias("f1"),
        ratio_or_zero(tp, tp + fp).alias("precision"),
        ratio_or_zero(tp, tp + fn).alias("recall"),
        F.lit(float(threshold)).alias("threshold"),
    )
    auc = roc_auc(df, label, prob, by).select(*by, "roc_auc")
    both = rates.unionByName(auc, allowMissingColumns=True)  # one row of each kind per group
    return both.groupBy(*by).agg(*[F.max(c).alias(c) for c in ("roc_auc", "f1", "precision", "recall", "threshold")])


def validation_tuned_metrics(validation: DataFrame, test: DataFrame, label="y_true", prob="y_prob") -> DataFrame:
    """Metrics on ``test`` at the threshold with the best F1 on ``validation``, and that F1."""
    best = best_threshold(validation, label=label, prob=prob).first()
    return binary_metrics(test, best["threshold"], label, prob).withColumn("val_f1", F.lit(best["f1"]))


def classification_report(df: DataFrame, predicted: str = "y_pred", label: str = "y_true") -> DataFrame:
    """Precision, recall, F1 and support per class, accuracy, macro and weighted averages."""
    counts = df.groupBy(F.col(label).cast("int").alias("t"), F.col(predicted).cast("int").alias("p")).agg(
        F.count(F.lit(1)).alias("n")
    )
    sides = counts.select(F.explode(F.array(*[
        F.struct(F.col("t").alias("class"), F.lit("true").alias("side"), F.col("n"), (F.col("t") == F.col("p")).alias("hit")),
        F.struct(F.col("p").alias("class"), F.lit("pred").alias("side"), F.col("n"), F.lit(False).alias("hit")),
    ])).alias("s")).select("s.*")

    def total(condition: Column) -> Column:
        return F.coalesce(F.sum(F.when(condition, F.col("n"))), F.lit(0))

    per_class = sides.groupBy("class").agg(
        total(F.col("side") == "true").alias("support"),
        total(F.col("side") == "pred").alias("predicted"),
        total(F.col("hit")).alias("tp"),
    )
    tp = F.col("tp")
    scored = per_class.select(
        F.col("class").cast("string").alias("row"),
        ratio_or_zero(tp, F.col("predicted")).alias("precision"),
        ratio_or_zero(tp, F.col("support")).alias("recall"),
        ratio_or_zero(2 * tp, F.col("predicted") + F.col("support")).alias("f1"),
        "support",
        "tp",
    )
    names = ["precision", "recall", "f1"]
    macro = scored.agg(*[F.avg(c).alias(c) for c in names], F.sum("support").alias("support"))
    weighted = scored.agg(
        *[(F.sum(F.col(c) * F.col("support")) / F.sum("support")).alias(c) for c in names], F.sum("support").alias("support")
    )
    accuracy = scored.agg((F.sum("tp") / F.sum("support")).alias("f1"), F.sum("support").alias("support"))
    out = scored.drop("tp")
    for row, part in (("macro avg", macro), ("weighted avg", weighted), ("accuracy", accuracy)):
        out = out.unionByName(part.withColumn("row", F.lit(row)), allowMissingColumns=True)
    return out


def stack_results(tables: dict[str, DataFrame], name: str = "experiment") -> DataFrame:
    """Result tables under each other, absent columns null, tagged with their name."""
    out = None
    for key, df in tables.items():
        tagged = df.withColumn(name, F.lit(key))
        out = tagged if out is None else out.unionByName(tagged, allowMissingColumns=True)
    return out


def experiment_comparison(tables: dict[str, DataFrame]) -> DataFrame:
    return stack_results(tables).orderBy(F.desc("f1"), F.desc("roc_auc"))


def metric_deltas(
    results: DataFrame, metrics: Sequence[str], model: str = "model", variant: str = "augmentation", baseline: str = "none"
) -> DataFrame:
    """Each metric minus the value of the same model's baseline variant."""
    of_model = Window.partitionBy(model)
    base = {m: F.max(F.when(F.col(variant) == baseline, F.col(m))).over(of_model) for m in metrics}
    return results.withColumns({f"{m}_delta": F.col(m) - base[m] for m in metrics})


def rank_rows(df: DataFrame, order: Sequence[Column], out: str = "rank") -> DataFrame:
    """1-based position in a sorted result table (a small one: features, experiments)."""
    return df.withColumn(out, F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order)))


def roll_up_importance(flat: DataFrame, feature: str | Column, mean="importance_mean", std="importance_std") -> DataFrame:
    """Importance per original feature: total, mean and maximum over its time steps, mean spread, and rank."""
    grouped = flat.groupBy(col(feature).alias("original_feature")).agg(
        F.sum(mean).alias("total_importance"),
        F.avg(mean).alias("mean_importance"),
        F.max(mean).alias("max_importance"),
        F.avg(std).alias("std_mean"),
    )
    return rank_rows(grouped, [F.desc("total_importance"), F.col("original_feature")])
