"""Queries that fit models.

Single fits on the stage 1 table run the operators' full settings; single fits on sequences use all columns and weeks with
few rounds or epochs. Studies of several fits run on ``STUDY_COLUMNS`` and ``STUDY_WEEKS``; the README lists the keys.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from weekspan.catalog.base import query
from weekspan.catalog.logs import CATEGORIES, stage1
from weekspan.catalog.sequences import stage2
from weekspan.operators import clean, demographics
from weekspan.operators import evaluate as E
from weekspan.operators import models as M
from weekspan.operators.features import CALENDAR_FEATURES, STAGE1_ADDITIONAL, STAGE1_BASELINE, STAGE1_FEATURES, WEEKLY_FEATURES
from weekspan.operators.sampling import stratified_split
from weekspan.operators.sequences import flat_names, original_feature
from weekspan.plans import experiments as X
from weekspan.session import durable
from weekspan.sources import star

FEW_ROUNDS, DEPTH, L = 3, 3, 12
EPOCHS, HIDDEN = 2, 8
COLUMNS = list(WEEKLY_FEATURES)
STUDY_WEEKS = 4
STUDY_COLUMNS = ["n_events", "n_transactions", "activity_score", "mean_hour", "year", "day"]
RESULT = "experiment:s n_features:i roc_auc:d f1:d precision:d recall:d threshold:d val_f1:d"


def stage1_parts(spark, folder):
    table = stage1(spark, folder, categories=CATEGORIES, return_from=4)
    return M.Splits.of(durable(stratified_split(table.df, "user_id", "came_back"))), table.feature_cols


def stage1_trees(spark, folder):
    splits, _ = stage1_parts(spark, folder)
    return splits.map(lambda df: M.vector_of(df, STAGE1_FEATURES, "came_back", ["user_id"]).persist())


def trees(train, validation):
    return M.fit_gbt(train, validation, FEW_ROUNDS, DEPTH)


def network(train, validation):
    return M.fit_mlp(train, validation, hidden=HIDDEN, epochs=EPOCHS, block=5)[0]


def weeks(spark, folder):
    return durable(stage2(spark, folder))


@query("gbt_stage1", RESULT)
def gbt_stage1(spark, folder):
    splits = stage1_trees(spark, folder)
    model = M.fit_gbt(splits.train, splits.validation)
    return M.results(spark, [M.evaluate_model("boosted trees", model, splits, len(STAGE1_FEATURES))])


@query("logreg_stage1", RESULT)
def logreg_stage1(spark, folder):
    splits, _ = stage1_parts(spark, folder)
    scaled = M.scaled_splits(splits, STAGE1_FEATURES).map(lambda df: M.vector_of(df, STAGE1_FEATURES, "came_back").persist())
    return M.results(spark, [M.evaluate_model("logistic", M.fit_logistic(scaled.train), scaled, len(STAGE1_FEATURES))])


@query("predictions", "user_id:i came_back:i came_back_probability:d prediction:i")
def predictions(spark, folder):
    splits = stage1_trees(spark, folder)
    model = M.fit_gbt(splits.train, splits.validation)
    threshold = E.best_threshold(M.score(model, splits.validation)).first()["threshold"]
    return M.predictions(model, splits.test, threshold, ["user_id"], "came_back")


@query("feature_importance", "feature:s importance:d rank:i")
def feature_importance(spark, folder):
    splits = stage1_trees(spark, folder)
    return M.feature_importance(spark, M.fit_gbt(splits.train, splits.validation), STAGE1_FEATURES)


@query("permutation_importance", "flat_feature:s importance_mean:d importance_std:d")
def permutation_importance(spark, folder):
    splits = stage1_trees(spark, folder)
    return M.permutation_importance(M.fit_gbt(splits.train, splits.validation), splits.test, ["user_id"], STAGE1_FEATURES)


@query("ablation_cumulative", RESULT)
def ablation_cumulative(spark, folder):
    splits, columns = stage1_parts(spark, folder)
    groups = {"baseline": STAGE1_BASELINE, "additional": STAGE1_ADDITIONAL, "demographics": demographics.demographic_columns(columns)}
    return M.ablation_cumulative(splits, groups, "came_back", FEW_ROUNDS, DEPTH)


@query("gbt_sequences", RESULT)
def gbt_sequences(spark, folder):
    splits = X.sequence_splits(weeks(spark, folder), COLUMNS, L)
    return M.results(spark, [M.evaluate_model("boosted trees", trees(splits.train, splits.validation), splits, L * len(COLUMNS))])


@query("mlp_sequences", "epoch:i train_loss:d val_f1:d val_threshold:d")
def mlp_sequences(spark, folder):
    """Training history of the network."""
    splits = X.sequence_splits(weeks(spark, folder), COLUMNS, L)
    _, history = M.fit_mlp(splits.train, splits.validation, hidden=HIDDEN, epochs=EPOCHS, block=5)
    return M.results(spark, history, "epoch int, train_loss double, val_f1 double, val_threshold double")


def demographic_block(spark, folder):
    users = clean.clean_users(star.star_users(spark, folder))
    index = demographics.demographic_index(users, CATEGORIES["gender"])
    flags = demographics.demographic_features(users, CATEGORIES)
    cantons = [c for c in flags.columns if c.startswith("canton_")]
    return index.drop("canton_index").join(flags.select("user_id", *cantons), "user_id")


@query("mlp_sequences_demographics", RESULT)
def mlp_sequences_demographics(spark, folder):
    block = demographic_block(spark, folder)
    splits = X.sequence_splits(weeks(spark, folder), STUDY_COLUMNS, STUDY_WEEKS, demographics=block)
    model = network(splits.train, splits.validation)
    return M.results(spark, [M.evaluate_model("network + demographics", model, splits, STUDY_WEEKS * len(STUDY_COLUMNS) + len(block.columns) - 1)])


@query("experiment_grid", "name:s n_features:i roc_auc:d f1:d precision:d recall:d threshold:d val_f1:d demographics:b drop_summer_test:b")
def experiment_grid(spark, folder):
    specs = {
        "weekly": {"columns": STUDY_COLUMNS},
        "weekly, no summer test": {"columns": STUDY_COLUMNS, "drop_summer_test": True},
        "time only": {"columns": CALENDAR_FEATURES},
        "weekly + demographics": {"columns": STUDY_COLUMNS, "demographics": demographic_block(spark, folder)},
    }
    return X.experiment_grid(weeks(spark, folder), specs, STUDY_WEEKS, network)


ABLATION = RESULT + " removed_features:s roc_auc_drop:d f1_drop:d"


def leave_out(spark, folder):
    splits, _ = stage1_parts(spark, folder)
    removals = {"without hours": ["mean_hour_0_2", "std_hour_0_2"], "without days": ["n_active_days_0_2"]}
    return splits, M.ablation_leave_out(splits, STAGE1_FEATURES, removals, "came_back", FEW_ROUNDS, DEPTH)


@query("ablation_cumulative_sequences", RESULT)
def ablation_cumulative_sequences(spark, folder):
    """Weekly activity, then objective time, then demographics."""
    groups = {"baseline": [c for c in STUDY_COLUMNS if c not in CALENDAR_FEATURES], "objective time": CALENDAR_FEATURES}
    return X.cumulative_study(weeks(spark, folder), groups, STUDY_WEEKS, trees, demographic_block(spark, folder))


@query("ablation_leave_out_sequences", ABLATION)
def ablation_leave_out_sequences(spark, folder):
    """Without hours and without the calendar, then again from the baseline without the calendar."""
    removals = {"without hours": ["mean_hour"], "without calendar": CALENDAR_FEATURES}
    return X.leave_out_study(weeks(spark, folder), STUDY_COLUMNS, removals, STUDY_WEEKS, trees)


@query("ablation_leave_out", ABLATION)
def ablation_leave_out(spark, folder):
    return leave_out(spark, folder)[1]


@query("evaluation_summary", "analysis_type:s experiment:s removed_features:s roc_auc:d f1:d roc_auc_drop:d f1_drop:d")
def evaluation_summary(spark, folder):
    """Ablations of weekly features and permutation importances rolled up from weekly steps to features."""
    table = weeks(spark, folder)
    sequences = X.sequence_splits(table, STUDY_COLUMNS, STUDY_WEEKS)
    ablation = X.leave_out_study(table, STUDY_COLUMNS, {"without hours": ["mean_hour"]}, STUDY_WEEKS, trees, splits=sequences)
    model = trees(sequences.train, sequences.validation)
    flat = M.permutation_importance(model, sequences.test, X.KEYS, flat_names(STUDY_COLUMNS, STUDY_WEEKS))
    return M.evaluation_summary(ablation, E.roll_up_importance(flat, original_feature(F.col("flat_feature"))))


CONFUSION = "train_rows:i tn:i fp:i fn:i tp:i accuracy:d"


@query("augmentation_comparison", f"{RESULT} {CONFUSION}")
def augmentation_comparison(spark, folder):
    cols = STUDY_COLUMNS[:3]
    splits = X.sequence_splits(weeks(spark, folder), cols, STUDY_WEEKS)
    variants = X.flat_augmentations(STUDY_WEEKS * len(cols), smote_cap=3000)
    return M.compare_augmentations(splits, variants, trees, STUDY_WEEKS * len(cols))


@query(
    "augmentation_matrix",
    "model:s augmentation:s roc_auc:d f1:d accuracy:d roc_auc_delta:d f1_delta:d precision_delta:d recall_delta:d accuracy_delta:d",
)
def augmentation_matrix(spark, folder):
    cols = STUDY_COLUMNS[:3]
    splits = X.sequence_splits(weeks(spark, folder), cols, STUDY_WEEKS, keep_sequences=True)
    return X.augmentation_matrix(splits, {"boosted trees": trees, "network": network}, STUDY_WEEKS, len(cols))
