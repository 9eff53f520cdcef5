"""Experiment grids on sequences: feature sets, summer-free tests, demographics, augmentation."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.ml.feature import VectorSlicer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weekspan.operators import augment as A
from weekspan.operators import evaluate as E
from weekspan.operators import models as M
from weekspan.operators.features import CALENDAR_FEATURES
from weekspan.operators.sampling import SEED, fit_scaler, split_users
from weekspan.operators.sequences import attach_demographics, make_sequences, with_vector
from weekspan.session import durable

KEYS = ["user_id", "target_week"]


def sequence_splits(
    weeks: DataFrame,
    columns: Sequence[str],
    length: int,
    drop_summer_test: bool = False,
    demographics: DataFrame | None = None,
    keep_sequences: bool = False,
    seed: int = SEED,
) -> M.Splits:
    """User-disjoint parts, scaled by the train part, cut into sequences and flattened.

    ``weeks`` is a stage 2 table; the users and their parts are stored, so that the weeks are not searched for them again, and
    every part is stored once because fitting reads it many times.
    """
    users = durable(weeks.select("user_id").distinct(), "users")
    tagged = weeks.filter(F.col("user_id").isNotNull()).join(durable(split_users(users, seed=seed), "parts"), "user_id", "left")
    scaler = fit_scaler(tagged.filter("part = 'train'"), columns)
    extra = [c for c in demographics.columns if c != "user_id"] if demographics is not None else []

    def cut(part: DataFrame, drop_summer: bool) -> DataFrame:
        sequences = make_sequences(scaler.apply(part), columns, length, drop_summer=drop_summer)
        if demographics is not None:
            sequences = attach_demographics(sequences, demographics)
        kept = [*KEYS, "label", "features", *(["seq"] if keep_sequences else [])]
        return durable(with_vector(sequences, extra).select(*kept))

    parts = M.Splits.of(tagged)
    return M.Splits(cut(parts.train, False), cut(parts.validation, False), cut(parts.test, drop_summer_test))


def narrowed(splits: M.Splits, columns: Sequence[str], left: Sequence[str], length: int) -> M.Splits:
    """Splits of ``columns`` with the features of ``left`` only: what ``sequence_splits`` gives for these, not cut again."""
    if list(left) == list(columns):
        return splits
    places = [list(columns).index(c) for c in left]
    slicer = VectorSlicer(inputCol="features", outputCol="_left", indices=[t * len(columns) + p for t in range(length) for p in places])
    return splits.map(lambda df: slicer.transform(df).withColumn("features", F.col("_left")).drop("_left"))


def experiment_grid(
    weeks: DataFrame, specs: dict[str, dict], length: int, fit: Callable[[DataFrame, DataFrame], object]
) -> DataFrame:
    """One row per experiment: the same learner on other columns, test weeks or with demographics."""
    rows = []
    for name, spec in specs.items():
        splits = sequence_splits(weeks, length=length, **spec)
        row = M.evaluate_model(name, fit(splits.train, splits.validation), splits, len(spec["columns"]))
        rows.append((*row, spec.get("demographics") is not None, bool(spec.get("drop_summer_test"))))
    table = M.results(weeks.sparkSession, rows, M.RESULT + ", demographics boolean, drop_summer_test boolean")
    return E.experiment_comparison({"grid": table.withColumnRenamed("experiment", "name")})


def cumulative_study(
    weeks: DataFrame, groups: dict[str, Sequence[str]], length: int, fit: Callable[[DataFrame, DataFrame], object],
    demographics: DataFrame | None = None,
) -> DataFrame:
    """Feature groups of the weeks added one after the other, demographics last; one row per step."""
    rows, columns = [], []
    every = [c for cols in groups.values() for c in cols]
    whole = sequence_splits(weeks, every, length)
    steps = [(name, list(cols), None) for name, cols in groups.items()]
    if demographics is not None:
        steps.append(("demographics", [], demographics))
    for name, added, block in steps:
        columns = columns + added
        splits = narrowed(whole, every, columns, length) if block is None else sequence_splits(weeks, columns, length, demographics=block)
        width = length * len(columns) + (len(block.columns) - 1 if block is not None else 0)
        rows.append(M.evaluate_model(f"+ {name}" if rows else name, fit(splits.train, splits.validation), splits, width))
    return M.results(weeks.sparkSession, rows)


def leave_out_study(
    weeks: DataFrame, columns: Sequence[str], removals: dict[str, Sequence[str]], length: int, fit: Callable[[DataFrame, DataFrame], object],
    second_without: Sequence[str] = CALENDAR_FEATURES, splits: M.Splits | None = None,
) -> DataFrame:
    """Feature sets left out of flattened weeks, with the loss against the full set.

    A second pass repeats this from a baseline that already lacks the ``second_without`` columns; its rows are named
    after that baseline and compared with it. Removals that leave nothing to remove there are not repeated. The sequences of
    all columns are cut once, or given as ``splits``.
    """
    whole = sequence_splits(weeks, columns, length) if splits is None else splits
    rows = []
    for gone in ([], list(second_without)):
        base = None
        for name, removed in {"baseline": [], **removals}.items():
            removed = [c for c in removed if c not in gone]
            left = [c for c in columns if c not in {*gone, *removed}]
            if name != "baseline" and not removed:
                continue
            splits = narrowed(whole, columns, left, length)
            row = M.evaluate_model(f"no calendar, {name}" if gone else name, fit(splits.train, splits.validation), splits, length * len(left))
            base = base or row
            rows.append((*row, ", ".join([*gone, *removed]), base[2] - row[2], base[3] - row[3]))
    return M.results(weeks.sparkSession, rows, M.RESULT + ", removed_features string, roc_auc_drop double, f1_drop double")


def flat_augmentations(width: int, smote_cap: int = 200_000, seed: int = SEED) -> dict[str, Callable[[DataFrame], DataFrame]]:
    """The augmentations of flat train rows; every one takes and returns a table with ``features`` and ``label``."""
    from pyspark.ml.functions import array_to_vector, vector_to_array

    def on_arrays(change: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame], DataFrame]:
        def run(train: DataFrame) -> DataFrame:
            rows = train.select(*KEYS, "label", vector_to_array("features").alias("x"))
            return change(rows).select("label", array_to_vector("x").alias("features"))

        return run

    return {
        "none": lambda train: train.select("label", "features"),
        "oversampling": on_arrays(lambda d: A.oversample_minority(d, KEYS, "label", seed)),
        "smote": on_arrays(lambda d: A.smote(d, KEYS, "label", max_samples=smote_cap, seed=seed)),
        "mixup": on_arrays(lambda d: A.mixup(d, KEYS, "label", seed=seed)),
        "continuous noise": on_arrays(lambda d: A.continuous_noise(d, KEYS, width=width, seed=seed)),
        "masking": on_arrays(lambda d: A.masking(d, KEYS, width=width, seed=seed)),
    }


def sequence_augmentations(length: int, features: int, seed: int = SEED) -> dict[str, Callable[[DataFrame], DataFrame]]:
    """Sequence policies, one changed copy per train row."""

    def policy(change) -> Callable[[DataFrame], DataFrame]:
        def run(train: DataFrame) -> DataFrame:
            both = A.augmented_train_set(train, change, seed=seed, keys=KEYS, length=length, features=features)
            return with_vector(both).select("label", "features")

        return run

    return {
        "none": lambda train: train.select("label", "features"),
        "mask_crop": policy(A.policy_mask_crop),
        "conservative": policy(A.policy_conservative),
    }


def augmentation_matrix(splits: M.Splits, fits: dict[str, Callable], length: int, features: int) -> DataFrame:
    """Every learner on every sequence policy, with differences to the learner's own un-augmented row."""
    out = None
    for model, fit in fits.items():
        table = M.compare_augmentations(splits, sequence_augmentations(length, features), fit, length * features)
        table = table.withColumnRenamed("experiment", "augmentation").withColumn("model", F.lit(model))
        out = table if out is None else out.unionByName(table)
    return E.metric_deltas(out, ["roc_auc", "f1", "precision", "recall", "accuracy"])
