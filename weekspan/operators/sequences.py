"""Fixed-length week sequences cut from the dense timeline.

Sequences are arrays carried on one row; rows are only multiplied (several window lengths) after the features are
packed. The windows run over the weeks of one user, whose number is bounded by the calendar span of the data.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weekspan.functions.arrays import drop_positions, flatten_sequence, group_curve, left_pad

LABEL = "is_dropout_point"


def _packed(cols: Sequence[str]) -> Column:
    return F.expr("array(" + ", ".join(f"cast(`{c}` as double)" for c in cols) + ")")


def _window(df: DataFrame, cols: Sequence[str], first: int, last: int) -> DataFrame:
    """Add ``seq``: the packed weeks at row offsets first..last of the same user, oldest first."""
    frame = Window.partitionBy("user_id").orderBy("relative_week").rowsBetween(first, last)
    return df.withColumn("_week", _packed(cols)).withColumn("seq", F.collect_list("_week").over(frame)).drop("_week")


def make_sequences(
    df: DataFrame, cols: Sequence[str], length: int = 12, label: str = LABEL, drop_summer: bool = False
) -> DataFrame:
    """For each labelled week with ``length`` weeks before it: those weeks (the labelled week is not part of them).

    A table without ``is_summer`` has no summer weeks to drop.
    """
    wanted = (F.size("seq") == length) & F.col(label).isNotNull()
    if drop_summer and "is_summer" in df.columns:
        wanted = wanted & ~F.coalesce(F.col("is_summer"), F.lit(False))
    return (
        _window(df, cols, -length, -1)
        .filter(wanted)
        .select("user_id", F.col("relative_week").alias("target_week"), "seq", F.col(label).cast("double").alias("label"))
    )


def make_sequences_multi_window(
    df: DataFrame, cols: Sequence[str], length: int = 12, min_length: int = 2, label: str = LABEL
) -> DataFrame:
    """Every suffix of ``min_length``..``length`` weeks before each labelled week, padded in front to ``length``."""
    size = F.size("seq")
    return (
        _window(df, cols, -length, -1)
        .filter((size >= min_length) & F.col(label).isNotNull())
        .select(
            "user_id",
            F.col("relative_week").alias("target_week"),
            F.col(label).cast("double").alias("label"),
            "seq",
            F.explode(F.sequence(F.lit(min_length), size)).alias("window_length"),
        )
        .withColumn("seq", left_pad(F.slice("seq", size - F.col("window_length") + 1, F.col("window_length")), length))
    )


def trajectory_sequences(scaled: DataFrame, cols: Sequence[str], length: int = 12, label: str = LABEL) -> DataFrame:
    """``length`` labelled weeks ending at and including each week; unlabelled weeks must be removed before scaling."""
    return (
        _window(scaled, cols, -(length - 1), 0)
        .filter(F.size("seq") == length)
        .select("user_id", F.col("relative_week").alias("end_week"), "seq", F.col(label).cast("int").alias(label))
    )


def flat_names(cols: Sequence[str], length: int) -> list[str]:
    return [f"t{t}_{c}" for t in range(length) for c in cols]


def original_feature(flat: Column) -> Column:
    """Feature name without its time step."""
    return F.regexp_replace(flat, r"^[^_]*_", "")


def with_vector(sequences: DataFrame, extra: Sequence[str] = (), out: str = "features") -> DataFrame:
    """Flattened sequence (and further numeric columns) as an ML vector."""
    values = flatten_sequence("seq")
    if extra:
        values = F.concat(values, F.array(*[F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(0.0)) for c in extra]))
    return sequences.withColumn(out, array_to_vector(values))


def drop_features(sequences: DataFrame, cols: Sequence[str], dropped: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """Sequences without the given features at any step, and the remaining feature list."""
    absent = set(dropped) - set(cols)
    if absent:
        raise ValueError(f"not among the features: {sorted(absent)}")
    positions = [i for i, c in enumerate(cols) if c in set(dropped)]
    left = [c for c in cols if c not in set(dropped)]
    return sequences.withColumn("seq", drop_positions("seq", positions, len(cols))), left


def attach_demographics(sequences: DataFrame, demographics: DataFrame) -> DataFrame:
    """Static user columns on every sequence, 0 for unknown users; users with very many sequences are spread."""
    cols = [c for c in demographics.columns if c != "user_id"]
    joined = sequences.join(demographics, "user_id", "left")
    return joined.fillna(0, subset=cols)


def fairness_frame(df: DataFrame, users: DataFrame, length: int = 12, label: str = LABEL) -> DataFrame:
    """Label and user groups of every row that gets a sequence, keyed by user and week."""
    position = F.row_number().over(Window.partitionBy("user_id").orderBy("relative_week"))
    rows = (
        df.select("user_id", "relative_week", label)
        .withColumn("_position", position)
        .filter((F.col("_position") > length) & F.col(label).isNotNull())
        .select("user_id", F.col("relative_week").alias("target_week"), F.col(label).cast("int").alias("true_label"))
    )
    return rows.join(users.select("user_id", "gender", "canton"), "user_id", "left")


def dimension_curves(sequences: DataFrame, cols: Sequence[str], groups: dict[str, Sequence[str]]) -> DataFrame:
    """One array column per feature group: its mean in every week."""
    out = sequences
    for name, members in groups.items():
        positions = [list(cols).index(c) for c in members if c in cols]
        if positions:
            out = out.withColumn(name, group_curve("seq", positions))
    return out
