"""Leakage-safe splits, train-fitted scaling and stratified samples, all by hashed keys.

The same key always lands in the same part; results do not depend on partitioning or on repeated tasks.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weekspan.functions.ordered import hash_parts
from weekspan.functions.quantiles import exact_medians

SEED = 42


PARTS = ("test", "validation", "train")


def _part_cuts(test: float, validation: float) -> Callable[[tuple, int], list[int]]:
    """Where the test part and then the validation part end, among n rows in hashed order."""

    def cuts(stratum: tuple, n: int) -> list[int]:
        n_test = math.ceil(n * test)
        return [n_test, n_test + math.ceil((n - n_test) * validation)]

    return cuts


def _named_parts(df: DataFrame, key: str, seed: int | str, test: float, validation: float, by: Sequence[str] = ()) -> DataFrame:
    names = F.array(*[F.lit(p) for p in PARTS])
    return hash_parts(df, key, seed, _part_cuts(test, validation), by, "_part").withColumn("part", F.get(names, F.col("_part"))).drop("_part")


def split_users(
    users: DataFrame, test: float = 0.15, validation: float = 0.20, seed: int | str = SEED, user: str = "user_id"
) -> DataFrame:
    """user -> part. The first ceil(n * test) users in hashed order are the test part, then the validation share of
    the rest, then train."""
    distinct = users.select(user).filter(F.col(user).isNotNull()).distinct()
    return _named_parts(distinct, user, seed, test, validation)


def split_by_users(df: DataFrame, spread: Sequence[str] = ("relative_week",), **options) -> DataFrame:
    """Every row tagged with its user's part; rows without a user drop out."""
    return df.filter(F.col("user_id").isNotNull()).join(split_users(df, **options), "user_id", "left")


def stratified_split(
    df: DataFrame, key: str, label: str, test: float = 0.20, validation: float = 0.20, seed: int | str = SEED
) -> DataFrame:
    """Row split with the same shares inside every label class."""
    return _named_parts(df, key, seed, test, validation, [label])


@dataclass(frozen=True)
class Scaler:
    """Column means and population deviations (1 where a column is constant), with optional fill values."""

    columns: list[str]
    mean: dict[str, float]
    std: dict[str, float]
    fill: dict[str, float]

    def apply(self, df: DataFrame) -> DataFrame:
        scaled = set(self.columns)

        def expression(c: str) -> str:
            if c not in scaled:
                return f"`{c}`"
            value = f"cast(`{c}` as double)"
            if self.fill.get(c) is not None:
                value = f"coalesce({value}, {self.fill[c]!r}D)"
            return f"({value} - {self.mean[c]!r}D) / {self.std[c]!r}D as `{c}`"

        return df.selectExpr(*[expression(c) for c in df.columns])


def fit_scaler(df: DataFrame, columns: Sequence[str], impute: bool = False) -> Scaler:
    """Fit on the given rows only; with ``impute`` nulls first become the exact column median."""
    fill = exact_medians(df, columns) if impute else {}
    aggs = []
    for c in columns:
        value = f"cast(`{c}` as double)"
        if fill.get(c) is not None:
            value = f"coalesce({value}, {fill[c]!r}D)"
        aggs += [F.expr(f"avg({value})").alias(f"m|{c}"), F.expr(f"stddev_pop({value})").alias(f"s|{c}")]
    row = df.agg(*aggs).first()
    mean = {c: float(row[f"m|{c}"] or 0.0) for c in columns}
    # a deviation at rounding level means a constant column
    std = {c: float(row[f"s|{c}"] or 0.0) for c in columns}
    std = {c: s if s > 10 * 2.2e-16 * max(abs(mean[c]), 1e-300) else 1.0 for c, s in std.items()}
    return Scaler(list(columns), mean, std, {c: v for c, v in fill.items() if v is not None})


def impute_scale(df: DataFrame, columns: Sequence[str]) -> tuple[DataFrame, Scaler]:
    scaler = fit_scaler(df, columns, impute=True)
    return scaler.apply(df), scaler


def class_counts(df: DataFrame, label: str) -> dict:
    return {r[0]: r[1] for r in df.groupBy(label).count().collect()}


def largest_remainder(counts: dict, size: int) -> dict:
    """Class quotas of a stratified sample: floors of the exact shares, left-over rows to the largest remainders."""
    total = sum(counts.values())
    if size >= total:
        return dict(counts)
    exact = {c: n * size / total for c, n in counts.items()}
    quota = {c: int(e) for c, e in exact.items()}
    order = sorted(counts, key=lambda c: (-(exact[c] - quota[c]), c))
    for c in order[: size - sum(quota.values())]:
        quota[c] += 1
    return quota


def raised(quota: dict, amount: int) -> dict:
    """Quotas after ``amount`` rows went, one by one, to the smallest quota: all below a common level rise to it."""
    low, high = min(quota.values()), max(quota.values()) + amount
    while low < high:  # the highest level that the amount reaches
        middle = (low + high + 1) // 2
        low, high = (middle, high) if sum(max(0, middle - n) for n in quota.values()) <= amount else (low, middle - 1)
    rest = amount - sum(max(0, low - n) for n in quota.values())
    level = {c: max(n, low) for c, n in quota.items()}
    extra = [c for c in sorted(level) if level[c] == low][:rest]
    return {c: n + (c in extra) for c, n in level.items()}


def floor_quota(counts: dict, size: int) -> dict:
    """Floors of the class shares, at least one each; surplus leaves the largest quota, shortage joins the smallest."""
    total = sum(counts.values())
    if total <= size:
        return dict(counts)
    quota = {c: max(1, n * size // total) for c, n in counts.items()}
    missing = size - sum(quota.values())
    if missing >= 0:
        return raised(quota, missing)
    return {c: -n for c, n in raised({c: -n for c, n in quota.items()}, -missing).items()}


def take_quota(df: DataFrame, key: str | Sequence[str], label: str, quota: dict, seed: int | str = SEED) -> DataFrame:
    """The first rows of each class in hashed order, as many as its quota."""
    classes = df.filter(F.col(label).isin(list(quota)))
    return hash_parts(classes, key, seed, lambda stratum, n: [quota[stratum[0]]], [label], "_part").filter("_part = 0").drop("_part")


def stratified_subsample(df: DataFrame, key, label: str, size: int, seed: int | str = SEED) -> DataFrame:
    return take_quota(df, key, label, largest_remainder(class_counts(df, label), size), seed)


def stratified_cap(df: DataFrame, key, label: str, size: int = 200_000, seed: int | str = SEED) -> DataFrame:
    return take_quota(df, key, label, floor_quota(class_counts(df, label), size), seed)


def hash_sample(df: DataFrame, key: str | Sequence[str], size: int, seed: int | str = SEED) -> DataFrame:
    """A plain random sample of ``size`` rows: those with the smallest hashes."""
    return hash_parts(df, key, seed, lambda stratum, n: [size], (), "_part").filter("_part = 0").drop("_part")


def balanced_class_weights(df: DataFrame, label: str, out: str = "weight") -> DataFrame:
    """Add n / (classes * class size)."""
    counts = class_counts(df, label)
    total = sum(counts.values())
    weight = F.lit(None).cast("double")
    for c, n in counts.items():
        weight = F.when(F.col(label) == c, F.lit(total / (len(counts) * n))).otherwise(weight)
    return df.withColumn(out, weight)
