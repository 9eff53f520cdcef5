"""Augmentation of training rows with hashed draws.

Tables carry their values in one array column: a flat row (``x``: array<double>) or a sequence (``seq``: weeks of
features). Draws are joined on hashed ranks, which are uniform, so no join key is hot.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weekspan.functions.arrays import bind, reorder_weeks, swap_positions, zero_weeks, zeros
from weekspan.functions.cells import noisy_cells
from weekspan.functions.hashing import gaussian, hash_digits, uniform
from weekspan.functions.ordered import hash_rank
from weekspan.functions.quantiles import exact_medians
from weekspan.operators.neighbours import nearest_neighbours
from weekspan.operators.sampling import SEED, class_counts, stratified_cap
from weekspan.session import durable

BETA_ATTEMPTS = 12


def _pick(keys: Sequence[str | Column], seed: str, n: Column) -> Column:
    """Uniform integer in [0, n)."""
    return F.floor(uniform(keys, seed) * n).cast("long")


def _ranked(df: DataFrame, key: Sequence[str], seed, by: Sequence[str] = ()) -> DataFrame:
    return hash_rank(df, key, f"{seed}|order", by).drop("rank_of")


def _draws(df: DataFrame, n: int) -> DataFrame:
    return df.sparkSession.range(n).withColumnRenamed("id", "draw")


def _append(df: DataFrame, extra: DataFrame) -> DataFrame:
    """Originals carry draw = null."""
    return df.withColumn("draw", F.lit(None).cast("long")).unionByName(extra.select(*df.columns, "draw"))


# --- flat rows -----------------------------------------------------------------------------------------------------


def oversample_minority(df: DataFrame, key: Sequence[str], label: str, seed: int | str = SEED) -> DataFrame:
    """Add random copies of the smaller classes until all are as large as the largest."""
    counts = class_counts(df, label)
    top = max(counts.values())
    ranked = _ranked(df, key, seed, [label])
    extra = None
    for value, n in sorted(counts.items()):
        if n == top:
            continue
        index = _pick([F.col("draw"), F.lit(value)], f"{seed}|pick", F.lit(n))
        draws = _draws(df, top - n).withColumn("rank", index).withColumn(label, F.lit(value))
        copies = draws.join(ranked, ["rank", label]).select(*df.columns, "draw")
        extra = copies if extra is None else extra.unionByName(copies)
    return _append(df, extra) if extra is not None else df.withColumn("draw", F.lit(None).cast("long"))


def _resampled(df: DataFrame, key: Sequence[str], ratio: float, seed) -> DataFrame:
    """int(n * ratio) random rows with replacement, each with its draw number."""
    n = df.count()
    draws = _draws(df, int(n * ratio)).withColumn("rank", _pick(["draw"], f"{seed}|pick", F.lit(n)))
    return draws.join(_ranked(df, key, seed), "rank").drop("rank")


def beta_symmetric(keys: Sequence[str | Column], seed: str, alpha: float) -> Column:
    """Beta(alpha, alpha) draw by rejection: (u^(1/a), v^(1/a)) accepted when the sum is at most one."""
    out = F.lit(0.5)
    for attempt in reversed(range(BETA_ATTEMPTS)):
        u = F.pow(uniform(keys, f"{seed}|u{attempt}"), F.lit(1 / alpha))
        v = F.pow(uniform(keys, f"{seed}|v{attempt}"), F.lit(1 / alpha))
        out = F.when((u + v > 0) & (u + v <= 1), u / (u + v)).otherwise(out)
    return out


def mixup(
    df: DataFrame, key: Sequence[str], label: str, values: str = "x", alpha: float = 0.2, ratio: float = 0.5, seed=SEED
) -> DataFrame:
    """Append convex mixes of two random rows; the mixed label is rounded at one half."""
    n = df.count()
    ranked = _ranked(df, key, seed).select("rank", F.col(values).alias("_x"), F.col(label).alias("_y"), *key)
    pairs = (
        _draws(df, int(n * ratio))
        .withColumn("_i", _pick(["draw"], f"{seed}|first", F.lit(n)))
        .withColumn("_j", _pick(["draw"], f"{seed}|second", F.lit(n)))
        .withColumn("_w", beta_symmetric(["draw"], f"{seed}|beta", alpha))
    )
    first = ranked.withColumnRenamed("rank", "_i")
    second = ranked.select(F.col("rank").alias("_j"), F.col("_x").alias("_x2"), F.col("_y").alias("_y2"))
    mixed = pairs.join(first, "_i").join(second, "_j")
    w = F.col("_w")
    mixed = mixed.withColumn(values, F.zip_with("_x", "_x2", lambda a, b: w * a + (1 - w) * b)).withColumn(
        label, (w * F.col("_y") + (1 - w) * F.col("_y2") >= 0.5).cast(df.schema[label].dataType)
    )
    kept = [*key, label, values]
    return _append(df.select(*kept), mixed.select(*kept, "draw"))


def column_spread(df: DataFrame, values: str, width: int, min_distinct: int = 50) -> list[float]:
    """Population deviation of every position with at least ``min_distinct`` distinct values, else 0; nulls do not count.

    Tasks keep at most ``min_distinct`` distinct values per position, and count, mean and squared deviations; one row per
    task and position is merged.
    """

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = [np.zeros(0) for _ in range(width)]
        n, mean, squares = np.zeros(width), np.zeros(width), np.zeros(width)
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.asarray(batch.column(0).flatten().to_numpy(zero_copy_only=False), np.float64).reshape(batch.num_rows, -1)
            for i in range(width):
                column = x[~np.isnan(x[:, i]), i]
                if not len(column):
                    continue
                if len(seen[i]) < min_distinct:
                    seen[i] = np.unique(np.concatenate([seen[i], column]))[:min_distinct]
                more, centre = len(column), column.mean()
                squares[i] += ((column - centre) ** 2).sum() + (centre - mean[i]) ** 2 * n[i] * more / (n[i] + more)
                mean[i] += (centre - mean[i]) * more / (n[i] + more)
                n[i] += more
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays(
            [pa.array(at.astype(np.int32)), pa.array(n[at]), pa.array(mean[at]), pa.array(squares[at]), pa.array([seen[i] for i in at], pa.list_(pa.float64()))], ["pos", "n", "mean", "squares", "seen"]
        )

    parts = df.filter(F.col(values).isNotNull()).select(F.col(values).cast("array<double>").alias("x")).mapInArrow(tally, "pos int, n double, mean double, squares double, seen array<double>")
    merged = parts.groupBy("pos").agg(F.collect_list(F.struct("n", "mean", "squares")).alias("parts"), F.size(F.array_distinct(F.flatten(F.collect_list("seen")))).alias("distinct"))
    out = [0.0] * width
    for r in merged.filter(F.col("distinct") >= min_distinct).collect():  # a row per position
        n, mean, squares = (np.array([p[c] for p in r["parts"]]) for c in ("n", "mean", "squares"))
        centre = (n * mean).sum() / n.sum()
        out[r["pos"]] = float(np.sqrt((squares.sum() + (n * (mean - centre) ** 2).sum()) / n.sum()))
    return out


def continuous_noise(
    df: DataFrame, key: Sequence[str], values: str = "x", width: int | None = None, level: float = 0.01,
    ratio: float = 0.5, min_distinct: int = 50, seed=SEED,
) -> DataFrame:
    """Append resampled rows with Gaussian noise on their continuous columns."""
    width = width or len(df.select(values).first()[0])
    spread = F.array(*[F.lit(level * s) for s in column_spread(df, values, width, min_distinct)])

    def noisy(v: Column, i: Column) -> Column:
        sigma = F.get(spread, i)
        return F.when(sigma > 0, v + sigma * gaussian([F.col("draw"), i], f"{seed}|noise")).otherwise(v)

    extra = _resampled(df, key, ratio, seed).withColumn(values, F.transform(values, noisy))
    return _append(df, extra)


def masking(
    df: DataFrame, key: Sequence[str], values: str = "x", width: int | None = None, rate: float = 0.02,
    ratio: float = 0.5, seed=SEED,
) -> DataFrame:
    """Append resampled rows in which random cells become the exact column median."""
    width = width or len(df.select(values).first()[0])
    columns = df.select(*[F.col(values)[i].alias(f"c{i}") for i in range(width)])
    medians = exact_medians(columns, columns.columns)
    fill = F.array(*[F.lit(medians[f"c{i}"]) for i in range(width)])

    def masked(v: Column, i: Column) -> Column:
        return F.when(uniform([F.col("draw"), i], f"{seed}|mask") < rate, F.get(fill, i)).otherwise(v)

    extra = _resampled(df, key, ratio, seed).withColumn(values, F.transform(values, masked))
    return _append(df, extra)


def smote(
    df: DataFrame, key: Sequence[str], label: str, values: str = "x", max_samples: int = 200_000, k: int = 5, seed=SEED
) -> DataFrame:
    """Stratified subset of at most ``max_samples`` rows, its smaller classes filled up with synthetic rows between a
    row and one of its k nearest rows of the same class. With a single row in a class it falls back to copies."""
    subset = stratified_cap(df.select(*key, label, values), key, label, max_samples, seed)
    counts = class_counts(subset, label)
    top = max(counts.values())
    k = min(k, min(counts.values()) - 1)
    if k < 1:
        return oversample_minority(subset, key, label, seed)
    extra = None
    for value, n in sorted(counts.items()):
        if n == top:
            continue
        members = durable(_ranked(subset.filter(F.col(label) == value), key, seed))
        near = nearest_neighbours(members, "rank", k, values).select(F.col("key").alias("rank"), (F.col("rank") - 1).alias("_slot"), F.col("neighbour").alias("_other"))
        draws = (
            _draws(df, top - n)
            .withColumn("rank", _pick(["draw"], f"{seed}|base", F.lit(n)))
            .withColumn("_slot", _pick(["draw"], f"{seed}|slot", F.lit(k)).cast("int"))
            .withColumn("_u", uniform(["draw"], f"{seed}|step"))
        )
        other = members.select(F.col("rank").alias("_other"), F.col(values).alias("_b"))
        u = F.col("_u")
        made = (
            draws.join(members, "rank")
            .join(near, ["rank", "_slot"])
            .join(other, "_other")
            .withColumn(values, F.zip_with(values, "_b", lambda a, b: a + u * (b - a)))
            .select(*key, label, values, "draw")
        )
        extra = made if extra is None else extra.unionByName(made)
    return _append(subset, extra) if extra is not None else subset.withColumn("draw", F.lit(None).cast("long"))


# --- sequences -----------------------------------------------------------------------------------------------------


def _random_weeks(keys: Sequence[str], seed: str, length: int, n: int) -> Column:
    """``n`` distinct week positions in hashed order."""
    order = F.array(*[F.struct(hash_digits([*map(F.col, keys), F.lit(t)], seed).alias("h"), F.lit(t).alias("t")) for t in range(length)])
    return F.slice(F.sort_array(order), 1, n)["t"]


def mask_weeks(seq, keys: Sequence[str], seed: str, length: int, features: int, n: int) -> Column:
    return zero_weeks(seq, _random_weeks(keys, f"{seed}|mask", length, min(n, length)), features)


def crop_and_pad(seq, keys: Sequence[str], seed: str, length: int, features: int, min_crop: int = 6) -> Column:
    """Keep a random stretch of ``min_crop``..length-1 weeks, moved to the end behind zero weeks."""
    longest = length - 1
    shortest = max(2, min(min_crop, longest))
    keys = [F.col(k) for k in keys]
    crop = F.lit(shortest) + _pick(keys, f"{seed}|crop", F.lit(longest - shortest + 1)).cast("int")
    start = _pick(keys, f"{seed}|start", F.lit(length) - crop + 1).cast("int")
    return F.concat(F.array_repeat(zeros(features), F.lit(length) - crop), F.slice(seq, start + 1, crop))


def swap_nearby(seq, keys: Sequence[str], seed: str, length: int, max_swaps: int = 2, distance: int = 2) -> Column:
    """One to ``max_swaps`` exchanges of two weeks at most ``distance`` apart."""
    keys = [F.col(k) for k in keys]
    n = F.lit(1) + _pick(keys, f"{seed}|swaps", F.lit(max_swaps))
    order = F.array(*[F.lit(t) for t in range(length)])

    def swapped(order: Column, s: int) -> Column:
        i = _pick(keys, f"{seed}|i{s}", F.lit(length)).cast("int")

        def with_partner(i: Column) -> Column:
            low, high = F.greatest(F.lit(0), i - distance), F.least(F.lit(length - 1), i + distance)
            return swap_positions(order, i, low + _pick(keys, f"{seed}|j{s}", high - low + 1).cast("int"))

        return F.when(n > s, bind(i, with_partner)).otherwise(order)

    def chain(order: Column, s: int) -> Column:
        return order if s == max_swaps else bind(swapped(order, s), lambda o: chain(o, s + 1))

    return reorder_weeks(seq, chain(order, 0))


def jitter(seq, keys: Sequence[str], seed: str, sigma: float = 0.03, wanted: Column | None = None) -> Column:
    """Normal noise on every cell, drawn by key, week and feature; only where ``wanted``, if that is given."""
    return F.coalesce(noisy_cells(seq, F.xxhash64(*keys), f"{seed}|jitter", sigma, wanted), seq)


def _stepwise(df: DataFrame, steps: Sequence[tuple[Column, Callable[[Column], Column]]]) -> DataFrame:
    """Apply (condition, change) one after the other; every step is a projection of its own, so that it runs as generated code."""
    for condition, change in steps:
        df = df.withColumn("seq", F.when(condition, change(F.col("seq"))).otherwise(F.col("seq")))
    return df


def policy_mask_crop(df: DataFrame, keys: Sequence[str], length: int, features: int, seed=SEED, p_mask=0.5, p_crop=0.5):
    """Masking and / or cropping, always at least one of them."""
    cols = [F.col(k) for k in keys]
    mask = uniform(cols, f"{seed}|do_mask") < p_mask
    crop = uniform(cols, f"{seed}|do_crop") < p_crop
    instead = uniform(cols, f"{seed}|fallback") < 0.5
    neither = ~mask & ~crop
    return _stepwise(
        df,
        [
            (mask | (neither & instead), lambda s: mask_weeks(s, keys, str(seed), length, features, max(1, length // 4))),
            (crop | (neither & ~instead), lambda s: crop_and_pad(s, keys, str(seed), length, features, max(4, length // 2))),
        ],
    )


def policy_conservative(
    df: DataFrame, keys: Sequence[str], length: int, features: int, seed=SEED, p_drop=0.5, p_swap=0.5, p_jitter=0.7
):
    """Week dropout, nearby swaps and jitter, always at least one of them."""
    cols = [F.col(k) for k in keys]
    drop = uniform(cols, f"{seed}|do_drop") < p_drop
    swap = uniform(cols, f"{seed}|do_swap") < p_swap
    shake = uniform(cols, f"{seed}|do_jitter") < p_jitter
    noise = shake | (~drop & ~swap)
    n = max(1, round(length * 0.20))
    return _stepwise(
        df,
        [
            (drop, lambda s: mask_weeks(s, keys, str(seed), length, features, n)),
            (swap, lambda s: swap_nearby(s, keys, str(seed), length, 2, 1)),
            (noise, lambda s: jitter(s, keys, str(seed), wanted=noise)),
        ],
    )


def augmented_train_set(df: DataFrame, policy, copies: int = 1, seed=SEED, **options) -> DataFrame:
    """Originals (copy 0) followed by ``copies`` changed versions of every sequence."""
    out = df.withColumn("copy", F.lit(0))
    for c in range(1, copies + 1):
        out = out.unionByName(policy(df, seed=f"{seed}|{c}", **options).withColumn("copy", F.lit(c)))
    return out


def changed_values(before: Column, after: Column, tolerance: float = 1e-12) -> Column:
    """Number of cells that differ between two sequences."""
    pairs = F.zip_with(F.flatten(before), F.flatten(after), lambda a, b: (F.abs(a - b) > tolerance).cast("int"))
    return F.aggregate(pairs, F.lit(0), lambda total, v: total + v)


def augmentation_audit(df: DataFrame, before: str = "seq", after: str = "augmented") -> DataFrame:
    """Share of changed sequences and mean, median, minimum and maximum of changed cells.

    The number of changed cells is bounded by the sequence size, so the exact median works on a short histogram.
    """
    counts = df.select(changed_values(F.col(before), F.col(after)).alias("n")).groupBy("n").agg(F.count(F.lit(1)).alias("freq"))
    weight = F.col("freq")
    return counts.agg(
        (F.sum(F.when(F.col("n") > 0, weight).otherwise(0)) / F.sum(weight)).alias("changed_ratio"),
        (F.sum(F.col("n") * weight) / F.sum(weight)).alias("mean_changed"),
        F.percentile("n", F.lit(0.5), weight).alias("median_changed"),
        F.min("n").alias("min_changed"),
        F.max("n").alias("max_changed"),
    )
