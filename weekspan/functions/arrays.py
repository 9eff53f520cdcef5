"""Expressions over sequences: arrays of weeks, each week an array of feature values."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from weekspan.functions.scalars import col


def flatten_sequence(seq: str | Column) -> Column:
    """Row-major values: position t * features + f."""
    return F.flatten(col(seq))


def left_pad(seq: str | Column, length: int) -> Column:
    """Repeat the first week in front until the sequence has ``length`` weeks."""
    s = col(seq)
    return F.concat(F.array_repeat(s[0], F.greatest(F.lit(length) - F.size(s), F.lit(0))), s)


def zeros(features: int) -> Column:
    return F.array_repeat(F.lit(0.0), features)


def mean_over_time(seq: str | Column, features: int) -> Column:
    """Average of every feature over the weeks."""
    s = col(seq)
    total = F.aggregate(s, zeros(features), lambda acc, week: F.zip_with(acc, week, lambda a, b: a + b))
    return F.transform(total, lambda v: v / F.size(s))


def l2_normalize(seq: str | Column, features: int) -> Column:
    """Divide every feature by its Euclidean norm over the weeks (a zero norm counts as one)."""
    s = col(seq)
    squares = F.aggregate(s, zeros(features), lambda acc, week: F.zip_with(acc, week, lambda a, b: a + b * b))
    roots = F.transform(squares, lambda v: F.when(v == 0, F.lit(1.0)).otherwise(F.sqrt(v)))
    return bind(roots, lambda norms: F.transform(s, lambda week: F.zip_with(week, norms, lambda a, n: a / n)))


def group_curve(seq: str | Column, positions: Sequence[int]) -> Column:
    """Mean of the chosen feature positions, week by week."""

    def week_mean(week: Column) -> Column:
        total = week[positions[0]]
        for p in positions[1:]:
            total = total + week[p]
        return total / len(positions)

    return F.transform(col(seq), week_mean)


def drop_positions(seq: str | Column, positions: Sequence[int], features: int) -> Column:
    """Remove feature positions from every week."""
    kept = [i for i in range(features) if i not in set(positions)]
    return F.transform(col(seq), lambda week: F.array(*[week[i] for i in kept]))


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once per row, also when the body uses it inside array functions."""
    return F.transform(F.array(value), body)[0]


def zero_weeks(seq: str | Column, chosen: Column, features: int) -> Column:
    """Zero all features of the weeks whose 0-based position is in the array ``chosen``."""
    s, blank = col(seq), F.array(*[F.lit(0.0)] * features)

    def zeroed(positions: Column) -> Column:
        return F.transform(s, lambda week, t: F.when(F.array_contains(positions, t), blank).otherwise(week))

    return bind(chosen, zeroed)


def swap_positions(order: Column, i: Column, j: Column) -> Column:
    """Exchange two entries of an array of positions."""

    def swapped(pair: Column) -> Column:
        a, b = pair["a"], pair["b"]
        return F.transform(order, lambda p, t: F.when(t == a, F.get(order, b)).when(t == b, F.get(order, a)).otherwise(p))

    return bind(F.struct(i.alias("a"), j.alias("b")), swapped)


def reorder_weeks(seq: str | Column, order: Column) -> Column:
    s = col(seq)
    return bind(order, lambda positions: F.transform(positions, lambda p: F.get(s, p)))
