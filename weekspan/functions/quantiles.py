"""Exact column quantiles without sorting a column in one task."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

ACCURACY = 10_000
DISTINCT_LIMIT = 200_000


def _brackets(df: DataFrame, cols: Sequence[str], probs: Sequence[float], bounds: dict, accuracy: int) -> dict:
    """Narrow every (column, probability) bracket by approximate percentiles with a known rank error."""
    picks = []
    for c in cols:
        for i, p in enumerate(probs):
            low, high = bounds[c, i]["range"]
            inside = F.when(F.col(c).between(low, high), F.col(c).cast("double"))
            # target position inside the bracket, as a share of the rows it holds
            share = bounds[c, i]["share"]
            margin = bounds[c, i]["margin"] / accuracy
            ends = F.array(F.lit(max(share - margin, 0.0)), F.lit(min(share + margin, 1.0)))
            picks.append(F.percentile_approx(inside, ends, F.lit(accuracy)).alias(f"{c}|{i}"))
    row = df.agg(*picks).first()
    return {(c, i): tuple(row[f"{c}|{i}"]) for c in cols for i in range(len(probs))}


def exact_quantiles(
    df: DataFrame, cols: Sequence[str], probs: Sequence[float], accuracy: int = ACCURACY, limit: int = DISTINCT_LIMIT
) -> dict[str, list[float | None]]:
    """Linearly interpolated quantiles of each column, nulls ignored (None for an empty column).

    Approximate percentiles bracket each target rank; the rows inside a bracket are counted per distinct value and
    only those counts are ordered. Brackets with more than ``limit`` distinct values are narrowed again first.
    The table is scanned a few times, so pass one that is stored or cheap to read.
    """
    cols = list(cols)
    probs = list(probs)
    names = {c: f"_q{j}" for j, c in enumerate(cols)}
    data = df.select(*[F.col(c).cast("double").alias(names[c]) for c in cols])
    aggs = []
    for n in names.values():
        aggs += [F.count(n).alias(f"n{n}"), F.min(n).alias(f"lo{n}"), F.max(n).alias(f"hi{n}")]
        aggs.append(F.approx_count_distinct(n).alias(f"d{n}"))
    row = data.agg(*aggs).first()
    sizes = {n: row[f"n{n}"] for n in names.values()}
    live = [n for n in names.values() if sizes[n] > 0]
    targets: dict[tuple[str, int], tuple[int, int]] = {}
    bounds: dict[tuple[str, int], dict] = {}
    for n in live:
        for i, p in enumerate(probs):
            position = p * (sizes[n] - 1)
            targets[n, i] = (math.floor(position), math.ceil(position))
            bounds[n, i] = {"range": (row[f"lo{n}"], row[f"hi{n}"]), "share": p, "margin": 3.0}
            bounds[n, i]["distinct"] = row[f"d{n}"]

    while True:
        wide = [k for k, b in bounds.items() if b["distinct"] > limit and b["range"][0] < b["range"][1]]
        if not wide:
            break
        todo = sorted({n for n, _ in wide})
        narrowed = _brackets(data, todo, probs, bounds, accuracy)
        checks = []
        for (n, i), (low, high) in narrowed.items():
            checks += [
                F.count_if(F.col(n) < low).alias(f"b{n}|{i}"),
                F.count_if(F.col(n).between(low, high)).alias(f"w{n}|{i}"),
                F.approx_count_distinct(F.when(F.col(n).between(low, high), F.col(n))).alias(f"d{n}|{i}"),
            ]
        found = data.agg(*checks).first()
        for (n, i), (low, high) in narrowed.items():
            below, within = found[f"b{n}|{i}"], found[f"w{n}|{i}"]
            first, last = targets[n, i]
            holds = below <= first and last < below + within
            shrinks = (low, high) != bounds[n, i]["range"]
            if holds and shrinks:
                middle = (first + last) / 2 - below
                bounds[n, i].update(
                    range=(low, high),
                    share=middle / max(within - 1, 1),
                    distinct=found[f"d{n}|{i}"],
                )
            elif not holds and bounds[n, i]["margin"] < accuracy:  # the approximation was off: look in a wider bracket
                bounds[n, i]["margin"] *= 4
            else:  # no bracket is shorter than this one: order what is left
                bounds[n, i]["distinct"] = 0

    result = {c: [None] * len(probs) for c in cols}
    if not live:
        return result
    entries, below_aggs = [], []
    for (n, i), b in bounds.items():
        low, high = b["range"]
        value = F.when(F.col(n).between(low, high), F.col(n))
        entries.append(F.struct(F.lit(f"{n}|{i}").alias("slot"), value.alias("value")))
        below_aggs.append(F.count_if(F.col(n) < low).alias(f"{n}|{i}"))
    below = data.agg(*below_aggs).first()
    counts = (
        data.select(F.explode(F.array(*entries)).alias("e"))
        .select("e.slot", "e.value")
        .filter(F.col("value").isNotNull())
        .groupBy("slot", "value")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    running = Window.partitionBy("slot").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    ranked = counts.withColumn("end", F.sum("n").over(running)).withColumn("start", F.col("end") - F.col("n"))
    wanted = F.lit(False)
    for (n, i), (first, last) in targets.items():
        for rank in {first, last}:
            at = rank - below[f"{n}|{i}"]
            wanted = wanted | ((F.col("slot") == f"{n}|{i}") & (F.col("start") <= at) & (F.col("end") > at))
    rows: dict[str, list] = {}
    for r in ranked.filter(wanted).collect():  # at most two rows per column and probability
        rows.setdefault(r["slot"], []).append(r)
    for c, n in names.items():
        for i, p in enumerate(probs):
            if sizes[n] == 0:
                continue
            first, last = targets[n, i]
            offset = below[f"{n}|{i}"]
            pick = {
                rank: next(r["value"] for r in rows[f"{n}|{i}"] if r["start"] <= rank - offset < r["end"])
                for rank in {first, last}
            }
            weight = p * (sizes[n] - 1) - first
            result[c][i] = pick[first] + (pick[last] - pick[first]) * weight
    return result


def exact_medians(df: DataFrame, cols: Sequence[str], **options) -> dict[str, float | None]:
    return {c: q[0] for c, q in exact_quantiles(df, cols, [0.5], **options).items()}
