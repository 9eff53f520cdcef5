"""Group statistics: confusion rates and gaps, outcome disparity, composition, independence tests."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weekspan.functions.quantiles import exact_quantiles
from weekspan.operators.evaluate import confusion

# Support and disparity limits.
MIN_GROUP = 30
DISPARITY_LOW, DISPARITY_HIGH = 0.8, 1.25
RATES = ["TPR", "FPR", "PPV", "NPV"]


def _share(part: Column, rest: Column) -> Column:
    return F.when(part + rest > 0, part / (part + rest))


def group_confusion(df: DataFrame, group: str, label: str = "y_true", predicted: str = "y_pred") -> DataFrame:
    """n, TPR, FPR, PPV, NPV per group; null on a zero denominator; rows without a group drop out."""
    counts = confusion(df.filter(F.col(group).isNotNull()), F.col(predicted) == 1, label, [group])
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    return counts.select(
        F.col(group).cast("string").alias("group"),
        (tn + fp + fn + tp).alias("n_samples"),
        _share(tp, fn).alias("TPR"),
        _share(fp, tn).alias("FPR"),
        _share(tp, fp).alias("PPV"),
        _share(tn, fn).alias("NPV"),
    )


def parity_gaps(metrics: DataFrame, by: Sequence[str] = (), min_groups: int = 2) -> DataFrame:
    """Largest difference of each rate between groups; null with fewer than ``min_groups`` non-null groups."""
    return metrics.groupBy(*by).agg(
        *[F.when(F.count(m) >= min_groups, F.max(m) - F.min(m)).alias(f"{m}_gap") for m in RATES]
    )


def outcome_rates(df: DataFrame, by: Sequence[str], outcome: str = "is_dropout_point", user: str = "user_id") -> DataFrame:
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_distinct(user).alias("n_unique_users"),
        F.avg(outcome).alias("dropout_point_rate"),
        F.sum(outcome).alias("_positive"),
        F.count(outcome).alias("_known"),
    )


def _with_reference(cells: DataFrame, scope: Window, rate: str, gap: str, ratio: str) -> DataFrame:
    reference = F.sum("_positive").over(scope) / F.sum("_known").over(scope)
    return (
        cells.withColumn(rate, reference)
        .withColumn(gap, F.col("dropout_point_rate") - F.col(rate))
        .withColumn(ratio, F.col("dropout_point_rate") / F.nullif(F.col(rate), F.lit(0.0)))
        .drop("_positive", "_known")
    )


def outcome_by_cluster_group(
    df: DataFrame,
    group: str,
    cluster: str = "spectral_eucl",
    outcome: str = "is_dropout_point",
    user: str = "user_id",
    min_n: int = MIN_GROUP,
) -> DataFrame:
    """Outcome of every well supported (cluster, group) cell against its cluster's own rate.

    The raw rows are aggregated once; cluster rates come from the cells, small ones included.
    """
    named = df.filter(F.col(cluster).isNotNull())
    cells = _with_reference(
        outcome_rates(named, [cluster, group], outcome, user),
        Window.partitionBy(cluster),
        "cluster_rate",
        "rate_gap_vs_cluster",
        "disparity_ratio_vs_cluster",
    )
    note = F.when(F.col("n_unique_users") < min_n, F.lit("low unique-user support")).otherwise(F.lit(""))
    supported = (F.col("n_rows") >= min_n) & F.col(group).isNotNull()
    return cells.filter(supported).withColumn("support_note", note)


def disparity_flags(tables: dict[str, DataFrame], cluster: str = "spectral_eucl") -> DataFrame:
    """Cells outside the accepted disparity range, per attribute, with a reading note."""
    out = None
    for attribute, table in tables.items():
        part = table.withColumn("attribute", F.lit(attribute)).withColumnRenamed(attribute, "group")
        out = part if out is None else out.unionByName(part)
    ratio = F.col("disparity_ratio_vs_cluster")
    note = (
        F.when(F.lower("group") == "unknown", F.lit("Unknown category: interpret mainly as missingness / data-quality signal"))
        .when(F.col("support_note") != "", F.lit("Small unique-user support: interpret cautiously"))
        .otherwise(F.lit(""))
    )
    return (
        out.filter((ratio < DISPARITY_LOW) | (ratio > DISPARITY_HIGH))
        .withColumn("interpretation_note", note)
        .drop("support_note")
        .orderBy("disparity_ratio_vs_cluster")
    )


def disparate_impact(df: DataFrame, cluster: str, group: str, outcome: str = "is_dropout_point") -> DataFrame:
    """Outcome rate of each (cluster, group) relative to the overall rate of the table."""
    cells = df.groupBy(cluster, group).agg(
        F.count(F.lit(1)).alias("n_users"),
        F.avg(outcome).alias("outcome_rate"),
        F.sum(outcome).alias("_positive"),
        F.count(outcome).alias("_known"),
    )
    cells = cells.filter(F.col(cluster).isNotNull() & F.col(group).isNotNull())

    def pooled(scope: Window) -> Column:
        return F.sum("_positive").over(scope) / F.sum("_known").over(scope)

    overall = pooled(Window.partitionBy(F.lit(0)))  # one row per cell
    return cells.select(
        cluster,
        group,
        "n_users",
        "outcome_rate",
        (F.col("outcome_rate") / F.nullif(overall, F.lit(0.0))).alias("disparity_ratio"),
        pooled(Window.partitionBy(cluster)).alias("cluster_overall_rate"),
    )


def composition(df: DataFrame, group: str, cluster: str) -> DataFrame:
    """Counts and percentages within each cluster."""
    named = df.filter(F.col(group).isNotNull() & F.col(cluster).isNotNull())
    cells = named.groupBy(cluster, group).agg(F.count(F.lit(1)).alias("n"))
    return cells.withColumn("pct", F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy(cluster)))


def intersectional_outcome(df: DataFrame, groups: Sequence[str], outcome="is_dropout_point", min_n: int = MIN_GROUP) -> DataFrame:
    named = df.dropna(subset=list(groups))
    cells = outcome_rates(named, groups, outcome).drop("_positive", "_known")
    return cells.filter(F.col("n_rows") >= min_n).orderBy(F.desc("dropout_point_rate"), *groups)


def cluster_summary(df: DataFrame, cluster: str, outcome: str = "is_dropout_point") -> DataFrame:
    rates = outcome_rates(df, [cluster], outcome).drop("_positive", "_known")
    return rates.withColumns(
        {
            "non_dropout_point_rate": 1 - F.col("dropout_point_rate"),
            "rows_per_user": F.col("n_rows") / F.col("n_unique_users"),
        }
    )


def sample_representativeness(full: DataFrame, sample: DataFrame, column: str) -> DataFrame:
    """Share of each value in the full table and in the sample, in percent, and the difference."""

    def shares(df: DataFrame, out: str) -> DataFrame:
        counts = df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("_n"))
        return counts.select(column, (F.col("_n") * 100.0 / F.sum("_n").over(Window.partitionBy(F.lit(0)))).alias(out))

    joined = shares(full, "full_pct").join(shares(sample, "sample_pct"), column, "outer")
    gap = F.col("sample_pct") - F.col("full_pct")
    return joined.fillna(0.0).withColumn("percentage_point_gap", gap).orderBy(F.desc(F.abs(gap)), column)


def coverage_summary(full: DataFrame, rows: DataFrame, user: str = "user_id") -> DataFrame:
    """Size of the full table and of the clustered rows, and how much of the users the latter cover."""
    a = full.agg(F.count(F.lit(1)).alias("n"), F.count_distinct(user).alias("u")).select(F.lit("full").alias("side"), "n", "u")
    b = rows.agg(F.count(F.lit(1)).alias("n"), F.count_distinct(user).alias("u")).select(F.lit("rows").alias("side"), "n", "u")

    def of(side: str, c: str) -> Column:
        return F.max(F.when(F.col("side") == side, F.col(c))).cast("double")

    values = {
        "Stage 1 demographic rows": of("full", "n"),
        "Stage 1 unique users": of("full", "u"),
        "Stage 2 clustered trajectory rows": of("rows", "n"),
        "Stage 2 clustered unique users": of("rows", "u"),
        "Unique-user coverage rate": of("rows", "u") / of("full", "u"),
        "Mean trajectory rows per clustered user": of("rows", "n") / of("rows", "u"),
    }
    wide = a.unionByName(b).agg(*[v.alias(k) for k, v in values.items()])
    return wide.unpivot([], [F.col(f"`{k}`") for k in values], "metric", "value")


# --- independence --------------------------------------------------------------------------------------------------


def contingency(df: DataFrame, methods: Sequence[str], attributes: Sequence[str]) -> DataFrame:
    """Counts of every (method, cluster, attribute, group) from a single aggregation of the raw rows."""
    base = df.groupBy(*methods, *attributes).agg(F.count(F.lit(1)).alias("n"))
    pairs = [
        F.struct(
            F.lit(m).alias("method"),
            F.col(m).cast("string").alias("cluster"),
            F.lit(a).alias("attribute"),
            F.col(a).cast("string").alias("group"),
            F.col("n").alias("n"),
        )
        for m in methods
        for a in attributes
    ]
    cells = base.select(F.explode(F.array(*pairs)).alias("c")).select("c.*")
    cells = cells.filter(F.col("cluster").isNotNull() & F.col("group").isNotNull())
    return cells.groupBy("method", "cluster", "attribute", "group").agg(F.sum("n").alias("n"))


def chi_square(cells: DataFrame) -> DataFrame:
    """Chi-square statistic, degrees of freedom and Cramer's V per (method, attribute), from the seen cells alone.

    An empty cell adds its expected value, and all expected values add up to the total, so empty cells add the total
    less the expected values of the seen ones. The continuity correction applies to 2 x 2 tables, where all four
    differences are equal and the inverse expected values add up to n^3 over the product of the four margins.
    """
    test = ["method", "attribute"]
    counted = cells.withColumns(
        {
            "_row": F.sum("n").over(Window.partitionBy(*test, "cluster")).cast("double"),
            "_col": F.sum("n").over(Window.partitionBy(*test, "group")).cast("double"),
            "_n": F.sum("n").over(Window.partitionBy(*test)),
        }
    ).withColumn("_expected", F.col("_row") * F.col("_col") / F.col("_n"))
    expected = F.col("_expected")
    diff = F.abs(F.col("n") - expected)
    margins = F.max("_row") * F.min("_row") * F.max("_col") * F.min("_col")
    corrected = F.max(diff) - F.least(F.lit(0.5), F.max(diff))
    cube = F.max("_n").cast("double") * F.max("_n") * F.max("_n")
    out = counted.groupBy(*test).agg(
        (F.sum(diff * diff / expected) + F.max("_n") - F.sum(expected)).alias("_plain"),
        (corrected * corrected * cube / margins).alias("_yates"),
        F.count_distinct("cluster").alias("_r"),
        F.count_distinct("group").alias("_c"),
        F.max("_n").alias("_n"),
    )
    dof = (F.col("_r") - 1) * (F.col("_c") - 1)
    smaller = F.least("_r", "_c") - 1
    chi2 = F.when(dof == 1, F.col("_yates")).when(dof == 0, F.lit(0.0)).otherwise(F.col("_plain"))
    return out.select(
        *test,
        chi2.alias("chi2"),
        dof.alias("dof"),
        F.when(smaller > 0, F.sqrt(chi2 / (F.col("_n") * smaller))).alias("cramers_v"),
    )


FRACTION_STEPS = 200
SERIES_STEPS = 60


def _half_tail(half: Column) -> Column:
    """erfc(sqrt(half)): the upper incomplete gamma function of order 1/2 over its whole, by series or continued fraction."""
    steps = lambda n: F.sequence(F.lit(1), F.lit(n))
    front = F.sqrt(half / F.pi()) * F.exp(-half)
    start = F.struct(F.lit(2.0).alias("term"), F.lit(2.0).alias("total"))

    def longer(s: Column, k: Column) -> Column:
        term = s["term"] * half / (k + F.lit(0.5))
        return F.struct(term.alias("term"), (s["total"] + term).alias("total"))

    below = front * F.aggregate(steps(SERIES_STEPS), start, longer, lambda s: s["total"])
    last = half + F.lit(2 * FRACTION_STEPS + 0.5)
    bottom = F.aggregate(steps(FRACTION_STEPS), last, lambda f, k: half + 2 * (FRACTION_STEPS - k) + 0.5 - (FRACTION_STEPS - k + 1) * (FRACTION_STEPS - k + 0.5) / f)
    return F.when(half < 1.5, 1 - below).otherwise(front / bottom)


def chi_square_survival(statistic: Column, dof: Column) -> Column:
    """P(X >= statistic) of a chi-square variable: a finite series, for odd dof after the tail of one degree of freedom.

    Terms are summed with their logarithms carried along, so they neither overflow nor vanish early.
    """
    half = statistic.cast("double") / 2
    odd = dof % 2 == 1
    first = F.when(odd, -half + F.log(half) / 2 - F.log(F.sqrt(F.pi()) / 2)).otherwise(-half)
    start = F.struct(F.lit(0.0).alias("total"), first.alias("log"))

    def longer(s: Column, i: Column) -> Column:
        return F.struct((s["total"] + F.exp(s["log"])).alias("total"), (s["log"] + F.log(half) - F.log(i + F.when(odd, 0.5).otherwise(0.0))).alias("log"))

    terms = F.when(dof >= 2, F.sequence(F.lit(1).cast("long"), F.floor(dof / 2))).otherwise(F.array().cast("array<bigint>"))
    tail = F.aggregate(terms, start, longer, lambda s: s["total"]) + F.when(odd, _half_tail(half)).otherwise(0.0)
    return F.when((dof <= 0) | (half <= 0), F.lit(1.0)).otherwise(F.least(tail, F.lit(1.0)))


def chi_square_test(df: DataFrame, methods: Sequence[str], attributes: Sequence[str], level: float = 0.05) -> DataFrame:
    """``chi_square`` with p-value and significance; one row per (method, attribute)."""
    tests = chi_square(contingency(df, methods, attributes)).withColumn("p_value", chi_square_survival(F.col("chi2"), F.col("dof")))
    return tests.withColumn("significant", F.col("p_value") < level)


def method_cluster_summary(df: DataFrame, methods: Sequence[str], outcome="is_dropout_point", user="user_id") -> DataFrame:
    """Cluster sizes and outcome rates of several partitions in one pass."""
    long = df.select(
        user, outcome, F.explode(F.array(*[F.struct(F.lit(m).alias("method"), F.col(m).alias("cluster_label")) for m in methods])).alias("c")
    ).select(user, outcome, "c.*")
    return outcome_rates(long, ["method", "cluster_label"], outcome, user).drop("_positive", "_known")


# --- engagement ----------------------------------------------------------------------------------------------------


def engagement_score(df: DataFrame, columns: Sequence[str], out: str = "engagement_score") -> DataFrame:
    """Mean of the columns, each divided by its maximum (0 where the maximum is not positive)."""
    tops = df.agg(*[F.max(F.coalesce(F.col(c).cast("double"), F.lit(0.0))).alias(c) for c in columns]).first()
    total = F.lit(0.0)
    for c in columns:
        if tops[c] is not None and tops[c] > 0:
            total = total + F.coalesce(F.col(c).cast("double"), F.lit(0.0)) / F.lit(tops[c])
    return df.withColumn(out, total / len(columns))


def tercile_level(df: DataFrame, score: str, out: str = "engagement_level") -> DataFrame:
    """Low / Medium / High by right-closed exact terciles; null scores stay null, equal cut points collapse."""
    q = exact_quantiles(df, [score], [0.0, 1 / 3, 2 / 3, 1.0])[score]
    if q[0] is None:
        return df.withColumn(out, F.lit(None).cast("string"))
    low, high = q[1], q[2]
    level = F.when(F.col(score) <= low, "Low").when(F.col(score) <= high, "Medium").when(F.col(score).isNotNull(), "High")
    return df.withColumn(out, level)


def engagement_by_cluster(df: DataFrame, cluster: str, score: str = "engagement_score") -> DataFrame:
    stats = df.groupBy(cluster).agg(F.count(score).alias("count"), F.avg(score).alias("mean"), F.stddev_samp(score).alias("std"))
    return stats.withColumn("cv", F.col("std") / F.nullif(F.col("mean"), F.lit(0.0)))


def outcome_crosstab(df: DataFrame, rows: str, column: str, values: Sequence[str], outcome="is_dropout_point") -> DataFrame:
    """Mean outcome with one column per value of ``column``."""
    named = df.filter(F.col(rows).isNotNull())
    return named.groupBy(rows).pivot(column, list(values)).agg(F.avg(outcome))


def outcome_pivot(table: DataFrame, cluster: str, group: str, values: Sequence[str], value="dropout_point_rate") -> DataFrame:
    return table.groupBy(cluster).pivot(group, list(values)).agg(F.first(value))


def top_category_bucket(df: DataFrame, column: str, out: str, n: int = 8, other: str = "Other") -> DataFrame:
    """Keep the ``n`` most frequent categories and call the rest ``other``."""
    top = df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("_n"))
    top = top.orderBy(F.desc("_n"), column).limit(n).select(column, F.col(column).alias("_kept"))
    return df.join(F.broadcast(top), column, "left").withColumn(out, F.coalesce("_kept", F.lit(other))).drop("_kept")
