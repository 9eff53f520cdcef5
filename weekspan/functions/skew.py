"""Joins that stay balanced when a few keys own much of the large side."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROWS_PER_TASK = 5_000_000


def attach(
    big: DataFrame, lookup: DataFrame, key: str, spread: Sequence[str], rows_per_task: int = ROWS_PER_TASK, sizes: DataFrame | None = None
) -> DataFrame:
    """Left join of a one-row-per-key ``lookup`` onto ``big``.

    Keys with more than ``rows_per_task`` rows are cut into that many slices by a hash of the ``spread`` columns and
    their lookup row is copied once per slice. The list of such keys is broadcast: it cannot hold more than
    rows / rows_per_task entries. Without hot keys the plan is an ordinary join on the key. ``sizes`` holds the number
    of rows ``_n`` of every key where that is known already; else ``big`` is counted in a pass of its own.
    """
    sizes = sizes if sizes is not None else big.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    hot = (
        sizes.filter((F.col("_n") > rows_per_task) & F.col(key).isNotNull())
        .select(key, F.ceil(F.col("_n") / rows_per_task).cast("int").alias("_slices"))
    )
    slices = F.coalesce(F.col("_slices"), F.lit(1))
    left = (
        big.join(F.broadcast(hot), key, "left")
        .withColumn("_slice", F.pmod(F.xxhash64(*spread), slices).cast("int"))
        .drop("_slices")
    )
    right = (
        lookup.join(F.broadcast(hot), key, "left")
        .withColumn("_slice", F.explode(F.sequence(F.lit(0), slices - 1)))
        .drop("_slices")
    )
    return left.join(right, [key, "_slice"], "left").drop("_slice")
