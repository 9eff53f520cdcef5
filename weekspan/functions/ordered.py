"""Ordered computations over groups of any size.

A plain window sorts one whole group in one task. The helpers here cut a group into buckets that follow the order,
work inside the buckets, and carry the small per-bucket results across with a second window. Results are exact and
equal to the plain window's; a key that owns a third of all rows is spread over as many tasks as it has buckets.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weekspan.functions.hashing import HASH_BITS, hash32

SLICE_BITS = 12
ROWS_A_SLICE = 200_000


def _before(keys: Sequence[str], order: str) -> Window:
    scope = list(keys) or [F.lit(0)]
    return Window.partitionBy(*scope).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)


def previous_value(
    df: DataFrame, keys: Sequence[str], bucket: Column, order: Sequence[str], value: str, out: str
) -> DataFrame:
    """``lag(value)`` per key in ``order``; ``bucket`` must not decrease along that order."""
    cut = df.withColumn("_bucket", bucket)
    group = [*keys, "_bucket"]
    inside = Window.partitionBy(*group).orderBy(*order)
    last = cut.groupBy(*group).agg(F.max_by(value, F.struct(*order)).alias("_last"))
    carried = last.withColumn("_carry", F.lag("_last").over(Window.partitionBy(*keys).orderBy("_bucket"))).drop("_last")
    return (
        cut.withColumn("_first", F.row_number().over(inside) == 1)
        .withColumn("_prev", F.lag(value).over(inside))
        .join(carried, group, "left")
        .withColumn(out, F.when(F.col("_first"), F.col("_carry")).otherwise(F.col("_prev")))
        .drop("_bucket", "_first", "_prev", "_carry")
    )


def hash_rank(
    df: DataFrame, key: str | Sequence[str], seed: str | int, by: Sequence[str] = (), out: str = "rank", bits: int = 12
) -> DataFrame:
    """0-based rank of every row in hashed order within its stratum ``by``, and the stratum's size ``<out>_of``.

    ``key`` must identify a row. Strata are cut by the leading ``bits`` of the hash, so even a single stratum is
    ranked by 2**bits independent tasks. The offsets hold at most 2**bits rows for each stratum and are broadcast:
    ``by`` is meant for label-like columns.
    """
    keys = [key] if isinstance(key, str) else list(key)
    cut = df.withColumn("_hash", hash32(keys, seed)).withColumn("_bucket", F.shiftright("_hash", HASH_BITS - bits))
    sizes = cut.groupBy(*by, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    scope = list(by) or [F.lit(0)]
    offsets = sizes.select(
        *[F.col(b).alias(f"_by_{b}") for b in by],
        F.col("_bucket").alias("_at"),
        F.coalesce(F.sum("_n").over(_before(by, "_bucket")), F.lit(0)).alias("_offset"),
        F.sum("_n").over(Window.partitionBy(*scope)).alias(f"{out}_of"),
    )
    match = F.col("_bucket") == F.col("_at")
    for b in by:
        match = match & F.col(b).eqNullSafe(F.col(f"_by_{b}"))
    inside = Window.partitionBy(*by, "_bucket").orderBy("_hash", *keys)
    return (
        cut.withColumn("_rank", F.row_number().over(inside) - 1)
        .join(F.broadcast(offsets), match)
        .withColumn(out, F.col("_rank") + F.col("_offset"))
        .drop("_hash", "_bucket", "_rank", "_offset", "_at", *[f"_by_{b}" for b in by])
    )


def _hash_cuts(hashed: DataFrame, by: Sequence[str], cuts: Callable[[tuple, int], Sequence[int]], rows_a_slice: int) -> dict[tuple, list[tuple[int, int, int]]]:
    """For every stratum, the hash slice (first, end) in which each cut falls and how many rows of it lie before the cut.

    A histogram of the leading hash bits finds the slices; those with more than ``rows_a_slice`` rows are divided again.
    Counts per stratum and slice come to the driver: ``by`` is meant for label-like columns.
    """

    def histogram(bits: int, where: Column) -> dict[tuple, dict[int, int]]:
        found: dict[tuple, dict[int, int]] = {}
        for r in hashed.filter(where).groupBy(*by, F.shiftright("_hash", HASH_BITS - bits).alias("_slice")).count().collect():
            found.setdefault(tuple(r)[: len(by)], {})[r["_slice"]] = r["count"]
        return found

    bits, out, open_cuts = SLICE_BITS, {}, []
    for stratum, slices in histogram(bits, F.lit(True)).items():
        out[stratum] = []
        for place, rank in enumerate(cuts(stratum, sum(slices.values()))):
            out[stratum].append((0, 0, 0))
            open_cuts.append((stratum, place, rank, slices))
    while open_cuts:
        waiting = []
        for stratum, place, rank, slices in open_cuts:
            before = 0
            for at in sorted(slices):
                if before + slices[at] > rank:
                    break
                before += slices[at]
            else:
                out[stratum][place] = (1 << HASH_BITS, 1 << HASH_BITS, 0)  # all rows lie before the cut
                continue
            width = HASH_BITS - bits
            out[stratum][place] = (at << width, at + 1 << width, rank - before)
            if slices[at] > rows_a_slice and bits < HASH_BITS and 0 < rank - before:
                waiting.append((stratum, place, rank - before, at))
        if not waiting:
            break
        finer = min(bits + SLICE_BITS, HASH_BITS)
        inside = F.lit(False)
        for at in sorted({w[3] for w in waiting}):
            inside = inside | (F.shiftright("_hash", HASH_BITS - bits) == at)
        counts, step = histogram(finer, inside), finer - bits
        open_cuts = [(stratum, place, rank, {x: n for x, n in counts[stratum].items() if x >> step == at}) for stratum, place, rank, at in waiting]
        bits = finer
    return out


def hash_parts(
    df: DataFrame, key: str | Sequence[str], seed: str | int, cuts: Callable[[tuple, int], Sequence[int]], by: Sequence[str] = (), out: str = "part", rows_a_slice: int = ROWS_A_SLICE
) -> DataFrame:
    """Number of cuts at or before every row's rank in hashed order within its stratum ``by``: 0 before the first cut.

    ``cuts`` gives increasing ranks for a stratum and its number of rows; ``key`` must identify a row. Only the rows of the hash
    slices in which a cut falls are ordered, one slice of at most about ``rows_a_slice`` rows per task.
    """
    keys = [key] if isinstance(key, str) else list(key)
    hashed = df.withColumn("_hash", hash32(keys, seed))
    found = _hash_cuts(hashed, by, cuts, rows_a_slice)
    limits = F.array().cast("array<struct<first:bigint,end:bigint,need:bigint>>")
    for stratum, places in found.items():
        here = F.lit(True)
        for c, v in zip(by, stratum, strict=True):
            here = here & F.col(c).eqNullSafe(F.lit(v))
        listed = F.array(*[F.struct(F.lit(a).cast("long").alias("first"), F.lit(b).cast("long").alias("end"), F.lit(n).cast("long").alias("need")) for a, b, n in places])
        limits = F.when(here, listed.cast("array<struct<first:bigint,end:bigint,need:bigint>>")).otherwise(limits)
    placed = hashed.withColumn("_cuts", limits)
    h = F.col("_hash")
    met = F.filter("_cuts", lambda c: (h >= c["first"]) & (h < c["end"]))
    cut = placed.withColumn("_slice", F.get(met, 0)["first"])
    plain = cut.filter("_slice is null").withColumn(out, F.size(F.filter("_cuts", lambda c: h >= c["end"])))
    inner = F.row_number().over(Window.partitionBy(*by, "_slice").orderBy("_hash", *keys)) - 1
    ranked = cut.filter("_slice is not null").withColumn("_inner", inner)
    passed = F.filter("_cuts", lambda c: (h >= c["end"]) | ((h >= c["first"]) & (F.col("_inner") >= c["need"])))
    ranked = ranked.withColumn(out, F.size(passed)).drop("_inner")
    return plain.unionByName(ranked).drop("_hash", "_cuts", "_slice")


def grouped_median(df: DataFrame, keys: Sequence[str], value: str, width: float, out: str) -> DataFrame:
    """Exact median per key of a value with a bounded range, by counting buckets of ``width`` first.

    Only the one or two buckets that hold the middle ranks are sorted, so no task ever sees a whole group. Keys
    without any value are absent from the result.
    """
    seen = df.filter(F.col(value).isNotNull())
    counts = seen.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n")).withColumn(
        "_bucket", F.floor(F.col(value) / F.lit(width))
    )
    group = [*keys, "_bucket"]
    buckets = (
        counts.groupBy(*group)
        .agg(F.sum("_n").alias("_size"))
        .withColumn("_offset", F.coalesce(F.sum("_size").over(_before(keys, "_bucket")), F.lit(0)))
        .withColumn("_total", F.sum("_size").over(Window.partitionBy(*keys)))
        .withColumn("_low", F.floor((F.col("_total") - 1) / 2))
        .withColumn("_high", F.ceil((F.col("_total") - 1) / 2))
        .filter((F.col("_high") >= F.col("_offset")) & (F.col("_low") < F.col("_offset") + F.col("_size")))
        .select(*group, "_offset", "_low", "_high")
    )
    inside = Window.partitionBy(*group).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    end = F.col("_offset") + F.sum("_n").over(inside)
    middle = counts.join(buckets, group).withColumn("_end", end).withColumn("_start", F.col("_end") - F.col("_n"))

    def at(rank: str) -> Column:
        return F.max(F.when((F.col("_start") <= F.col(rank)) & (F.col(rank) < F.col("_end")), F.col(value)))

    return (
        middle.groupBy(*keys)
        .agg(at("_low").alias("_a"), at("_high").alias("_b"))
        .select(*keys, ((F.col("_a") + F.col("_b")) / 2).alias(out))
    )
