"""Sharding by proportional stratified interleaving, in DataFrame functions alone.

Rows of each source are put in a seeded random order; a row's fractional rank is its middle position in that order
divided by the size of the source. Sorting all rows by fractional rank interleaves the sources in proportion, so every
run of the sorted sequence matches the mixture, and the sequence is cut into shards whose row counts differ by at most
one (law ``rows``).

Both orders are found without ordering a source, or the table, in one task. A source is cut into slices by leading
bits of the random key, the sequence into slices of equal fraction; rows are numbered inside a slice, and the slices of
a source are chained by their row counts. A source with a third of all rows is just cut into that many slices. Only
narrow rows (no text) are shuffled.

Defined cases: a null source is a source of its own; a null text has size 1 and the checksum of no bytes; null keys are
an ordinary key; rows equal in key and text are interchangeable and each gets its own place; an empty table gives no rows.
Other columns are not read, so their names may clash with those of the result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SHARDS = 8
SEED = "interleave-1"
ROWS_PER_SLICE = 250_000
LEAST_SLICES = 4_096
KEY_HEX = 8  # the random key is read as this many hex digits


def random_key(key: str, seed: str) -> Column:
    """md5 of the seed and the key: repeatable in any partitioning and in SQL."""
    return F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col(key).cast("string"), F.lit("null"))).cast("binary"))


def slices_for(rows: int) -> int:
    """A power of two: each slice of the whole sequence has at most about ROWS_PER_SLICE rows."""
    n = LEAST_SLICES
    while n * ROWS_PER_SLICE < rows and n < 1 << 24:
        n *= 2
    return n


def numbered(df: DataFrame, by: list[str], piece: str, order: list[Column], into: str) -> DataFrame:
    """Adds the 0-based position in the order (``piece``, ``order``) within each ``by``, and the size ``_of`` of each.

    Slices are numbered apart and chained by their counts; both sides of the join are dealt by (``by``, ``piece``).
    """
    counts = df.groupBy(*by, piece).agg(F.count(F.lit(1)).alias("_n"))
    chained = Window.partitionBy(*by).orderBy(piece).rowsBetween(Window.unboundedPreceding, -1)
    before = counts.withColumn("_before", F.coalesce(F.sum("_n").over(chained), F.lit(0))).withColumn("_of", F.sum("_n").over(Window.partitionBy(*by))).drop("_n")
    inside = F.row_number().over(Window.partitionBy(*by, piece).orderBy(*order))
    ranked = df.withColumn("_inside", inside)
    return ranked.join(before, [*by, piece]).withColumn(into, F.col("_before") + F.col("_inside") - 1).drop("_before", "_inside")


def interleave(df: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", shards: int = SHARDS, seed: str = SEED) -> DataFrame:
    """One row per row of ``df``: key, size, text_crc32, law, shard, slot, grown_shard (null: the law is not ``key``)."""
    if shards < 1:
        raise ValueError("shards must be positive")
    content = F.coalesce(F.col(text), F.lit(""))
    rows = df.select(
        F.col(key),
        (F.octet_length(content) + 1).cast("long").alias("size"),
        F.crc32(content.cast("binary")).alias("text_crc32"),
        F.when(F.col(source).isNull(), F.lit("0")).otherwise(F.concat(F.lit("1"), F.col(source).cast("string"))).alias("_stratum"),
        random_key(key, seed).alias("_key"),
    )
    total = df.count()
    slices = slices_for(total)
    tie = [F.col(key).asc_nulls_first(), F.col("text_crc32"), F.col("size")]
    rows = rows.withColumn("_slice", F.floor(F.conv(F.substring("_key", 1, KEY_HEX), 16, 10).cast("long") * F.lit(slices) / F.lit(16**KEY_HEX)).cast("long"))
    rows = numbered(rows, ["_stratum"], "_slice", [F.col("_key"), *tie], "_rank")
    fraction = (2 * F.col("_rank") + 1).cast("double") / (2 * F.col("_of")).cast("double")
    rows = rows.withColumn("_fraction", fraction).withColumn("_slice", F.floor(F.col("_fraction") * slices).cast("long")).drop("_of")
    rows = numbered(rows.withColumn("_all", F.lit(0)), ["_all"], "_slice", [F.col("_fraction"), F.col("_stratum"), F.col("_rank")], "_place")
    first = F.expr(f"(cast(_shard as long) * {total} + {shards - 1}) div {shards}")
    return rows.withColumn("_shard", F.expr(f"_place * {shards} div {max(total, 1)}")).select(
        key, "size", "text_crc32", F.lit("rows").alias("law"), F.col("_shard").cast("int").alias("shard"),
        (F.col("_place") - first).alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )
