"""Sequence queries in the size they must run at: no dense shuffle, no row per cell, draws computed once."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from weekspan.catalog import sequences as catalog
from weekspan.functions import arrays, hashing
from weekspan.operators import augment as A
from weekspan.operators import timeline

KEYS = ["user_id", "target_week"]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def sequences(spark, users=3, odd=False):
    df = spark.range(users * 4).selectExpr("id % 4 + 20 as target_week", "id div 4 as user_id", "cast(id % 2 as double) as label")
    cell = "cast(user_id * 100 + target_week + t * 10 + f as double)"
    df = df.withColumn("seq", F.expr(f"transform(sequence(0, 11), t -> transform(sequence(0, 2), f -> {'if(f = 1 and t = 3, null, ' + cell + ')' if odd else cell}))"))
    return df.localCheckpoint()


def test_weeks_are_made_after_the_last_shuffle(spark):
    data = [(1, 2, 5), (1, 4, 7), (1, -1, 9), (2, 0, 1), (3, -2, 1), (None, 1, 3), (None, 1, 4), (4, 1, 6), (4, 1, 8)]
    weekly = spark.createDataFrame(data, "user_id long, relative_week long, n long")
    last = weekly.groupBy("user_id").agg(F.max("relative_week").alias("_last")).filter("_last >= 0")
    spine = last.select("user_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_last"))).alias("relative_week"))
    expected = spine.join(weekly, ["user_id", "relative_week"], "left")  # dense rows joined to sparse ones
    got = timeline.weekly_timeline(timeline.deal_users(weekly, 2))
    text = plan(got)
    assert text.count("Exchange") == 1 and "Join" not in text
    assert got.columns == expected.columns
    assert sorted(map(repr, got.collect())) == sorted(map(repr, expected.collect()))


def test_sparse_rows_are_dealt_by_the_weeks_between_them(spark):
    weekly = spark.createDataFrame([(u, w, 1) for u in range(40) for w in (0, 99)], "user_id long, relative_week long, n long")
    assert timeline.deal_users(weekly, 500).rdd.getNumPartitions() == 8


@pytest.mark.parametrize("odd", [False, True])
def test_checksum_without_a_row_per_cell(spark, odd):
    df = sequences(spark, odd=odd).withColumn("seq", F.when(F.col("target_week") == 23, F.slice("seq", 1, F.col("user_id").cast("int"))).otherwise(F.col("seq")))
    cells = df.select("user_id", "label", "target_week", F.posexplode(F.flatten("seq")).alias("i", "x"))
    expected = cells.groupBy("user_id").agg(F.count_if(F.col("i") == 0), F.expr("sum(if(i = 0, label, 0))"), F.min("target_week"), F.max("target_week"), F.expr(f"sum(x * (i % 97 + 1)) / {catalog.SCALE}"))
    got = catalog.condensed(df)
    assert "Generate" not in plan(got)
    a, b = ({r[0]: list(r)[1:] for r in t.collect()} for t in (expected, got))
    assert a.keys() == b.keys() and all(np.allclose(a[k], b[k]) for k in a)


def test_masked_weeks_follow_the_smallest_hashes(spark):
    df = sequences(spark)
    masked = A.mask_weeks(F.col("seq"), KEYS, "s", 12, 3, 3)
    text = masked._jc.toString()
    assert "conv" not in text  # hex digits are compared as they are
    draws = F.transform(F.sequence(F.lit(0), F.lit(11)), lambda t: hashing.uniform([*map(F.col, KEYS), t], "s|mask"))
    for r in df.select(draws.alias("d"), "seq", masked.alias("m")).collect():
        gone = set(np.argsort(r["d"], kind="stable")[:3])
        assert r["m"] == [[0.0] * 3 if t in gone else r["seq"][t] for t in range(12)]


@pytest.mark.parametrize("seed", ["s", "a seed of many more than thirty-two bytes"])
def test_jitter_draws_are_those_of_the_expressions(spark, seed):
    df = sequences(spark, odd=True).withColumn("seq", F.when(F.col("target_week") != 22, F.col("seq")))
    cols = [F.col(k) for k in KEYS]
    each = F.transform("seq", lambda week, t: F.transform(week, lambda v, f: v + F.lit(0.03) * hashing.gaussian([*cols, t, f], f"{seed}|jitter")))
    got = df.select("seq", each.alias("a"), A.jitter(F.col("seq"), KEYS, seed).alias("b"), A.jitter(F.col("seq"), KEYS, seed, wanted=F.col("label") == 1).alias("c"), "label")
    assert "ArrowEvalPython" in plan(got)
    for r in got.collect():
        if r["seq"] is None:
            assert r["a"] is None and r["b"] is None and r["c"] is None
            continue
        a, b, c, s = (np.array(r[x], float) for x in ("a", "b", "c", "seq"))
        assert np.allclose(a, b, rtol=0, atol=1e-9, equal_nan=True)
        assert np.allclose(c, a if r["label"] == 1 else s, rtol=0, atol=1e-9, equal_nan=True)


def test_moved_cells_are_counted_as_they_were(spark):
    df = sequences(spark, odd=True).withColumn("before", F.col("seq")).withColumn("seq", A.jitter(F.col("seq"), KEYS, "s"))
    pairs = F.zip_with(F.flatten("before"), F.flatten("seq"), lambda a, b: F.abs(a - b))
    count = lambda bound: F.sum(F.size(F.filter(pairs, lambda v: v > bound)))
    expected = df.groupBy("user_id").agg(count(0).alias("m"), count(0.05).alias("f")).collect()
    got = catalog.moved(df, bound=0.05).collect()
    assert sorted((r["user_id"], r["n_moved"], r["n_far"]) for r in got) == sorted(map(tuple, expected))


def test_l2_norms_are_computed_once_a_row(spark):
    """Inside the function over the weeks they were computed again for every week."""
    text = plan(sequences(spark, odd=True).select(arrays.l2_normalize("seq", 3).alias("x")))
    assert text.index("aggregate(") < text.index("transform(seq")
