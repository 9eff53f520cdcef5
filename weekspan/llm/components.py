"""Connected components by rounds of random contraction, every round a few Spark aggregations and joins.

In a round each node moves to the neighbour (or itself) with the smallest random draw, edges follow and loops and
repetitions vanish. The draws change from round to round, so a constant share of the nodes disappears in each and the
number of rounds grows with the logarithm of the largest component, whatever its shape. The moves and the edges still
alive are written to the shared folder in each round, in files of about ``ROWS_A_FILE`` rows, so lost executors cost one
round; a node's root follows from joins with the stored moves.

A node with very many neighbours is only met by map-side combined minima and by joins with one row per key on the other
side, which Spark may split. Loops, repeated edges and both directions of an edge are allowed; null ends are dropped; no
edges give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weekspan.session import durable

ROUNDS = 60
ROWS_A_FILE = 200_000
LEAST_FILES = 12
HOT_KEYS = 2_000
LEAST_HOT = 256


def stored(df: DataFrame, rows: int, rows_a_file: int = ROWS_A_FILE) -> DataFrame:
    """A durable table of about ``rows`` rows in few files, made by as many tasks."""
    return durable(df.coalesce(max(LEAST_FILES, -(-rows // rows_a_file))))


def hot_rows(rows: int) -> int:
    """From how many rows on a component counts as large: at most ``HOT_KEYS`` components of ``rows`` rows are."""
    return max(LEAST_HOT, -(-rows // HOT_KEYS))


def connected_components(edges: DataFrame, u: str = "u", v: str = "v", rows: int | None = None) -> DataFrame:
    """(node, root) for every node of the edges; nodes have the same root exactly if a path joins them.

    ``rows`` is a bound on the number of edges, where one is known; it only sizes the stored files.
    """
    ends = edges.select(F.col(u).alias("u"), F.col(v).alias("v")).filter("u is not null and v is not null").distinct()
    ends = durable(ends) if rows is None else stored(ends, rows)
    alive = ends.filter("u <> v")
    places = ends.select(F.explode(F.array("u", "v")).alias("node")).distinct().withColumn("root", F.col("node"))
    for turn in range(ROUNDS):
        left = alive.count()
        if not left:
            return places
        files = -(-left // ROWS_A_FILE)
        draw = lambda c, turn=turn: F.struct(F.xxhash64(F.lit(turn), c).alias("draw"), F.col(c).alias("to"))
        both = alive.select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("e")).select("e.u", "e.v")
        moves = both.groupBy("u").agg(F.min(draw("v")).alias("m")).select(F.col("u").alias("node"), F.least(draw("u"), "m").getField("to").alias("to"))
        moves = durable(moves.coalesce(files))
        a, b = moves.select(F.col("node").alias("u"), F.col("to").alias("to_u")), moves.select(F.col("node").alias("v"), F.col("to").alias("to_v"))
        moved = alive.join(a, "u").join(b, "v").filter("to_u <> to_v").select(F.least("to_u", "to_v").alias("u"), F.greatest("to_u", "to_v").alias("v"))
        alive = durable(moved.distinct().coalesce(files))
        step = moves.filter("node <> to").select(F.col("node").alias("root"), "to")
        places = places.join(step, "root", "left").select("node", F.coalesce("to", "root").alias("root"))
    raise RuntimeError("the contraction did not end")
