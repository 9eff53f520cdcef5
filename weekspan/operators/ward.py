"""Ward's bottom-up merging of tables of any size, over summaries of rows.

A summary is a number of rows, their vector sum and their sum of squared norms. Tasks fold their rows into at most
``SUMMARIES`` of them: equal rows always share one, and where there are too many, the closest by Ward's cost are merged.
Summaries of several tasks are folded again, ``FAN_IN`` at a time, until one bounded set is left, which is merged exactly
by the nearest-neighbour chain. Every row then gets the label of its nearest summary. Up to ``SUMMARIES`` distinct rows,
nothing is summarised and the result is Ward's own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weekspan.operators.kmeans import assign
from weekspan.session import durable

SUMMARIES = 1_024
FAN_IN = 8
SPEC = "part int, n double, norm double, body binary"


class Summaries:
    def __init__(self, n: np.ndarray, sums: np.ndarray, norms: np.ndarray):
        self.n, self.sums, self.norms = n, sums, norms

    @classmethod
    def of_rows(cls, x: np.ndarray) -> Summaries:
        distinct, n = np.unique(x, axis=0, return_counts=True)
        return cls(n.astype(float), distinct * n[:, None], n * (distinct * distinct).sum(1))

    @classmethod
    def joined(cls, parts: list[Summaries]) -> Summaries:
        return cls(*[np.concatenate([getattr(p, c) for p in parts]) for c in ("n", "sums", "norms")])

    def centres(self) -> np.ndarray:
        return self.sums / self.n[:, None]

    def grouped(self, group: np.ndarray) -> Summaries:
        """One summary for each group number."""
        count = int(group.max(initial=-1)) + 1
        sums = np.zeros((count, self.sums.shape[1]))
        np.add.at(sums, group, self.sums)
        return Summaries(np.bincount(group, self.n, count), sums, np.bincount(group, self.norms, count))

    def folded(self, limit: int) -> Summaries:
        """Equal centres as one; then at most ``limit`` summaries, merged in Ward's order from the cheapest on."""
        _, same = np.unique(self.centres(), axis=0, return_inverse=True)
        out = self.grouped(same.ravel())
        return out if len(out.n) <= limit else out.grouped(cut_tree(ward_tree(out.n, out.centres()), len(out.n), limit))


def ward_tree(weights: np.ndarray, centres: np.ndarray) -> list[tuple[float, int, int]]:
    """(cost, a, b) of all merges in the order of cost; a cluster is named by its first member.

    Follows chains of nearest neighbours; two clusters that are each other's nearest are merged, which leaves the result
    of greedy merging unchanged for Ward's cost n m / (n + m) |x - y|^2.
    """
    m = len(weights)
    n, c = weights.astype(float).copy(), centres.astype(float).copy()
    alive = np.ones(m, bool)
    merges, chain = [], []
    for _ in range(m - 1):
        if not chain:
            chain.append(int(np.flatnonzero(alive)[0]))
        while True:
            a = chain[-1]
            cost = n[a] * n / (n[a] + n) * ((c - c[a]) ** 2).sum(1)
            cost[~alive] = np.inf
            cost[a] = np.inf
            b = int(cost.argmin())
            if len(chain) > 1 and cost[chain[-2]] <= cost[b]:
                b = chain[-2]
                break
            chain.append(b)
        chain = chain[:-2]
        a, b = min(a, b), max(a, b)
        merges.append((float(n[a] * n[b] / (n[a] + n[b]) * ((c[a] - c[b]) ** 2).sum()), a, b))
        c[a] = (n[a] * c[a] + n[b] * c[b]) / (n[a] + n[b])
        n[a] += n[b]
        alive[b] = False
    return sorted(merges, key=lambda x: x[0])


def cut_tree(merges: list[tuple[float, int, int]], members: int, k: int) -> np.ndarray:
    """Group number of every member after all merges but the ``k - 1`` dearest; groups are numbered by their first member."""
    parent = np.arange(members)

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = int(parent[x])
        return x

    for _, a, b in merges[: max(members - k, 0)]:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    return np.unique([root(x) for x in range(members)], return_inverse=True)[1]


def _batch(part: int, s: Summaries) -> pa.RecordBatch:
    rows = len(s.n)
    return pa.RecordBatch.from_arrays([pa.array([part] * rows, pa.int32()), pa.array(s.n), pa.array(s.norms), pa.array([r.tobytes() for r in s.sums], pa.binary())], ["part", "n", "norm", "body"])


def _read(rows: pa.Table | pa.RecordBatch) -> Summaries:
    n, norms, bodies = (rows.column(c).to_pylist() for c in ("n", "norm", "body"))
    return Summaries(np.array(n), np.array([np.frombuffer(b) for b in bodies]).reshape(len(n), -1), np.array(norms))


def summaries(df: DataFrame, values: str = "vector", limit: int = SUMMARIES) -> Summaries | None:
    """At most ``limit`` summaries of all rows with a vector, or None for an empty table."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Summaries | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.asarray(batch.column(0).flatten().to_numpy(zero_copy_only=False), np.float64).reshape(batch.num_rows, -1)
            for a in range(0, len(x), 2 * limit):
                fresh = Summaries.of_rows(x[a : a + 2 * limit])
                held = (fresh if held is None else Summaries.joined([held, fresh])).folded(limit)
        if held is not None:
            yield _batch(TaskContext.get().partitionId(), held)

    def again(rows: pa.Table) -> pa.Table:
        part = rows.column("part")[0].as_py()
        return pa.Table.from_batches([_batch(part, _read(rows.combine_chunks()).folded(limit))])

    read = df.filter(F.col(values).isNotNull()).select(F.col(values).cast("array<double>").alias("v"))
    parts = durable(read.mapInArrow(fold, SPEC), "summaries")
    while True:
        top = parts.agg(F.max("part"), F.count_distinct("part")).first()
        if top[0] is None:
            return None
        if top[1] == 1:
            return _read(parts.toArrow())  # at most ``limit`` rows
        parts = durable(parts.withColumn("part", F.floor(F.col("part") / FAN_IN).cast("int")).groupBy("part").applyInArrow(again, SPEC), "summaries")


def run_ward(df: DataFrame, k: int, values: str = "vector", out: str = "cluster", limit: int = SUMMARIES) -> DataFrame:
    """``df`` with one of ``k`` clusters per row (fewer for fewer distinct rows); null for rows without a vector."""
    held = summaries(df, values, limit)
    if held is None:
        return df.withColumn(out, F.lit(None).cast("int"))
    order = np.lexsort(held.centres().T[::-1])
    held = Summaries(held.n[order], held.sums[order], held.norms[order])
    group = cut_tree(ward_tree(held.n, held.centres()), len(held.n), k)
    labels = F.array(*[F.lit(int(g)) for g in group])
    placed = assign(df, held.centres(), values, "_summary")
    return placed.withColumn(out, F.get(labels, F.col("_summary"))).drop("_summary")

