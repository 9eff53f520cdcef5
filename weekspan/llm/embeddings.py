"""Near duplicates among embeddings by an epsilon grid order join.

Unit vectors whose cosine is at least c are at most epsilon = sqrt(2 - 2c) apart. Vectors are projected on the leading
principal dimensions, whose coordinates never lie further apart than the vectors, and sorted by the cells of a grid of
width epsilon. The sorted sequence is cut into blocks of ``BLOCK`` rows. Intervals of blocks are joined recursively:
a pair of intervals whose boxes on the projected dimensions are more than epsilon apart is skipped with everything
below it; the others are split further, down to pairs of blocks. These are compared exactly, in double precision.

The basis comes from a sample of ``SAMPLE_ROWS`` vectors in expectation; any orthonormal basis gives the same links, so
the sample bears only on speed. Equal vectors are collapsed first and count with their number of copies. A task returns,
for the vectors of its two blocks, numbers of links and one edge per vector to its local component, never pairs, so a
group of near copies makes rows in proportion to its size. Hot cells are cut like any others, as the sort goes on by a
hash of the vector.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components link with nothing, and neither
do those with a null label; vectors of different dimension are not compared; rows that repeat a key are rows of their
own; a null key never names a component unless all its keys are null; an empty table gives no rows; other columns are
not read, so their names may clash with those of the result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weekspan.functions.skew import attach
from weekspan.llm.components import connected_components, hot_rows
from weekspan.llm.textbatch import batch_column, buckets_for, local_components, tidy
from weekspan.session import durable

THRESHOLD = 0.98
BLOCK = 512
BLOCKS_A_PARTITION = 8
SAMPLE_ROWS = 4_000
GRID_DIMENSIONS = 8
PLACE_BITS = 20
FAN_BITS = 3
TOP_INTERVALS = 64


def _vectors(column: pa.Array) -> np.ndarray:
    flat = column.flatten()
    return np.asarray(flat.to_numpy(zero_copy_only=False), np.float64).reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def _units(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def _basis(reps: DataFrame, count: int) -> dict[int, np.ndarray]:
    """For each dimension of vectors, its leading principal directions (columns) in a sample."""
    share = min(1.0, SAMPLE_ROWS / max(count, 1))
    drawn = reps.filter(F.pmod(F.xxhash64(F.lit("basis"), "node"), F.lit(1 << 30)) < int(share * (1 << 30))).select("node", "vector").collect()
    found: dict[int, list] = {}
    for r in sorted(drawn, key=lambda r: r.node):
        found.setdefault(len(r.vector), []).append(r.vector)
    out = {}
    for size, rows in found.items():
        units = _units(np.array(rows, np.float64))
        _, _, directions = np.linalg.svd(units - units.mean(0), full_matrices=False)
        out[size] = directions[: min(GRID_DIMENSIONS, len(directions))].T
    return out


def _project(vectors: np.ndarray, basis: dict[int, np.ndarray]) -> np.ndarray:
    """Coordinates on the leading dimensions, filled up with zeros."""
    out = np.zeros((len(vectors), GRID_DIMENSIONS))
    if len(vectors) and vectors.shape[1] in basis:
        b = basis[vectors.shape[1]]
        out[:, : b.shape[1]] = _units(vectors) @ b
    return out


def _block_pairs(blocks: DataFrame, epsilon: float) -> DataFrame:
    """Pairs (a, b) of blocks that may hold links, found from pairs of ever shorter intervals."""
    bounds = [f"{side}{i}" for side in ("low", "high") for i in range(GRID_DIMENSIONS)]
    top = blocks.agg(F.max("block")).first()[0] or 0
    shifts = [0, PLACE_BITS]
    while top >> shifts[-1] >= TOP_INTERVALS:
        shifts.append(shifts[-1] + FAN_BITS)

    def summary(shift: int) -> DataFrame:
        limits = [(F.min if n.startswith("low") else F.max)(n).alias(n) for n in bounds]
        return blocks.groupBy("grp", F.shiftright("block", shift).alias("i")).agg(*limits)

    def side(table: DataFrame, name: str, up: int) -> DataFrame:
        return table.select(F.col("grp"), F.col("i").alias(name), F.shiftright("i", up).alias(f"{name}_up"), *[F.col(n).alias(f"{name}_{n}") for n in bounds])

    gap = [F.greatest(F.lit(0.0), F.col(f"a_low{i}") - F.col(f"b_high{i}"), F.col(f"b_low{i}") - F.col(f"a_high{i}")) for i in range(GRID_DIMENSIONS)]
    near = (F.col("a") <= F.col("b")) & (reduce(lambda x, y: x + y, [g * g for g in gap]) <= epsilon * epsilon)
    intervals = summary(shifts[-1])
    pairs = side(intervals, "a", 0).join(side(intervals, "b", 0), "grp").filter(near).select("grp", "a", "b")
    for above, shift in zip(shifts[:0:-1], shifts[-2::-1], strict=True):
        intervals = summary(shift)
        parents = pairs.select("grp", F.col("a").alias("a_up"), F.col("b").alias("b_up"))
        pairs = parents.join(side(intervals, "a", above - shift), ["grp", "a_up"]).join(side(intervals, "b", above - shift), ["grp", "b_up"]).filter(near).select("grp", "a", "b")
    return pairs


def near_links(reps: DataFrame, threshold: float) -> DataFrame:
    """(node, n, to): links of each node by pair of blocks, counted with copies, and its local component's first node."""
    epsilon = float(np.sqrt(max(2 - 2 * threshold, 0.0))) + 1e-9
    count = reps.count()
    basis = _basis(reps, count)
    cells = [f"cell{i}" for i in range(GRID_DIMENSIONS)]
    columns = ["grp", *cells, "node"]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = batch_column(batch, "vector")
            sizes = np.array(vectors.value_lengths())
            found = np.zeros((batch.num_rows, GRID_DIMENSIONS))
            for size in np.unique(sizes):
                rows = np.flatnonzero(sizes == size)
                found[rows] = _project(_vectors(vectors.take(pa.array(rows))), basis)
            grid = np.floor(found / epsilon).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns, *[pa.array(grid[:, i]) for i in range(GRID_DIMENSIONS)]], [*batch.schema.names, *cells])

    spec = "grp string, node string, vector array<double>, copies long"
    placed = reps.select("grp", "node", F.col("vector").cast("array<double>").alias("vector"), "copies").mapInArrow(tidy(place), spec + "".join(f", {c} int" for c in cells))
    ordered = placed.repartitionByRange(buckets_for(count, BLOCK * BLOCKS_A_PARTITION, 1), *columns).sortWithinPartitions(*columns)
    sides = [f"{s}{i}" for s in ("low", "high") for i in range(GRID_DIMENSIONS)]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, made = TaskContext.get().partitionId(), 0
        waiting: list[pa.RecordBatch] = []

        def block(rows: pa.Table) -> pa.RecordBatch:
            nonlocal made
            vectors = _vectors(rows.column("vector").combine_chunks())
            points = _project(vectors, basis)
            box = np.concatenate([points.min(0), points.max(0)])
            values = [[rows.column("grp")[0].as_py()], [(here << PLACE_BITS) + made], [rows.column("node").to_pylist()], [rows.column("copies").to_pylist()], [vectors.tobytes()]]
            kinds = [pa.string(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.int64()), pa.binary()]
            made += 1
            return pa.RecordBatch.from_arrays([*map(pa.array, values, kinds), *[pa.array([x]) for x in box]], ["grp", "block", "nodes", "copies", "vectors", *sides])

        def cuts(rows: pa.Table, end: bool) -> tuple[list[pa.RecordBatch], pa.Table]:
            out = []
            while rows.num_rows:
                groups = np.array(rows.column("grp").slice(0, BLOCK).to_pylist(), object)
                n = int((groups == groups[0]).cumprod().sum())
                if n == rows.num_rows and n < BLOCK and not end:
                    break
                out.append(block(rows.slice(0, n)))
                rows = rows.slice(n)
            return out, rows

        for batch in batches:
            done, rest = cuts(pa.Table.from_batches([*waiting, batch]), False)
            yield from done
            waiting = rest.to_batches()
        if waiting:
            yield from cuts(pa.Table.from_batches(waiting), True)[0]

    spec = "grp string, block long, nodes array<string>, copies array<long>, vectors binary" + "".join(f", {s} double" for s in sides)
    blocks = durable(ordered.mapInArrow(tidy(cut), spec))
    content = lambda s: blocks.select(F.col("block").alias(s), *[F.col(c).alias(f"{s}_{c}") for c in ("nodes", "copies", "vectors")])
    pairs = _block_pairs(blocks, epsilon).join(content("a"), "a").join(content("b"), "b")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                a, b, a_nodes, a_copies, a_vectors, b_nodes, b_copies, b_vectors = (batch_column(batch, n)[row].as_py() for n in ("a", "b", "a_nodes", "a_copies", "a_vectors", "b_nodes", "b_copies", "b_vectors"))
                linked = _links(np.frombuffer(a_vectors), np.frombuffer(b_vectors), len(a_nodes), len(b_nodes), a == b, threshold)
                if not linked.any():
                    continue
                nodes = a_nodes + b_nodes
                n = np.concatenate([linked @ np.array(b_copies), np.zeros(len(b_nodes), np.int64) if a == b else np.array(a_copies) @ linked])
                first = local_components(linked, a == b)
                at = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array([nodes[i] for i in at]), pa.array(n[at].astype(np.int64)), pa.array([nodes[first[i]] for i in at])], ["node", "n", "to"])

    return pairs.drop("grp").mapInArrow(tidy(compare), "node string, n long, to string")


def _links(a: np.ndarray, b: np.ndarray, rows: int, columns: int, same: bool, threshold: float) -> np.ndarray:
    linked = _units(a.reshape(rows, -1)) @ _units(b.reshape(columns, -1)).T >= threshold
    if same:
        np.fill_diagonal(linked, False)
    return linked


def near_duplicates(df: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of ``df``: key, n_links, component_id, kept."""
    if not 0 < threshold <= 1:
        raise ValueError("threshold must be above 0 and at most 1")
    x = F.col(vector)
    fit = (
        F.col(label).isNotNull() & x.isNotNull() & (F.size(x) > 0) & ~F.exists(x, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")))
        & F.exists(x, lambda e: e != 0)
    )
    grp = F.concat_ws("/", F.col(label).cast("string"), F.size(x).cast("string"))
    node = F.concat_ws("-", F.xxhash64(F.lit(1), grp, x), F.xxhash64(F.lit(2), x, grp))
    rows = df.select(F.col(key).alias("key"), F.when(F.coalesce(fit, F.lit(False)), node).alias("node"), grp.alias("grp"), x.alias("vector"))
    sound = rows.filter("node is not null")
    reps = durable(sound.groupBy("node", "grp").agg(F.min("key").alias("least"), F.count(F.lit(1)).alias("copies"), F.first("vector").alias("vector")))
    links = durable(near_links(reps, threshold))
    degrees = links.groupBy("node").agg(F.sum("n").alias("n"))
    roots = connected_components(links, "node", "to")
    members = reps.select("node", "least", "copies").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    names = members.groupBy("root").agg(F.min("least").alias("component_id"))
    sizes = members.groupBy("root").agg(F.count(F.lit(1)).alias("_n"))
    found = attach(members, names, "root", ["node"], hot_rows(reps.count()), sizes).join(degrees, "node", "left").select("node", "component_id", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    out = rows.select("key", "node").join(found, "node", "left")
    component = F.when(F.col("node").isNull(), F.col("key")).otherwise(F.col("component_id"))
    return out.select(F.col("key").alias(key), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("key") == component, F.lit(False)).alias("kept"))
