"""Hard negatives of anchors among embeddings, found exactly through an inverted multi-index.

Vectors are quantised to integers, floor(scale * x); a score is the inner product of two of them. Both halves of the
vectors get a codebook of their own (k-means on a sample of at most ``SAMPLE_ROWS`` vectors in expectation, which bears
only on speed); a pair of codewords is a cell. Rows are sorted by cell and stored in blocks of at most ``BLOCK`` rows with
the radius of each half around its codeword, so a cell that holds a third of all rows is many blocks like any others.

Anchors are taken in batches of about ``BATCH``, which every task gets whole; a task walks its part of the index in
shards of at most ``SHARD`` rows. In a shard, the best score any row of a cell can reach for an anchor is the sum of two
half-score bounds (codeword score plus radius times the length of the anchor's half). A heap visits the cells in the order
of these sums without forming all of them. The first pass keeps the best rows of the anchor's label, its positives; the
second keeps, for every positive, the best rows of other labels inside the window of scores the positive sets. An anchor is
done with a shard as soon as the next sum certifies that no unseen row can enter: it lies below the last kept score of all
that is asked for. Scores among a sample give thresholds to begin with, what earlier shards kept gives better ones; each
pass ends in a merge of at most as many rows per anchor, task and window as are asked for.

Results are exact, since bounds are only ever used to skip what cannot be among them; no candidates are capped. Where
vectors have no structure the bounds skip little and every anchor meets every row, in blocks.

Defined cases: rows with a null label, a null vector or a null or non-finite component take no part; vectors of another
length than the anchor's are no partners; quantised components saturate at +-sqrt(2**53 / length), 2**23 for 64, so that
scores are exact; a null key is no anchor and larger than all others; rows that repeat a key are rows of their own (equal
ones are stored once with their number), an anchor that stands twice is answered twice; ties go by key, and where keys
tie too the rows look the same; an empty table, no anchors or no positives give no rows; names of other columns may clash.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weekspan.llm.textbatch import batch_column, buckets_for, runs, tidy
from weekspan.session import durable, scratch_path

SAMPLE_ROWS = 4_000
SEED_ROWS = 1_000
CELL_ROWS = 512
MOST_CODES = 256
ROUNDS = 10
BLOCK = 512
SHARD = 32_768
PARTITION_ROWS = 16_384
BATCH = 1_024
NO_KEY = np.iinfo(np.int64).max
LOWEST = np.iinfo(np.int64).min
BLOCK_SCHEMA = pa.schema(
    [("size", pa.int32()), ("i", pa.int32()), ("j", pa.int32()), ("far_i", pa.float64()), ("far_j", pa.float64()), ("n", pa.int32()), *[(c, pa.binary()) for c in ("keys", "labels", "copies", "vectors")]]
)
BLOCK_SPEC = "size int, i int, j int, far_i double, far_j double, n int, keys binary, labels binary, copies binary, vectors binary"


def quantised(vector: Column, scale: int = 256) -> Column:
    """floor(scale * x) of every component as long, saturated so that inner products stay exact; null if a component is null or not finite."""
    limit = F.floor(F.sqrt(F.lit(float(1 << 53)) / F.greatest(F.size(vector), F.lit(1))))
    sound = vector.isNotNull() & ~F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    within = lambda x: F.greatest(F.least(F.floor(x.cast("double") * scale), limit), -limit)
    return F.when(F.coalesce(sound, F.lit(False)), F.transform(vector, within))


def halves(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    cut = vectors.shape[1] // 2
    return vectors[:, :cut], vectors[:, cut:]


def _nearest(points: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest codeword of each point and the distance to it."""
    squared = (codes * codes).sum(1) - 2 * (points @ codes.T)
    at = squared.argmin(1)
    return at, np.sqrt(((points - codes[at]) ** 2).sum(1))


def codebook(points: np.ndarray, k: int) -> np.ndarray:
    """k-means from evenly spaced distinct points; empty codewords are dropped."""
    distinct = np.unique(points, axis=0)
    codes = distinct[np.linspace(0, len(distinct) - 1, min(k, len(distinct))).astype(int)]
    for _ in range(ROUNDS):
        at, _ = _nearest(points, codes)
        n = np.bincount(at, minlength=len(codes))
        sums = np.zeros_like(codes)
        np.add.at(sums, at, points)
        codes = sums[n > 0] / n[n > 0, None]
    return codes


def _book(books: dict[int, tuple[np.ndarray, np.ndarray]], size: int) -> tuple[np.ndarray, np.ndarray]:
    """The codebooks of vectors of this length; a length that the sample lacks has one codeword, the origin."""
    return books.get(size) or (np.zeros((1, size // 2)), np.zeros((1, size - size // 2)))


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(column), size)


@dataclass
class Index:
    blocks: DataFrame
    sample: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]  # by length: vectors, labels, keys
    books: dict[int, tuple[np.ndarray, np.ndarray]]


def build(rows: DataFrame, count: int) -> Index:
    """``rows``: key long, label long, vector array<long>, copies long; each combination once."""
    share = min(1.0, SAMPLE_ROWS / max(count, 1))
    drawn = rows.filter(F.pmod(F.xxhash64(F.lit("codes"), "key", "label", "vector"), F.lit(1 << 30)) < int(share * (1 << 30))).select("key", "label", "vector").collect()
    by_size: dict[int, list] = {}
    for r in sorted(drawn, key=lambda r: (r.key is None, r.key or 0, r.label, r.vector)):
        by_size.setdefault(len(r.vector), []).append(r)
    k = int(np.clip(np.sqrt(count / CELL_ROWS), 1, MOST_CODES))
    sample, books = {}, {}
    for size, found in by_size.items():
        vectors = np.array([r.vector for r in found], np.float64).reshape(len(found), size)
        books[size] = tuple(codebook(h, k) if h.shape[1] else np.zeros((1, 0)) for h in halves(vectors))
        few = found[:: -(-len(found) // SEED_ROWS)]
        keys = np.array([NO_KEY if r.key is None else r.key for r in few])
        sample[size] = vectors[:: -(-len(found) // SEED_ROWS)], np.array([r.label for r in few]), keys

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.array(batch_column(batch, "vector").value_lengths())
            cells = np.zeros((batch.num_rows, 2), np.int32)
            for size in np.unique(sizes):
                at = np.flatnonzero(sizes == size)
                for side, (points, codes) in enumerate(zip(halves(_matrix(batch_column(batch, "vector").take(pa.array(at)), size)), _book(books, size), strict=True)):
                    cells[at, side] = _nearest(points, codes)[0]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sizes.astype(np.int32)), pa.array(cells[:, 0]), pa.array(cells[:, 1])], [*batch.schema.names, "size", "i", "j"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["size", "i", "j"]

        def block(run: pa.Table) -> dict:
            size, i, j = (run.column(c)[0].as_py() for c in names)
            vectors = _matrix(run.column("vector").combine_chunks(), size)
            away = [np.sqrt(((h - codes[c]) ** 2).sum(1)).max() for h, codes, c in zip(halves(vectors), _book(books, size), (i, j), strict=True)]
            keys = run.column("key").fill_null(NO_KEY).to_numpy()
            return {
                "size": size, "i": i, "j": j, "far_i": float(away[0]), "far_j": float(away[1]), "n": run.num_rows, "keys": keys.astype(np.int64).tobytes(),
                "labels": run.column("label").to_numpy().astype(np.int64).tobytes(), "copies": run.column("copies").to_numpy().astype(np.int64).tobytes(), "vectors": vectors.astype(np.int32).tobytes(),
            }

        for run in runs(batches, names):
            for first in range(0, run.num_rows, BLOCK):
                yield pa.RecordBatch.from_pylist([block(run.slice(first, BLOCK))], BLOCK_SCHEMA)

    order = ["size", "i", "j", "key", "label"]
    placed = rows.mapInArrow(tidy(place), "key long, label long, vector array<long>, copies long, size int, i int, j int")
    dealt = placed.repartitionByRange(buckets_for(count, PARTITION_ROWS, 1), *order).sortWithinPartitions(*order)
    return Index(durable(dealt.mapInArrow(tidy(cut), BLOCK_SPEC)), sample, books)


class Best:
    """The ``most`` best rows of one window of scores [low, high]: higher scores first, ties by key."""

    def __init__(self, low: int, high: int, most: int, same: bool):
        self.low, self.high, self.most, self.same = low, high, most, same
        self.scores, self.keys = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.floor = low

    def seed(self, scores: np.ndarray) -> None:
        """Rows known to exist (not counted here) with these scores inside the window raise the threshold."""
        if len(scores) >= self.most:
            self.floor = max(self.floor, int(np.partition(scores, -self.most)[-self.most]))

    def open_for(self, bound: int, least_key: int = LOWEST) -> bool:
        """Whether a row with a score of at most ``bound`` and a key of at least ``least_key`` could still enter."""
        if bound < self.floor or self.low > self.high:
            return False
        return len(self.scores) < self.most or (bound, -least_key) > (int(self.scores[-1]), -int(self.keys[-1]))

    def add(self, scores: np.ndarray, keys: np.ndarray) -> None:
        scores, keys = np.concatenate([self.scores, scores]), np.concatenate([self.keys, keys])
        order = np.lexsort((keys, -scores))[: self.most]
        self.scores, self.keys = scores[order], keys[order]
        if len(order) == self.most:
            self.floor = max(self.floor, int(self.scores[-1]))


@dataclass
class Anchor:
    number: int
    key: int
    label: int
    vector: np.ndarray
    windows: list[Best] = field(default_factory=list)

    def seed(self, sample: tuple[np.ndarray, np.ndarray, np.ndarray]) -> None:
        vectors, labels, keys = sample
        scores = np.rint(vectors @ self.vector).astype(np.int64)
        for w in self.windows:
            w.seed(scores[((labels == self.label) == w.same) & (keys != self.key) & (scores >= w.low) & (scores <= w.high)])


class Shard:
    """Blocks of one vector length, by cell."""

    def __init__(self, blocks: list[dict], books: tuple[np.ndarray, np.ndarray]):
        self.size = blocks[0]["size"]
        self.cells: dict[tuple[int, int], list[dict]] = {}
        far: list[dict[int, float]] = [{}, {}]
        for b in blocks:
            long = {c: np.frombuffer(b[c], np.int64) for c in ("keys", "labels", "copies")}
            self.cells.setdefault((b["i"], b["j"]), []).append(b | long | {"least": int(long["keys"].min()), "vectors": np.frombuffer(b["vectors"], np.int32).astype(np.float64).reshape(b["n"], self.size)})
            for side, c in enumerate(("i", "j")):
                far[side][b[c]] = max(far[side].get(b[c], 0.0), b[f"far_{c}"])
        self.codes = [np.array(sorted(f)) for f in far]
        self.far = [np.array([f[c] for c in codes]) for f, codes in zip(far, self.codes, strict=True)]
        self.points = [book[codes] for book, codes in zip(books, self.codes, strict=True)]

    def search(self, anchor: Anchor) -> None:
        """Bring the anchor's windows up to date with all rows of the shard."""
        parts = halves(anchor.vector[None])
        lengths = [float(np.sqrt((h * h).sum())) for h in parts]
        middle = [p @ h[0] for p, h in zip(self.points, parts, strict=True)]
        reach = [m + x * f for m, x, f in zip(middle, lengths, self.far, strict=True)]
        order = [np.argsort(-r, kind="stable") for r in reach]
        tops = [r[o].tolist() for r, o in zip(reach, order, strict=True)]
        slack = 1e-6 + 1e-9 * (abs(tops[0][0]) + abs(tops[1][0]) + sum(lengths))
        waiting = [(-(tops[0][0] + tops[1][0]), 0, 0)]
        while waiting:
            bound, a, b = heapq.heappop(waiting)
            limit = int(np.floor(slack - bound))
            if not any(w.open_for(limit) for w in anchor.windows):
                return
            if b + 1 < len(tops[1]):
                heapq.heappush(waiting, (-(tops[0][a] + tops[1][b + 1]), a, b + 1))
            if b == 0 and a + 1 < len(tops[0]):
                heapq.heappush(waiting, (-(tops[0][a + 1] + tops[1][0]), a + 1, 0))
            i, j = order[0][a], order[1][b]
            centre = middle[0][i] + middle[1][j]
            for block in self.cells.get((int(self.codes[0][i]), int(self.codes[1][j])), ()):
                radius = lengths[0] * block["far_i"] + lengths[1] * block["far_j"] + slack
                self.visit(anchor, block, int(np.floor(centre + radius)), int(np.floor(centre - radius)))

    def visit(self, anchor: Anchor, block: dict, most: int, least: int) -> None:
        windows = [w for w in anchor.windows if w.high >= least and w.open_for(most, block["least"])]
        if not windows:
            return
        scores = np.rint(block["vectors"] @ anchor.vector).astype(np.int64)
        same = block["labels"] == anchor.label
        for w in windows:
            at = np.flatnonzero((same if w.same else ~same) & (scores >= w.floor) & (scores <= w.high))
            if not len(at):
                continue
            n = block["copies"][at]
            own = block["keys"][at] == anchor.key
            if w.same and own.any():  # the anchor's own row
                n = n - [o and (block["vectors"][x] == anchor.vector).all() for o, x in zip(own, at, strict=True)]
            times = np.minimum(n, w.most)
            w.add(np.repeat(scores[at], times), np.repeat(block["keys"][at], times))


def _search(index: Index, anchors: list[Anchor]) -> DataFrame:
    """(anchor, window, rank, score, key): each window's best rows over the whole index."""
    spark = index.blocks.sparkSession
    sent = spark.sparkContext.broadcast((anchors, index.sample, index.books))

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, sample, books = sent.value
        by_size: dict[int, list[Anchor]] = {}
        for x in asked:
            by_size.setdefault(len(x.vector), []).append(Anchor(x.number, x.key, x.label, x.vector, [Best(w.low, w.high, w.most, w.same) for w in x.windows]))
        for size, members in by_size.items():
            for x in members:
                if size in sample:
                    x.seed(sample[size])

        def shards() -> Iterator[Shard]:
            held: list[dict] = []
            for batch in batches:
                for b in batch.to_pylist():
                    if held and (b["size"] != held[0]["size"] or sum(x["n"] for x in held) >= SHARD):
                        yield Shard(held, _book(books, held[0]["size"]))
                        held = []
                    if b["size"] in by_size:
                        held.append(b)
            if held:
                yield Shard(held, _book(books, held[0]["size"]))

        for shard in shards():
            for x in by_size[shard.size]:
                shard.search(x)
        for members in by_size.values():
            rows = [(x.number, k, s, y) for x in members for k, w in enumerate(x.windows) for s, y in zip(w.scores.tolist(), w.keys.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in enumerate((pa.int32(), pa.int32(), pa.int64(), pa.int64()))], ["anchor", "window", "score", "key"])

    most = max((w.most for x in anchors for w in x.windows), default=0)
    found = index.blocks.mapInArrow(tidy(walk), "anchor int, window int, score long, key long")
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("anchor", "window").orderBy(F.desc("score"), "key")))
    return ranked.filter(F.col("rank") <= most)


def mine(
    df: DataFrame, is_anchor: Column | str, key: str = "vec_id", vector: str = "embedding", label: str = "label",
    positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, scale: int = 256,
) -> DataFrame:
    """For each anchor and each of its first ``positives`` positives, the first ``negatives`` rows of other labels whose
    score is ``low`` to ``high`` per cent of the positive's: anchor_id, positive_id, rank, negative_id, positive_score,
    negative_score.

    ``is_anchor`` is a condition on the columns of ``df``; null counts as false.
    """
    marked = F.expr(is_anchor) if isinstance(is_anchor, str) else is_anchor
    read = df.select(F.col(key).cast("long").alias("key"), F.col(label).cast("long").alias("label"), quantised(F.col(vector), scale).alias("vector"), (F.coalesce(marked, F.lit(False)) & F.col(key).isNotNull()).alias("chosen"))
    grouped = read.filter("label is not null and vector is not null").groupBy("key", "label", "vector").agg(F.count(F.lit(1)).alias("copies"), F.sum(F.col("chosen").cast("long")).alias("chosen"))
    rows = durable(grouped)
    count, asked = rows.agg(F.count(F.lit(1)), F.sum((F.col("chosen") > 0).cast("long"))).first()
    path = scratch_path(df.sparkSession, "negatives")
    spec = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    index = build(rows.select("key", "label", "vector", "copies"), count) if asked else None
    batches = -(-(asked or 0) // BATCH)
    anchors_in = rows.filter("chosen > 0").withColumn("batch", F.pmod(F.xxhash64(F.lit("batch"), "key", "label", "vector"), F.lit(max(batches, 1))))
    for turn in range(batches):
        _one_batch(index, anchors_in.filter(F.col("batch") == turn).collect(), positives, negatives, low, high).write.parquet(f"{path}/batch={turn}")
    if not batches:
        return df.sparkSession.createDataFrame([], spec)
    return df.sparkSession.read.schema(spec).parquet(*[f"{path}/batch={t}" for t in range(batches)])


def _one_batch(index: Index, found: list, positives: int, negatives: int, low: int, high: int) -> DataFrame:
    spark = index.blocks.sparkSession
    anchors = [Anchor(n, r.key, r.label, np.array(r.vector, np.float64), [Best(LOWEST, NO_KEY, positives, True)]) for n, r in enumerate(found)]
    best = sorted((r.anchor, r.rank, r.key, r.score) for r in _search(index, anchors).collect())
    pairs = []
    for a in anchors:
        a.windows = []
    for a, _, k, s in best:
        pairs.append((a, len(anchors[a].windows), found[a].key, None if k == NO_KEY else k, s, found[a].chosen))
        anchors[a].windows.append(Best(-((-low * s) // 100), high * s // 100, negatives, False))
    sides = spark.createDataFrame(pairs, "anchor int, window int, anchor_id long, positive_id long, positive_score long, times long")
    hits = _search(index, [a for a in anchors if a.windows]).join(F.broadcast(sides), ["anchor", "window"])  # at most positives x batch rows
    return hits.withColumn("_", F.explode(F.sequence(F.lit(1), F.col("times")))).select("anchor_id", "positive_id", "rank", F.when(F.col("key") < NO_KEY, F.col("key")).alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
