"""Join of documents on the Jaccard similarity of their word n-gram sets, by MinHash banding and exact verification.

Words end at white space, A-Z in lower case; a document of fewer than ``SIZE`` words, but not none, has one n-gram of
all its words. The number of rows in a band is the largest for which the bands needed for the target recall at the
threshold stay within ``HASHES`` hashes (0.8 and 0.9999: 24 bands of 5).

1. One scan computes the n-gram set's 128-bit hash, the band hashes and a one-byte-per-hash signature. Documents with
   equal sets are collapsed to one representative with a number of copies.
2. Band hashes are shuffled; those met once are dropped by counting. Within the others, signatures that agree in less
   than ``LEAST_AGREEMENT`` of the places (several standard deviations below the threshold) are no candidates; the rest
   give edges along their local components, at most one per member. Connected, these edges give families.
3. Members of a family meet with their full n-gram sets, which decide every pair in the family: Jaccard >= threshold.
   Returned are numbers of links, weighted by copies, and one edge per member, never pairs.

A large bucket or family is cut into chunks by a hash of the member, and every pair of chunks is a unit of work of its
own, so no task holds a whole group. A group of m different near copies costs m * m / 2 comparisons in all, as counting
links does, but rows only in proportion to m times its number of chunks.

Defined cases: null texts and texts without words link with nothing; repeated rows are rows of their own and link with
each other; a class is named by the smallest key in it, null keys only if there is no other; rows that repeat a key with
another text are judged by their own text; an empty table gives no rows; other columns are not read by ``link``, and
kept by ``deduplicate``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weekspan.functions.skew import attach
from weekspan.llm.components import connected_components, hot_rows, stored
from weekspan.llm.textbatch import NOT_SPACE, Texts, batch_column, fresh, local_components, mix, runs, slices, tidy
from weekspan.session import durable

SIZE = 5
THRESHOLD = 0.8
RECALL = 0.9999
HASHES = 120
LEAST_AGREEMENT = 0.6
BUCKET_CHUNK = 1_024
FAMILY_CHUNK = 512
FAMILY_GRAMS = 300_000
VOCABULARY_STEP = 4_096
TABLE_ROWS = 20_000  # rows of a stored file
FAMILY_ROWS = 2_000
NAMED_ROWS = 200_000  # members whose places may be broadcast, about 20 MB


def bands_for(threshold: float, recall: float, hashes: int = HASHES) -> tuple[int, int]:
    """(bands, rows): the most rows whose bands reach the recall at the threshold within the hashes."""
    for rows in range(hashes, 0, -1):
        chance = threshold**rows
        bands = 1 if chance >= 1 else math.ceil(math.log(1 - recall) / math.log1p(-chance))
        if bands * rows <= hashes:
            return bands, rows
    raise ValueError("too few hashes for this recall")


def gram_sets(texts: Texts, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct n-gram hashes of every document, one after another, and where each document's begin."""
    words = texts.lower().words(NOT_SPACE)
    own = words.hashes()
    where, grams = words.windows(size, own)
    counts = words.counts()
    owner = words.documents()[where]
    for d in np.flatnonzero((counts > 0) & (counts < size)):
        part = own[words.first[d] : words.first[d + 1]]
        total = np.uint64(counts[d])
        for h in part:
            total = mix(np.array([total ^ h]))[0]
        grams, owner = np.append(grams, total), np.append(owner, d)
    order = np.lexsort((grams, owner))
    grams, owner = grams[order], owner[order]
    once = np.append(True, (grams[1:] != grams[:-1]) | (owner[1:] != owner[:-1]))[: len(grams)]
    grams, owner = grams[once], owner[once]
    return grams, np.searchsorted(owner, np.arange(len(texts) + 1))


def signatures(grams: np.ndarray, first: np.ndarray, hashes: int) -> np.ndarray:
    """MinHash values (documents x hashes) of the documents that have n-grams."""
    starts = first[:-1][np.diff(first) > 0]
    seeds = mix(np.arange(1, 2 * hashes + 1, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F))
    out = np.empty((len(starts), hashes), np.uint64)
    for i in range(hashes):
        out[:, i] = np.minimum.reduceat((grams ^ seeds[2 * i]) * (seeds[2 * i + 1] | np.uint64(1)), starts)
    return out


def described(df: DataFrame, key: str, text: str, size: int, bands: int, rows: int) -> DataFrame:
    """key, row hash of the text, node (hash of the n-gram set, null without words), n_grams, bands, signature."""

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = mix(np.arange(1, rows + 1, dtype=np.uint64)) | np.uint64(1)
        turn = mix(np.arange(1, bands + 1, dtype=np.uint64) + np.uint64(1 << 40))
        for batch in batches:
            for a, b, texts in slices(batch_column(batch, "text"), rows=20_000):
                grams, first = gram_sets(texts, size)
                n = np.diff(first)
                full = np.flatnonzero(n)
                nodes, listed, marks = [None] * len(texts), [None] * len(texts), [None] * len(texts)
                if len(full):
                    starts = first[:-1][full]
                    names = np.stack([np.add.reduceat(mix(grams ^ np.uint64(s)), starts) for s in (0x5851F42D4C957F2D, 0x14057B7EF767814F)], 1)
                    found = signatures(grams, first, bands * rows)
                    keys = mix((mix(found.reshape(len(full), bands, rows)) * weights).sum(2, dtype=np.uint64) + turn).view(np.int64)
                    marked = (mix(found) >> np.uint64(56)).astype(np.uint8)
                    for i, d in enumerate(full):
                        nodes[d], listed[d], marks[d] = names[i].tobytes(), keys[i], marked[i].tobytes()
                yield pa.RecordBatch.from_arrays(
                    [*[batch.column(c).slice(a, b - a) for c in (0, 1)], pa.array(nodes, pa.binary()), pa.array(n.astype(np.int32)), pa.array(listed, pa.list_(pa.int64())), pa.array(marks, pa.binary())],
                    ["key", "row", "node", "n_grams", "bands", "signature"],
                )

    kind = df.schema[key].dataType.simpleString()
    rows_in = df.select(F.col(key).alias("key"), F.xxhash64(F.col(text)).alias("row"), F.col(text).alias("text"))
    return rows_in.mapInArrow(tidy(describe), f"key {kind}, row long, node binary, n_grams int, bands array<long>, signature binary")


def _paired(df: DataFrame, chunks: str) -> DataFrame:
    """Each row once for every pair (i, j) of chunks, i <= j, that its chunk is in; ``chunk`` is its own."""
    own = F.pmod(F.xxhash64(F.lit("chunk"), "node"), F.col(chunks)).cast("int")
    other = df.withColumn("chunk", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col(chunks).cast("int") - 1)))
    return other.withColumn("i", F.least("chunk", "other")).withColumn("j", F.greatest("chunk", "other")).drop("other", chunks)


def _sides(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers of the two chunks of a pair; the second is the first for a chunk with itself."""
    if table.column("i")[0].as_py() == table.column("j")[0].as_py():
        both = np.arange(table.num_rows)
        return both, both
    chunk = table.column("chunk").to_numpy()
    return np.flatnonzero(chunk == table.column("i")[0].as_py()), np.flatnonzero(chunk == table.column("j")[0].as_py())


def _star(linked: np.ndarray, a: np.ndarray, b: np.ndarray, nodes: list) -> tuple[list, list]:
    """An edge from each linked row to its local component's first."""
    first = local_components(linked, a is b)
    members = np.concatenate([a, b])
    at = np.flatnonzero(np.concatenate([linked.any(1), linked.any(0)]))
    return [nodes[members[i]] for i in at], [nodes[members[first[i]]] for i in at]


def candidates(reps: DataFrame, least_agreement: float) -> DataFrame:
    """Edges (u, v) between nodes that share a band and whose signatures agree."""
    exploded = reps.select("node", F.explode("bands").alias("bucket"))
    shared = exploded.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    members = exploded.join(shared, "bucket").withColumn("chunks", F.ceil(F.col("n") / BUCKET_CHUNK).cast("int")).drop("n")
    signed = _paired(members.join(reps.select("node", "signature"), "node"), "chunks")
    keys = ["bucket", "i", "j"]

    def agree(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        us, vs = [], []
        for table in runs(batches, keys):
            a, b = _sides(table)
            marks = np.frombuffer(b"".join(table.column("signature").to_pylist()), np.uint8).reshape(table.num_rows, -1)
            nodes = table.column("node").to_pylist()
            linked = np.zeros((len(a), len(b)), bool)
            for r in range(len(a)):
                linked[r] = (marks[a[r]] == marks[b]).mean(1) >= least_agreement
            if a is b:
                np.fill_diagonal(linked, False)
            u, v = _star(linked, a, b, nodes)
            us += u
            vs += v
            if len(us) > 50_000:
                yield pa.RecordBatch.from_arrays([pa.array(us, pa.binary()), pa.array(vs, pa.binary())], ["u", "v"])
                us, vs = [], []
        yield pa.RecordBatch.from_arrays([pa.array(us, pa.binary()), pa.array(vs, pa.binary())], ["u", "v"])

    return signed.select(*keys, "chunk", "node", "signature").repartition(*keys).sortWithinPartitions(*keys).mapInArrow(tidy(agree), "u binary, v binary")


def common_grams(sets: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of the sets in ``a`` with those in ``b``, by blocks of the shared vocabulary."""
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, gram, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    place = np.cumsum(counts > 1) - 1
    kept = counts[gram] > 1
    owner, gram = owner[kept], place[gram[kept]]
    order = np.argsort(gram, kind="stable")
    owner, gram = owner[order], gram[order]
    total = np.zeros((len(a), len(b)), np.float32)
    size = int(gram[-1]) + 1 if len(gram) else 0
    for start in range(0, size, VOCABULARY_STEP):
        lo, hi = np.searchsorted(gram, [start, start + VOCABULARY_STEP])
        held = np.zeros((len(sets), min(VOCABULARY_STEP, size - start)), np.float32)
        held[owner[lo:hi], gram[lo:hi] - start] = 1
        total += held[a] @ held[b].T
    return total.astype(np.int64)


def verified(families: DataFrame, rows_of: int, df: DataFrame, key: str, text: str, size: int, threshold: float) -> DataFrame:
    """(node, n, to): links of each node by pair of chunks, weighted by copies, and its local component's first node."""
    sizes = families.groupBy("root").agg(F.count(F.lit(1)).alias("m"), F.sum("n_grams").alias("grams"))
    chunks = F.greatest(F.ceil(F.col("m") / FAMILY_CHUNK), F.ceil(F.col("grams") / FAMILY_GRAMS)).cast("int")
    members = families.join(sizes.select("root", chunks.alias("chunks")), "root").select(F.col("key").alias("_key"), F.col("row").alias("_row"), "node", "root", "copies", "chunks")
    rows = df.select(F.col(key).alias("_key"), F.xxhash64(F.col(text)).alias("_row"), F.col(text).alias("text"))
    same = rows["_key"].eqNullSafe(members["_key"]) & (rows["_row"] == members["_row"])
    if rows_of <= NAMED_ROWS:  # else the texts are shuffled
        members = F.broadcast(members)
    texts_in = rows.join(members, same).select("root", "node", "copies", "chunks", "text")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, texts in slices(batch_column(batch, "text"), rows=20_000):
                grams, first = gram_sets(texts, size)
                raw = [grams[x:y].tobytes() for x, y in zip(first[:-1], first[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([*[batch_column(batch, n).slice(a, b - a) for n in ("root", "node", "copies", "chunks")], pa.array(raw, pa.binary())], ["root", "node", "copies", "chunks", "grams"])

    held = texts_in.mapInArrow(tidy(sets), "root binary, node binary, copies long, chunks int, grams binary")
    family = F.xxhash64("root").alias("family")
    keys = ["family", "root", "i", "j"]
    paired = _paired(held, "chunks").select(family, "root", "i", "j", "chunk", "node", "copies", "grams")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in runs(batches, keys):
            nodes = table.column("node").to_pylist()
            seen: dict[bytes, int] = {}
            for r, node in enumerate(nodes):  # rows that repeat a representative's key and text bring its set again
                seen.setdefault(node, r)
            table = table.take(pa.array(list(seen.values())))
            nodes = list(seen)
            a, b = _sides(table)
            if not len(a) or not len(b):
                continue
            found = [np.frombuffer(g, np.uint64) for g in table.column("grams").to_pylist()]
            n = np.array([len(g) for g in found])
            copies = table.column("copies").to_numpy()
            common = common_grams(found, a, b)
            linked = common >= threshold * (n[a][:, None] + n[b][None, :] - common) - 1e-9
            if a is b:
                np.fill_diagonal(linked, False)
            if not linked.any():
                continue
            members = np.concatenate([a, b])
            links = np.concatenate([linked @ copies[b], np.zeros(len(b), np.int64) if a is b else copies[a] @ linked])
            first = local_components(linked, a is b)
            at = np.flatnonzero(links)
            yield pa.RecordBatch.from_arrays([pa.array([nodes[members[i]] for i in at], pa.binary()), pa.array(links[at].astype(np.int64)), pa.array([nodes[members[first[i]]] for i in at], pa.binary())], ["node", "n", "to"])

    return paired.repartition("family", "i", "j").sortWithinPartitions(*keys).mapInArrow(tidy(compare), "node binary, n long, to binary")


def _linked(df: DataFrame, key: str, text: str, size: int, threshold: float, recall: float) -> DataFrame:
    """key, row, node, class_id, least_row (text hash of the class's first row), n_links of every row."""
    bands, rows = bands_for(threshold, recall)
    found = durable(described(df, key, text, size, bands, rows))
    sound = found.filter("node is not null")
    first = F.min(F.struct(F.col("key").isNull().alias("unnamed"), "key", "row")).alias("first")
    reps = sound.groupBy("node").agg(first, F.count(F.lit(1)).alias("copies"), F.first("bands").alias("bands"), F.first("signature").alias("signature"), F.first("n_grams").alias("n_grams"))
    total = found.count()
    reps = stored(reps.select("node", "first.key", "first.row", "copies", "bands", "signature", "n_grams"), total, TABLE_ROWS)
    agreement = LEAST_AGREEMENT * threshold / THRESHOLD
    roots = connected_components(candidates(reps, agreement), rows=total * bands)
    families = stored(reps.select("node", "key", "row", "copies", "n_grams").join(roots, "node"), total, TABLE_ROWS)
    size_of = families.count()
    links = stored(verified(families, size_of, df, key, text, size, threshold), size_of, FAMILY_ROWS)
    degrees = links.groupBy("node").agg(F.sum("n").alias("n"))
    members = reps.select("node", "key", "row", "copies").join(connected_components(links, "node", "to", rows=total), "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = F.min(F.struct(F.col("key").isNull().alias("unnamed"), "key", "row")).alias("first")
    names = members.groupBy("root").agg(least).select("root", F.col("first.key").alias("class_id"), F.col("first.row").alias("least_row"))
    sizes = members.groupBy("root").agg(F.count(F.lit(1)).alias("_n"))
    classes = attach(members, names, "root", ["node"], hot_rows(total), sizes).join(degrees, "node", "left").select("node", "class_id", "least_row", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    out = found.select("key", "row", "node").join(classes, "node", "left")
    return out.select("key", "row", "node", F.when(F.col("node").isNull(), F.col("key")).otherwise(F.col("class_id")).alias("class_id"), "least_row", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def link(df: DataFrame, key: str = "doc_id", text: str = "text", size: int = SIZE, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """One row per row of ``df``: key, class_id (smallest key reachable by links), n_links (other rows linked directly)."""
    return _linked(df, key, text, size, threshold, recall).select(F.col("key").alias(key), "class_id", "n_links")


def deduplicate(df: DataFrame, key: str = "doc_id", text: str = "text", size: int = SIZE, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """``df`` with one row of each class, that with the smallest key (of these, the smallest text hash); rows that link
    with nothing stay."""
    found = _linked(df, key, text, size, threshold, recall)
    found = stored(found, df.count(), TABLE_ROWS)
    first = F.col("key").eqNullSafe(F.col("class_id")) & (F.col("row") == F.col("least_row"))
    row, own, named, times = fresh(df, "row", "own", "named", "times")
    name = [F.col("key").alias(own), F.col("row").alias(named)]
    sound = found.filter("node is not null")
    gone = sound.filter(~first).select(*name).distinct()
    rows = df.withColumn(row, F.xxhash64(F.col(text)))
    same = lambda other: rows[key].eqNullSafe(other[own]) & (rows[row] == other[named])
    stay = rows.join(gone, same(gone), "left_anti")
    tied = stored(sound.filter(first).groupBy(*name).agg(F.count(F.lit(1)).alias(times)).filter(F.col(times) > 1), 0)
    if not tied.isEmpty():  # rows that repeat the first row of their class: one of them stays
        marked = stay.join(tied, same(tied), "left")
        several = marked.filter(F.col(times).isNotNull()).dropDuplicates([own, named])
        stay = marked.filter(F.col(times).isNull()).unionByName(several)
    return stay.select(*[F.col(f"`{c}`") for c in df.columns])
