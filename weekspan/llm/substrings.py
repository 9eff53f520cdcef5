"""Substring deduplication on a coloured de Bruijn graph of word windows.

Every window of ``WINDOW`` consecutive words is an edge between its first and its last ``WINDOW - 1`` words. Only edges
that stand in several documents matter. The colour of an edge is the set of documents that hold it; a path ends where
the next edge is not repeated or has another colour, that is at every branching node. So a repeated passage of thousands
of words is one row per document instead of thousands.

1. One scan hashes all windows and deals (hash, document) into buckets by hash, packed into byte blocks that hold a pair
   once per document. A bucket has about ``EDGES`` pairs however large the table is. More buckets do not split an edge,
   so edges of very many documents (``common``) go into none: their smallest and largest key and colour are computed by
   map-side sums over all documents, and this list of bounded length is broadcast to where documents are cut.
2. Each bucket finds its repeated edges and sends (document, edge, colour, later) back to the document; ``later`` says
   that a document with a smaller key holds the edge as well.
3. Documents meet their edges, form paths with the source coordinates (key, first word) and a 128-bit digest of the
   path's words, and cut the words covered by later edges.
4. Paths are verified by a join on colour, first edge, length and digest: a smaller document must hold the same words.
   Paths without a partner (documents that hold the edges in another order, or hashes that collide) are taken apart and
   verified edge by edge against all edges of their colours. Documents with an edge that fails are cut again without it.

A window counts by document key: rows with equal keys do not remove each other's words. All words are judged on the
input. Defined cases: null and empty texts have no words; fewer words than a window remove nothing; repeated rows and
ties in the key get equal results; a null key is larger than all others; an empty table gives no rows; other columns are
kept unless they have the name of a result column.
"""

from __future__ import annotations

import gc
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weekspan.llm import common
from weekspan.llm.textbatch import NOT_SPACE, Texts, Words, batch_column, buckets_for, by_bucket, fresh, mix, packed, slices, squeezed, text_volume, tidy
from weekspan.session import durable

WINDOW = 13
EDGES = 1_000_000
WORD_BYTES = 6  # bytes of text taken for a word when buckets are counted
DOCUMENT_BYTES = 8_000_000
NAMED_DOCUMENTS = 500_000  # keys of so many documents may be broadcast
LEAST_BUCKETS = 48
EDGE_BYTES = 5
LAST_KEY = (1 << 63) - 1
KEY, ROW, BUCKET, PATHS = "_order_key", "_row_key", "_bucket", "_paths"
HITS = f"{BUCKET} long, bucket long, rows binary, edges binary, marks binary, left_in binary"


class Edges:
    """How the hash of a window names its bucket and, within it, its edge."""

    def __init__(self, buckets: int, bits: int):
        self.buckets, self.mask = np.uint64(buckets), np.uint64((1 << bits) - 1)

    def bucket(self, hashes: np.ndarray) -> np.ndarray:
        return ((hashes >> np.uint64(32)) * self.buckets) >> np.uint64(32)

    def stored(self, hashes: np.ndarray) -> np.ndarray:
        return hashes & self.mask

    @staticmethod
    def whole(bucket: np.ndarray | int, stored: np.ndarray) -> np.ndarray:
        return (np.uint64(bucket) if np.isscalar(bucket) else bucket) << np.uint64(8 * EDGE_BYTES) | stored


def to_bytes(edges: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(edges.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :EDGE_BYTES])


def from_bytes(raw: bytes) -> np.ndarray:
    part = np.frombuffer(raw, np.uint8).reshape(-1, EDGE_BYTES)
    full = np.zeros((len(part), 8), np.uint8)
    full[:, :EDGE_BYTES] = part
    return full.view("<u8").reshape(-1)


def _cuts(sorted_codes: np.ndarray) -> np.ndarray:
    """Starts of runs of equal values, and the end."""
    if not len(sorted_codes):
        return np.zeros(1, np.int64)
    return np.append(np.flatnonzero(np.append(True, sorted_codes[1:] != sorted_codes[:-1])), len(sorted_codes))


def _windows(texts: Texts) -> tuple[np.ndarray, np.ndarray]:
    words = texts.words(NOT_SPACE)
    where, hashes = words.windows(WINDOW)
    return hashes, words.documents()[where]


def _whole(names: Edges, hashes: np.ndarray) -> np.ndarray:
    return Edges.whole(names.bucket(hashes), names.stored(hashes))


def _common_edges(rows: DataFrame, text: str, names: Edges, count: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Edges of very many documents, sorted, with the smallest and the largest key and the colour of each."""

    def values(texts: Texts) -> tuple[np.ndarray, np.ndarray]:
        hashes, owner = _windows(texts)
        return _whole(names, hashes), owner

    edges = common.candidates(rows, text, ROW, count, values)
    least, most, colour = np.full(len(edges), LAST_KEY), np.full(len(edges), -LAST_KEY - 1), np.zeros(len(edges), np.uint64)
    if not len(edges):
        return edges, least, most, colour
    known = rows.sparkSession.sparkContext.broadcast(edges)

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low, high, sums = np.full(len(known.value), LAST_KEY), np.full(len(known.value), -LAST_KEY - 1), np.zeros(len(known.value), np.uint64)
        for batch in batches:
            keys, row_keys = batch_column(batch, KEY).to_numpy(), batch_column(batch, ROW).to_numpy()
            for first, last, texts in slices(batch_column(batch, text), rows=60_000):
                hashes, owner = _windows(texts)
                found = common.places(known.value, _whole(names, hashes))[1]
                hashes, owner = common.once(hashes[found], owner[found])  # as in _edges, once per hash and document
                at = common.places(known.value, _whole(names, hashes))[0]
                order = np.argsort(at, kind="stable")
                at, owner = at[order], owner[order]
                if len(at):
                    starts = _cuts(at)[:-1]
                    key = keys[first:last][owner]
                    at = at[starts]
                    low[at], high[at] = np.minimum(low[at], np.minimum.reduceat(key, starts)), np.maximum(high[at], np.maximum.reduceat(key, starts))
                    sums[at] += np.add.reduceat(mix(row_keys[first:last][owner].view(np.uint64)), starts)
        at = np.flatnonzero(low <= high)
        halves = [(sums[at] & np.uint64(0xFFFFFFFF)).astype(np.int64), (sums[at] >> np.uint64(32)).astype(np.int64)]
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (at.astype(np.int64), low[at], high[at], *halves)], ["at", "least", "most", "lower", "upper"])

    found = rows.select(KEY, ROW, text).mapInArrow(tidy(tally), "at long, least long, most long, lower long, upper long")
    total = found.groupBy("at").agg(F.min("least").alias("least"), F.max("most").alias("most"), F.sum("lower").alias("lower"), F.sum("upper").alias("upper")).toArrow()
    at, low, high, lower, upper = (total.column(n).to_numpy() for n in ("at", "least", "most", "lower", "upper"))
    least[at], most[at], colour[at] = low, high, lower.astype(np.uint64) + (upper.astype(np.uint64) << np.uint64(32))
    return edges, least, most, colour


def _mark(colour: np.ndarray, later: np.ndarray) -> np.ndarray:
    """The upper bits of a colour with the ``later`` bit."""
    return (colour >> np.uint64(32)).astype(np.uint32) & np.uint32(0xFFFFFFFE) | later.astype(np.uint32)


def _edges(rows: DataFrame, text: str, names: Edges, apart) -> DataFrame:
    """Blocks of (edge, document) pairs by bucket, without the edges of the broadcast ``apart``; a document is a number
    into the block's lists of keys."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch_column(batch, KEY).to_numpy()
            row_keys = batch_column(batch, ROW).to_numpy()
            for first, last, texts in slices(batch_column(batch, text), rows=60_000):
                hashes, owner = _windows(texts)
                left = ~common.places(apart.value[0], _whole(names, hashes))[1]
                hashes, owner = hashes[left], owner[left]
                if not len(hashes):
                    continue
                order = np.argsort(hashes, kind="stable")
                hashes, owner = hashes[order], owner[order]
                once = np.append(True, (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1]))
                hashes, owner = hashes[once], owner[once]
                bucket = names.bucket(hashes)
                cuts = _cuts(bucket)
                blocks = list(zip(cuts[:-1], cuts[1:], strict=True))
                listed = [np.unique(owner[a:b], return_inverse=True) for a, b in blocks]
                raw = to_bytes(names.stored(hashes))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(bucket[cuts[:-1]].astype(np.int64)), pa.array([raw[a:b].tobytes() for a, b in blocks], pa.binary()), pa.array([c.astype("<u2").tobytes() for _, c in listed], pa.binary()),
                        pa.array([keys[first:last][u].astype("<i8").tobytes() for u, _ in listed], pa.binary()),
                        pa.array([row_keys[first:last][u].astype("<i8").tobytes() for u, _ in listed], pa.binary()),
                    ],
                    ["bucket", "edges", "documents", "keys", "row_keys"],
                )

    return rows.select(KEY, ROW, text).mapInArrow(tidy(emit), "bucket long, edges binary, documents binary, keys binary, row_keys binary")


def _repeated(blocks: DataFrame, buckets: int, groups: int) -> DataFrame:
    """For each document, blocks of its repeated edges: row key, edge, colour with the ``later`` bit."""

    def find(table: pa.Table) -> pa.Table:
        keys, row_keys, edges = [], [], []
        for e, d, k, r in zip(*[table.column(n).to_pylist() for n in ("edges", "documents", "keys", "row_keys")], strict=True):
            numbers = np.frombuffer(d, "<u2")
            edges.append(from_bytes(e))
            keys.append(np.frombuffer(k, "<i8")[numbers])
            row_keys.append(np.frombuffer(r, "<i8")[numbers])
        edge, key, row_key = map(np.concatenate, (edges, keys, row_keys))
        del edges, keys, row_keys
        order = np.argsort(edge, kind="stable")
        edge = edge[order]
        cuts = _cuts(edge)
        sizes = np.diff(cuts)
        many = np.repeat(sizes > 1, sizes)
        order, edge = order[many], edge[many]
        key, row_key = key[order], row_key[order]
        if len(edge):
            cuts = _cuts(edge)
            sizes = np.diff(cuts)
            least = np.minimum.reduceat(key, cuts[:-1])
            most = np.maximum.reduceat(key, cuts[:-1])
            colour = np.add.reduceat(mix(row_key.view(np.uint64)), cuts[:-1])
            shared = np.repeat(least < most, sizes)
            later = key > np.repeat(least, sizes)
            mark = _mark(np.repeat(colour, sizes), later)
            edge, row_key, mark = edge[shared], row_key[shared], mark[shared]
        else:
            mark = np.zeros(0, np.uint32)
        group = (mix(row_key.view(np.uint64)) >> np.uint64(32)) * np.uint64(groups) >> np.uint64(32)
        order = np.lexsort((row_key, group))
        group, edge, row_key, mark = group[order], edge[order], row_key[order], mark[order]
        cuts = _cuts(group)
        raw = to_bytes(edge)
        return pa.table(
            {
                BUCKET: pa.array(group[cuts[:-1]].astype(np.int64)), "bucket": pa.array([table.column("bucket")[0].as_py()] * (len(cuts) - 1), pa.int64()), "rows": pa.array(packed(row_key, cuts), pa.binary()),
                "edges": pa.array([raw[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary()), "marks": pa.array(packed(mark, cuts), pa.binary()),
                "left_in": pa.array([None] * (len(cuts) - 1), pa.binary()),
            }
        )

    return by_bucket(blocks, "bucket", buckets).groupBy("bucket").applyInArrow(tidy(find), HITS)


def _joint(row_key: np.ndarray, edge: np.ndarray) -> np.ndarray:
    """One value for a document and an edge."""
    return mix(row_key.view(np.uint64)) + mix(edge + np.uint64(1))


def _group_of(groups: int):
    """The document group of a row key, as ``_repeated`` computes it."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key = batch_column(batch, ROW).to_numpy().view(np.uint64)
            group = (mix(key) >> np.uint64(32)) * np.uint64(groups) >> np.uint64(32)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(group.astype(np.int64))], [*batch.schema.names, BUCKET])

    return of


def _cut_documents(kept: list[str], text: str, names: Edges, digest: bool, with_paths: bool, apart):
    """Left: documents of a group; right: blocks of their repeated edges and, when cut again, of windows to leave in."""

    def run(documents: pa.Table, blocks: pa.Table) -> pa.Table:
        joints, marks, left_in = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint32)], [np.zeros(0, np.uint64)]
        for b, r, e, m, x in zip(*[blocks.column(n).to_pylist() for n in ("bucket", "rows", "edges", "marks", "left_in")], strict=True):
            if x is not None:
                left_in.append(_joint(np.frombuffer(r, "<i8"), np.frombuffer(x, "<u8")))
            else:
                joints.append(_joint(np.frombuffer(r, "<i8"), Edges.whole(b, from_bytes(e))))
                marks.append(np.frombuffer(m, "<u4"))
        joint, mark, unwanted = map(np.concatenate, (joints, marks, left_in))
        del joints, marks
        order = np.argsort(joint)
        joint, mark = joint[order], mark[order]
        n_words = np.zeros(documents.num_rows, np.int64)
        n_removed = np.zeros(documents.num_rows, np.int64)
        kept_out: list = [None] * documents.num_rows if digest else documents.column(text).to_pylist()
        paths: list = [[] for _ in range(documents.num_rows)] if with_paths else []
        row_keys, keys = documents.column(ROW).to_numpy(), documents.column(KEY).to_numpy()
        often, least, most, often_colour = apart.value
        for first, last, texts in slices(documents.column(text)):
            words = texts.words(NOT_SPACE)
            n_words[first:last] = words.counts()
            where, hashes = words.windows(WINDOW)
            owner = words.documents()
            edge = _whole(names, hashes)
            row = row_keys[first:last][owner[where]]
            wanted = _joint(row, edge)
            at, here = common.places(joint, wanted)
            marked = np.zeros(len(edge), np.uint32)
            marked[here] = mark[at[here]]
            at, shared = common.places(often, edge)
            shared = np.flatnonzero(shared)
            shared = shared[least[at[shared]] < most[at[shared]]]
            at, here[shared] = at[shared], True
            marked[shared] = _mark(often_colour[at], keys[first:last][owner[where[shared]]] > least[at])
            found = np.flatnonzero(here)
            if len(unwanted):
                found = found[~np.isin(_joint(row[found], hashes[found]), unwanted)]
            colour, place = marked[found], where[found]
            later = (colour & np.uint32(1)).astype(bool)
            steps = np.zeros(len(words) + 1, np.int32)
            np.add.at(steps, place[later], 1)
            np.add.at(steps, np.minimum(place[later] + WINDOW, len(words)), -1)
            removed = np.cumsum(steps[:-1]) > 0
            gone = np.bincount(owner[removed], minlength=len(texts))
            n_removed[first:last] = gone
            if digest or gone.any():
                left, _ = squeezed(words, ~removed)
                for d in range(len(texts)) if digest else np.flatnonzero(gone):
                    body = left.document(d)
                    kept_out[first + d] = hashlib.sha256(body).hexdigest() if digest else body.decode("utf-8", "replace")
            if with_paths and len(found):
                _paths(paths, first, words, place, edge[found], colour, owner)
        out = {n: documents.column(n) for n in kept}
        out |= {"n_words": pa.array(n_words), "n_removed": pa.array(n_removed), "kept_sha256" if digest else text: pa.array(kept_out, pa.string())}
        if with_paths:
            kind = pa.list_(pa.struct([("colour", pa.int32()), ("edge", pa.int64()), ("n", pa.int32()), ("digest", pa.binary()), ("start", pa.int32()), ("later", pa.bool_())]))
            out[PATHS] = pa.array(paths, kind)
        return pa.table(out)

    return run


def _paths(paths: list, first: int, words: Words, place: np.ndarray, edge: np.ndarray, colour: np.ndarray, owner: np.ndarray) -> None:
    """Compact runs of neighbouring edges of one colour and describe each by its words' digest and its source coordinates."""
    joins = (place[1:] == place[:-1] + 1) & (colour[1:] == colour[:-1]) & (owner[place[1:]] == owner[place[:-1]])
    starts = np.flatnonzero(np.append(True, ~joins))
    lengths = np.diff(np.append(starts, len(place)))
    plain, begin = squeezed(words)
    data = plain.data.tobytes()
    sizes = words.ends - words.starts
    for s, n in zip(starts, lengths, strict=True):
        p = place[s]
        final = p + n - 1 + WINDOW - 1
        body = data[begin[p] : begin[final] + sizes[final]]
        d = owner[p]
        paths[first + d].append((int(colour[s] >> np.uint32(1)), int(edge[s].view(np.int64)), int(n), hashlib.blake2b(body, digest_size=16).digest(), int(p - words.first[d]), bool(colour[s] & np.uint32(1))))


PATH_TYPE = "array<struct<colour: int, edge: long, n: int, digest: binary, start: int, later: boolean>>"


def _release() -> None:
    """Let Spark's cleaner delete the shuffle files of finished steps, whose rows are stored by now."""
    from pyspark.sql import SparkSession

    for _ in range(2):
        gc.collect()
        SparkSession.active().sparkContext._jvm.System.gc()


def _failed(found: DataFrame, documents: DataFrame, text: str) -> DataFrame | None:
    """(row key, hash) of windows marked ``later`` whose words no smaller document holds; None if there are none."""
    path = found.select(KEY, ROW, F.explode(PATHS).alias("p")).select(KEY, ROW, "p.*")
    group = ["colour", "edge", "n", "digest"]
    least = path.groupBy(*group).agg(F.min(KEY).alias("_least"), F.max(KEY).alias("_most")).filter(F.col("_least") < F.col("_most"))
    alone = path.filter("later").join(least, group, "left").filter(F.col("_least").isNull() | (F.col("_least") >= F.col(KEY)))
    alone = durable(alone.select(KEY, ROW, "colour"))
    if alone.isEmpty():
        return None
    involved = path.join(alone.select("colour").distinct(), "colour", "left_semi")
    places = durable(involved.groupBy(KEY, ROW).agg(F.collect_list(F.struct("start", "n", "later")).alias("_places")))
    rows = documents.select(KEY, ROW, text)
    if places.count() <= NAMED_DOCUMENTS:  # else all texts are shuffled
        rows = rows.join(F.broadcast(places.select(ROW).distinct()), ROW, "left_semi")
    joined = rows.join(places, [KEY, ROW])

    def apart(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            every = batch_column(batch, "_places").to_pylist()
            keys, rows = batch_column(batch, KEY).to_pylist(), batch_column(batch, ROW).to_pylist()
            for first, last, texts in slices(batch_column(batch, text)):
                words = texts.words(NOT_SPACE)
                where, hashes = words.windows(WINDOW)
                plain, begin = squeezed(words)
                data, sizes = plain.data.tobytes(), words.ends - words.starts
                out: list[tuple] = []
                for d in range(last - first):
                    base = int(words.first[d])
                    for x in every[first + d]:
                        for p in range(base + x["start"], base + x["start"] + x["n"]):
                            body = data[begin[p] : begin[p + WINDOW - 1] + sizes[p + WINDOW - 1]]
                            whole = int(hashes[np.searchsorted(where, p)].view(np.int64))
                            out.append((keys[first + d], rows[first + d], whole, hashlib.blake2b(body, digest_size=16).digest(), x["later"]))
                        if len(out) > 20_000:
                            yield _apart_batch(out)
                            out = []
                if out:
                    yield _apart_batch(out)

    windows = durable(joined.mapInArrow(tidy(apart), f"{KEY} long, {ROW} long, hash long, digest binary, later boolean"))
    held = windows.groupBy("hash", "digest").agg(F.min(KEY).alias("_least"))
    failed = durable(windows.filter("later").join(held, ["hash", "digest"]).filter(F.col("_least") >= F.col(KEY)).select(ROW, "hash").distinct())
    return None if failed.isEmpty() else failed


def _apart_batch(out: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.bool_()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], [KEY, ROW, "hash", "digest", "later"])


def remove_repeats(df: DataFrame, key: str = "doc_id", text: str = "text", digest: bool = False, edge_bits: int = 8 * EDGE_BYTES) -> DataFrame:
    """``df`` with n_words, n_removed and the text without later repeats (unchanged where nothing is removed, else the
    kept words with one space between them). With ``digest`` the texts are replaced by kept_sha256, the hash of the kept
    words with one space between them, and only the key column is kept."""
    clashing = [c for c in df.columns if c.lower() in {KEY, ROW, BUCKET, PATHS}]
    inner = dict(zip(clashing, fresh(df, *[f"{c}_own" for c in clashing]), strict=True))
    found = _without_repeats(df.withColumnsRenamed(inner), inner.get(key, key), inner.get(text, text), digest, edge_bits)
    return found.withColumnsRenamed({v: k for k, v in inner.items()})


def _without_repeats(df: DataFrame, key: str, text: str, digest: bool, edge_bits: int) -> DataFrame:
    names = [key] if digest else [c for c in df.columns if c not in (text, "n_words", "n_removed")]
    count, volume = text_volume(df, text)
    edges = Edges(buckets_for(volume // WORD_BYTES, EDGES, LEAST_BUCKETS), edge_bits)
    groups = buckets_for(volume, DOCUMENT_BYTES, LEAST_BUCKETS)
    order_key = F.coalesce(F.col(key).cast("long"), F.lit(LAST_KEY)).alias(KEY)
    documents = df.select(*[F.col(f"`{c}`") for c in names], F.col(text), order_key, F.xxhash64(F.col(key), F.col(text)).alias(ROW))
    apart = df.sparkSession.sparkContext.broadcast(_common_edges(documents, text, edges, count))
    hits = durable(_repeated(_edges(documents, text, edges, apart), int(edges.buckets), groups))
    _release()
    spec = T.StructType([*documents.schema.fields, T.StructField(BUCKET, T.LongType())])
    dealt = documents.mapInArrow(tidy(_group_of(groups)), spec)
    kept = [*names, KEY, ROW]
    result = T.StructType([*[documents.schema[c] for c in kept], T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_sha256" if digest else text, T.StringType())])
    with_paths = T.StructType([*result.fields, T.StructField(PATHS, T._parse_datatype_string(PATH_TYPE))])
    found = durable(by_bucket(dealt, BUCKET, groups).groupBy(BUCKET).cogroup(by_bucket(hits, BUCKET, groups).groupBy(BUCKET)).applyInArrow(tidy(_cut_documents(kept, text, edges, digest, True, apart)), with_paths))
    _release()
    failed = _failed(found, documents, text)
    if failed is not None:  # practically only with colliding hashes
        again = failed.select(ROW).distinct()
        redo = dealt.join(again, ROW, "left_semi").select(dealt.columns)
        known = hits.unionByName(_left_in(failed, groups))
        redone = redo.groupBy(BUCKET).cogroup(known.groupBy(BUCKET)).applyInArrow(tidy(_cut_documents(kept, text, edges, digest, False, apart)), result)
        found = found.drop(PATHS).join(again, ROW, "left_anti").select(result.names).unionByName(redone)
    counts = ["n_words", "n_removed"]
    columns = [key, *counts, "kept_sha256"] if digest else [*[c for c in df.columns if c not in counts], *counts]
    return found.select(*[F.col(f"`{c}`") for c in columns])


def _left_in(failed: DataFrame, groups: int) -> DataFrame:
    """Windows that stay, as blocks for the groups of their documents."""
    schema = T.StructType([*failed.schema.fields, T.StructField(BUCKET, T.LongType())])

    def block(table: pa.Table) -> pa.Table:
        rows, hashes = (table.column(n).to_numpy().tobytes() for n in (ROW, "hash"))
        columns = [[table.column(BUCKET)[0].as_py()], [0], [rows], [b""], [b""], [hashes]]
        kinds = [pa.int64(), pa.int64()] + [pa.binary()] * 4
        return pa.table({n.split()[0]: pa.array(c, k) for n, c, k in zip(HITS.split(", "), columns, kinds, strict=True)})

    return failed.mapInArrow(tidy(_group_of(groups)), schema).groupBy(BUCKET).applyInArrow(tidy(block), HITS)
