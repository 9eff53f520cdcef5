"""Benchmark decontamination: a broadcast set of the benchmark's word windows, looked for in every document.

Words are runs of letters, digits and multi-byte characters of the text with A-Z in lower case. A benchmark item gives
all its windows of ``WINDOW`` words, a shorter one a single window of all its words. Documents are scanned in one narrow
pass: window hashes are looked up in the broadcast hash set, every hit is verified on the words themselves, and words
inside a verified window are hit. Nothing is shuffled, so a hot source or a passage in a third of all documents costs
no more than any other text.

Equal item texts are collapsed, and the benchmark is cut into blocks of about ``BLOCK_BYTES`` of text and ids, the bound of
each broadcast and of what the driver holds at a time. One block is the normal case; a larger benchmark takes a pass for
each block, whose hits are united with those of the passes before and stored, before the next block is fetched.

Defined cases: null texts, on either side, have no words; repeated items count once per item id; a null item id is the
text ``null``; an empty benchmark hits nothing; extra columns are kept unless they have the name of a result column.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weekspan.llm.textbatch import ALNUM, Words, batch_column, fresh, slices, tidy, with_columns
from weekspan.session import durable

WINDOW = 10
BLOCK_BYTES = 16_000_000
FILTER_BITS = 22
SPANS, DOCUMENTS = "spans", "documents"
FOUND = ("n_words", "hit_words", "items")


class Index:
    """Windows of one block of the benchmark: sorted hashes by window length, and the items of each window."""

    def __init__(self, items: list[tuple[list[str], str]]):
        self.items: dict[bytes, set[str]] = {}
        hashes: dict[int, list[np.ndarray]] = {}
        names = [i for i, _ in items]
        for first, _, texts in slices(pa.array([t for _, t in items], pa.string())):
            words = texts.lower().words(ALNUM)
            own = words.hashes()
            for d, n in enumerate(words.counts()):
                if not n:
                    continue
                size = min(int(n), WINDOW)
                for p in range(words.first[d], words.first[d + 1] - size + 1):
                    self.items.setdefault(words.joined(np.arange(p, p + size)), set()).update(names[first + d])
            for size in {min(int(n), WINDOW) for n in words.counts() if n}:
                where, found = words.windows(size, own)
                owner = words.documents()[where]
                hashes.setdefault(size, []).append(found[np.minimum(words.counts(), WINDOW)[owner] == size])
        self.sizes = {size: np.unique(np.concatenate(found)) for size, found in hashes.items()}
        self.filters = {size: self._filter(found) for size, found in self.sizes.items()}

    @staticmethod
    def _filter(hashes: np.ndarray) -> np.ndarray:
        """Leading bits that occur: rules nearly all windows out before the search among the sorted hashes."""
        seen = np.zeros(1 << FILTER_BITS, bool)
        seen[hashes >> np.uint64(64 - FILTER_BITS)] = True
        return seen

    def hits(self, words: Words) -> Iterator[tuple[int, int, set[str]]]:
        """(first word, window length, items) of every verified window."""
        own = words.hashes()
        for size, hashes in self.sizes.items():
            where, found = words.windows(size, own)
            maybe = np.flatnonzero(self.filters[size][found >> np.uint64(64 - FILTER_BITS)])
            at = np.minimum(np.searchsorted(hashes, found[maybe]), len(hashes) - 1)
            for p in where[maybe[hashes[at] == found[maybe]]]:
                items = self.items.get(words.joined(np.arange(p, p + size)))
                if items:
                    yield int(p), size, items


def _blocks(benchmark: DataFrame, item: str, text: str) -> tuple[DataFrame, int]:
    """(names, text, block) of each distinct item text, stored, and the number of blocks."""
    rows = benchmark.select(F.coalesce(F.col(item).cast("string"), F.lit("null")).alias("item"), F.col(text).alias("text")).filter(F.col("text").isNotNull())
    distinct = rows.groupBy("text").agg(F.sort_array(F.collect_set("item")).alias("names"))
    sized = distinct.withColumn("bytes", F.octet_length("text") + F.octet_length(F.concat_ws(",", "names")))
    sized = durable(sized, "items")
    volume = sized.agg(F.sum("bytes")).first()[0] or 0
    count = max(1, -(-volume // BLOCK_BYTES))
    return sized.select("names", "text", F.pmod(F.xxhash64("text"), F.lit(count)).alias("block")), count


def scan(df: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", kept: list[str] | None = None, names: tuple[str, str, str] = FOUND) -> DataFrame:
    """``kept`` columns with n_words, hit_words (positions of hit words) and items (sorted ids of items that occur)."""
    kept = [c for c in (df.columns if kept is None else kept) if c not in names]
    carried = kept if text in kept else [*kept, text]
    out = df.select(*[F.col(f"`{c}`") for c in carried])
    added = [T.StructField(n, kind) for n, kind in zip(names, (T.LongType(), T.ArrayType(T.IntegerType()), T.ArrayType(T.StringType())), strict=True)]
    items, count = _blocks(benchmark, item, item_text)
    for i in range(count):
        block = sorted((r.names, r.text) for r in items.filter(F.col("block") == i).collect())
        index = df.sparkSession.sparkContext.broadcast(Index(block))
        columns = kept if i == count - 1 else carried
        schema = T.StructType([*[out.schema[c] for c in columns], *added])
        out = out.mapInArrow(tidy(_pass(index, text, columns, names, i > 0)), schema)
        if i < count - 1:
            out = durable(out, "passed")
            index.unpersist()
    return out


def _pass(index, text: str, kept: list[str], names: tuple[str, str, str], earlier: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words = np.zeros(batch.num_rows, np.int64)
            hit_words: list = batch_column(batch, names[1]).to_pylist() if earlier else [[]] * batch.num_rows
            items: list = batch_column(batch, names[2]).to_pylist() if earlier else [[]] * batch.num_rows
            for first, last, texts in slices(batch_column(batch, text)):
                words = texts.lower().words(ALNUM)
                n_words[first:last] = words.counts()
                covered: dict[int, set[int]] = {}
                found: dict[int, set[str]] = {}
                for p, size, ids in index.value.hits(words):
                    d = int(np.searchsorted(words.first, p, "right")) - 1
                    covered.setdefault(d, set()).update(range(p - words.first[d], p - words.first[d] + size))
                    found.setdefault(d, set()).update(ids)
                for d in covered:
                    hit_words[first + d] = sorted(covered[d].union(hit_words[first + d]))
                    items[first + d] = sorted(found[d].union(items[first + d]))
            found_arrays = (pa.array(n_words), pa.array(hit_words, pa.list_(pa.int32())), pa.array(items, pa.list_(pa.string())))
            yield with_columns(batch, kept, dict(zip(names, found_arrays, strict=True)))

    return run


def decontaminate(df: DataFrame, benchmark: DataFrame, remove: str = DOCUMENTS, text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """``df`` without contaminated documents, or with the hit spans cut out of their texts, columns unchanged."""
    if remove not in (SPANS, DOCUMENTS):
        raise ValueError(f"remove must be {SPANS} or {DOCUMENTS}")
    columns, names = df.columns, fresh(df, *FOUND)
    found = scan(df, benchmark, text, item, item_text, names=names)
    if remove == DOCUMENTS:
        return found.filter(F.size(names[2]) == 0).select(*[F.col(f"`{c}`") for c in columns])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts_out = batch_column(batch, text).to_pylist()
            hit = batch_column(batch, names[1]).to_pylist()
            for first, last, texts in slices(batch_column(batch, text)):
                words = texts.lower().words(ALNUM)
                for d in range(last - first):
                    if hit[first + d]:
                        texts_out[first + d] = _without(texts.document(d), words, d, np.array(hit[first + d]), int(texts.bounds[d]))
            place = batch.schema.get_field_index(text)
            batch = batch.set_column(place, batch.schema.field(place), pa.array(texts_out, pa.string()))
            yield batch.select(columns)

    return found.mapInArrow(tidy(cut), T.StructType([found.schema[c] for c in columns]))


def _without(body: bytes, words: Words, d: int, hit: np.ndarray, origin: int) -> str:
    """The text without each run of hit words, from its first word's start to its last word's end."""
    ends_run = np.append(np.diff(hit) > 1, True)
    starts_run = np.append(True, np.diff(hit) > 1)
    out, at = [], 0
    for a, b in zip(hit[starts_run] + words.first[d], hit[ends_run] + words.first[d], strict=True):
        out.append(body[at : words.starts[a] - origin])
        at = int(words.ends[b]) - origin
    return b"".join([*out, body[at:]]).decode("utf-8", "replace")
