"""Whole texts as byte arrays: word boundaries and word hashes of an Arrow batch at once, without a loop over words.

Every function here works on one slice of an Arrow column. A slice holds at most ``SLICE_BYTES`` of text or a single
longer document, so memory follows the batch and never the table. Nulls are empty texts.
"""

from __future__ import annotations

import ctypes
import functools
import inspect
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SLICE_BYTES = 1_000_000
MOST_TASKS = 20_000
MASK = (1 << 64) - 1
MULTIPLIER = 0x9E3779B97F4A7C15 | 1


def give_back() -> None:
    """Return freed memory to the system, as Spark keeps idle Python workers."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def tidy(run: Callable) -> Callable:
    """A function of Arrow batches or of whole groups that leaves no freed memory behind in its worker."""

    def batches(*arguments):
        try:
            yield from run(*arguments)
        finally:
            give_back()

    @functools.wraps(run)
    def group(left: pa.Table) -> pa.Table:
        out = run(left)
        give_back()
        return out

    @functools.wraps(run)
    def groups(left: pa.Table, right: pa.Table) -> pa.Table:
        out = run(left, right)
        give_back()
        return out

    if inspect.isgeneratorfunction(run):
        return functools.wraps(run)(batches)
    return group if len(inspect.signature(run).parameters) == 1 else groups


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def text_volume(df: DataFrame, column: str = "text") -> tuple[int, int]:
    """Rows and UTF-8 bytes; from these every operator derives how many buckets it deals its rows into."""
    row = df.select(F.octet_length(column).alias("n")).agg(F.count(F.lit(1)), F.sum("n")).first()
    return row[0], row[1] or 0


def buckets_for(amount: int, per_bucket: int, least: int = 8) -> int:
    """Number of buckets of about ``per_bucket`` units; grows in proportion to the data."""
    return max(least, -(-amount // per_bucket))


def by_bucket(df: DataFrame, bucket: str, buckets: int) -> DataFrame:
    """``df`` by bucket, a task for each up to ``MOST_TASKS``; grouping by the bucket then needs no further shuffle."""
    return df.repartition(min(buckets, MOST_TASKS), bucket)


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit values (the splitmix64 finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def member(*characters: str) -> np.ndarray:
    """Lookup of the bytes listed as single characters or (first, last) ranges."""
    found = np.zeros(256, bool)
    for c in characters:
        found[ord(c[0]) : ord(c[-1]) + 1] = True
    return found


#: Bytes of words that end at white space, [^\x20\x09-\x0D]+
NOT_SPACE = ~member("\x20", "\x09\x0d")
#: Bytes of words [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ of text whose A-Z are lower case
ALNUM = member("09", "az")
ALNUM[128:] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32


class Powers:
    """Powers of an odd multiplier and of its inverse modulo 2**64, kept per process and extended when needed."""

    up = np.ones(1, np.uint64)
    down = np.ones(1, np.uint64)

    @classmethod
    def of(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            size = max(n, 2 * len(cls.up), 1 << 16)
            for name, base in (("up", MULTIPLIER), ("down", pow(MULTIPLIER, -1, 1 << 64))):
                steps = np.full(size, base, np.uint64)
                steps[0] = 1
                setattr(cls, name, np.multiply.accumulate(steps))
        return cls.up[:n], cls.down[:n]


BYTE_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of every byte range, equal for equal contents wherever they stand."""
    up, down = Powers.of(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE_VALUES[data] * up[: len(data)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


class Texts:
    """Some documents: ``data`` holds their bytes, document i is ``data[bounds[i]:bounds[i + 1]]``."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray):
        self.data, self.bounds = data, bounds

    def __len__(self) -> int:
        return len(self.bounds) - 1

    def lower(self) -> Texts:
        return Texts(LOWER[self.data], self.bounds)

    def bytes_of(self, start: int, end: int) -> bytes:
        return self.data[start:end].tobytes()

    def document(self, i: int) -> bytes:
        return self.bytes_of(self.bounds[i], self.bounds[i + 1])

    def words(self, allowed: np.ndarray) -> Words:
        """Maximal runs of allowed bytes within a document."""
        inside = allowed[self.data]
        before = np.zeros(len(inside), bool)
        before[1:] = inside[:-1]
        after = np.zeros(len(inside), bool)
        after[:-1] = inside[1:]
        filled = self.bounds[:-1] < self.bounds[1:]
        before[self.bounds[:-1][filled]] = False
        after[self.bounds[1:][filled] - 1] = False
        starts = np.flatnonzero(inside & ~before)
        ends = np.flatnonzero(inside & ~after) + 1
        return Words(self, starts, ends, np.searchsorted(starts, self.bounds))


class Words:
    """Word i is ``data[starts[i]:ends[i]]``; those of document d are ``first[d]`` to ``first[d + 1]``."""

    def __init__(self, texts: Texts, starts: np.ndarray, ends: np.ndarray, first: np.ndarray):
        self.texts, self.starts, self.ends, self.first = texts, starts, ends, first
        self.known: np.ndarray | None = None

    def __len__(self) -> int:
        return len(self.starts)

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def documents(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.texts)), self.counts())

    def hashes(self) -> np.ndarray:
        if self.known is None:
            self.known = span_hashes(self.texts.data, self.starts, self.ends)
        return self.known

    def joined(self, positions: np.ndarray) -> bytes:
        """The words at these positions with one space between them."""
        data = self.texts.data
        return b" ".join([data[s:e].tobytes() for s, e in zip(self.starts[positions], self.ends[positions], strict=True)])

    def windows(self, size: int, hashes: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """First positions of all runs of ``size`` words inside one document, and their hashes."""
        n = len(self) - size + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        return self._within(size), self._rolled(size, self.hashes() if hashes is None else hashes)

    def _within(self, size: int) -> np.ndarray:
        remaining = np.repeat(self.first[1:], self.counts()) - np.arange(len(self))
        return np.flatnonzero(remaining >= size)

    def _rolled(self, size: int, hashes: np.ndarray) -> np.ndarray:
        return roll(hashes, size)[self._within(size)]


def roll(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of ``size`` consecutive values; order matters."""
    n = len(hashes) - size + 1
    total = np.zeros(n, np.uint64)
    weight = 1
    for i in range(size):
        total += hashes[i : i + n] * np.uint64(weight)
        weight = weight * MULTIPLIER & MASK
    return mix(total)


def slices(column: pa.Array | pa.ChunkedArray, limit: int = SLICE_BYTES, rows: int = 1 << 30) -> Iterator[tuple[int, int, Texts]]:
    """Cut a text column into runs of rows (first, last + 1, texts) of bounded bytes and at most ``rows`` rows."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    if not len(column):
        return
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, values = column.buffers()
    kind = np.int64 if wide else np.int32
    bounds = np.frombuffer(offsets, kind, len(column) + 1, column.offset * kind().itemsize).astype(np.int64)
    data = np.frombuffer(values, np.uint8) if values is not None else np.zeros(0, np.uint8)
    first = 0
    while first < len(column):
        last = int(np.searchsorted(bounds, bounds[first] + limit, "right")) - 1
        last = min(max(last, first + 1), first + rows, len(column))
        yield first, last, Texts(data[bounds[first] : bounds[last]], bounds[first : last + 1] - bounds[first])
        first = last


def packed(values: np.ndarray, cuts: np.ndarray) -> list[bytes]:
    """``values[cuts[i]:cuts[i + 1]]`` as bytes."""
    raw, width = values.tobytes(), values.itemsize
    return [raw[a * width : b * width] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def key_remainder(key: str, divisor: int):
    """crc32 of the key as text, modulo ``divisor``; null for a null key."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % divisor


def fresh(df: DataFrame, *names: str) -> tuple[str, ...]:
    """Names like the given ones that no column of ``df`` has, whatever the case of its letters."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return tuple(out)


def batch_column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def with_columns(batch: pa.RecordBatch, kept: list[str], added: dict[str, pa.Array]) -> pa.RecordBatch:
    """The kept columns of a batch followed by new ones."""
    arrays = [batch_column(batch, n) for n in kept] + list(added.values())
    return pa.RecordBatch.from_arrays(arrays, names=[*kept, *added])


def squeezed(words: Words, kept: np.ndarray | None = None) -> tuple[Texts, np.ndarray]:
    """The kept words of each document with one space between them, and where each kept word starts there.

    Works for words that end at bytes they do not contain: the byte after a word then becomes its space.
    """
    texts = words.texts
    n = len(words)
    kept = np.ones(n, bool) if kept is None else kept
    chosen = np.flatnonzero(kept)
    owner = words.documents()[chosen]
    last = np.append(owner[1:] != owner[:-1], True) if len(chosen) else np.zeros(0, bool)
    steps = np.zeros(len(texts.data) + 2, np.int32)
    ends = words.ends[chosen] + np.where(last, 0, 1)
    np.add.at(steps, words.starts[chosen], 1)
    np.add.at(steps, ends, -1)
    inside = np.cumsum(steps[:-2]) > 0
    data = texts.data.copy()
    data[words.ends[chosen][~last]] = 32
    before = np.zeros(len(texts.data) + 1, np.int64)
    np.cumsum(inside, out=before[1:])
    return Texts(data[inside], before[texts.bounds]), before[words.starts[chosen]]


def runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables of neighbouring rows with equal keys, from batches that are sorted by them."""
    waiting: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = pa.Table.from_batches([batch]) if waiting is None else pa.concat_tables([waiting, pa.Table.from_batches([batch])]).combine_chunks()
        change = np.zeros(rows.num_rows, bool)
        for k in keys:
            values = rows.column(k).to_numpy()
            change[1:] |= values[1:] != values[:-1]
        cuts = np.concatenate([[0], np.flatnonzero(change)])
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            yield rows.slice(a, b - a)
        waiting = rows.slice(cuts[-1])
    if waiting is not None:
        yield waiting


def local_components(linked: np.ndarray, same: bool) -> np.ndarray:
    """For the rows, then the columns of a matrix of links between two lists: the first member of each one's component.

    ``same``: row i and column i are one member.
    """
    rows, columns = linked.shape
    if same:
        linked = linked | np.eye(rows, dtype=bool)
    none = rows + columns
    by_row, by_column = np.arange(rows), np.arange(rows, none)
    while True:
        new_column = np.minimum(by_column, np.where(linked, by_row[:, None], none).min(0, initial=none))
        new_row = np.minimum(by_row, np.where(linked, new_column[None, :], none).min(1, initial=none))
        if (new_column == by_column).all() and (new_row == by_row).all():
            return np.concatenate([by_row, by_column])
        by_row, by_column = new_row, new_column
