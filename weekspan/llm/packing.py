"""Best-fit packing of tokenised documents into sequences by linear grouping.

Documents are cut into pieces of at most the capacity. Packing needs only how many pieces of each length there are, at
most ``capacity`` numbers, so it is planned on the driver whatever the number of documents:

1. Linear grouping: pieces longer than ``capacity // SMALL_PART`` are sorted by length, cut into ``GROUPS`` groups of
   equal cardinality and rounded up to the longest of their group.
2. The cheapest mix of configurations (how many of each rounded length share a sequence) is a linear program with one
   row per group, solved by column generation; whole multiples of each configuration are used.
3. Actual pieces take the places of the rounded ones, which leaves room. Pieces that whole multiples leave over are
   grouped and placed again, ``ROUNDS`` times in all.
4. What is left over and the small pieces go, longest first, where they fit best, into that room or new sequences.

The plan is a list of runs: the pieces of one length with ranks a to b go, k to a sequence, into consecutive sequences
at one offset. Its size depends on the capacity and the number of groups alone. A piece's rank among those of its length
is its number within its task plus the counts of earlier tasks; then a join with the (bounded, broadcast) runs gives its
place. Texts are read once and never shuffled; a length that a third of all pieces share needs no sorting anywhere.

Defined cases: null and empty texts are a piece that holds the end id alone; repeated rows are packed once each; equal
lengths are told apart by task and position; an empty table gives no rows; other columns are not read, so their names
may clash with those of the result.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weekspan.llm.textbatch import batch_column, tidy
from weekspan.session import durable

CAPACITY = 1_024
END_ID = 2
GROUPS = 768
SMALL_PART = 4
ROUNDS = 3
TOKENIZER = "byte_bpe_50k"
SPECIAL = "<|endoftext|>"


@lru_cache(maxsize=2)
def _fast(name: str):
    """The vocabulary as ranks: same ids as the tokenizer file's, about four times as fast on texts without special tokens."""
    import public_tokenizers
    import tiktoken

    with open(public_tokenizers.path(f"{name}.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@lru_cache(maxsize=2)
def _full(name: str):
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path(f"{name}.json"))


def token_ids(text: str | None, name: str = TOKENIZER) -> np.ndarray:
    """Ids of a text, then the end id."""
    if not text:
        return np.array([END_ID], "<u4")
    ids = _full(name).encode(text, add_special_tokens=False).ids if SPECIAL in text else _fast(name).encode_ordinary(text)
    ids.append(END_ID)
    return np.array(ids, "<u4")


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids; only the first may be shorter than the capacity."""
    first = n % capacity or min(n, capacity)
    return [(0, first)] + [(s, capacity) for s in range(first, n, capacity)]


def pieces(df: DataFrame, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, name: str = TOKENIZER, with_ids: bool = False) -> DataFrame:
    """key, piece, start, length, ids_crc32, the task and the piece's number among those of its length there (, ids)."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here = TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        for batch in batches:
            rows: list[tuple] = []
            for i, body in enumerate(batch.column(1)):
                ids = token_ids(body.as_py(), name)
                for p, (start, length) in enumerate(cut(len(ids), capacity)):
                    content = ids[start : start + length]
                    rows.append((i, p, start, length, zlib.crc32(content.tobytes()), here, seen[length], *([content] if with_ids else [])))
                    seen[length] += 1
            if rows:
                at, *columns = zip(*rows, strict=True)
                kinds = [pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.int32())]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), *[pa.array(c, k) for c, k in zip(columns, kinds, strict=False)]], names)

    names = [key, "piece", "start", "length", "ids_crc32", "task", "number"] + ["ids"] * with_ids
    kind = df.schema[key].dataType.simpleString()
    spec = f"`{key}` {kind}, piece int, start long, length int, ids_crc32 long, task int, number long" + ", ids array<int>" * with_ids
    return df.select(F.col(key), F.col(text)).mapInArrow(tidy(encode), spec)


def _best_configuration(sizes: np.ndarray, worth: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The most valuable set of at most three items that fits; a fourth never does, as all are above a quarter."""
    order = np.argsort(sizes, kind="stable")
    by_size, value = sizes[order], worth[order]
    at = np.arange(len(value))
    best = np.maximum.accumulate(np.where(value > 0, value, 0))  # the best single item up to each size
    who = np.maximum.accumulate(np.where(value >= best, at, -1))

    def top(room: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        k = np.searchsorted(by_size, room, "right") - 1
        return np.where(k >= 0, best[np.maximum(k, 0)], 0.0), np.where(k >= 0, who[np.maximum(k, 0)], -1)

    one, _ = top(np.array([capacity]))
    pair, _ = top(capacity - by_size)
    few = max(1, int(np.searchsorted(by_size, capacity - 2 * by_size[0], "right")))  # larger ones are in no triple
    room = capacity - by_size[:few, None] - by_size[None, :few]
    third, _ = top(room)
    triple = np.where(room >= 0, value[:few, None] + value[None, :few] + third, -1.0)
    i, j = np.unravel_index(triple.argmax(), triple.shape)
    options = [(float(one[0]), [who[np.searchsorted(by_size, capacity, "right") - 1]]), (float((value + pair).max()), None), (float(triple[i, j]), None)]
    which = max(range(3), key=lambda o: options[o][0])
    if which == 0:
        chosen = options[0][1]
    elif which == 1:
        a = int((value + pair).argmax())
        chosen = [a, int(top(np.array([capacity - by_size[a]]))[1][0])]
    else:
        chosen = [int(i), int(j), int(top(np.array([room[i, j]]))[1][0])]
    counts = np.zeros(len(sizes))
    for x in chosen:
        if x >= 0 and value[x] > 0:
            counts[order[x]] += 1
    return options[which][0], counts


def configurations(sizes: np.ndarray, demand: np.ndarray, capacity: int, steps: int = 12_000) -> list[tuple[np.ndarray, int]]:
    """(items of each size, how often), whole multiples that do not exceed the demand; by column generation."""
    k = len(sizes)
    columns = np.diag((capacity // sizes).astype(float))
    inverse, change = np.diag(1 / np.diag(columns)), np.empty((k, k))
    for step in range(steps):
        worth = inverse.sum(0)
        best, column = _best_configuration(sizes, worth, capacity)
        if best <= 1 + 1e-7:
            break
        x, direction = inverse @ demand, inverse @ column
        ratio = np.where(direction > 1e-9, x / np.where(direction > 1e-9, direction, 1), np.inf)
        leaving = int(ratio.argmin())
        columns[:, leaving] = column
        if step % 100 == 99:
            inverse = np.linalg.inv(columns)
        else:
            row = inverse[leaving] / direction[leaving]
            np.multiply(direction[:, None], row, out=change)
            inverse -= change
            inverse[leaving] = row
    often = np.floor(np.maximum(np.linalg.solve(columns, demand.astype(float)), 0) + 1e-7)
    left = demand.astype(float).copy()
    out = []
    for i in np.argsort(-often, kind="stable"):
        items = columns[:, i]
        n = int(min(often[i], np.min(left[items > 0] // items[items > 0])))
        if n:
            left -= n * items
            out.append((items.astype(int), n))
    return out


class Bins:
    """Sequences that are filled alike: how many, [length, pieces a sequence] in order, the room left in each."""

    __slots__ = ("items", "n", "room", "configured")

    def __init__(self, n: int, items: tuple[tuple[int, int], ...], room: int, configured: int = 0):
        self.n, self.items, self.room = n, items, room
        self.configured = configured  # pieces a sequence that a configuration placed


class Plan:
    """Runs (length, first rank, pieces, first sequence, pieces a sequence, offset); sequences counts those used.

    ``configured`` is the number of large pieces in places that configurations gave them, ``large`` all large pieces.
    """

    def __init__(self, counts: dict[int, int], capacity: int = CAPACITY, groups: int = GROUPS):
        self.capacity = capacity
        self.left = {s: n for s, n in counts.items() if n}
        self.room: dict[int, list[Bins]] = {}
        full = self.left.pop(capacity, 0)
        if full:
            self._add(Bins(full, ((capacity, 1),), 0))
        self.large = sum(n for s, n in self.left.items() if s > capacity // SMALL_PART)
        for _ in range(ROUNDS):  # what one round's whole multiples leave over is grouped again
            if not self._large(groups):
                break
        self._fill()
        self.sequences = 0
        self.runs: list[tuple[int, int, int, int, int, int]] = []
        self.configured = sum(b.n * b.configured for bins in self.room.values() for b in bins)
        ranks = dict.fromkeys(counts, 0)
        for b in (b for room in sorted(self.room) for b in self.room[room]):
            at = 0
            for length, each in b.items:
                self.runs.append((length, ranks[length], b.n * each, self.sequences, each, at))
                ranks[length] += b.n * each
                at += length * each
            self.sequences += b.n

    def _add(self, bins: Bins) -> None:
        if bins.n:
            self.room.setdefault(bins.room, []).append(bins)

    def _fill(self) -> None:
        for length in sorted(self.left, reverse=True):
            self._best_fit(length, self.left.pop(length))

    def _large(self, groups: int) -> int:
        """Group the large pieces still left, place them by configurations; returns how many sequences were opened."""
        lengths = [s for s in sorted(self.left, reverse=True) if s > self.capacity // SMALL_PART]
        total = sum(self.left[s] for s in lengths)
        if not total:
            return 0
        each = -(-total // groups)
        members: list[list[list[int]]] = [[]]  # of each group: [length, pieces], longest first
        taken = 0
        for s in lengths:
            n = self.left[s]
            while n:
                part = min(n, each - taken)
                members[-1].append([s, part])
                taken, n = taken + part, n - part
                if taken == each:
                    members.append([])
                    taken = 0
        members = [g for g in members if g]
        merged: dict[int, list[list[int]]] = {}
        for g in members:
            merged.setdefault(g[0][0], []).extend(g)
        sizes = np.array(list(merged))
        queues = list(merged.values())
        demand = np.array([sum(n for _, n in q) for q in queues])
        return sum(self._substitute(items, often, queues) for items, often in configurations(sizes, demand, self.capacity))

    def _substitute(self, items: np.ndarray, often: int, queues: list[list[list[int]]]) -> int:
        """Fill ``often`` sequences of one configuration with actual pieces; equal neighbours form a run."""
        slots = []
        for g in np.flatnonzero(items):
            for _ in range(items[g]):
                slot, need = [], often
                while need:
                    s, n = queues[g][0]
                    part = min(n, need)
                    slot.append([s, part])
                    need -= part
                    queues[g][0][1] -= part
                    if not queues[g][0][1]:
                        queues[g].pop(0)
                slots.append(slot)
        done = 0
        while done < often:
            n = min(slot[0][1] for slot in slots)
            lengths = [slot[0][0] for slot in slots]
            self._add(Bins(n, tuple((s, lengths.count(s)) for s in sorted(set(lengths), reverse=True)), self.capacity - sum(lengths), len(lengths)))
            for s in lengths:
                self.left[s] -= n
                if not self.left[s]:
                    del self.left[s]
            for slot in slots:
                slot[0][1] -= n
                if not slot[0][1]:
                    slot.pop(0)
            done += n
        return often

    def _best_fit(self, length: int, n: int) -> None:
        while n:
            room = min((r for r in self.room if r >= length), default=None)
            if room is None:
                each = self.capacity // length
                self._add(Bins(-(-n // each), (), self.capacity))
                continue
            b = self.room[room].pop()
            if not self.room[room]:
                del self.room[room]
            each, bins = room // length, b.n
            whole = min(bins, n // each)
            if whole:
                self._add(Bins(whole, (*b.items, (length, each)), room - each * length, b.configured))
                n -= whole * each
                bins -= whole
            if bins and 0 < n < each:
                self._add(Bins(1, (*b.items, (length, n)), room - n * length, b.configured))
                bins, n = bins - 1, 0
            self._add(Bins(bins, b.items, room, b.configured))


def pack(df: DataFrame, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, groups: int = GROUPS, name: str = TOKENIZER, with_ids: bool = False) -> DataFrame:
    """One row per piece: key, piece, start, length, ids_crc32, sequence_id, offset (, ids)."""
    if capacity < 1:
        raise ValueError("capacity must be positive")
    spark = df.sparkSession
    rows = durable(pieces(df, key, text, capacity, name, with_ids))
    tallies = rows.groupBy("task", "length").agg(F.count(F.lit(1)).alias("n"))
    counts = {r.length: r.n for r in tallies.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most capacity rows
    runs = spark.createDataFrame(Plan(counts, capacity, groups).runs, "length int, first_rank long, n long, first_sequence long, each long, at long")
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    starts = tallies.select("task", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    ranked = rows.join(starts, ["task", "length"]).withColumn("rank", F.col("before") + F.col("number")).drop("before")
    within = F.col("rank") - F.col("first_rank")
    placed = ranked.join(F.broadcast(runs), "length").filter((within >= 0) & (within < F.col("n")))
    return placed.select(
        key, "piece", "start", F.col("length").cast("long").alias("length"), "ids_crc32",
        (F.col("first_sequence") + F.floor(within / F.col("each"))).alias("sequence_id"), (F.col("at") + within % F.col("each") * F.col("length")).alias("offset"), *["ids"] * with_ids,
    )
