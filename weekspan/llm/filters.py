"""How quality filters interact: what every filter removes in every order, from sorted posting lists.

Each document's failures are a bit mask of five text filters. Per part of the corpus (a source) and range of ids, every
filter keeps the sorted list of the ids that fail it. All lists of a part are walked together, one id range after another:
the range ends where the shortest stretch of ``STRIDE`` entries ends, and every list gallops to that end by doubling steps
and a bisection. Within a range the 32 unions of the lists are merged, the 80 differences "fails f, fails none of S" are
taken from them, and sizes are summed. Spark adds these up over the ranges; what a filter removes at a step of an order
follows from the set of filters before it, so all 120 orders need no further pass.

Only failing documents travel, one narrow row each; equal rows (part, id, mask) are collapsed first and counted. Rows
are dealt by ranges of (part, id), so a part that holds most rows spreads over many tasks. Equal texts are found by a
128-bit digest; a text that very many documents share is cut into slices for the join (``functions.skew``). The number of
distinct words is first taken from hashes and settled exactly where a collision could tip the balance.

Defined cases: a null text is empty, fails A and, if it is not the first of them, E; a null part is the empty string; a
null key is larger than no other, so it never fails E, and has no labels; rows that repeat a key count as documents of
their own, and equal texts with equal keys do not fail E; a key labelled both ways counts as marked; an empty table gives
no rows; other columns are not read, so their names may clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weekspan.functions.skew import attach
from weekspan.llm.common import once
from weekspan.llm.textbatch import NOT_SPACE, Texts, batch_column, buckets_for, member, runs, slices, tidy
from weekspan.session import durable

LETTERS = "ABCDE"
LEAST_WORDS = 200
UPPER = member("AZ")
SYMBOLS = member("#&", "*", "|")
#: Distinct words that share a hash within one document, at most, before the count is taken from the words themselves
COLLISIONS = 4
STRIDE = 1024
FAILS_A_TASK = 200_000


def _per_document(texts: Texts, flags: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=sums[1:])
    return np.diff(sums[texts.bounds])


def text_masks(texts: Texts) -> np.ndarray:
    """Bits 0 to 3 of each document: too few words, too repetitive, too many capitals, holds a symbol."""
    words = texts.words(NOT_SPACE)
    n = words.counts()
    distinct = np.bincount(once(words.hashes(), words.documents())[1], minlength=len(texts))
    for d in np.flatnonzero((2 * distinct < n) & (2 * (distinct + COLLISIONS) >= n)):
        at = range(words.first[d], words.first[d + 1])
        distinct[d] = len({texts.bytes_of(words.starts[i], words.ends[i]) for i in at})
    points = _per_document(texts, (texts.data & 0xC0) != 0x80)
    capitals = _per_document(texts, UPPER[texts.data])
    fails = [n < LEAST_WORDS, 100 * distinct < 50 * n, 100 * capitals > 2 * points, _per_document(texts, SYMBOLS[texts.data]) > 0]
    return sum(f.astype(np.int32) << i for i, f in enumerate(fails))


def fail_masks(df: DataFrame, key: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """(key, part, mask) of every document; bit 4 marks texts that a document with a smaller key also holds."""

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, texts in slices(batch_column(batch, "text")):
                digests = [hashlib.blake2b(texts.document(i), digest_size=16).digest() for i in range(b - a)]
                kept = [batch_column(batch, c).slice(a, b - a) for c in ("key", "part")]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(text_masks(texts), pa.int32()), pa.array(digests, pa.binary())], ["key", "part", "mask", "digest"])

    read = df.select(F.col(key).alias("key"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.col(text).alias("text"))
    seen = durable(read.mapInArrow(tidy(look), f"key {read.schema['key'].dataType.simpleString()}, part string, mask int, digest binary"))
    sizes = seen.groupBy("digest").agg(F.min("key").alias("first"), F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    known = attach(seen, sizes.select("digest", "first"), "digest", ["key", "part"], sizes=sizes.select("digest", "_n"))
    return known.select("key", "part", (F.col("mask") + F.when(F.col("key") > F.col("first"), 1 << 4).otherwise(0)).alias("mask"))


def gallop(values: np.ndarray, start: int, last: int) -> int:
    """The first place from ``start`` on whose value exceeds ``last``, by doubling steps and a bisection between them."""
    step, low = 1, start
    while low + step < len(values) and values[low + step] <= last:
        low += step
        step *= 2
    return low + int(np.searchsorted(values[low : low + step + 1], last, "right"))


def id_ranges(lists: list[np.ndarray], stride: int = STRIDE) -> Iterator[list[np.ndarray]]:
    """Stretches of all lists over one id range after another; none has more than ``stride`` entries."""
    at = [0] * len(lists)
    while any(a < len(x) for a, x in zip(at, lists, strict=True)):
        last = min(int(x[a + stride - 1]) if a + stride < len(x) else int(max(y[-1] for y in lists if len(y))) for a, x in zip(at, lists, strict=True) if a < len(x))
        ends = [gallop(x, a, last) if a < len(x) else a for a, x in zip(at, lists, strict=True)]
        yield [x[a:e] for a, e, x in zip(at, ends, lists, strict=True)]
        at = ends


def merged(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Union of two sorted lists without repetitions."""
    if not len(a) or not len(b):
        return a if len(a) else b
    return np.insert(a, np.searchsorted(a, new := without(b, a)), new)


def without(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The entries of the sorted list ``a`` that the sorted list ``b`` does not hold."""
    if not len(a) or not len(b):
        return a
    at = np.minimum(np.searchsorted(b, a), len(b) - 1)
    return a[b[at] != a]


def part_sums(masks: np.ndarray, copies: np.ndarray, marks: list[np.ndarray], filters: int) -> np.ndarray:
    """For every filter f and set S of others: documents that fail f and none of S, and how many of them bear each mark.

    The result has the shape (filters, 2**filters, 1 + marks); sets that hold f itself stay zero.
    """
    posting = [np.flatnonzero(masks >> f & 1) for f in range(filters)]
    out = np.zeros((filters, 1 << filters, 1 + len(marks)), np.int64)
    weights = np.stack([copies, *[np.where(m, copies, 0) for m in marks]], 1)
    for stretch in id_ranges(posting):
        unions = [np.zeros(0, np.int64)]
        for s in range(1, 1 << filters):
            top = s.bit_length() - 1
            unions.append(merged(unions[s - (1 << top)], stretch[top]))
        for f in range(filters):
            for s in range(1 << filters):
                if not s >> f & 1:
                    out[f, s] += weights[without(stretch[f], unions[s])].sum(0)
    return out


def audit(masks: DataFrame, marks: DataFrame, names: list[str], letters: str = LETTERS) -> DataFrame:
    """What every filter does at every step of every order, per part.

    ``masks`` has (key, part, mask), one row per document; ``marks`` has a key and the columns ``names``, true where a
    document bears that mark. Columns: part, filter_order, step, kept, removed, redundant, unique_fails, one
    ``<name>_lost`` per mark, and shapley, the filter's removals summed over all orders.
    """
    k = len(letters)
    key_type = masks.schema["key"].dataType.simpleString()
    totals = masks.groupBy("part").agg(F.count(F.lit(1)).alias("total"))
    fails = masks.filter("mask <> 0").groupBy("part", "key", "mask").agg(F.count(F.lit(1)).alias("copies"))
    known = marks.filter(F.col("key").isNotNull()).groupBy("key").agg(*[F.max(F.coalesce(F.col(n), F.lit(False))).alias(n) for n in names])
    flags = [F.coalesce(F.col(n), F.lit(False)).alias(n) for n in names]
    rows = durable(fails.join(known.select(F.col("key").cast(key_type).alias("key"), *names), "key", "left").select("part", "key", "mask", "copies", *flags))
    n = buckets_for(rows.count(), FAILS_A_TASK, 1)
    dealt = rows.repartitionByRange(n, "part", "key").sortWithinPartitions("part", "key", "mask").select("part", "mask", "copies", *names)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run in runs(batches, ["part"]):
            mask, copies, *bears = (run.column(c).to_numpy() for c in ("mask", "copies", *names))
            found = part_sums(mask, copies, [b.astype(bool) for b in bears], k)
            f, s = np.nonzero(found[:, :, 0])
            here = [pa.array([run.column("part")[0].as_py()] * len(f), pa.string()), pa.array(f.astype(np.int32)), pa.array(s.astype(np.int32))]
            yield pa.RecordBatch.from_arrays([*here, *[pa.array(found[f, s, i]) for i in range(1 + len(names))]], ["part", "f", "s", "removed", *names])

    spec = "part string, f int, s int, removed long" + "".join(f", {x} long" for x in names)
    cells = durable(dealt.mapInArrow(tidy(sums), spec).groupBy("part", "f", "s").agg(*[F.sum(c).alias(c) for c in ("removed", *names)]))
    share = F.element_at(F.lit([factorial(i) * factorial(k - 1 - i) for i in range(k)]), F.bit_count("s") + 1)
    others = F.lit((1 << k) - 1) - F.element_at(F.lit([1 << i for i in range(k)]), F.col("f") + 1)
    by_filter = cells.groupBy("part", "f").agg(
        F.sum(F.when(F.col("s") == 0, F.col("removed"))).alias("fails"),
        F.sum(F.when(F.col("s") == others, F.col("removed"))).alias("unique_fails"),
        F.sum(share * F.col("removed")).alias("shapley"),
    )

    orders = F.explode(F.lit(["".join(p) for p in permutations(letters)]))
    steps = totals.select("*", orders.alias("filter_order")).select("*", F.explode(F.sequence(F.lit(1), F.lit(k))).alias("step"))
    before = F.expr("substring(filter_order, 1, step - 1)")
    earlier = sum((F.when(F.contains(before, F.lit(c)), 1 << i).otherwise(0) for i, c in enumerate(letters)), F.lit(0))
    placed = steps.select("*", F.expr(f"locate(substring(filter_order, step, 1), '{letters}') - 1").alias("f"), earlier.alias("s"))
    found = placed.join(cells, ["part", "f", "s"], "left").join(by_filter, ["part", "f"], "left")
    count = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    so_far = F.sum(count("removed")).over(Window.partitionBy("part", "filter_order").orderBy("step"))
    return found.select(
        "part", "filter_order", F.col("step").cast("int").alias("step"), (F.col("total") - so_far).alias("kept"), count("removed").alias("removed"),
        (count("fails") - count("removed")).alias("redundant"), count("unique_fails").alias("unique_fails"),
        *[count(n).alias(f"{n}_lost") for n in names], count("shapley").alias("shapley"),
    )
