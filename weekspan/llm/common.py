"""Values (words, windows) that stand in very many documents, told apart so that no bucket has to hold them.

A value is common from ``COMMON`` documents on, or one in ``ONE_IN`` of all where that is more. A common value is expected
``HITS`` times in the documents drawn; those met half as often are candidates. Drawing decides only which values are kept
out of the buckets: their totals are computed exactly by the caller over all documents. A table of n documents with v values
each has at most n v / (n / ONE_IN / 2) = 2 v ``ONE_IN`` candidates, a bound that does not grow with the table; a value that
is not common has few enough documents for a bucket.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weekspan.llm.textbatch import Texts, batch_column, slices, tidy

COMMON = 20_000
ONE_IN = 20_000
HITS = 200


def once(values: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every value once per document, sorted by value."""
    order = np.lexsort((owner, values))
    values, owner = values[order], owner[order]
    kept = np.append(True, (values[1:] != values[:-1]) | (owner[1:] != owner[:-1]))[: len(values)]
    return values[kept], owner[kept]


def places(known: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each value stands in the sorted ``known``, and whether it does."""
    if not len(known):
        return np.zeros(len(values), np.int64), np.zeros(len(values), bool)
    at = np.minimum(np.searchsorted(known, values), len(known) - 1)
    return at, known[at] == values


def candidates(df: DataFrame, text: str, row: str, rows: int, values_of: Callable[[Texts], tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Sorted values of very many of the ``rows`` documents; ``values_of`` gives (values, document), ``row`` names a row."""
    if rows < COMMON:
        return np.zeros(0, np.uint64)
    limit = max(COMMON, rows // ONE_IN)
    share = min(1.0, HITS / limit)

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, texts in slices(batch_column(batch, "text"), rows=30_000):
                found, n = np.unique(once(*values_of(texts))[0], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(n.astype(np.int64))], ["value", "n"])

    drawn = df.filter(F.pmod(F.xxhash64(F.lit("common"), row), F.lit(1 << 40)) < int(share * (1 << 40))).select(F.col(text).alias("text"))
    counts = drawn.mapInArrow(tidy(tally), "value long, n long").groupBy("value").agg(F.sum("n").alias("n"))
    table = counts.filter(F.col("n") >= share * limit / 2).select("value").toArrow()
    return np.sort(table.column("value").to_numpy().view(np.uint64))
